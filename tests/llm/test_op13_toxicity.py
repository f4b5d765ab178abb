from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from keepstone.llm import op13_toxicity as X
from keepstone.llm import queries
from tests.conftest import DATA


def test_held_out_accuracy(spark):
    got = queries.queries()["op13_weak_toxicity"](spark, f"{DATA}/sf0.1")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("predicted", "toxic", "score").collect()
    bad, clean = [r["predicted"] for r in rows if r["toxic"] == 1], [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(bad) > 0.9 and np.mean(clean) < 0.005
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in rows)


def test_reading_against_plain_loops(monkeypatch):
    text = "You are an IDIOT!! Trashy trash, trash?! ñandú Ñandú " * 40 + "x" * 30
    stems = ["tra", "trash$", "ñan", "idiot$", "xxxxxxxx"]
    words = re.findall(r"[^\W\d_]+", text.lower())
    for size in (30, 1 << 18):
        monkeypatch.setattr(X, "SEGMENT", size)
        r = X.Reader(stems).read(text.encode())
        assert r.words == len(words)
        for k, s in enumerate(stems):
            assert r.stems[k] == sum(w == s[:-1] if s.endswith("$") else w.startswith(s) for w in words)
        insults = sum(w in X.INSULTS for w in words) / len(words)
        assert abs(r.patterns[0] - insults) < 1e-12 and abs(r.patterns[3] - len(re.findall("[A-Z]", text)) / sum(map(len, words))) < 1e-12
        level = X.mined(text.encode())
        count = Counter(s for w in words for s in X.stems_of(w))
        assert level == {s: max(k for k, d in enumerate(X.DENSITIES) if n >= d * len(words)) for s, n in count.items()}


def test_posterior_is_that_of_the_joint_distribution():
    rng = np.random.default_rng(0)
    m = X.LabelModel(0.3, np.asarray([-1, 0, 1, 0]), rng.uniform(0.1, 0.9, (4, 2, 2)))
    votes = np.asarray(list(itertools.product((0, 1), repeat=4)))
    joint = np.zeros((2, len(votes)))
    for y, prior in ((0, 0.7), (1, 0.3)):
        for j, v in enumerate(votes):
            p = prior
            for i, parent in enumerate(m.parent):
                one = m.table[i, y, v[parent] if parent >= 0 else 0]
                p *= one if v[i] else 1 - one
            joint[y, j] = p
    assert abs(joint.sum() - 1) < 1e-9
    assert np.allclose(m.posterior(votes, np.full(len(votes), -1)), joint[1] / joint.sum(axis=0))


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(1)
    y = rng.random(6000) < 0.3
    vote = lambda a, b: np.where(y, rng.random(6000) < a, rng.random(6000) < b)
    base = vote(0.8, 0.1)
    votes = np.stack([base, np.where(rng.random(6000) < 0.9, base, vote(0.5, 0.5)), vote(0.7, 0.05), vote(0.5, 0.5), vote(0.9, 0.2)], axis=1).astype(np.int8)
    labels = np.where(rng.random(6000) < 0.05, ~y, y).astype(int)
    m = X.fit_label_model(votes, labels, np.ones(6000))
    assert (m.parent[1] == 0) or (m.parent[0] == 1)  # the copied voter hangs at the one that it copies
    q = m.posterior(votes, np.full(6000, -1))
    naive = np.log(0.3 / 0.7) + sum(np.where(votes[:, i] == 1, np.log(votes[y, i].mean() / votes[~y, i].mean()), np.log((1 - votes[y, i].mean()) / (1 - votes[~y, i].mean()))) for i in range(5))
    loss = lambda p: -np.mean(np.log(np.where(y, p, 1 - p).clip(1e-9)))
    assert loss(q) < loss(1 / (1 + np.exp(-naive))) and 0.85 < m.annotator[1] < 1 and 0 < m.annotator[0] < 0.15


def test_stems_stand_for_their_family():
    rows = [("trash", 0, 50.0), ("tra", 0, 40.0), ("trashy$", 0, 30.0), ("tra", 1, 45.0), ("scum$", 0, 44.0), ("scu", 0, 44.0)]
    assert X.pick_stems(rows, 9) == [("trash", 0), ("tra", 1), ("scu", 0)]
    assert X.pick_stems(rows, 1) == [("trash", 0)]


def test_edges(spark):
    toxic, clean = "vile slurry slurred words here ", "a calm and plain text of words "
    rows = [(i, (toxic if i % 3 == 0 else clean) * (1 + i % 4), None, 0.5) for i in range(90)]
    rows += [(None, toxic, "x", 0.1), (90, None, "x", 0.1), (91, "", "x", 0.1), (92, toxic + clean * 200_000, "x", 0.1), (0, toxic, "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)] + [(None, 1), (90, 0), (91, None), (500, 1)], "doc_id long, toxic int")
    model = X.fit(docs, labels, F.lit(True))
    got = X.score(docs.drop("score"), model, ["doc_id", "text"]).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == int(toxic in r["text"]) for r in got if r["text"] and len(r["text"]) < 1000)
    assert {r["predicted"] for r in got if not r["text"]} == {0}
    for few, value in ((labels.limit(0), 0.0), (labels.where("toxic = 0"), 0.0), (labels.where("toxic = 1"), 0.98)):
        prior = X.fit(docs, few, F.lit(True))
        assert {round(r["score"], 6) for r in X.score(docs.drop("score"), prior, ["doc_id"]).collect()} == {value}
    assert X.score(docs.limit(0).drop("score"), model, ["doc_id"]).count() == 0
    assert X.fit(docs.limit(0), labels, F.lit(True)).stems == []


def test_the_sample_is_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(i % 40, f"text number {i}") for i in range(600)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(X, "train", lambda stems, voters, readings, said, weight, ridge: seen.append(len(readings)))
    X.fit(docs, labels, F.lit(True), most_rows=10)
    assert 10 <= seen[0] <= 30
