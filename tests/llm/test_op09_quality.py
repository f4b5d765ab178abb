from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from keepstone.llm import op9_quality as Q
from keepstone.llm import queries
from tests.conftest import DATA


def _bags():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (0, 5, 600, 3000, 511)]
    return Q.passages(texts)


def test_passages_cover_whole_texts():
    x, counts = _bags()
    assert counts.tolist() == [1, 1, 2, 6, 1] and x.shape == (11, Q.FEATURES) and np.isfinite(x).all()
    again, _ = Q.passages([b"ab" * 256])
    assert (Q.passages([b"zz", b"ab" * 256])[0][1] == again[0]).all()


def test_gradients_against_differences():
    x, counts = _bags()
    y = np.asarray([0, 1, 1, 0, 1.0])
    model = Q.AttentionModel.init(x, 5, 4, 0.7, 0)
    model.c *= 10
    _, grads = model.gradients(x, counts, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[i], 1e-5
        p[i] = old + step
        up = model.gradients(x, counts, y)[0]
        p[i] = old - step
        down = model.gradients(x, counts, y)[0]
        p[i] = old
        assert abs(g[i] - (up - down) / (2 * step)) < 1e-5


def test_attention_weights_sum_to_one_for_each_document():
    x, counts = _bags()
    model = Q.AttentionModel.init(x, 5, 4, 0.7, 0)
    weight, starts = model.forward(x, counts)[4], model.forward(x, counts)[6]
    assert np.allclose(np.add.reduceat(weight, starts), 1)


def test_held_out_accuracy(spark):
    found = queries.queries()["op9_attention_quality"](spark, f"{DATA}/sf0.1")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    rows = found.where("held_out").join(labels, "doc_id").select("predicted", "quality", "score").collect()
    good, bad = [r["predicted"] for r in rows if r["quality"] == 1], [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) for r in rows)


def test_edges(spark):
    rows = [(1, "fine prose here. " * 9, "a"), (2, "$$$ ### " * 9, "b"), (None, None, None), (4, "", "c"), (4, "long text " * 30_000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None), (77, 1)], "doc_id long, quality int")
    model = Q.fit(docs, labels, F.lit(True), epochs=2)
    out = Q.score(docs.drop("score"), model, ["doc_id"]).collect()
    assert len(out) == 5 and all(0 <= r["score"] <= 1 for r in out)
    for few in (labels.limit(0), labels.where("quality = 1")):
        prior = Q.fit(docs, few, F.lit(True))
        assert len({round(r["score"], 9) for r in Q.score(docs.drop("score"), prior, ["doc_id"]).collect()}) == 1
    assert Q.score(docs.limit(0).drop("score"), model, ["doc_id"]).count() == 0


def test_score_against_plain_loops(spark):
    rows = [(i, ("plain prose of a kind. " if i % 2 else "$$ # 12 @@ ") * (5 + 40 * (i % 3))) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    m = Q.fit(docs, labels, F.lit(True), epochs=3)
    for r in Q.score(docs, m, ["doc_id", "text"]).collect():
        data = r["text"].encode()
        h = []
        for at in range(0, len(data), Q.PASSAGE):
            text = data[at : at + Q.PASSAGE + 1]  # a passage's last pair reaches into the next one
            x = np.zeros(Q.FEATURES)
            pairs = np.zeros(Q.BUCKETS)
            size = min(Q.PASSAGE, len(data) - at)
            for i in range(size):
                pairs[Q._BUCKET[text[i] * 256 + (text[i + 1] if i + 1 < len(text) else 10)]] += 1
                x[Q.BUCKETS + Q._KIND[text[i]]] += 1 / size
            x[: Q.BUCKETS] = np.sqrt(pairs / size)
            again = sum(c * (c - 1) for c in pairs) / max(size * (size - 1), 1)
            x[-3:] = np.log(again + 1e-4), np.count_nonzero(pairs) / np.sqrt(size), np.log(size)
            h.append(np.tanh(((x - m.mean) / m.scale) @ m.w + m.b))
        e = np.asarray([m.a @ (np.tanh(v @ m.v) / (1 + np.exp(-(v @ m.u)))) for v in h])
        weight = np.exp(e - e.max())
        z = sum(w * v for w, v in zip(weight / weight.sum(), h, strict=True))
        assert abs(r["score"] - 1 / (1 + np.exp(-(z @ m.c + m.d[0])))) < 1e-4


def test_the_driver_gets_a_bounded_sample(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q, "train", lambda x, counts, y, **_: seen.append((len(x), len(y))))
    Q.fit(docs, labels, F.lit(True), most_rows=20)
    assert seen == [(20, 20)]
