from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from keepstone.llm import op2_language as L
from keepstone.llm import queries
from tests.conftest import DATA


def test_gradients_against_differences():
    model = L.ByteGru.init(["a", "b", "c"], 4, 0)
    for name in ("w", "u", "b", "c", "v", "d"):
        setattr(model, name, getattr(model, name).astype(np.float64))
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 6, (7, 5)).astype(np.uint8), rng.integers(0, 3, 5)
    _, grads = model.gradients(x, y)
    for p, g in zip(model.parameters(), grads, strict=True):
        i = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, step = p[i], 1e-3
        p[i] = old + step
        up = model.gradients(x, y)[0]
        p[i] = old - step
        down = model.gradients(x, y)[0]
        p[i] = old
        assert abs(g[i] - (up - down) / (2 * step)) < 1e-4


def test_every_position_counts():
    model = L.ByteGru.init(["a", "b"], 4, 0)
    text = bytes(range(97, 120)) * 30
    p = L.document_probabilities(model, [text, b"", text[:5]])
    windows = [text[i : i + L.WINDOW] for i in range(0, len(text), L.WINDOW)]
    parts = []
    for w in windows:
        x = np.frombuffer(w.ljust(L.WINDOW), np.uint8)[:, None]
        parts.append(model.probabilities(x)[: len(w), 0])
    assert np.allclose(p[0], np.concatenate(parts).mean(axis=0), atol=1e-5)
    assert p[1].sum() == 0 and abs(p[2].sum() - 1) < 1e-5


def test_held_out_accuracy(spark):
    found = queries.queries()["op2_byte_gru_language"](spark, f"{DATA}/sf0.01")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "lang")
    share = found.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share > 0.98
    assert found.count() == docs.count() and found.where("score < 0 or score > 1").count() == 0


def test_edges(spark):
    rows = [(1, "the cat and the dog", "en", "x"), (2, "le chat et la souris", "fr", "y"), (3, None, "en", None), (None, "123 !?", None, "z"), (5, "", None, "z"), (5, "the " * 60_000, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = L.fit(docs, F.col("doc_id") < 4, steps=3)
    assert model.languages == ["en", "fr"]
    out = L.predict(docs.drop("score"), model, ["doc_id"]).collect()
    assert len(out) == 6 and [r["lang_pred"] for r in out if r["score"] == 0] == ["und"] * 3
    nothing = L.fit(docs.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in L.predict(docs.drop("score"), nothing, ["doc_id"]).collect()} == {"und"}
    assert L.predict(docs.limit(0).drop("score"), model, ["doc_id"]).count() == 0


def test_sample_takes_the_most_frequent_languages(spark):
    rows = [(f"text {k} {i}", f"l{k:03d}") for k in range(40) for i in range(1 + k % 7)] + [(f"zz {i}", "zz") for i in range(9)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    found = L.sample_rows(df, F.col("text"), F.col("lang"), 2, 100, 4).collect()
    assert sorted(r["lang"] for r in found) == ["l006"] * 2 + ["l013"] * 2 + ["l020"] * 2 + ["zz"] * 2


def test_probabilities_against_plain_loops():
    model = L.train([b"abc abd abe " * 40, b"xyz xyw xyv " * 40], ["a", "x"], steps=5, hidden=6)
    sigmoid = lambda x: 1 / (1 + np.exp(-x))

    def states(data, d):
        h, out = np.zeros(model.hidden), []
        for byte in data:
            w, u, n = model.w[d][byte].astype(float) + model.b[d][0], h @ model.u[d].astype(float), model.hidden
            z, r = sigmoid(w[:n] + u[:n]), sigmoid(w[n : 2 * n] + u[n : 2 * n])
            new = np.tanh(w[2 * n :] + r * (u[2 * n :] + model.c[d][0]))
            h = (1 - z) * new + z * h
            out.append(h)
        return out

    for text in (b"ab xy", b"abd xyw " * 30):
        total = np.zeros(2)
        for at in range(0, len(text), L.WINDOW):
            part = text[at : at + L.WINDOW].ljust(L.WINDOW)
            forth, back = states(part, 0), states(part[::-1], 1)[::-1]
            for i in range(min(L.WINDOW, len(text) - at)):
                logits = forth[i] @ model.v[0] + back[i] @ model.v[1] + model.d
                p = np.exp(logits - logits.max())
                total += p / p.sum()
        assert np.allclose(L.document_probabilities(model, [text])[0], total / len(text), atol=1e-4)


def test_the_sample_counts_texts_and_not_rows(spark):
    """Languages that are mostly copies keep min(400, distinct) texts."""
    one = F.concat(F.lit("text of the large language "), (F.col("id") % F.col("kinds")).cast("string"))
    for rows, kinds in ((40_000, 6), (200_000, 201), (6_000, 6), (20_000, 20_000)):
        large = spark.range(rows).withColumn("kinds", F.lit(kinds)).select(F.lit("bb").alias("lang"), one.alias("text"))
        small = spark.range(2_000).select(F.lit("aa").alias("lang"), F.concat(F.lit("another tongue "), F.col("id").cast("string")).alias("text"))
        found = L.sample_rows(large.unionByName(small), F.col("text"), F.col("lang"), 400, 1500, 64).groupBy("lang").count().collect()
        assert {r["lang"]: r["count"] for r in found} == {"aa": 400, "bb": min(400, kinds)}
