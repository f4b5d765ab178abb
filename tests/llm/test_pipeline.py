from __future__ import annotations

import random
import re

import corpus_pipeline as cp
from tests.conftest import DATA
from tests.llm.test_near_copies import brute


def _stages(spark, sf):
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, f"{DATA}/{sf}").cache()
        yield name, before, docs


def test_stages_against_brute_force(spark):
    for name, before, after in _stages(spark, "sf0.001"):
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
        assert set(new) <= set(old) and len(new) == after.count()
        if name != "repeated_passages":
            assert all(new[i] == old[i] for i in new)
        if name == "near_duplicates":
            comps = brute([(i, r["text"]) for i, r in old.items()])
            assert set(new) == set(comps.values())
        if name == "repeated_passages":
            first = {}
            for i in sorted(old):
                w = old[i]["text"].split()
                for a in range(len(w) - 49):
                    first.setdefault(tuple(w[a : a + 50]), i)
            for i, r in old.items():
                w = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
                gone = [False] * len(w)
                for a in range(len(w) - 49):
                    if first[tuple(w[a : a + 50])] < i:
                        gone[a : a + 50] = [True] * 50
                kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
                if not any(gone):
                    assert new[i] == r
                elif kept:
                    assert (new[i]["text"], new[i]["n_chars"]) == (kept, len(kept))
                else:
                    assert i not in new


def test_filters_keep_clean_documents(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert cp.language(spark, docs, "").count() > 0.98 * docs.count()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/sf0.01/labels.parquet").collect()}
    kept = {r["doc_id"] for r in cp.quality(spark, docs, f"{DATA}/sf0.01").select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) > 0.97 * len(good)


def test_edges(spark):
    rng = random.Random(0)
    prose = " ".join(f"w{rng.randrange(90)}" for _ in range(120))
    rows = [(1, prose, "en", "a", len(prose)), (2, prose, "en", "a", len(prose)), (None, None, None, None, None), (3, "", None, None, 0), (4, "12 !", "en", None, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in cp.language(spark, docs, "").collect()] == [1, 2]
    assert sorted(str(r["doc_id"]) for r in cp.near_duplicates(spark, docs, "").collect()) == ["1", "3", "4"]
    assert sorted(str(r["doc_id"]) for r in cp.repeated_passages(spark, docs, "").collect()) == ["1", "3", "4", "None"]
    for stage in (cp.near_duplicates, cp.repeated_passages, cp.packing):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_columns_of_any_name(spark):
    rng = random.Random(4)
    prose = lambda k, n: " ".join(f"{k}{rng.randrange(90)}" for _ in range(n))
    rows = [(i, prose("ab"[i % 2], 150), ["en", "de"][i % 2], "a", 1) for i in range(24)] + [(1, prose("a", 60), "de", "b", 2), (30, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = ("score", "predicted", "lang_pred", "h", "r", "tag", "spans", "key", "node", "k", "id", "label", "ids", "length")
    wide = docs.selectExpr("*", *[f"doc_id as {n}" for n in names])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, f"{DATA}/sf0.001")
        assert out.columns == wide.columns, name
        assert all(r["score"] == r["doc_id"] == r["length"] for r in out.collect())
    assert cp.near_duplicates(spark, docs, "").count() == 26  # two texts of one id both stay
    assert cp.packing(spark, wide, "").groupBy("doc_id", "doc_tokens").sum("length").count() == 26


def test_language_without_labels(spark):
    docs = spark.createDataFrame([(1, "some words", None), (2, "12", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in cp.language(spark, docs, "").collect()] == [1]


def test_whole_run(spark):
    out = cp.run(spark, f"{DATA}/sf0.001")
    assert out.count() > 100 and out.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
