from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from keepstone.llm import op7_substring as D
from keepstone.llm import queries
from keepstone.llm.fm_index import FmIndex
from tests.conftest import DATA, oracle


def brute(rows, window=50):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    first = {}
    for i, w in split:
        for a in range(len(w) - window + 1) if i is not None else ():
            k = tuple(w[a : a + window])
            first[k] = min(first.get(k, i), i)
    out = []
    for i, w in split:
        gone = [False] * len(w)
        for a in range(len(w) - window + 1) if i is not None else ():
            if first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(map(repr, out))


def test_index_against_plain_search():
    rng = np.random.default_rng(0)
    for _ in range(40):
        letters, depth = int(rng.integers(1, 5)), int(rng.integers(1, 9))
        texts = [rng.integers(1 << 60, (1 << 60) + letters, rng.integers(0, 30)).astype(np.uint64) for _ in range(rng.integers(1, 8))]
        if not sum(map(len, texts)):
            continue
        owner = rng.integers(0, 100, len(texts))
        runs: dict[tuple, int] = {}
        for t, o in zip(texts, owner.tolist(), strict=True):
            for i in range(len(t)):
                for j in range(i + 1, min(len(t), i + depth) + 1):
                    runs[tuple(t[i:j])] = min(runs.get(tuple(t[i:j]), o), o)
        streams = [rng.integers(1 << 60, (1 << 60) + letters + 1, rng.integers(0, 40)).astype(np.uint64) for _ in range(5)] + texts
        length, least, at = FmIndex(texts, owner, depth).stream(streams)
        for s, a in zip(streams, at, strict=True):
            for e in range(1, len(s) + 1):
                n = 0
                while n < min(depth, e) and tuple(s[e - n - 1 : e]) in runs:
                    n += 1
                assert length[a + e - 1] == n
                assert least[a + e - 1] == (runs[tuple(s[e - depth : e])] if n == depth else -1)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(0)
    words = [f"w{rng.randrange(40)}".encode() for _ in range(600)]
    a, b = words[:400], words[100:500]
    seen = {}
    for w in (a, b):
        h, first, count = D.anchors(D.word_hashes(b" ".join(w)))
        assert first[0] == 0 and count.sum() == len(w) - D.WINDOW + 1
        for k, x in enumerate(np.repeat(h, count).tolist()):
            assert seen.setdefault(tuple(w[k : k + D.WINDOW]), x) == x
    assert len(D.word_hashes(b" \t\n ")) == 0 and len(D.anchors(D.word_hashes(b"a b"))[0]) == 0


@pytest.mark.parametrize("contents", [1, 1024])
def test_small_corpus_with_edges(spark, monkeypatch, contents):
    monkeypatch.setattr(D, "ANCHOR_CONTENTS", contents)  # 1: all anchors with several contents go by window hashes
    rng = random.Random(5)
    text = lambda n: " ".join(f"w{rng.randrange(300)}" for _ in range(n))
    shared, other = text(90), text(55)
    rows = [(i, f"{text(rng.randrange(60))} {shared if i % 2 else other}\n{text(rng.randrange(40))}") for i in range(24)]
    rows += [(30, shared), (31, shared), (31, shared), (31, other), (None, shared), (32, None), (33, ""), (34, "  \t "), (35, "ha " * 300), (36, "ha " * 200), (37, " ".join(shared.split()[:49])), (-5, shared)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as h", "2 as tag", "3 as spans")
    assert sorted(repr(tuple(r)) for r in D.remove_repeats(spark, df).collect()) == brute(rows)


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()]
    out = queries.queries()["op7_fm_index_substrings"](spark, f"{DATA}/sf0.01")
    found = sorted(repr(tuple(r)) for r in out.collect())
    assert found == brute(rows)
    sql = oracle("sf0.01").sql(queries.oracle_sql()["op7_fm_index_substrings"])
    assert sql.columns == out.columns and sorted(map(repr, sql.fetchall())) == found
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert D.remove_repeats(spark, empty).count() == 0
