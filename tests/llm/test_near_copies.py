from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline as cp
from keepstone.llm import near_copies as N
from keepstone.llm.common import Scratch
from tests.conftest import DATA


def brute(rows):
    """id to the least id that pairs of 5-word Jaccard 0.8 or more reach."""
    sets = {}
    for i, text in rows:
        w = text.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    ids, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            s, t = len(sets[a]), len(sets[b])
            if 5 * min(s, t) >= 4 * max(s, t) and 9 * len(sets[a] & sets[b]) >= 4 * (s + t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_stage_drops_near_copies(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").where("text is not null and trim(text) != ''").dropDuplicates(["doc_id"])
    kept = [r["doc_id"] for r in cp.near_duplicates(spark, docs, "").select("doc_id").collect()]
    comps = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(kept) == sorted(set(comps.values()))


@pytest.mark.parametrize(("block", "sample"), [(7, 1), (1024, 16)])
def test_components_of_large_groups(spark, block, sample):
    rng = random.Random(3)
    rows, i = [], 0
    for _ in range(4):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice((60, 150)))]
        for _ in range(60):
            text = list(base)
            for _ in range(rng.randrange(5)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(500)}"
            rows.append(((i := i + 1), " ".join(text)))
    rng.shuffle(rows)
    rows += [(900, "a b"), (901, "A  b"), (902, "a b c")]
    df = spark.createDataFrame([*rows, (950, ""), (951, None), (None, rows[0][1])], "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in N.groups(spark, df, Scratch(spark, "test"), block=block, sample=sample).collect()}
    comps = brute(rows)
    assert found == comps | {950: 950, 951: 950, None: comps[rows[0][0]]}
    assert N.groups(spark, df.limit(0), Scratch(spark, "test")).count() == 0


def test_prefixes_of_pairs_meet():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        a = np.unique(rng.integers(0, 1 << 20, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 20, max(1, n // 12)).astype(np.uint64)]))
        if 9 * len(np.intersect1d(a, b)) < 4 * (len(a) + len(b)):
            continue
        every = np.concatenate([a, b])
        told = rng.choice(every, min(len(every), 9), replace=False)
        told = np.unique(told)
        f = N.Frequent(told, rng.integers(2, 9, len(told)))
        counted = [f.counted(x) for x in (a, b)]
        several = np.intersect1d(*counted)
        p, q = f.prefix(a, several), f.prefix(b, several)
        assert len(np.intersect1d(p, q))


def test_rows_that_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    near = text.replace("w9 ", "x ")  # 5 of 36 shingles differ: below the similarity
    close = text + " w40"
    rows = [(1, text, "a"), (1, other, "b"), (2, close, "c"), (3, near, "d"), (None, text, "e"), (None, "alone here", "f"), (4, other, "g"), (5, None, "h"), (6, " ", "i"), (7, "one", "j"), (7, "one", "k"), (8, "A b c d e f", "l"), (9, "a B c d e f", "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").selectExpr("*", "'x' as node", "1 as h", "2 as component_id", "map(1, 2) as _map")
    out = [tuple(r)[:3] for r in N.drop_near_copies(spark, docs).collect()]
    assert N.drop_near_copies(spark, docs).columns == docs.columns
    texts = sorted((str(i), t) for i, t, _ in out)
    want = [(1, text), (1, other), (3, near), (None, "alone here"), (5, None), (7, "one"), (8, "A b c d e f")]
    assert texts == sorted((str(i), t) for i, t in want)
