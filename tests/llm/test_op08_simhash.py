from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from keepstone.llm import op8_simhash as H
from keepstone.llm import queries
from keepstone.llm.common import Scratch
from keepstone.llm.components import components
from tests.conftest import DATA


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: id to fingerprint."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprints(spark, monkeypatch):
    texts = ["", " ", "a", "A b", "a b c", "a b C d e", "x " * 500, "É é\t É"] + [r["text"] for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").limit(60).collect()]
    for chunk in (7, 1 << 16):
        monkeypatch.setattr(H, "CHUNK", chunk)
        assert [H.fingerprint(t.encode()) for t in texts] == [brute_print(t) for t in texts]
    assert H.fingerprint(None) == 0


def test_coordinates_never_discard_a_link():
    rng = np.random.default_rng(0)
    fps = rng.integers(0, 1 << 64, 400, np.uint64)
    near = fps ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    both = np.concatenate([fps, near])
    left, right = (x.ravel() for x in np.meshgrid(np.arange(800), np.arange(800)))
    table = np.stack([np.bitwise_count(both ^ r) for r in H.references()]).astype(np.int8)
    hits = H.close_pairs(left, right, both, table)
    assert set(hits.tolist()) == set(np.flatnonzero(np.bitwise_count(both[left] ^ both[right]) <= 3).tolist())


def test_packed_coordinates(spark):
    fps = np.random.default_rng(3).integers(0, 1 << 64, 50, np.uint64)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    rows = df.select("fp", *H.coordinates(df["fp"])).collect()
    found = H.unpacked([np.asarray([r[i] for r in rows], np.int64) for i in (1, 2, 3)])
    mine = np.asarray([r[0] for r in rows], np.int64).view(np.uint64)
    assert (found == np.stack([np.bitwise_count(mine ^ r) for r in H.references()])).all()


@pytest.mark.parametrize("block", [2, 1024])
def test_links_against_all_pairs(spark, block):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(5)] + [0]
    fps = sorted({rng.choice(base) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(5))) for _ in range(150)})
    df = spark.createDataFrame([(i, H._signed(x)) for i, x in enumerate(fps)], "id long, fp long")
    found = {tuple(sorted(r)) for r in H.links(spark, df, block=block).collect()}
    assert found == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(50)] + [(200 - i, 199 - i) for i in range(20)] + [(500, 501)]
    found = dict(components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect())
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(180, 201), 180), 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    prints = {i: brute_print(t) for i, t in rows}
    comps = brute_components(prints)
    out = queries.queries()["op8_simhash_pivots"](spark, f"{DATA}/sf0.001").collect()
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out) == sorted((i, f"{prints[i]:016x}", comps[i]) for i in prints)


def test_edges(spark):
    rows = [(3, None), (2, ""), (7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (None, "only here"), (9, "zzz " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as fp", "2 as component_id")
    out = sorted(((r["doc_id"], r["component_id"]) for r in H.near_duplicates(spark, df).collect()), key=str)
    assert out == sorted([(3, 2), (2, 2), (7, 7), (7, 7), (None, 7), (None, None), (9, 9)], key=str)
    assert H.near_duplicates(spark, df.limit(0)).count() == 0
