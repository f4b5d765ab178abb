from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from keepstone.llm import op10_packing as K
from keepstone.llm import queries, tokens
from tests.conftest import DATA


@pytest.mark.parametrize("least", [1, 16, 64])
def test_bins_hold_a_fixed_count_and_little_padding(least):
    rng = random.Random(0)
    lengths = [rng.choice([0, 1, 2, 63, 64, 65, 700, 2047, 2048, 2049, 5000, rng.randrange(1, 6000)]) for _ in range(500)]
    packer, bins = K.HarmonicPacker(2048, least), []
    for i, n in enumerate(lengths):
        for start, length in K.cut(n, 2048, least):
            bins += packer.put(i, start, length)
    assert all(len(held) == k and all(2048 // (k + 1) < n <= 2048 // k for _, _, n in held) for k, held in bins)
    bins += packer.finish()
    seen = {}
    for _, held in bins:
        assert sum(n for _, _, n in held) <= 2048
        for i, start, n in held:
            seen.setdefault(i, []).append((start, n))
    for i, n in enumerate(lengths):
        at = 0
        for start, size in sorted(seen.get(i, [])):
            assert start == at and size > 0
            at += size
        assert at == n
    total = np.asarray([sum(n for _, _, n in held) for _, held in bins])
    assert K.padding(total) / total.sum() < 0.01


def test_bad_sizes():
    with pytest.raises(ValueError):
        K.HarmonicPacker(2000, 64)


def _check(rows, out):
    t = tokens.WordEncoder(queries.tokenizer_path()).tokenizer
    ids = {i: np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for i, x in rows}
    at, bins = dict.fromkeys(ids, 0), {}
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        x = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(x) // 4
        at[r["doc_id"]] += r["length"]
        assert r["ids_crc32"] == zlib.crc32(x[4 * r["start"] : 4 * at[r["doc_id"]]])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(at[i] == len(x) // 4 for i, x in ids.items())
    sums = []
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 2048
        sums.append(end)
    assert K.padding(np.asarray(sums)) / sum(sums) < 0.01


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()]
    _check(rows, queries.queries()["op10_harmonic_packing"](spark, f"{DATA}/sf0.001").collect())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "word " * 50_000), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as start")
    out = K.pack_documents(df, queries.tokenizer_path()).collect()
    _check(rows, out)
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] for r in out)
    again = K.pack_documents(spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b")], "doc_id long, text string"), queries.tokenizer_path()).collect()
    assert len(again) >= 3 and sum(r["length"] for r in again) == 9
    assert K.pack_documents(df.limit(0), queries.tokenizer_path()).count() == 0
