from __future__ import annotations

import heapq
import zlib

import numpy as np
import pytest

from keepstone.llm import op4_huffman as H
from keepstone.llm import queries, tokens
from keepstone.llm.common import Scratch
from tests.conftest import DATA


def _best_cost(counts):
    heap = [(int(w), i) for i, w in enumerate(counts) if w]
    heapq.heapify(heap)
    cost, n = 0, len(counts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], n := n + 1))
    return cost


@pytest.mark.parametrize("n", [2, 3, 40, 700])
def test_lengths_are_optimal_where_the_limit_allows(n):
    counts = np.random.default_rng(n).integers(0, 1000, n)
    counts[:2] = 5, 7
    lengths = H.code_lengths(counts)
    assert (lengths[counts > 0] > 0).all() and (lengths[counts == 0] == 0).all()
    assert int((counts * lengths.astype(int)).sum()) == _best_cost(counts)
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1


def test_limit_holds_for_steep_counts():
    counts = np.asarray([int(1.6**i) + 1 for i in range(60)])
    lengths = H.code_lengths(counts, 10)
    assert lengths.max() <= 10 and sum(2.0 ** -int(x) for x in lengths) <= 1
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(5, int), 2)


def test_bits_are_packed_in_order():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 63, 64, 65, 1000):
        bits = rng.integers(1, 19, n)
        codes = (rng.integers(0, 1 << 18, n) & ((1 << bits) - 1)).astype(np.uint32)
        plain = "".join(format(c, f"0{b}b") for c, b in zip(codes.tolist(), bits.tolist(), strict=True))
        plain += "0" * (-len(plain) % 8)
        want = bytes(int(plain[i : i + 8], 2) for i in range(0, len(plain), 8))
        assert H.pack_bits(codes, bits, np.cumsum(bits) - bits) == want


@pytest.mark.parametrize("stored", ["<u2", "<u4"])
def test_blocks_round_trip(stored):
    rng = np.random.default_rng(0)
    counts = (rng.pareto(0.8, 3000) * 5).astype(int)
    lengths = H.code_lengths(counts)
    used = np.flatnonzero(counts)
    docs = [rng.choice(used, k).astype(stored).tobytes() for k in (0, 1, 127, 128, 129, 5000, 0)]
    out = H.decode_block(H.encode_block(docs, lengths, H.canonical_codes(lengths), stored), H.decoding_table(lengths))
    assert [x.astype(stored).tobytes() for x in out] == docs
    one = H.code_lengths(np.asarray([0, 9]))
    same = [np.ones(300, stored).tobytes()]
    assert [x.astype(stored).tobytes() for x in H.decode_block(H.encode_block(same, one, H.canonical_codes(one), stored), H.decoding_table(one))] == same
    with pytest.raises(ValueError):
        H.decode_block(bytes(40), H.decoding_table(one))


def _expected(rows):
    t = tokens.WordEncoder(queries.tokenizer_path()).tokenizer
    ids = [np.asarray(t.encode(x or "", add_special_tokens=False).ids + [1], "<u4").tobytes() for _, x in rows]
    at, out = 0, []
    for (i, _), x in zip(rows, ids, strict=True):
        out.append((i, at, len(x) // 4, zlib.crc32(x)))
        at += len(x) // 4
    return out


def test_query_round_trip(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect())
    out = queries.queries()["op4_huffman_files"](spark, f"{DATA}/sf0.001")
    assert sorted(tuple(r) for r in out.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == _expected(rows)


def test_edges(spark):
    rows = [(None, "b"), (1, None), (2, ""), (3, "word " * 40_000), (3, "word " * 40_000), (4, "<|endoftext|> x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 as ids", "2 as start")
    out = [tuple(r) for r in H.huffman_round_trip(spark, df, queries.tokenizer_path()).orderBy("start").collect()]
    assert out == _expected(rows)
    assert H.huffman_round_trip(spark, df.limit(0), queries.tokenizer_path()).count() == 0


def test_ids_that_take_four_bytes(spark, monkeypatch):
    assert H.stored_type(1 << 16) == "<u2" and H.stored_type((1 << 16) + 1) == "<u4"
    monkeypatch.setattr(H, "stored_type", lambda vocabulary: "<u4")
    rows = [(1, "two words"), (2, None), (3, "words, again " * 3000)]
    out = H.huffman_round_trip(spark, spark.createDataFrame(rows, "doc_id long, text string"), queries.tokenizer_path(), 1000)
    assert [tuple(r) for r in out.orderBy("start").collect()] == _expected(rows)


def test_files_shrink(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    scratch = Scratch(spark, "test")
    H.write_files(docs, queries.tokenizer_path(), scratch, block_tokens=4096)
    blocks = scratch.read("blocks").collect()
    assert len(blocks) > 5 and max(scratch.read("header").first()["lengths"]) <= H.MAX_BITS
    assert sum(len(b["payload"]) for b in blocks) < 2 * sum(b["n_tokens"] for b in blocks)
