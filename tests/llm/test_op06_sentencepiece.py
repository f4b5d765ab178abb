from __future__ import annotations

import random
import zlib

import numpy as np

from keepstone.llm import op6_sentencepiece as S
from keepstone.llm import queries
from tests.conftest import DATA

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def test_chunks_equal_the_library():
    e, rng = S.encoder(MODEL), random.Random(0)
    alphabet = list("abetion  \n▁é漢𝒳0.") + ["tion", "the ", "  ", "ing", "\t"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        expected = e.model.encode(text)
        for chunk in (3, 7, 20):
            assert S.encode_giant(e, text, chunk) == expected
    blob = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8000))  # no place to cut a unit
    assert S.encode_giant(e, blob, 700) == e.model.encode(blob)


def test_products_are_associative():
    rng = random.Random(1)
    states = [(0, "a"), (1, "b"), (0, None)]
    make = lambda: {s: {t: -rng.randrange(9) * 1.0 for t in rng.sample(states, rng.randrange(1, 4))} for s in rng.sample(states, 2)}
    for _ in range(200):
        a, b, c = make(), make(), make()
        assert S.combine(S.combine(a, b), c) == S.combine(a, S.combine(b, c))


def test_query_and_edges(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 2000)
    library = S.encoder(MODEL).model
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, " "), (-3, "x" * 9000), (-4, "a b " * 4000), (-4, "a b " * 4000)], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(extra).selectExpr("doc_id", "text", "1 as ids", "2 as k")
    out = S.encode_documents(spark, both, MODEL, chunk=2000)
    rows = both.collect()
    expected = sorted((r["doc_id"] if r["doc_id"] is not None else -9, len(x), zlib.crc32(np.asarray(x, "<u4").tobytes())) for r, x in zip(rows, library.encode([r["text"] or "" for r in rows]), strict=True))
    found = out.collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -9, r["n_pieces"], r["ids_crc32"]) for r in found) == expected
    assert all(r["round_trip"] for r in found) and max(r["n_chunks"] for r in found) > 3
    decoded = {r["doc_id"]: r["text"] for r in S.decode_documents(out, MODEL).collect()}
    assert all(decoded[r["doc_id"]] == (r["text"] or "") for r in rows)
    assert S.encode_documents(spark, both.limit(0), MODEL).count() == 0
