from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstone.llm import op1_mih, queries
from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA


def _brute(rows, k):
    rows = {(i, c) for i, c in rows if i is not None and c is not None}
    out = set()
    for q, code in rows:
        if q % 5 == 0:
            near = sorted(((code ^ c) & (2**64 - 1)).bit_count() * 10**6 + i for i, c in rows if i != q)
            out |= {(q, r + 1, x % 10**6, x // 10**6) for r, x in enumerate(near[:k])}
    return out


@pytest.mark.parametrize("shard", [7, 1 << 17])
def test_against_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(op1_mih, "SHARD_ROWS", shard)
    rng = random.Random(0)
    base = [rng.getrandbits(63) for _ in range(6)]
    rows = [(i, rng.choice(base) ^ sum(1 << rng.randrange(63) for _ in range(rng.randrange(5)))) for i in range(60)]
    rows += [(100 + i, base[0]) for i in range(30)] + [(0, rows[0][1]), (None, 5), (999, None)]
    df = spark.createDataFrame(rows, "vec_id long, code long").withColumns({"rank": F.lit(1), "distance": F.lit("x")})
    found = op1_mih.nearest_codes(spark, df, F.col("vec_id") % 5 == 0, k=7)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in found.collect()} == _brute(rows, 7)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, 1), (1, 3)], "vec_id long, code long")
    assert [tuple(r) for r in op1_mih.nearest_codes(spark, df, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1)]
    assert op1_mih.nearest_codes(spark, df.limit(0), F.lit(True)).count() == 0


def test_sign_code_of_odd_vectors(spark):
    rows = [([1.0] * 64,), ([1.0] * 63,), ([float("nan")] * 64,), (None,), ([-1.0] + [1.0] * 63,)]
    got = [r["c"] for r in spark.createDataFrame(rows, "v array<double>").select(op1_mih.sign_code(F.col("v")).alias("c")).collect()]
    assert got == [-1, None, None, None, 2**63 - 1]


def test_query_matches_sql(spark, duck):
    df = queries.queries()["op1_mih_sign_codes"](spark, f"{DATA}/sf0.001")
    assert spark_rows(df) == duck_rows(duck, queries.oracle_sql()["op1_mih_sign_codes"])


def test_shard_tables_cover_every_code():
    codes = np.random.default_rng(1).integers(0, 1 << 64, 500, np.uint64)
    shard = op1_mih.Shard(np.arange(500), codes, 3)
    assert all(sorted(o) == list(range(500)) for o in shard.order)
