from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from keepstone.llm import op3_permutation as P
from keepstone.llm import queries
from tests.conftest import DATA


def _vectors(spark, sf):
    rows = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    return np.asarray([r[0] for r in rows]), np.asarray([r[1] for r in rows], float)


def test_recall_against_brute_force(spark):
    ids, v = _vectors(spark, "sf0.1")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    found: dict[int, list] = {}
    for r in queries.queries()["op3_permutation_index"](spark, f"{DATA}/sf0.1").orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        sims = unit @ unit[i]
        sims[i] = -2
        best = set(ids[np.argsort(-sims)[:5]].tolist())
        hits += len(best & {x for x, _ in found[ids[i]]})
        total += 5
        assert len(found[ids[i]]) == 5
        for other, score in found[ids[i]]:
            assert abs(score - sims[np.flatnonzero(ids == other)[0]]) < 1e-12
    assert set(found) == set(ids[ids % 50 == 0].tolist()) and hits / total >= 0.9


def test_postings_give_the_footrule_distance():
    rng = np.random.default_rng(0)
    x, pivots = rng.normal(size=(60, 8)), rng.normal(size=(40, 8))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = P.prefixes(unit, pivots, 12)
    assert (near == np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :12]).all()
    block = P.Block(np.arange(60), x, pivots[:12])
    assert block.size == 12 and all(len(set(block.row[block.start[i] : block.start[i + 1]])) == 60 for i in range(12))
    block = P.Block(np.arange(60), x, pivots)
    block_near = P.prefixes(block.vectors / block.length[:, None], pivots)
    size = block.size
    position = np.full((60, len(pivots)), size)
    np.put_along_axis(position, block_near, np.arange(size)[None, :], axis=1)
    for q in range(5):
        footrule = np.abs(position - position[q]).sum(axis=1)
        assert (size * (size + 1) - 2 * block.closeness(block_near[q]) == footrule).all()


def test_ties_of_a_prefix():
    pivots = np.asarray([[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], [0.0, 1.0], [-1.0, 0.0]])
    assert P.prefixes(np.asarray([[1.0, 0.0]]), pivots, 3).tolist() == [[0, 2, 1]]


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (None, [1.0, 1.0]), (8, []), (9, [1.0]), (10, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    out = [tuple(r) for r in P.nearest(spark, df, F.col("vec_id").isin(0, 3, 4, 5)).orderBy("rank").collect()]
    assert out == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 10, 0.0)]
    more = df.unionByName(spark.createDataFrame([(11, [3.0])], "vec_id long, embedding array<double>").withColumn("score", F.lit("y")))
    assert [tuple(r) for r in P.nearest(spark, more, F.col("vec_id") == 9).collect()] == [(9, 1, 11, 1.0)]
    assert P.nearest(spark, df.limit(0), F.lit(True)).count() == 0


def test_repeats_take_no_places(spark):
    rows = [(0, [1.0, 0.0])] + [(1, [1.0, 0.01])] * 6 + [(i, [1.0, 0.1 * i]) for i in range(2, 9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = P.nearest(spark, df, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [r["vec_id"] for r in out] == [1, 2, 3, 4, 5]
