from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstone.operators import balls
from keepstone.operators import vectors as V

D = 16


def _clustered(n, seed, spread):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 1, (9, D))[rng.integers(0, 9, n)] + rng.normal(0, spread, (n, D))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _frame(spark, v, **more):
    columns = "".join(f", {k} long" for k in more)
    return spark.createDataFrame([(i, x.tolist(), *(int(m[i]) for m in more.values())) for i, x in enumerate(v)], f"id long, v array<double>{columns}")


@pytest.fixture(scope="module", params=[0.05, 2.0])
def sets(request, spark):
    """Vectors in clusters, and vectors that all but fill the sphere."""
    a, b = _clustered(330, 1, request.param), _clustered(300, 2, request.param)
    return request.param, a, b, _frame(spark, a).cache(), _frame(spark, b).cache()


def test_bounds_hold_and_leave_pairs_out(sets):
    spread, a, b, da, db = sets
    x, y = balls.Balls(da, 20), balls.Balls(db, 20)
    blocks = [{r["id"]: r["block"] for r in z.rows.collect()} for z in (x, y)]
    assert len(blocks[0]) == 330 and sum(r["n"] for r in x.stats.collect()) == 330
    most = {(r["i"], r["j"]): r["most"] for r in balls.bounds(x, y).collect()}
    for i in range(330):
        for j in range(300):
            assert a[i] @ b[j] <= most[blocks[0][i], blocks[1][j]] + 1e-9
    skipped = np.mean([m < 0.8 for m in most.values()])
    assert skipped > 0.6 if spread < 1 else skipped < 0.1


def test_nearest_equals_brute_force(sets):
    _, a, b, da, db = sets
    sims = np.round(a @ b.T, 12)
    got: dict[int, list] = {}
    for r in V.nearest(da, db, 6, block=25).collect():
        got.setdefault(r["id"], []).append((-round(r["similarity"], 12), r["other"]))
    for i in range(330):
        assert sorted(got[i]) == sorted((-s, j) for j, s in enumerate(sims[i]))[:6]


def test_pairs_and_labels_equal_brute_force(sets, spark):
    _, a, b, da, _ = sets
    sims = a @ a.T
    got = {(r["id"], r["other"]) for r in V.similar_pairs(da, 0.6, block=25).collect()}
    assert got == {(i, j) for i, j in zip(*np.nonzero(sims >= 0.6), strict=True) if i < j}
    people = np.arange(300) % 5
    rejected = spark.createDataFrame([(i, i % 5) for i in range(0, 330, 3)], "id long, person_id long")
    labels = {r["id"]: r["person_id"] for r in V.label_from_examples(da, _frame(spark, b, person_id=people), rejected, 0.5, block=25).collect()}
    best = np.round(a @ b.T, 12)
    for i in range(330):
        scores = sorted((-best[i, people == p].max(), p) for p in range(5) if not (i % 3 == 0 and p == i % 5))
        assert labels.get(i) == (scores[0][1] if -scores[0][0] >= 0.5 else None)


def test_few_and_no_vectors(spark):
    one = _frame(spark, np.asarray([[1.0, 0.0]]))
    assert [tuple(r) for r in V.nearest(one, one, 3).collect()] == [(0, 0, 1.0)]
    assert V.nearest(one, one.limit(0), 3).count() == 0 and V.similar_pairs(one.limit(0), 0.5).count() == 0
    assert V.mutual_groups(one, 3, 0.5).select(F.sum("group_id")).first()[0] == 0


def test_pairs_of_blocks_are_not_shuffled(spark):
    """each block was shuffled once for every block that it met."""
    found = V.similar_pairs(_frame(spark, _clustered(200, 3, 2.0)), 0.6, block=10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_nearest_meets_most_blocks_without_a_shuffle(spark):
    """F8: as F7; and the k best of each pair of blocks were shuffled, not those of a part. Ties go to the smaller id."""
    v = np.repeat(_clustered(40, 4, 2.0), 6, axis=0)
    df = _frame(spark, v)
    found = V.nearest(df, df, 4, block=10)
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "CartesianProduct" in plan and plan.count("Exchange") == 1
    got: dict[int, list] = {}
    for r in found.collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert {k: sorted(x) for k, x in got.items()} == {i: [i // 6 * 6 + j for j in range(4)] for i in range(240)}


def test_first_blocks_meet_without_a_shuffle(spark):
    """F8: blocks were shuffled four times over for the two that each meets first."""
    x = balls.Balls(_frame(spark, _clustered(200, 5, 2.0)), 10)
    met = balls.beside(x, x, balls.bounds(x, x).where("i = j or i = j + 1"))
    assert "CartesianProduct" in met._jdf.queryExecution().executedPlan().toString()
    blocks = x.stats.count()
    assert met.count() == 2 * blocks - 1 and met.where("block = r_block and vs = r_vs and ids = r_ids").count() == blocks


@pytest.mark.parametrize("k", [0, 3])
@pytest.mark.parametrize("rank", [2, 60, 250])
def test_single_precision_loses_no_product(rank, k):
    """F8: few products are made in double precision; those that equal the least are among them."""
    rng = np.random.default_rng(rank)
    v, w = rng.integers(-9, 10, (200, D)) / 3.0, rng.integers(-9, 10, (300, D)) / 3.0
    sims = v @ w.T
    least = np.sort(sims, axis=1)[:, -rank] - 1e-12
    i, j, s = V._reaching(v, w, least, k)
    got, every = dict(zip(zip(i, j, strict=True), s, strict=True)), set(zip(*np.nonzero(sims >= least[:, None]), strict=True))
    assert set(got) == every if not k or rank < 30 else set(got) <= every and np.array_equal(np.bincount(i, minlength=200) >= 3, np.full(200, True))
    assert max(abs(sims[p] - x) for p, x in got.items()) < 1e-12
