from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keepstone.operators import ranking, relations
from keepstone.operators.ordering import last_values

SCHEMA = "k string, ts timestamp_ntz, v long"


def _rows(spark, n, seed, keys):
    rng = random.Random(seed)
    df = spark.createDataFrame([(rng.choice(keys), rng.randrange(3000), i) for i in range(n)], "k string, s long, v long")
    return df.select("k", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "v").repartition(5)


@pytest.mark.parametrize("keys", [["a"], ["a", "b", None]])
def test_as_of_each_way(spark, keys):
    left, right = _rows(spark, 300, 1, keys), _rows(spark, 60, 2, keys)
    l, r = left.collect(), right.collect()
    for direction in ("backward", "forward", "nearest"):
        for tolerance in (None, 40.0):
            got = {x["v"]: x["as_of_v"] for x in relations.as_of(left, right, ["k"], "ts", ["v"], direction, tolerance).collect()}
            for x in l:
                gap = lambda y: (y["ts"] - x["ts"]).total_seconds()  # noqa: E731, B023
                near = [y for y in r if y["k"] == x["k"] and (direction == "nearest" or (gap(y) <= 0) == (direction == "backward") or gap(y) == 0)]
                near = [y for y in near if tolerance is None or abs(gap(y)) <= tolerance]
                best = min(near, key=lambda y: (abs(gap(y)), gap(y) > 0, -y["v"]), default=None)
                assert got[x["v"]] == (best["v"] if best else None), (direction, tolerance)


def test_last_values_over_ranges(spark):
    df = spark.range(500).select(F.col("id").alias("o"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v")).repartition(9)
    for up_to in (0, -1):
        for r in last_values(df, [], ["o"], {"last": F.col("v")}, up_to).collect():
            assert r["last"] == max((i for i in range(r["o"] + 1 + up_to) if i % 7 == 3), default=None)


def test_lists(spark):
    items = spark.createDataFrame([(f"i{i}", i * 10) for i in range(30)], "item string, position long").repartition(4)
    for item, step in (("i4", 1), ("i4", -1), ("i0", -1), ("i29", 1), ("gone", 1)):
        want = [f"i{i}" for i in range(30)]
        if item in want:
            at = want.index(item)
            to = min(max(at + step, 0), 29)
            want[at], want[to] = want[to], want[at]
        assert [r["item"] for r in ranking.moved_by_one(items, "item", "position", item, step).orderBy("position").collect()] == want
    rows = {r["item"]: r for r in ranking.neighbours(items, ["position"], "item", F.col("position") % 30 == 0).collect()}
    assert (rows["i4"]["previous"], rows["i4"]["next"], rows["i4"]["previous_todo"], rows["i4"]["next_todo"]) == ("i3", "i5", "i3", "i6")
    assert rows["i0"]["previous"] is None and rows["i29"]["next"] is None and rows["i3"]["previous_todo"] == "i0"
