from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from keepstone.operators import intervals

BASE = dt.datetime(1985, 3, 1)


def _ranges(rng, n):
    """Ranges of seconds and of decades, some with swapped ends."""
    out = []
    for i in range(n):
        start = BASE + dt.timedelta(seconds=rng.randrange(10**9))
        length = rng.choice([0, 1, 59, 3600, 7200, 86_400 * rng.randrange(1, 40), 86_400 * 365 * rng.randrange(1, 30), -5, -9000])
        out.append((f"r{i}", start, start + dt.timedelta(seconds=length), None if i % 2 else "r1"))
    return out


SCHEMA = "slug string, start timestamp_ntz, end timestamp_ntz, parent string"


def test_cells_cover_exactly_the_hours(spark):
    rng = random.Random(1)
    rows = [(i, s := rng.randrange(-500, 500), s + rng.choice([0, 1, 2, 7, 100, 3000, -1])) for i in range(300)] + [(300, -(10**6), 2 * 10**7)]
    df = spark.createDataFrame(rows, "i long, s long, e long")
    for r in df.withColumn("c", intervals.cells(F.col("s"), F.col("e"))).collect():
        spans = sorted((x["cell"] << x["level"], (x["cell"] + 1) << x["level"]) for x in r["c"])
        assert len(spans) <= 2 * intervals._LEVELS and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert (spans[0][0], spans[-1][1]) == (r["s"], r["e"] + 1) if r["e"] >= r["s"] else spans == []


def test_points_in_ranges_of_all_lengths(spark, monkeypatch):
    rng = random.Random(2)
    ranges, points = _ranges(rng, 80), [(i, BASE + dt.timedelta(seconds=rng.choice([rng.randrange(10**9), 5 * 10**8 + i % 7]))) for i in range(400)]
    expected = sorted((i, slug) for i, t in points for slug, s, e, _ in ranges if s <= t <= e)
    r, p = spark.createDataFrame(ranges, SCHEMA), spark.createDataFrame(points, "i long, t timestamp_ntz")
    for crowd in (1 << 20, 40):
        monkeypatch.setattr(intervals, "_CROWD", crowd)
        assert sorted((x["i"], x["slug"]) for x in intervals.containing(p, "t", r).collect()) == expected
    assert intervals.containing(p, "t", r.limit(0)).count() == 0


def test_overlaps_once_for_each_pair(spark):
    rng = random.Random(3)
    a, b = _ranges(rng, 60), _ranges(rng, 60)
    kind = lambda x, y: "within" if y[1] <= x[1] and x[2] <= y[2] else "contains" if x[1] <= y[1] and y[2] <= x[2] else "overlaps"
    good = lambda rows: [r for r in rows if r[1] <= r[2]]
    expected = sorted((x[0], y[0], kind(x, y)) for x in good(a) for y in good(b) if x[1] <= y[2] and y[1] <= x[2])
    got = intervals.overlapping(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == expected
