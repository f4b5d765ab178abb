"""Sketches of a column by day, kept as a table: merged when they are read, and added to day by day.

A row holds what a day knows of a column: a HyperLogLog sketch of its different values (cheap to merge), a theta sketch of
them (which can also be intersected), and a KLL sketch of its numbers. Any range of days, or several tables, then answer
from a few kilobytes a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Logarithms of the sketches' sizes: relative errors (one standard deviation) of 0.8 % and 1.6 %, and the KLL parameter
#: for a rank error of about 1.3 %.
HLL, THETA, KLL = 14, 12, 200


def by_day(rows: DataFrame, day: Column, value: Column, number: Column) -> DataFrame:
    """(day, n, values, set, numbers) of rows: the sketches of each day; null values and numbers are left out."""
    r = rows.select(day.alias("day"), value.cast("string").alias("v"), number.cast("double").alias("x"))
    return r.groupBy("day").agg(
        F.count("*").alias("n"), F.hll_sketch_agg("v", HLL).alias("values"), F.theta_sketch_agg("v", THETA).alias("set"),
        F.kll_sketch_agg_double("x", KLL).alias("numbers"),
    )


def merged(*tables: DataFrame, by: list[str] = ("day",)) -> DataFrame:
    """Sketches of all tables by the given columns (none: one row). A day of several tables is that of all their rows."""
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("values").alias("values"), F.theta_union_agg("set", THETA).alias("set"),
        F.kll_merge_agg_double("numbers", KLL).alias("numbers"),
    )


def added(kept: DataFrame, rows: DataFrame, day: Column, value: Column, number: Column) -> DataFrame:
    """kept with new rows in it: only their days are merged, all others stay as they are."""
    new = by_day(rows, day, value, number)
    touched = kept.join(new.select("day"), "day", "left_semi")
    return kept.join(new.select("day"), "day", "left_anti").unionByName(merged(touched, new))


def told(sketches: DataFrame, shares: list[float]) -> DataFrame:
    """sketches as numbers: n, distinct, and the quantiles of ``shares`` in order."""
    ranks = F.array(*[F.kll_sketch_get_quantile_double("numbers", F.lit(s)) for s in shares])
    rest = [c for c in sketches.columns if c not in ("n", "values", "set", "numbers")]
    return sketches.select(*rest, "n", F.hll_sketch_estimate("values").alias("distinct"), ranks.alias("quantiles"))


def in_common(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """(by, common): about how many values rows of ``a`` and ``b`` with the same ``by`` share."""
    pair = a.select(*by, F.col("set").alias("_a")).join(b.select(*by, F.col("set").alias("_b")), by)
    return pair.select(*by, F.theta_sketch_estimate(F.theta_intersection("_a", "_b")).alias("common"))
