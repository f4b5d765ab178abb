"""Running sums, positions and last values in an order, of which one key is many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.sources.shared import stored


def _slices(df: DataFrame, keys: list[str], order: list[str | Column], added: dict[str, Column]) -> DataFrame:
    """df in ranges of (keys, order), each row with its key ``_k`` and its range ``_p``.

    Ranges are written, as another run might cut them elsewhere. A key's rows lie in as many ranges as it needs.
    """
    key = F.struct(*keys) if keys else F.struct(F.lit(0))
    by = [*keys, *order]
    ranged = df.withColumns({"_k": key, **added}).repartitionByRange(*by).withColumn("_p", F.spark_partition_id())
    return stored(ranged, "ranges")


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """df plus, for each name, the sum of its expression over the key's rows up to this one, in order.

    Rows are ordered within ranges; what a range needs of those before it is one row for each key and range. ``order``
    has to tell all rows of a key apart. Keys may be null.
    """
    rows = _slices(df, keys, order, {f"_v_{n}": c.cast("long") for n, c in sums.items()})
    totals = rows.groupBy("_k", "_p").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_k", "_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in sums])
    within = Window.partitionBy("_k", "_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.join(offsets, ["_k", "_p"])
    return found.select(*df.columns, *[(F.sum(f"_v_{n}").over(within) + F.col(f"_o_{n}")).alias(n) for n in sums])


def last_values(df: DataFrame, keys: list[str], order: list[str | Column], values: dict[str, Column], up_to: int = 0) -> DataFrame:
    """df plus, for each name, the last value that isn't null of its expression among the key's rows so far, in order.

    up_to: 0 counts the row itself, -1 only those before it. As with sums, rows are ordered within ranges, and what a range
    needs of those before it is one row for each key and range, so one key may be all of the table.
    """
    rows = _slices(df, keys, order, {f"_v_{n}": c for n, c in values.items()})
    whole = Window.partitionBy("_k", "_p").orderBy(*order)
    ends = whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lasts = rows.select("_k", "_p", F.struct(*[F.last(f"_v_{n}", True).over(ends).alias(n) for n in values]).alias("_l")).groupBy("_k", "_p").agg(F.any_value("_l").alias("_l"))
    before = Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("_k", "_p", *[F.last(f"_l.{n}", True).over(before).alias(f"_o_{n}") for n in values])
    within = whole.rowsBetween(Window.unboundedPreceding, up_to)
    found = rows.join(carried, ["_k", "_p"])
    return found.select(*df.columns, *[F.coalesce(F.last(f"_v_{n}", True).over(within), F.col(f"_o_{n}")).alias(n) for n in values])
