"""Aggregates behind the overview: folders, months, years, calendar, galleries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def folder_summary(records: DataFrame, videos: DataFrame, marks: DataFrame) -> DataFrame:
    """One row for each folder: records, groups, close calls, videos and whether its day is done.

    records (folder, day, moment_id, close_call), videos (folder, day), marks (day, status).
    """
    r = records.groupBy("folder").agg(
        F.first("day", ignorenulls=True).alias("r_day"),
        F.count("*").alias("records"),
        F.count_distinct("moment_id").alias("moments"),
        F.count_distinct(F.when(F.col("close_call"), F.col("moment_id"))).alias("close_calls"),
    )
    v = videos.groupBy("folder").agg(F.first("day", ignorenulls=True).alias("v_day"), F.count("*").alias("videos"))
    both = r.join(v, "folder", "full").withColumn("day", F.coalesce("r_day", "v_day")).drop("r_day", "v_day")
    done = F.coalesce(F.col("status") == "reviewed", F.lit(False))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("records", "moments", "close_calls", "videos")}
    return both.join(marks, "day", "left").withColumns(zero).withColumn("reviewed", done)


def overview(folders: DataFrame) -> DataFrame:
    """(year, month, records, days, done, todo) by month, by year (month null) and over all (both null)."""
    dated = folders.where("day is not null").withColumns({"year": F.substring("day", 1, 4), "month": F.substring("day", 1, 7)})
    return dated.rollup("year", "month").agg(
        F.sum("records").alias("records"),
        F.count("*").alias("days"),
        F.count_if("reviewed").alias("done"),
        (F.count("*") - F.count_if("reviewed")).alias("todo"),
    )


def calendar(days: DataFrame, year: int) -> DataFrame:
    """One row for each month of a year and 31 columns: records of the day, 0 without any, null beyond its end."""
    spark = days.sparkSession
    grid = spark.range(1).select(
        F.explode(F.sequence(F.lit(f"{year}-01-01").cast("date"), F.lit(f"{year}-12-31").cast("date"))).alias("date")
    )
    cells = grid.select(F.date_format("date", "yyyy-MM-dd").alias("day"), F.date_format("date", "yyyy-MM").alias("month"), F.dayofmonth("date").alias("d"))
    filled = cells.join(days.groupBy("day").agg(F.sum("records").alias("n")), "day", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    wide = filled.groupBy("month").pivot("d", list(range(1, 32))).agg(F.first("n"))
    return wide.select("month", *[F.col(str(i)).alias(f"d{i:02d}") for i in range(1, 32)])


def gallery(picks: DataFrame) -> DataFrame:
    """(year, month, n, items): picks by month, newest year first, items in time order."""
    item = F.struct("taken_at", "name", "sha256")
    return picks.groupBy(F.date_format("taken_at", "yyyy").alias("year"), F.date_format("taken_at", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("items")
    )


def common(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The n most frequent values of each group; ties go to the lesser value."""
    from pyspark.sql import Window

    counts = df.groupBy(*keys, value).count()
    order = Window.partitionBy(*keys).orderBy(F.desc("count"), value)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
