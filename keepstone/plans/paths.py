"""Where each record belongs in the library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone import config as C
from keepstone.operators.intervals import most_specific
from keepstone.sources.shared import stored


def desired_paths(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """(sha256, path). Records with no date, or only a month, wait in folders of their own; all others go where their
    group's best member goes: day and event of the best, then best, copy or alternate. Exactly one best per group.

    records (sha256, name, ext, taken_at, date_source, moment_id, is_best, duplicate_of).
    """
    # Scores take sorts and shuffles; they are written once and read for the bests, the names and the rows.
    records = stored(records.select("sha256", "name", "ext", "taken_at", "date_source", "moment_id", "is_best", "duplicate_of"), "scored")
    return with_paths(records, ranges).select("sha256", "path")


def with_paths(records: DataFrame, ranges: DataFrame) -> DataFrame:
    """records plus the path of each; they are read several times, so they should be written (``stored``)."""
    best = most_specific(records.where("is_best").select("moment_id", "sha256", "name", "taken_at", "date_source"), "taken_at", ranges, "sha256")
    real = ~F.col("date_source").isin(*C.NO_TIME)
    day = F.date_format("taken_at", "yyyy-MM-dd")
    event = F.when(real & F.col("slug").isNotNull(), F.concat(F.lit("_"), F.col("slug"))).otherwise("")
    best = best.select("moment_id", F.col("name").alias("best_name"), F.concat(F.date_format("taken_at", "yyyy"), F.lit("/"), day, event).alias("folder"))
    names = records.select(F.col("sha256").alias("duplicate_of"), F.col("name").alias("kept_name"))
    # Only copies look for a name; the others have no key, and all of them would meet in one task.
    copies = records.where("duplicate_of is not null").join(names, "duplicate_of", "left")
    both = copies.unionByName(records.where("duplicate_of is null").withColumn("kept_name", F.lit(None).cast("string")))
    joined = both.join(best, "moment_id", "left")
    file = F.concat("name", "ext")
    month = F.date_format("taken_at", "yyyy-MM")
    path = (
        F.when(F.col("date_source") == "mtime", F.concat_ws("/", F.lit(C.UNDATED), file))
        .when(F.col("date_source") == "folder-month", F.concat_ws("/", F.date_format("taken_at", "yyyy"), F.concat(month, F.lit("_" + C.UNKNOWN_DAY)), file))
        .when(F.col("is_best"), F.concat_ws("/", "folder", file))
        .when(F.col("duplicate_of").isNotNull(), F.concat_ws("/", "folder", F.lit(C.DUPLICATES), "kept_name", file))
        .otherwise(F.concat_ws("/", "folder", F.lit(C.ALTERNATES), "best_name", file))
    )
    return joined.select(*records.columns, path.alias("path"))
