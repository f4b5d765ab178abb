"""Burst clustering: an order-dependent fold, made parallel by cutting time into islands first."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstone.config import NO_TIME
from keepstone.functions.scalars import hash_halves


def islands(df: DataFrame, keys: list[str], time: str, order: list[str], gap_seconds: float, name: str = "island") -> DataFrame:
    """df plus the number of each row's run of rows whose neighbours in time are at most the gap apart, by keys.

    Rows are only ever ordered within an hour of their keys, so one busy key is many tasks; what an hour needs of the
    hours before (the last time and the number of breaks) comes from one row for each key and hour.
    """
    gap, own = int(gap_seconds * 1_000_000), df.columns
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    rows = df.withColumns({"_day": F.date_trunc("hour", time), "_at": micros})
    day = Window.partitionBy(*keys, "_day").orderBy(time, *order)
    within = F.when(F.col("_at") - F.lag("_at").over(day) > gap, 1).otherwise(0)
    rows = rows.withColumn("_break", within).withColumn("_sum", F.sum("_break").over(day.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy(*keys, "_day").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.sum("_break").alias("_breaks"))
    over = Window.partitionBy(*keys).orderBy("_day") if keys else Window.orderBy("_day")
    days = days.withColumn("_new", F.when(F.col("_first") - F.lag("_last").over(over) > gap, 1).otherwise(0))
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_before", F.sum(F.col("_new") + F.col("_breaks")).over(so_far) - F.col("_breaks"))
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    offsets = days.select(*names, F.col("_day").alias("_d"), "_before")
    same = F.col("_day") == F.col("_d")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(offsets, same).select(*own, (F.col("_before") + F.col("_sum")).alias(name))


def _fold(most_bits: int):
    """A fold over sorted (camera, island, sha256, hi, lo, at); the open group goes on from batch to batch. Islands are
    named after their first record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, head, first, moment, held = None, None, None, None, {}
        for batch in batches:
            moments, heads, firsts = [], [], []
            for camera, island, sha, hi, lo, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x = hi << 32 | lo
                if place != (camera, island):
                    place, head, first, held = (camera, island), sha, at, {}
                if not (x in held or any((x ^ y).bit_count() <= most_bits for y in held)):
                    moment, held = sha, {}
                held[x] = True
                moments.append(moment)
                heads.append(head)
                firsts.append(first)
            made = [pa.array(moments, pa.string()), pa.array(heads, pa.string()), pa.array(firsts, pa.int64())]
            yield pa.record_batch([batch.column(2), *made, batch.column(5), batch.column(0)], names=["sha256", "moment_id", "island", "first", "at", "camera"])

    return run


def bursts(records: DataFrame, gap_seconds: float, most_bits: int) -> DataFrame:
    """(sha256, moment_id): a record joins the open group if it comes within the gap of the last member and its hash is
    within ``most_bits`` of any member; a failed test closes the group for good. Records without a real time stand alone.

    A gap always breaks a group, so islands of time are independent: they are dealt to tasks, sorted and folded in one
    pass that holds the distinct hashes of the open group only.
    """
    return folded(records, gap_seconds, most_bits).select("sha256", "moment_id")


def folded(records: DataFrame, gap_seconds: float, most_bits: int) -> DataFrame:
    """(sha256, moment_id, island, first, at, camera): groups as ``bursts`` makes them, with the first record of the island
    of time, when that begins and when the record was taken, in microseconds. Records without a real time are islands
    of their own, without a camera."""
    at = F.unix_micros(F.col("taken_at").cast("timestamp"))
    real = ~F.col("date_source").isin(*NO_TIME)
    sha = F.col("sha256")
    alone = records.where(~real).select(sha, sha.alias("moment_id"), sha.alias("island"), at.alias("first"), at.alias("at"), F.lit(None).cast("string").alias("camera"))
    timed = records.where(real).select("sha256", "taken_at", F.coalesce("camera", F.lit("")).alias("camera"), hash_halves(F.col("phash")).alias("h"))
    runs = islands(timed, ["camera"], "taken_at", ["sha256"], gap_seconds)
    sorted_runs = runs.repartition("camera", "island").sortWithinPartitions("camera", "island", "taken_at", "sha256")
    rows = sorted_runs.select("camera", "island", "sha256", F.col("h.hi").alias("hi"), F.col("h.lo").alias("lo"), at.alias("at"))
    return rows.mapInArrow(_fold(most_bits), "sha256 string, moment_id string, island string, first long, at long, camera string").unionByName(alone)


def apply_overrides(groups: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual groups win over clustered ones; a group may carry an id that is no record's."""
    o = overrides.select(F.col("sha256").alias("_o"), F.col("moment_id").alias("_m"))
    joined = groups.join(o, groups["sha256"] == F.col("_o"), "left")
    return joined.select("sha256", F.coalesce("_m", "moment_id").alias("moment_id"))


def sessions(records: DataFrame, gap_hours: float) -> DataFrame:
    """Suggested events over all records with a real time: (id, start, end, records), split where a pause is longer."""
    timed = records.where(~F.col("date_source").isin(*NO_TIME)).select("taken_at")
    runs = islands(timed, [], "taken_at", [], gap_hours * 3600, "event")
    out = runs.groupBy("event").agg(F.min("taken_at").alias("start"), F.max("taken_at").alias("end"), F.count("*").alias("records"))
    return out.select(F.date_format("start", "yyyyMMdd_HHmmss").alias("id"), "start", "end", "records")


def user_sessions(events: DataFrame, keys: list[str], time: str, gap: str) -> DataFrame:
    """Sessions of each key by gap; equality with the gap merges, and the end is the last row's time."""
    w = F.session_window(time, gap)
    out = events.groupBy(*keys, w.alias("w")).agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))
    return out.drop("w")
