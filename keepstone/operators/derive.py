"""Everything that follows from groups, for all of them or for those that a change touches; group ids that stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keepstone.config import Curation
from keepstone.operators.bursts import islands
from keepstone.operators.copies import copies_of
from keepstone.operators.intervals import most_specific
from keepstone.operators.ranking import score_groups
from keepstone.plans.paths import with_paths
from keepstone.sources.shared import stored


#: What copies and scores of records are made of, and what paths need besides.
_READ = ["sha256", "moment_id", "taken_at", "date_source", "width", "height", "size", "phash", "sharpness", "exposure", "faces", "face_sharpness", "user_best", "favorite"]
_PATH = ["name", "ext", "taken_at", "date_source"]
#: What ``rescored`` reads of a record before it has a group.
RESCORED = [c for c in _READ if c != "moment_id"]
_MADE = ["sha256", "moment_id", "duplicate_of", "score", "is_best", "close_call"]


def refresh(records: DataFrame, ranges: DataFrame, cfg: Curation, changed: DataFrame | None = None) -> DataFrame:
    """(sha256, moment_id, duplicate_of, score, is_best, close_call, path): copies, scores, best members and paths.

    changed (moment_id) names the groups that an edit touches: only those are derived, to the rows of a full run. Null
    derives all, an empty relation nothing. A group depends on nothing outside it, so no other row is read but once.
    """
    return with_paths(_scored(records, cfg, changed, _PATH), ranges).select(*_MADE, "path")


def rescored(records: DataFrame, cfg: Curation, changed: DataFrame | None = None) -> DataFrame:
    """(sha256, moment_id, duplicate_of, score, is_best, close_call): ``refresh`` without paths, where nothing asks for them."""
    return _scored(records, cfg, changed, [])


def _scored(records: DataFrame, cfg: Curation, changed: DataFrame | None, also: list[str]) -> DataFrame:
    own = records.select(*dict.fromkeys([*_READ, *also]))
    if changed is not None:
        own = own.join(changed.select("moment_id").distinct(), "moment_id", "left_semi")
    own = stored(own, "own")  # read by every step of finding copies, and by scores
    read = own.drop("size", "phash") if also else own.drop("size", "phash", "date_source")  # scores don't read these
    return stored(score_groups(read.join(copies_of(own, cfg), "sha256", "left"), cfg).select(*_MADE, *also), "scored")


def keep_ids(before: DataFrame, now: DataFrame) -> DataFrame:
    """now (sha256, moment_id) under the ids that groups had before (sha256, moment_id): late rows extend an old group.

    An old id goes to the group that holds most of its members, and a group takes the old id of which it holds most (ties
    go to the least id). All other groups keep their new id, unless that has become another group's: then it is hashed.
    """
    was = before.select("sha256", F.col("moment_id").alias("old"))
    shared = now.join(was, "sha256").groupBy("moment_id", "old").agg(F.count("*").alias("n"))
    heir = shared.groupBy("old").agg(F.max_by("moment_id", F.struct("n", _last("moment_id"))).alias("moment_id"), F.max("n").alias("n"))
    taken = heir.groupBy("moment_id").agg(F.max_by("old", F.struct("n", _last("old"))).alias("old"))
    used = taken.select(F.col("old").alias("moment_id"), F.lit(True).alias("_used"))
    ids = now.select("moment_id").distinct().join(taken, "moment_id", "left").join(used, "moment_id", "left")
    fresh = F.when(F.col("_used"), F.sha2(F.concat(F.lit("late:"), "moment_id"), 256)).otherwise(F.col("moment_id"))
    ids = ids.select("moment_id", F.coalesce("old", fresh).alias("_id"))
    return now.join(ids, "moment_id").select("sha256", F.col("_id").alias("moment_id"))


def _last(c: str):
    """An order in which the least text is the largest."""
    return F.translate(c, "0123456789abcdef", "fedcba9876543210")


def suggestions(records: DataFrame, ranges: DataFrame, gap_hours: float, no_time: tuple[str, ...]) -> DataFrame:
    """(id, start, end, records, slug): runs of records with pauses of at most the gap, and the range in which each begins."""
    timed = records.where(~F.col("date_source").isin(*no_time)).select("taken_at")
    runs = islands(timed, [], "taken_at", [], gap_hours * 3600, "event").groupBy("event")
    found = runs.agg(F.min("taken_at").alias("start"), F.max("taken_at").alias("end"), F.count("*").alias("records"))
    named = most_specific(found.select(F.col("start").alias("began"), F.col("end").alias("ended"), "records"), "began", ranges, "began")
    return named.select(F.date_format("began", "yyyyMMdd_HHmmss").alias("id"), F.col("began").alias("start"), F.col("ended").alias("end"), "records", "slug")


def month_covers(shown: DataFrame, pins: DataFrame, most: int = 6) -> DataFrame:
    """(month, moment_id, sha256, rank): at most ``most`` covers of a month, one of each group: favourites first, then
    best members of pinned groups, then by score. shown (sha256, moment_id, taken_at, duplicate_of, is_best, favorite, score)."""
    pinned = pins.select("moment_id", F.lit(True).alias("_pin")).distinct()
    rows = shown.where(F.col("duplicate_of").isNull() & (F.col("is_best") | F.col("favorite"))).join(pinned, "moment_id", "left")
    rows = rows.withColumn("month", F.date_format("taken_at", "yyyy-MM"))
    pin = F.coalesce(F.col("is_best") & F.col("_pin"), F.lit(False))
    order = [F.desc(F.col("favorite").cast("int")), F.desc(pin.cast("int")), F.desc(F.coalesce("score", F.lit(0.0))), F.asc("sha256")]
    one = rows.withColumn("_one", F.row_number().over(Window.partitionBy("month", "moment_id").orderBy(*order))).where("_one = 1")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy(*order)))
    return ranked.where(F.col("rank") <= most).select("month", "moment_id", "sha256", "rank")


def day_thumbs(records: DataFrame, day: str, order: list[str], most: int = 12) -> DataFrame:
    """(day, place, sha256, more): the first records of a day, and how many more there are."""
    rows = records.withColumn("place", F.row_number().over(Window.partitionBy(day).orderBy(*order))).where(F.col("place") <= most)
    total = records.groupBy(day).agg(F.count("*").alias("_n"))
    return rows.join(total, day).select(F.col(day).alias("day"), "place", "sha256", F.greatest(F.col("_n") - most, F.lit(0)).alias("more"))
