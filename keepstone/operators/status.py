"""What changed since a day was last looked at, by fingerprints of its members and their groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.functions.scalars import unordered_digest

# The states of a day.
NEW, REVIEWED, ADDED, UPDATED = "new", "reviewed", "pics added", "moments updated"
#: The digest of no members.
NO_MEMBERS = "0-0-0"


def fingerprints(records: DataFrame) -> DataFrame:
    """(day, members_sig, groups_sig, records): groups count by who is in them, not by their id.

    Digests are added up in parts, so neither a day nor a group is ever gathered.
    """
    rows = records.where("day is not null")
    groups = rows.groupBy("day", "moment_id").agg(unordered_digest(F.col("sha256")).alias("g"), F.count("*").alias("n"))
    of_groups = groups.groupBy("day").agg(unordered_digest(F.sha2("g", 256)).alias("groups_sig"), F.sum("n").alias("records"))
    of_members = rows.groupBy("day").agg(unordered_digest(F.col("sha256")).alias("members_sig"))
    return of_members.join(of_groups, "day").select("day", "members_sig", "groups_sig", "records")


def day_status(current: DataFrame, marks: DataFrame) -> DataFrame:
    """(day, status): new, reviewed, pics added or moments updated, for days with records or a mark."""
    m = marks.select("day", F.col("members_sig").alias("_m"), F.col("groups_sig").alias("_g"), F.col("records").alias("_n"), F.lit(True).alias("_marked"))
    both = current.join(m, "day", "full")
    members, groups, n = F.coalesce("members_sig", F.lit(NO_MEMBERS)), F.coalesce("groups_sig", F.lit(NO_MEMBERS)), F.coalesce("records", F.lit(0))
    status = (
        F.when(F.col("_marked").isNull(), NEW)
        .when(F.col("_m").isNull(), REVIEWED)
        .when(F.col("_m") != members, F.when(n > F.coalesce("_n", F.lit(0)), ADDED).otherwise(UPDATED))
        .when(F.col("_g") != groups, UPDATED)
        .otherwise(REVIEWED)
    )
    return both.select("day", status.alias("status"))


def mark(marks: DataFrame, current: DataFrame, days: DataFrame) -> DataFrame:
    """marks with the given days as they are now; a day without records is marked as empty."""
    now = days.select("day").distinct().join(current, "day", "left").select(
        "day", F.coalesce("members_sig", F.lit(NO_MEMBERS)).alias("members_sig"), F.coalesce("groups_sig", F.lit(NO_MEMBERS)).alias("groups_sig"), F.coalesce("records", F.lit(0)).alias("records")
    )
    return marks.join(now.select("day"), "day", "left_anti").unionByName(now, allowMissingColumns=True)


def backfill(marks: DataFrame, current: DataFrame) -> DataFrame:
    """Marks from before fingerprints take today's."""
    return mark(marks, current, marks.where("members_sig is null"))


def toggle_reviewed(marks: DataFrame, current: DataFrame, days: DataFrame) -> DataFrame:
    """Take the mark off days that are reviewed as they are; mark all others as they are now."""
    reviewed = day_status(current, marks).where(F.col("status") == REVIEWED).select("day")
    off = days.select("day").join(reviewed, "day", "left_semi")
    return mark(marks.join(off, "day", "left_anti"), current, days.select("day").join(reviewed, "day", "left_anti"))


def keep_reviewed(marks: DataFrame, before: DataFrame, after: DataFrame, days: DataFrame) -> DataFrame:
    """One's own edit keeps a reviewed day reviewed: days reviewed before it are marked as they are after it."""
    reviewed = day_status(before, marks).where(F.col("status") == REVIEWED).select("day")
    return mark(marks, after, days.select("day").join(reviewed, "day", "left_semi"))
