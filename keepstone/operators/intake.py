"""From listed files to rows: what each file became and why, with failures as rows, and what packages bring along."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.config import EMPTY_SHA256, VIDEO_EXTENSIONS
from keepstone.functions.scalars import header_time
from keepstone.operators.ingest import companions, route_content

#: Least side of an image that counts as readable, and the least spread of its gray values.
LEAST_SIDE, LEAST_SPREAD = 16, 2.0
#: How the names of recordings begin that a camera hasn't finished.
UNFINISHED = ".temp-"


def ingest_rows(
    plan: DataFrame, read: DataFrame, clips: DataFrame, entities: DataFrame, tombstones: DataFrame, members: DataFrame | None = None
) -> DataFrame:
    """(path, kind, sha256, status, reason, outcome) for every file of a plan that has to be looked at.

    plan (path, size, mtime, kind, action); read (path, sha256, error, read_size, read_mtime) of what could be read;
    clips (path, photo_path); members (path) of packages in which frames were found (null: all packages).

    Nothing is lost: a file that can't be understood is an error with its reason, and its bytes are routed among the
    others as long as they could be hashed. So are a package without frames and a recording that was never finished.
    Only junk, what changed while it was read, and what has no hash have no outcome.
    """
    todo = plan.where(~F.col("action").isin("unchanged", "arriving"))
    found = (members.select("path").distinct() if members is not None else plan.select("path").distinct()).withColumn("_frames", F.lit(True))
    rows = todo.join(read, "path", "left").join(clips.select("path", "photo_path"), "path", "left").join(found, "path", "left")
    moved = (F.col("read_size") != F.col("size")) | (F.col("read_mtime") != F.col("mtime"))
    temporary = (F.col("kind") == "video") & F.lower(F.substring_index("path", "/", -1)).startswith(UNFINISHED)
    clip = (F.col("kind") == "video") & F.col("photo_path").isNotNull()
    status = (
        F.when(F.col("action") == "empty", "junk")
        .when(F.col("kind") == "junk", "junk")
        .when(moved, "arriving")
        .when(temporary & F.col("sha256").isNotNull(), "other")
        .when(F.col("error").isNotNull() | F.col("sha256").isNull(), "error")
        .when(clip, "clip")
        .when((F.col("kind") == "rich") & F.col("_frames"), "package")
        .when(F.col("kind").isin("image", "video", "sidecar"), F.col("kind"))
        .otherwise("other")
    )
    ext = F.regexp_extract(F.lower("path"), r"(\.[^./]*)$", 1)
    reason = (
        F.when(F.col("action") == "empty", "empty file")
        .when(F.col("kind") == "junk", "junk file")
        .when(moved, "changed while it was read")
        .when(temporary & F.col("sha256").isNotNull(), "unfinished recording")
        .when(F.col("error").isNotNull(), F.concat(F.lit("unreadable: "), F.col("error")))
        .when(F.col("sha256").isNull(), "not read")
        .when(F.col("status") == "other", F.concat(F.lit("not a photo or video ("), F.when(ext == "", "no extension").otherwise(ext), F.lit(")")))
    )
    sha = F.when(F.col("action") == "empty", EMPTY_SHA256).otherwise(F.col("sha256"))
    named = rows.withColumn("status", status).withColumn("reason", reason).select("path", "kind", sha.alias("sha256"), "status", "reason")
    good = named.where(F.col("sha256").isNotNull() & ~F.col("status").isin("junk", "arriving")).select("path", "sha256")
    routed = route_content(good, entities, tombstones).select("path", "outcome")
    return named.join(routed, "path", "left")


def package_frames(rows: DataFrame, frames: DataFrame, entities: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(package_sha, member, sha256, outcome) of the frames of packages that came new; frames (package_sha, member, sha256)."""
    new = rows.where((F.col("status") == "package") & (F.col("outcome") == "new")).select(F.col("sha256").alias("package_sha")).distinct()
    mine = frames.join(new, "package_sha", "left_semi").withColumn("path", F.concat_ws("!", "package_sha", "member"))
    routed = route_content(mine.select("path", "sha256"), entities, tombstones).select("path", "outcome")
    return mine.join(routed, "path").select("package_sha", "member", "sha256", "outcome")


def checked_frames(frames: DataFrame, wanted: DataFrame) -> DataFrame:
    """(package_sha, member, sha256, ok): whether a frame that is taken out again still is what it was.

    frames (package_sha, member, data); wanted (package_sha, member, sha256). A member that isn't there isn't right.
    """
    there = frames.select("package_sha", "member", F.sha2("data", 256).alias("_found"))
    return wanted.join(there, ["package_sha", "member"], "left").select(
        "package_sha", "member", "sha256", F.coalesce(F.col("_found") == F.col("sha256"), F.lit(False)).alias("ok")
    )


def video_facts(probed: DataFrame) -> DataFrame:
    """(path, duration, width, height) from what a decoder reports (path, frames, fps, width, height); no rate, no duration."""
    return probed.select("path", F.when(F.col("fps") > 0, F.col("frames") / F.col("fps")).alias("duration"), "width", "height")


def companion_times(listing: DataFrame, headers: DataFrame, now_year: int) -> DataFrame:
    """(path, companion_time) of videos whose .thm file beside them carries a date; headers (path, header)."""
    beside = companions(listing, ".thm", list(VIDEO_EXTENSIONS))
    told = headers.select(F.col("path").alias("companion"), header_time(F.col("header"), now_year).alias("companion_time"))
    return beside.join(told, "companion").where("companion_time is not null").select("path", "companion_time")


def recover(attempts: DataFrame) -> DataFrame:
    """(sha256, attempt, outcome): the first attempt at a damaged image that gives something usable.

    attempts (sha256, attempt, width, height, spread): one row for each way that was tried, in order; null sizes stand
    for one that failed. An image is usable from 16 pixels a side on, unless it is one flat colour.
    """
    usable = (F.col("width") >= LEAST_SIDE) & (F.col("height") >= LEAST_SIDE) & (F.col("spread") >= LEAST_SPREAD)
    first = attempts.groupBy("sha256").agg(F.min(F.when(usable, F.col("attempt"))).alias("attempt"))
    return first.select("sha256", "attempt", F.when(F.col("attempt").isNull(), "failed").otherwise("recovered").alias("outcome"))

