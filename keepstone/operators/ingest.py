"""Incremental ingest: what is new or changed, exact copies, upserts, dates again, clean-up after replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.config import EMPTY_SHA256, NO_TIME
from keepstone.functions.scalars import batch_name, extension, file_kind, folder_time


def unchanged(kind: Column) -> Column:
    """Known with this size and time, hashed or junk, not failed last time, and not of a kind understood since."""
    same = (F.col("size") == F.col("known_size")) & (F.col("mtime") == F.col("known_mtime"))
    read = F.col("known_sha256").isNotNull() | (F.col("known_status") == "junk")
    redo = (F.col("known_status") == "error") | ((F.col("known_status") == "other") & kind.isin("rich", "image"))
    return F.coalesce(same & read & ~redo, F.lit(False))


def ingest_plan(listing: DataFrame, known: DataFrame, now: float | None = None, settle: float = 120.0) -> DataFrame:
    """listing (path, size, mtime) plus kind, batch and action: unchanged, arriving, empty, new or changed.

    A listing may have a ctime as well: a file settles from the later of both on.
    """
    k = known.select("path", *[F.col(c).alias(f"known_{c}") for c in ("size", "mtime", "status", "sha256")], F.lit(True).alias("_known"))
    joined = listing.join(k, "path", "left").withColumns({"kind": file_kind(F.col("path")), "batch": batch_name(F.col("path"))})
    clock = F.lit(now) if now is not None else F.unix_timestamp().cast("double")
    touched = F.greatest("mtime", "ctime") if "ctime" in listing.columns else F.col("mtime")
    action = (
        F.when(unchanged(F.col("kind")), "unchanged")
        .when(clock - touched < settle, "arriving")
        .when(F.col("size") == 0, "empty")
        .when(F.col("_known").isNull(), "new")
        .otherwise("changed")
    )
    return joined.select("path", "size", "mtime", "kind", "batch", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace rows of ``old`` with their key; of rows of ``new`` with one key the least counts."""
    one = new.groupBy(key).agg(F.min(F.struct(*[c for c in new.columns if c != key])).alias("_row")).select(key, "_row.*").select(*new.columns)
    return old.join(new.select(key), key, "left_anti").unionByName(one, allowMissingColumns=True)


def route_content(batch: DataFrame, entities: DataFrame, tombstones: DataFrame) -> DataFrame:
    """batch (path, sha256) plus outcome: deleted (never comes back), duplicate, or new (first path of a content)."""
    gone = tombstones.select("sha256", F.lit(True).alias("_gone")).distinct()
    here = entities.select("sha256", F.lit(True).alias("_here")).distinct()
    firsts = batch.groupBy("sha256").agg(F.min("path").alias("_first"))
    joined = batch.join(gone, "sha256", "left").join(here, "sha256", "left").join(firsts, "sha256")
    outcome = F.when(F.col("_gone"), "deleted").when(F.col("_here"), "duplicate").when(F.col("path") == F.col("_first"), "new").otherwise("duplicate")
    return joined.withColumn("outcome", outcome).drop("_gone", "_here", "_first")


def empties_as_junk(sources: DataFrame) -> DataFrame:
    hit = (F.col("sha256") == EMPTY_SHA256) & (F.col("status") != "junk")
    reason = F.when(hit, F.lit("empty file")).otherwise(F.col("reason"))
    return sources.withColumns({"reason": reason, "status": F.when(hit, "junk").otherwise(F.col("status"))})


def live_clips(listing: DataFrame, most_seconds: float = 5.0) -> DataFrame:
    """(path, photo_path) of short clips beside a photo of the same stem; of several photos the first kind wins."""
    stem = F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    rows = listing.withColumns({"stem": stem, "ext": extension(F.col("path"))})
    clips = rows.where(F.col("ext").isin(".mov", ".mp4") & (F.col("duration").isNull() | (F.col("duration") <= most_seconds)))
    order = F.expr("array_position(array('.heic', '.heif', '.jpg', '.jpeg'), ext)")
    photos = rows.where(order > 0).groupBy("stem").agg(F.min_by("path", F.struct(order, "path")).alias("photo_path"))
    return clips.join(photos, "stem").select("path", "photo_path")


def redate(records: DataFrame, sources: DataFrame, published: DataFrame, now_year: int) -> DataFrame:
    """Records dated by file time get their folder's date; their name is dropped unless they are published."""
    paths = sources.groupBy("sha256").agg(F.min("path").alias("_path"))
    out = published.select("sha256", F.lit(True).alias("_published")).distinct()
    joined = records.join(paths, "sha256", "left").join(out, "sha256", "left").withColumn("_found", folder_time(F.col("_path"), now_year))
    hit = (F.col("date_source") == "mtime") & F.col("_found").isNotNull()
    return joined.withColumns(
        {
            "taken_at": F.when(hit, F.col("_found.taken_at")).otherwise(F.col("taken_at")),
            "date_source": F.when(hit, F.col("_found.source")).otherwise(F.col("date_source")),
            "name": F.when(hit & F.col("_published").isNull(), F.lit(None)).otherwise(F.col("name")),
        }
    ).select(*records.columns)


def redate_from_companions(videos: DataFrame, companions: DataFrame) -> DataFrame:
    """Videos without a real time take that of their companion (sha256, companion_time)."""
    hit = F.col("date_source").isin(*NO_TIME) & F.col("companion_time").isNotNull()
    return videos.join(companions, "sha256", "left").withColumns(
        {"taken_at": F.when(hit, F.col("companion_time")).otherwise(F.col("taken_at")), "date_source": F.when(hit, "meta").otherwise(F.col("date_source"))}
    ).select(*videos.columns)


def forget_unreferenced(entities: DataFrame, sources: DataFrame, frames: DataFrame) -> DataFrame:
    """Entities whose content some source, or some frame of a referenced package, still has.

    frames (package_sha, sha256): a frame lives as long as its package does.
    """
    direct = sources.where("sha256 is not null").select("sha256").distinct()
    through = frames.join(direct.withColumnRenamed("sha256", "package_sha"), "package_sha", "left_semi").select("sha256")
    return entities.join(direct.unionByName(through).distinct(), "sha256", "left_semi")


def recovery_candidates(sources: DataFrame, recoveries: DataFrame, retry: bool = False) -> DataFrame:
    """Unreadable images not tried yet (or, on retry, that failed): (sha256, path), first path of each content."""
    tried = recoveries if not retry else recoveries.where("outcome = 'recovered'")
    bad = sources.where((F.col("status") == "error") & F.col("sha256").isNotNull() & (file_kind(F.col("path")) == "image"))
    return bad.join(tried.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.min("path").alias("path"))


def first_source(sources: DataFrame, listing: DataFrame) -> DataFrame:
    """(sha256, path): the first path of each content that is still there."""
    return sources.join(listing.select("path"), "path", "left_semi").groupBy("sha256").agg(F.min("path").alias("path"))


def companion_target(packages: DataFrame, frames: DataFrame, records: DataFrame) -> DataFrame:
    """(package_sha, sha256): what a package stands beside: its finished photo, else the preferred frame, if any.

    packages (package_sha, photo_sha), frames (package_sha, member, sha256).
    """
    known = records.select("sha256")
    finished = packages.join(known.withColumnRenamed("sha256", "photo_sha"), "photo_sha", "left_semi").select("package_sha", F.col("photo_sha").alias("_photo"))
    order = F.struct(F.lower("member") != "reference.jpg", F.col("member"))
    framed = frames.join(known, "sha256", "left_semi").groupBy("package_sha").agg(F.min_by("sha256", order).alias("_frame"))
    joined = packages.select("package_sha").join(finished, "package_sha", "left").join(framed, "package_sha", "left")
    return joined.select("package_sha", F.coalesce("_photo", "_frame").alias("sha256"))


def moved_files(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Reconcile (root, path, sha256) with what is there: moved (with new_path), missing, unknown; each file is used once.

    Files that nobody expects are matched by content in path order on both sides.
    """
    missing = expected.join(listing.select("root", "path"), ["root", "path"], "left_anti")
    unknown = listing.join(expected.select("root", "path"), ["root", "path"], "left_anti")
    w = Window.partitionBy("root", "sha256").orderBy("path")
    m = missing.withColumn("n", F.row_number().over(w))
    u = unknown.select("root", "sha256", F.col("path").alias("new_path"), F.row_number().over(Window.partitionBy("root", "sha256").orderBy("path")).alias("n"))
    both = m.join(u, ["root", "sha256", "n"], "full")
    kind = F.when(F.col("path").isNull(), "unknown").when(F.col("new_path").isNull(), "missing").otherwise("moved")
    return both.select("root", "sha256", "path", "new_path", kind.alias("kind"))


def hash_candidates(expected: DataFrame, listing: DataFrame) -> DataFrame:
    """Listed files (root, path, size) that nobody expects and whose size some missing file of their root has: only their
    contents have to be read to find what was moved. expected (root, path, size)."""
    missing = expected.join(listing.select("root", "path"), ["root", "path"], "left_anti").select("root", "size").distinct()
    unknown = listing.join(expected.select("root", "path"), ["root", "path"], "left_anti")
    return unknown.join(missing, ["root", "size"], "left_semi").select("root", "path", "size")


def with_retries(batch: DataFrame, failed: DataFrame, key: str = "path") -> DataFrame:
    """A batch together with what failed before, each key once: what the batch has of a key counts."""
    return batch.unionByName(failed.join(batch.select(key), key, "left_anti").select(*batch.columns))


def companions(listing: DataFrame, ext: str, of: list[str]) -> DataFrame:
    """(path, companion) of files with one extension beside files of the same folder and stem with others."""
    stem = F.lower(F.regexp_replace("path", r"\.[^./]*$", ""))
    rows = listing.select("path", stem.alias("stem"), extension(F.col("path")).alias("ext"))
    mine = rows.where(F.col("ext") == ext).groupBy("stem").agg(F.min("path").alias("companion"))
    return rows.where(F.col("ext").isin(*of)).join(mine, "stem").select("path", "companion")


def record_outcomes(recoveries: DataFrame, tried: DataFrame) -> DataFrame:
    """recoveries with new outcomes (sha256, outcome), which replace old ones."""
    return upsert(recoveries, tried, "sha256")


def drop_replaced(others: DataFrame, recovered: DataFrame) -> DataFrame:
    """Unsorted files without those whose content has become a record."""
    return others.join(recovered.select("sha256"), "sha256", "left_anti")


def ingest_counts(plan: DataFrame) -> DataFrame:
    """(kind, action, n): the counters of a run."""
    return plan.groupBy("kind", "action").agg(F.count("*").alias("n"))
