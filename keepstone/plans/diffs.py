"""Plans: what would be copied, moved, removed, written or uploaded, as DataFrames. Nothing is carried out here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def curate_plan(desired: DataFrame, current: DataFrame, listing: DataFrame | None, sources: DataFrame) -> DataFrame:
    """(sha256, path, from_path, action): unchanged, adopt, move, repaired (it should be there, but isn't), copy, missing
    or conflict.

    desired (sha256, path), current (sha256, path), listing (path, sha256) of the library, or None to trust current;
    sources (sha256, path) of files that could be copied.
    """
    d = desired.select("sha256", F.col("path").alias("want"))
    c = current.select("sha256", F.col("path").alias("have"))
    s = sources.groupBy("sha256").agg(F.min("path").alias("source"))
    plan = d.join(c, "sha256", "left").join(s, "sha256", "left")
    if listing is None:
        plan = plan.withColumns({"at_want": F.when(F.col("have") == F.col("want"), F.col("sha256")), "at_have": F.when(F.col("have").isNotNull(), F.col("sha256"))})
    else:
        a = listing.select(F.col("path").alias("want"), F.col("sha256").alias("at_want"))
        b = listing.select(F.col("path").alias("have"), F.col("sha256").alias("at_have"))
        plan = plan.join(a, "want", "left").join(b, "have", "left")
    action = (
        F.when(F.col("at_want").isNotNull() & (F.col("at_want") != F.col("sha256")), "conflict")
        .when(F.col("at_want").isNotNull() & F.col("have").eqNullSafe(F.col("want")), "unchanged")
        .when(F.col("at_want").isNotNull(), "adopt")
        .when(F.col("at_have").isNotNull(), "move")
        .when(F.col("source").isNotNull(), F.when(F.col("have") == F.col("want"), "repaired").otherwise("copy"))
        .otherwise("missing")
    )
    made = plan.withColumn("action", action)
    origin = F.when(F.col("action") == "move", F.col("have")).when(F.col("action").isin("copy", "repaired"), F.col("source"))
    return made.select("sha256", F.col("want").alias("path"), origin.alias("from_path"), "action")


def sync_plan(wanted: DataFrame, have: DataFrame, key: str = "sha256") -> DataFrame:
    """(key, path, action): removed, unchanged, moved (same stamp, new path) or written; both sides (key, path, stamp)."""
    w = wanted.select(key, F.col("path").alias("w_path"), F.col("stamp").alias("w_stamp"))
    h = have.select(key, F.col("path").alias("h_path"), F.col("stamp").alias("h_stamp"))
    action = (
        F.when(F.col("w_path").isNull(), "removed")
        .when((F.col("w_path") == F.col("h_path")) & (F.col("w_stamp") == F.col("h_stamp")), "unchanged")
        .when(F.col("w_stamp") == F.col("h_stamp"), "moved")
        .otherwise("written")
    )
    return w.join(h, key, "full").select(key, F.coalesce("w_path", "h_path").alias("path"), action.alias("action"))


def publish_plan(wanted: DataFrame, published: DataFrame, version: int) -> DataFrame:
    """(name, action): new, unchanged or gone; wanted (name, sha256), published (name, sha256, version)."""
    p = published.select("name", F.col("sha256").alias("p_sha"), F.col("version").alias("p_version"))
    action = (
        F.when(F.col("sha256").isNull(), "gone").when((F.col("sha256") == F.col("p_sha")) & (F.col("p_version") == version), "unchanged").otherwise("new")
    )
    return wanted.select("name", "sha256").join(p, "name", "full").select("name", action.alias("action"))


def complete_names(remote: DataFrame, sizes: int) -> DataFrame:
    """Names that a remote listing (size, name) has in every size."""
    return remote.groupBy("name").agg(F.count_distinct("size").alias("n")).where(F.col("n") == sizes).select("name")


def verified_plan(plan: DataFrame, published: DataFrame, remote: DataFrame, wanted: DataFrame, sizes: int) -> DataFrame:
    """A publish plan checked against what is really there: complete but unrecorded names are adopted, recorded but
    incomplete ones uploaded again, strays removed."""
    flag = lambda df, name: df.select("name", F.lit(True).alias(name)).distinct()
    names = plan.select("name", "action").join(flag(complete_names(remote, sizes), "complete"), "name", "full")
    names = names.join(flag(published, "recorded"), "name", "full").join(flag(remote, "there"), "name", "full").join(flag(wanted, "wanted"), "name", "full")
    yes = lambda c: F.coalesce(c, F.lit(False))
    action = (
        F.when(~yes("wanted"), F.when(yes("there") | (F.col("action") == "gone"), "gone"))
        .when(yes("recorded") & ~yes("complete"), "new")
        .when((F.col("action") == "new") & yes("complete") & ~yes("recorded"), "adopted")
        .otherwise(F.col("action"))
    )
    return names.select("name", action.alias("action")).where("action is not null")


def verify_files(listing: DataFrame, sources: DataFrame, placed: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(path, ok, message): may a listed file be deleted? placed (sha256, library_path) of files that are in place."""
    s = sources.select("path", *[F.col(c).alias(f"s_{c}") for c in ("size", "mtime", "status", "reason", "sha256")], F.lit(True).alias("_s"))
    t = tombstones.select(F.col("sha256").alias("s_sha256"), "purged")
    p = placed.select(F.col("sha256").alias("s_sha256"), "library_path")
    j = listing.join(s, "path", "left").join(p, "s_sha256", "left").join(t, "s_sha256", "left")
    changed = (F.col("size") != F.col("s_size")) | (F.col("mtime") != F.col("s_mtime"))
    message = (
        F.when(F.col("_s").isNull(), "not ingested yet")
        .when(changed, "changed since it was ingested")
        .when(F.col("s_status") == "junk", F.coalesce("s_reason", F.lit("junk")))
        .when(F.col("purged"), "deleted for good")
        .when(~F.col("purged"), "deleted, in the trash")
        .when(F.col("library_path").isNotNull(), F.col("library_path"))
        .otherwise("not copied yet")
    )
    ok = F.col("_s").isNotNull() & ~changed & ((F.col("s_status") == "junk") | F.col("purged").isNotNull() | F.col("library_path").isNotNull())
    return j.select("path", F.coalesce(ok, F.lit(False)).alias("ok"), message.alias("message"))


def render_sizes(width: Column, sizes: list[int]) -> Column:
    """Widths to render, never beyond the original, largest first."""
    return F.array_distinct(F.transform(F.array(*[F.lit(s) for s in sorted(sizes, reverse=True)]), lambda s: F.least(width, s)))


def allowed_metadata(tags: Column, allow: list[str]) -> Column:
    return F.map_filter(tags, lambda k, _: k.isin(allow))


def refuse_private(chosen: DataFrame, records: DataFrame) -> DataFrame:
    """chosen, or an error naming how many of them are private."""
    n = chosen.join(records.where("private"), "sha256", "left_semi").count()
    if n:
        raise ValueError(f"{n} private records can't be exported")
    return chosen


def manifest(favourites: DataFrame, people: DataFrame, tags: DataFrame, ranges: DataFrame) -> DataFrame:
    """(name, entry): one JSON object each; event is there even if null, people even if empty, other keys only if set.

    favourites (sha256, name, taken_at, top, private) without private ones; people (sha256, person), tags (sha256, tag).
    """
    from keepstone.functions.scalars import top_slug
    from keepstone.operators.intervals import most_specific

    open_rows = favourites.where(~F.col("private"))
    who = people.groupBy("sha256").agg(F.array_sort(F.collect_set("person")).alias("people"))
    tagged = tags.groupBy("sha256").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    j = most_specific(open_rows, "taken_at", ranges, "sha256").join(who, "sha256", "left").join(tagged, "sha256", "left")
    nested = F.when(F.col("slug").contains("/"), F.col("slug"))
    text = F.concat(
        F.lit('{"id":'), F.to_json(F.array("name")).substr(F.lit(2), F.length(F.to_json(F.array("name"))) - 2),
        F.lit(',"taken_at":"'), F.date_format("taken_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('","people":'),
        F.to_json(F.coalesce("people", F.expr("cast(array() as array<string>)"))),
        F.lit(',"event":'), F.coalesce(F.concat(F.lit('"'), top_slug(F.col("slug")), F.lit('"')), F.lit("null")),
        F.coalesce(F.concat(F.lit(',"sub_event":"'), nested, F.lit('"')), F.lit("")),
        F.coalesce(F.concat(F.lit(',"tags":'), F.to_json("tags")), F.lit("")),
        F.when(F.col("top"), ',"top":true').otherwise(""), F.lit("}"),
    )
    return j.select("name", text.alias("entry"))


def export_plan(picks: DataFrame, there: DataFrame, originals: bool = False) -> DataFrame:
    """(sha256, target, action): copies of picks (sha256, name, path) into one flat folder; files there are skipped."""
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1) if originals else F.lit(".jpg")
    wanted = picks.select("sha256", F.concat("name", ext).alias("target"))
    have = there.select(F.col("path").alias("target"), F.lit(True).alias("_there")).distinct()
    return wanted.join(have, "target", "left").select("sha256", "target", F.when(F.col("_there"), "skip").otherwise("copy").alias("action"))


def strays(desired: DataFrame, listing: DataFrame) -> DataFrame:
    """(sha256, path, found): files of the right name and content elsewhere in the folders of their day."""
    d = desired.select("sha256", "path", F.substring(F.element_at(F.split("path", "/"), 2), 1, 10).alias("day"), F.substring_index("path", "/", -1).alias("file"))
    parts = F.split("path", "/")
    there = listing.where(F.size(parts) >= 3).select(
        "sha256", F.col("path").alias("found"), F.substring(F.element_at(parts, 2), 1, 10).alias("day"), F.substring_index("path", "/", -1).alias("file")
    )
    missing = d.join(listing.select("path"), "path", "left_anti").where(F.size(F.split("path", "/")) >= 3)
    return missing.join(there, ["sha256", "day", "file"]).groupBy("sha256", "path").agg(F.min("found").alias("found"))


def tables_as_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(relation, row): every row of every relation as one JSON object, nulls left out."""
    out = None
    for name, df in tables.items():
        rows = df.select(F.lit(name).alias("relation"), F.to_json(F.struct(*df.columns)).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def weighted_progress(stages: DataFrame) -> DataFrame:
    """(done): the share of all work that is done; stages (weight, fraction)."""
    return stages.agg((F.sum(F.col("weight") * F.col("fraction")) / F.sum("weight")).alias("done"))


def companion_paths(targets: DataFrame, placed: DataFrame, ext: str) -> DataFrame:
    """(package_sha, path): beside the photo that a package belongs to; targets (package_sha, sha256), placed (sha256, path)."""
    base = F.regexp_replace("path", r"\.[^./]*$", "")
    return targets.join(placed.select("sha256", "path"), "sha256").select("package_sha", F.concat(base, F.lit(ext)).alias("path"))
