"""User decisions as relations: each function takes relations and returns the changed ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.functions.scalars import clean_tag, unordered_digest
from keepstone.operators.ordering import running_sums


def pick_best(records: DataFrame, moment_id: str, sha256: str | None) -> DataFrame:
    """Pick a member of a group, or clear the pick; other groups keep theirs."""
    here = F.col("moment_id") == moment_id
    return records.withColumn("user_best", F.when(here, F.col("sha256") == F.lit(sha256) if sha256 else F.lit(False)).otherwise(F.col("user_best")))


def combine(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """(sha256, moment_id) overrides that put the groups of the chosen (sha256) best members into one.

    The target is the group of the earliest member. Fewer than two groups, or a member that isn't best, is an error.
    """
    keys = chosen.select("sha256").distinct()
    picked = records.join(keys, "sha256", "left_semi")
    groups = picked.select("moment_id").distinct()
    found, best, several = picked.agg(F.count("*"), F.count_if("is_best"), F.count_distinct("moment_id")).first()
    if found != keys.count() or best != found:
        raise ValueError("choose best members only")
    if several < 2:
        raise ValueError("choose members of two groups at least")
    members = records.join(groups, "moment_id", "left_semi")
    target = members.agg(F.min_by("moment_id", F.struct("taken_at", "sha256"))).first()[0]
    return members.select("sha256", F.lit(target).alias("moment_id"))


def split_id(moment_id: str, digest: str, occupied: DataFrame | None = None) -> str:
    """A stable id for the part that leaves a group, from a digest of its members; ids that ``occupied`` (moment_id) has
    are passed over."""
    n = 0
    while True:
        made = hashlib.sha256(f"split:{moment_id}:{digest}{f':{n}' if n else ''}".encode()).hexdigest()
        if occupied is None or occupied.where(F.col("moment_id") == made).isEmpty():
            return made
        n += 1


def split(records: DataFrame, moment_id: str, chosen: DataFrame) -> DataFrame:
    """(sha256, moment_id) overrides for both parts of a group, of which the chosen (sha256) leave; refuses an empty or a
    full part."""
    keys = chosen.select("sha256", F.lit(True).alias("_out")).distinct()
    members = records.where(F.col("moment_id") == moment_id).select("sha256").join(keys, "sha256", "left")
    out = F.when(F.col("_out"), F.col("sha256"))
    total, inside, digest = members.agg(F.count("*"), F.count(out), unordered_digest(out)).first()
    if not inside or inside != keys.count() or inside == total:
        raise ValueError("choose some, but not all, members of the group")
    new = split_id(moment_id, digest, records.select("moment_id"))
    return members.select("sha256", F.when(F.col("_out"), new).otherwise(F.lit(moment_id)).alias("moment_id"))


def regroup(records: DataFrame, overrides: DataFrame, pins: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, touched, pins) after manual changes of groups, overrides (sha256, moment_id), for those records alone.

    touched (moment_id) has old and new groups; pins of touched groups that have no member left go.
    """
    o = overrides.select("sha256", F.col("moment_id").alias("_m"))
    joined = records.join(o, "sha256", "left")
    old = joined.where("_m is not null").select("moment_id")
    moved = joined.withColumn("moment_id", F.coalesce("_m", "moment_id")).select(*records.columns)
    touched = old.unionByName(o.select(F.col("_m").alias("moment_id"))).distinct()
    empty = touched.join(moved.select("moment_id"), "moment_id", "left_anti")
    return moved, touched, pins.join(empty, "moment_id", "left_anti")


def set_pin(pins: DataFrame, moments: DataFrame, chosen: DataFrame, pinned: bool) -> DataFrame:
    """pins (moment_id) with the chosen groups added or taken away; groups that have no member are not added."""
    keys = chosen.select("moment_id").distinct()
    if not pinned:
        return pins.join(keys, "moment_id", "left_anti")
    return pins.unionByName(keys.join(moments.select("moment_id"), "moment_id", "left_semi")).distinct()


def pin_starred(pins: DataFrame, records: DataFrame, starred: DataFrame) -> DataFrame:
    """Starring a record pins its group; taking the star off later leaves the pin."""
    return set_pin(pins, records, records.join(starred.select("sha256"), "sha256", "left_semi"), True)


def save_draft(drafts: DataFrame, name: str, fields: DataFrame) -> DataFrame:
    """drafts (name, body) with the one row of ``fields`` stored under a name as JSON; nulls are left out."""
    made = fields.limit(1).select(F.lit(name).alias("name"), F.to_json(F.struct(*fields.columns)).alias("body"))
    return drafts.where(F.col("name") != name).unionByName(made)


def save_drafts(drafts: DataFrame, fields: DataFrame) -> DataFrame:
    """drafts (name, body) with every row of ``fields`` (name and others) stored as JSON; of rows of a name the least counts."""
    made = fields.groupBy("name").agg(F.min(F.to_json(F.struct(*[c for c in fields.columns if c != "name"]))).alias("body"))
    return drafts.join(made.select("name"), "name", "left_anti").unionByName(made)


def load_drafts(drafts: DataFrame, names: DataFrame, schema: str) -> DataFrame:
    """The stored fields of all ``names`` (name); a name that isn't there has nulls, unknown fields are dropped."""
    told = names.select("name").join(drafts, "name", "left").withColumn("d", F.from_json(F.coalesce("body", F.lit("{}")), schema))
    return told.select("name", "d.*")


def load_draft(drafts: DataFrame, name: str, schema: str) -> DataFrame:
    """The stored fields; a name that isn't there gives one row of nulls, unknown fields are dropped."""
    body = drafts.where(F.col("name") == name).agg(F.coalesce(F.max("body"), F.lit("{}")).alias("body"))
    return body.select(F.from_json("body", schema).alias("d")).select("d.*")


def undo(now: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Members as they were in a snapshot (sha256, moment_id, user_best), others as they are."""
    s = snapshot.select("sha256", F.col("moment_id").alias("_m"), F.col("user_best").alias("_u"), F.lit(True).alias("_s"))
    joined = now.join(s, "sha256", "left")
    back = F.coalesce("_s", F.lit(False))
    return joined.withColumns(
        {"moment_id": F.when(back, F.col("_m")).otherwise(F.col("moment_id")), "user_best": F.when(back, F.col("_u")).otherwise(F.col("user_best"))}
    ).select(*now.columns)


def set_date(records: DataFrame, chosen: DataFrame, in_tray: DataFrame) -> DataFrame:
    """Chosen (sha256, taken_at, whole_day) get a date; a whole day means noon; names are dropped unless in the tray."""
    c = chosen.select("sha256", F.col("taken_at").alias("_t"), F.col("whole_day").alias("_d"))
    t = in_tray.select("sha256", F.lit(True).alias("_tray")).distinct()
    joined = records.join(c, "sha256", "left").join(t, "sha256", "left")
    hit = F.col("_t").isNotNull()
    noon = (F.date_trunc("day", F.col("_t")) + F.expr("interval 12 hours")).cast("timestamp_ntz")
    return joined.withColumns(
        {
            "taken_at": F.when(hit, F.when(F.col("_d"), noon).otherwise(F.col("_t"))).otherwise(F.col("taken_at")),
            "date_source": F.when(hit, F.when(F.col("_d"), "user-day").otherwise("user")).otherwise(F.col("date_source")),
            "name": F.when(hit & F.col("_tray").isNull(), F.lit(None)).otherwise(F.col("name")),
        }
    ).select(*records.columns)


def set_tags(tags: DataFrame, new: DataFrame) -> DataFrame:
    """Tags of the records in ``new`` (sha256, tag) are replaced; cleaned, without repeats. A null tag clears them."""
    cleaned = new.select("sha256", clean_tag(F.col("tag")).alias("tag")).where("tag is not null").distinct()
    return tags.join(new.select("sha256").distinct(), "sha256", "left_anti").unionByName(cleaned)


def toggle(relation: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that are in the relation leave it, others enter; extra columns of new rows are null."""
    name = keys.columns[0]
    kept = relation.join(keys, name, "left_anti")
    return kept.unionByName(keys.join(relation.select(name), name, "left_anti"), allowMissingColumns=True)


def append_positions(items: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New keys at the end of an ordered list (key, position); known ones stay where they are."""
    top = items.agg(F.coalesce(F.max("position"), F.lit(-1)).alias("_top"))
    fresh = new.join(items.select(key), key, "left_anti").select(key).distinct()
    numbered = running_sums(fresh, [], [key], {"_n": F.lit(1)})
    return items.unionByName(numbered.join(F.broadcast(top)).select(key, (F.col("_top") + F.col("_n")).cast("long").alias("position")))


def delete(records: DataFrame, doomed: DataFrame, dependents: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(records without the doomed, tombstones with the whole row as JSON, dependents without their rows)."""
    keys = doomed.select("sha256").distinct()
    gone = records.join(keys, "sha256", "left_semi")
    stones = gone.select("sha256", F.to_json(F.struct(*records.columns)).alias("data"), F.lit(False).alias("purged"))
    left = {name: df.join(keys, "sha256", "left_anti") for name, df in dependents.items()}
    return records.join(keys, "sha256", "left_anti"), stones, left


def restore(records: DataFrame, tombstones: DataFrame, wanted: DataFrame, derived: list[str]) -> DataFrame:
    """Records with the wanted ones back; derived columns start as null, stored columns that are no more are dropped."""
    rows = tombstones.where(~F.col("purged")).join(wanted.select("sha256").distinct(), "sha256", "left_semi")
    back = rows.select(F.from_json("data", records.schema).alias("r")).select("r.*")
    back = back.withColumns({c: F.lit(None).cast(records.schema[c].dataType) for c in derived})
    return records.unionByName(back.select(*records.columns))


def _chosen(vectors: DataFrame, chosen: DataFrame) -> DataFrame:
    """vectors plus ``_hit`` for those that were chosen (id)."""
    return vectors.join(chosen.select("id", F.lit(True).alias("_c")).distinct(), "id", "left").withColumn("_hit", F.coalesce("_c", F.lit(False))).drop("_c")


def identify(vectors: DataFrame, rejections: DataFrame, chosen: DataFrame, person: int) -> tuple[DataFrame, DataFrame]:
    """Name the chosen (id) vectors: the old person becomes a rejection, a rejection of the new one goes, ignored is cleared."""
    marked, hit = _chosen(vectors, chosen), F.col("_hit")
    old = marked.where(hit & F.col("person_id").isNotNull() & (F.col("person_id") != person)).select("id", "person_id")
    undone = chosen.select("id", F.lit(person).cast("long").alias("person_id")).distinct()
    kept = rejections.select("id", "person_id").join(undone, ["id", "person_id"], "left_anti")
    named = marked.withColumns(
        {
            "person_id": F.when(hit, F.lit(person).cast("long")).otherwise(F.col("person_id")),
            "label_source": F.when(hit, "user").otherwise(F.col("label_source")),
            "ignored": F.when(hit, F.lit(False)).otherwise(F.col("ignored")),
        }
    )
    return named.select(*vectors.columns), kept.unionByName(old).distinct()


def orphans(people: DataFrame, vectors: DataFrame) -> DataFrame:
    """People that no vector carries; null labels don't hide them."""
    return people.join(vectors.where("person_id is not null").select(F.col("person_id").alias("id")), "id", "left_anti")


def set_favourites(favourites: DataFrame, chosen: DataFrame, star: bool | None, top: bool | None) -> DataFrame:
    """favourites (sha256, top) after a click on each chosen record.

    Starring keeps what is known of the top mark; unstarring drops the row and so the mark; the top mark implies a star.
    """
    keys = chosen.select("sha256").distinct()
    others = favourites.join(keys, "sha256", "left_anti")
    if star is False:
        return others
    mine = keys.join(favourites, "sha256", "left")
    value = F.coalesce("top", F.lit(False)) if top is None else F.lit(top)
    if star is None and top is False:  # only the mark goes, and only where there is a star
        mine = mine.where("top is not null")
    return others.unionByName(mine.select("sha256", value.alias("top")))


def set_flag(records: DataFrame, chosen: DataFrame, flag: str, value: bool | None = None) -> DataFrame:
    """A boolean of the chosen records set, or flipped without a value."""
    c = chosen.select("sha256", F.lit(True).alias("_c")).distinct()
    new = ~F.col(flag) if value is None else F.lit(value)
    return records.join(c, "sha256", "left").withColumn(flag, F.when(F.col("_c"), new).otherwise(F.col(flag))).select(*records.columns)


def unlabel(vectors: DataFrame, rejections: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Take names off the chosen (id): what was given by a user or automatically becomes a rejection."""
    marked, hit = _chosen(vectors, chosen), F.col("_hit")
    old = marked.where(hit & F.col("person_id").isNotNull()).select("id", "person_id")
    blank = {c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in ("person_id", "label_source")}
    return marked.withColumns(blank).select(*vectors.columns), rejections.select("id", "person_id").unionByName(old).distinct()


def ignore(vectors: DataFrame, chosen: DataFrame, value: bool = True) -> DataFrame:
    """Chosen (id) vectors that are ignored lose their name; taking it back only lifts the mark."""
    marked, hit = _chosen(vectors, chosen), F.col("_hit")
    out = marked.withColumn("ignored", F.when(hit, F.lit(value)).otherwise(F.col("ignored")))
    if value:
        out = out.withColumns({c: F.when(hit, F.lit(None)).otherwise(F.col(c)) for c in ("person_id", "label_source")})
    return out.select(*vectors.columns)


def forget_missing(records: DataFrame, tombstones: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that were removed by hand become purged tombstones, so they don't come back."""
    left, stones, _ = delete(records, missing, {})
    return left, tombstones.unionByName(stones.withColumn("purged", F.lit(True)), allowMissingColumns=True)


def empty_trash(tombstones: DataFrame) -> DataFrame:
    return tombstones.withColumn("purged", F.lit(True))


def drop_stale_pins(pins: DataFrame, records: DataFrame) -> DataFrame:
    """Pins of groups that still have members."""
    return pins.join(records.select("moment_id").distinct(), "moment_id", "left_semi")
