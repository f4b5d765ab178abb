"""Bursts that are kept: late rows, deletions and edits fold again only those islands of time that they touch.

A store is a folder of three tables that only ever grow, each written once for a batch:

* ``rows``: records with their group, under the day on which their island begins (``cell``);
* ``index``: one row for each island and day that it reaches (camera, first, last), dead or alive;
* ``places``: the day under which a record is kept, under the first digits of its hash.

What counts is the latest batch that tells about an island, so a batch that stops half-way leaves nothing that is read:
its index is written last. All three are read by named folders only: the days around what changes, and the beginnings of
hashes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.config import NO_TIME
from keepstone.operators.bursts import folded
from keepstone.sources.shared import exists, stored

#: Folders (days, or beginnings of hashes) up to which they are read by name.
NAMED = 4096


def _day(micros: Column) -> Column:
    return F.concat(F.lit("d"), F.floor(micros / 86_400_000_000).cast("string"))


def _days(first: Column, last: Column) -> Column:
    """The cells of an interval in microseconds."""
    number = lambda c: F.floor(c / 86_400_000_000).cast("long")
    return F.transform(F.sequence(number(first), number(last)), lambda d: F.concat(F.lit("d"), d.cast("string")))


class BurstStore:
    """Groups of all records that were ever given to ``apply``, as a run of ``bursts`` over all of them would make them."""

    def __init__(self, spark: SparkSession, root: str, gap_seconds: float, most_bits: int):
        self.spark, self.root = spark, root
        self.gap_seconds, self.gap, self.most_bits = gap_seconds, int(gap_seconds * 1_000_000), most_bits

    def _table(self, name: str, folder: str, wanted: DataFrame | None) -> DataFrame | None:
        """A table's rows, of the folders in ``wanted`` (one column) only; no other folder is listed or read.

        Beyond ``NAMED`` folders they are found by a join, which lists all of them.
        """
        root = f"{self.root}/{name}"
        if not exists(self.spark, root):
            return None
        if wanted is None:
            return self.spark.read.parquet(root)
        named = [r[0] for r in wanted.distinct().limit(NAMED + 1).collect()]
        if len(named) > NAMED:
            return self.spark.read.parquet(root).join(wanted.distinct(), folder, "left_semi")
        there = [path for path in (f"{root}/{folder}={n}" for n in named) if exists(self.spark, path)]
        if not there:
            return self.spark.read.parquet(root).where("false")
        return self.spark.read.option("basePath", root).parquet(*there)

    def _append(self, df: DataFrame, name: str, folder: str) -> None:
        # A folder may hold nearly all rows (an island lies under its first day): those are dealt to as many tasks as they need.
        df.hint("rebalance", folder).write.mode("append").option("compression", "zstd").partitionBy(folder).parquet(f"{self.root}/{name}")

    def _live(self, cells: DataFrame | None) -> DataFrame | None:
        """(island, home, camera, first, last, batch, cell) of islands that are alive, a row for each cell that was read."""
        index = self._table("index", "cell", cells)
        if index is None:
            return None
        latest = index.groupBy("island", "cell").agg(F.max_by(F.struct("home", "camera", "first", "last", "live", "batch"), "batch").alias("x"))
        return latest.select("island", "cell", "x.*").where("live").drop("live")

    def _timed(self, rows: DataFrame) -> DataFrame:
        """rows plus camera key (null for a record without a real time, which stands alone) and microseconds."""
        camera = F.when(~F.col("date_source").isin(*NO_TIME), F.coalesce("camera", F.lit("")))
        return rows.withColumns({"_camera": camera, "_at": F.unix_micros(F.col("taken_at").cast("timestamp"))})

    def _hit(self, changes: DataFrame) -> DataFrame | None:
        """(island, home, batch, camera, first, last) of the islands within the gap of a change (_camera, _at, sha256)."""
        if not exists(self.spark, f"{self.root}/index"):
            return None
        near = changes.withColumn("cell", F.explode(_days(F.col("_at") - self.gap, F.col("_at") + self.gap)))
        near = stored(near.select("cell", "_camera", "_at", "sha256"), "near")
        live = self._live(near.select("cell"))
        if live is None:
            return None
        within = (F.col("_at") >= F.col("first") - self.gap) & (F.col("_at") <= F.col("last") + self.gap)
        timed = live.where("camera is not null").join(near, (live["cell"] == near["cell"]) & (F.col("camera") == F.col("_camera")) & within, "left_semi")
        alone = live.where("camera is null").join(near, (live["cell"] == near["cell"]) & (F.col("island") == F.col("sha256")), "left_semi")
        return timed.unionByName(alone).select("island", "home", "batch", "camera", "first", "last").distinct()

    def _rows(self, hit: DataFrame) -> DataFrame:
        """Records of islands, with their group."""
        rows = self._table("rows", "cell", hit.select(F.col("home").alias("cell")))
        return rows.join(hit.select("island", "batch"), ["island", "batch"], "left_semi").drop("island", "batch", "cell")

    def apply(self, late: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
        """Add records and take some out; (sha256, before, moment_id, given) of all records whose island was folded again.

        late: records (sha256, taken_at, date_source, camera, phash and any other columns, the same for each batch);
        deleted (sha256, taken_at, date_source, camera) as they were given. A record that is given again replaces itself
        if its time and camera are the same. ``before`` is null for new ones, ``moment_id`` for those that went;
        ``given`` tells records of this batch, whose values may be new.
        """
        batch = f"{self._number():012d}-{uuid.uuid4().hex[:8]}"
        late = stored(late, "late")
        key = ["sha256", "taken_at", "date_source", "camera"]
        gone = stored(deleted.select(*key), "gone") if deleted is not None else None
        hit = self._hit(self._timed(late.select(*key) if gone is None else late.select(*key).unionByName(gone)))
        kept, old = late, None
        if hit is not None:
            hit = stored(hit, "hit")
            old = self._rows(hit)
            kept = late.unionByName(old.drop("moment_id").join(late.select("sha256"), "sha256", "left_anti"))
        if gone is not None:
            kept = kept.join(gone.select("sha256"), "sha256", "left_anti")
        if kept is not late:
            kept = stored(kept, "kept")
        # Islands and groups are found on what they are made of; whole rows only meet them once, to be written.
        now = stored(folded(kept, self.gap_seconds, self.most_bits), "folded").withColumns({"batch": F.lit(batch), "cell": _day(F.col("first"))})
        rows = kept.join(now.select("sha256", "moment_id", "island", "batch", "cell"), "sha256")
        self._append(rows.select(*late.columns, "moment_id", "island", "batch", "cell"), "rows", "cell")
        self._append(now.select("sha256", "batch", "cell", F.substring("sha256", 1, 2).alias("begin")), "places", "begin")
        made = now.groupBy("island").agg(F.first("camera").alias("camera"), F.first("first").alias("first"), F.max("at").alias("last"), F.first("cell").alias("home"))
        lines = made.withColumn("live", F.lit(True))
        if hit is not None:
            dead = hit.join(made.select("island"), "island", "left_anti")
            lines = lines.unionByName(dead.select("island", "camera", "first", "last", "home", F.lit(False).alias("live")))
            # An island that ends earlier than it did is dead in the days that it no longer reaches.
            shrunk = hit.select("island", "camera", F.explode(_days(F.col("first"), F.col("last"))).alias("cell"), "home")
            still = made.select("island", F.explode(_days(F.col("first"), F.col("last"))).alias("cell"))
            stale = shrunk.join(still, ["island", "cell"], "left_anti").select("island", "camera", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("last"), "home", F.lit(False).alias("live"), "cell")
        posted = lines.withColumn("cell", F.explode(_days(F.col("first"), F.col("last"))))
        if hit is not None:
            posted = posted.unionByName(stale).dropDuplicates(["island", "cell"])
        self._append(posted.withColumn("batch", F.lit(batch)), "index", "cell")
        after = now.select("sha256", "moment_id")
        if old is None:
            return after.select("sha256", F.lit(None).cast("string").alias("before"), "moment_id", F.lit(True).alias("given"))
        given = late.select("sha256", F.lit(True).alias("_given")).distinct()
        told = after.join(old.select("sha256", F.col("moment_id").alias("before")), "sha256", "full").join(given, "sha256", "left")
        return told.select("sha256", "before", "moment_id", F.coalesce("_given", F.lit(False)).alias("given"))

    def _number(self) -> int:
        index = self._table("index", "cell", None)
        last = index.agg(F.max("batch")).first()[0] if index is not None else None
        return int(last.split("-")[0]) + 1 if last else 0

    def _latest(self, rows: DataFrame, cells: DataFrame | None) -> DataFrame:
        """Those of ``rows`` (read from the same cells, or all) that the latest batch which tells of their island wrote.

        Only islands that several batches told of, or that are gone, are looked for: all other rows of a batch that went
        through count, so rows aren't shuffled while few islands are folded again.
        """
        index = self._table("index", "cell", cells)
        batches = stored(index.select("batch").distinct(), "batches")
        told = index.groupBy("island").agg(F.max(F.struct("batch", "live")).alias("x"), F.min("batch").alias("_from"))
        again = told.where("not x.live or x.batch != _from").select(F.col("island").alias("_island"), F.when(F.col("x.live"), F.col("x.batch")).alias("_batch"))
        again = stored(again, "again")
        met = rows.join(F.broadcast(batches), "batch", "left_semi").join(again, F.col("island") == F.col("_island"), "left")
        return met.where("_island is null or batch = _batch").select(*rows.columns)

    def groups(self) -> DataFrame:
        """All records that are there, with their group."""
        return self._latest(self._table("rows", "cell", None), None).drop("island", "batch", "cell")

    def located(self, shas: DataFrame) -> DataFrame:
        """Records of the islands in which the records ``shas`` (sha256) lie, with their group; others are ignored."""
        keys = stored(shas.select("sha256").distinct(), "keys")
        places = self._table("places", "begin", keys.select(F.substring("sha256", 1, 2).alias("begin")))
        cells = places.join(keys, "sha256", "left_semi").groupBy("sha256").agg(F.max(F.struct("batch", "cell")).alias("x"))
        cells = stored(cells.select(F.col("x.cell").alias("cell")).distinct(), "cells")
        here = self._latest(self._table("rows", "cell", cells), cells)
        wanted = stored(here.join(keys, "sha256", "left_semi").select("island").distinct(), "wanted")
        return here.join(wanted, "island", "left_semi").drop("island", "batch", "cell")


def members(store: BurstStore, changed: DataFrame, overrides: DataFrame, edited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their group, changed groups) of all groups that a batch or an edit touches.

    changed: what ``BurstStore.apply`` gave (or no row); overrides (sha256, moment_id): all manual groups, as they are
    now; edited (sha256, before): records whose manual group was set, changed or taken away (before: the group until
    then, null if unknown). A group's records are those folded into it and those put into it by hand, wherever they lie;
    each is found by its hash, so what is read are the islands of what is asked for.
    """
    overrides = stored(overrides.select("sha256", "moment_id"), "overrides")
    given = overrides.select("sha256", F.col("moment_id").alias("_given"))
    # A record that stayed in its group, and wasn't given anew, leaves it as it was.
    changed = stored(changed.where("given or not (before <=> moment_id)").select("sha256", "before", "moment_id"), "moved")
    touched = stored(changed.select("sha256").unionByName(edited.select("sha256")).distinct(), "touched")
    manual = overrides.join(touched, "sha256", "left_semi").select("moment_id")
    ids = [changed.select(F.col("before").alias("moment_id")), changed.select("moment_id"), manual, edited.select(F.col("before").alias("moment_id"))]
    first = store.located(touched).select("sha256", "moment_id").join(touched, "sha256", "left_semi").join(given, "sha256", "left").select(F.coalesce("_given", "moment_id").alias("moment_id"))
    groups = ids[0]
    for more in (*ids[1:], first):
        groups = groups.unionByName(more)
    groups = stored(groups.where("moment_id is not null").distinct(), "groups")
    # The id of a folded group is its earliest record; a manual group may have an id of its own.
    by_hand = overrides.join(groups, "moment_id", "left_semi").select("sha256")
    asked = by_hand.unionByName(groups.select(F.col("moment_id").alias("sha256"))).unionByName(touched)
    rows = store.located(asked).join(given, "sha256", "left").withColumn("moment_id", F.coalesce("_given", "moment_id")).drop("_given")
    return rows.join(groups, "moment_id", "left_semi"), groups
