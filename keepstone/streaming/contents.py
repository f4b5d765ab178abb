"""Which contents were ever seen, for streams: a batch reads what its own keys reach, however much is stored.

Keys lie in buckets by the first digits of a hash. The number of digits grows with what is stored, and what was written
with fewer digits stays where it is, so a bucket never holds more than about ``BUCKET_ROWS`` keys and a key has one bucket
for each number of digits that was ever used (their number grows with the logarithm). A bucket has a bit map of its keys,
and the maps of the 16 buckets that differ in the last digit alone lie on one shelf: a batch reads the shelves of its keys'
buckets, and the keys of those buckets only where a map says that one of them may be there.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.sources.shared import exists, stored

BUCKET_ROWS = 1 << 16
#: Bits of a bucket's map: 16 for each key of a full bucket; and of a row of it.
MAP_BITS, PIECE_BITS = 1 << 20, 1 << 15
#: Buckets up to which they are read by name.
NAMED = 4096


def _places(digits: int) -> dict[str, Column]:
    """The bucket of a hash and the shelf of its map."""
    return {"bucket": F.concat(F.lit("b"), F.substring("_h", 1, digits)), "shelf": F.concat(F.lit("b"), F.substring("_h", 1, digits - 1))}


class ContentStore:
    def __init__(self, spark: SparkSession, root: str, key: list[str], bucket_rows: int = BUCKET_ROWS):
        self.spark, self.root, self.key, self.bucket_rows = spark, root, key, bucket_rows

    def _hashed(self, rows: DataFrame) -> DataFrame:
        """rows plus ``_h`` (16 hex digits) and the place of the key in a map."""
        place = F.pmod(F.xxhash64(F.lit("map"), *self.key), F.lit(MAP_BITS))
        return rows.withColumns({"_h": F.lpad(F.hex(F.xxhash64(*self.key)), 16, "0"), "_place": place})

    def _read(self, kind: str, digits: int, folders: DataFrame) -> DataFrame | None:
        """Rows of the folders (bucket, or shelf) of one number of digits, for a join by bucket; others are neither listed nor
        read, unless very many or most are asked for: to look each of them up takes longer then than to list all at once."""
        root, (level,) = f"{self.root}/{kind}/digits={digits}", folders.columns
        if not exists(self.spark, root):
            return None
        names = [r[0] for r in folders.distinct().limit(NAMED + 1).collect()]
        if len(names) > min(NAMED, 16 ** (digits - (level == "shelf")) // 2):
            return self.spark.read.parquet(root)
        there = [p for p in (f"{root}/{level}={n}" for n in names) if exists(self.spark, p)]
        if not there:
            return None
        return self.spark.read.option("basePath", root).parquet(*there)

    def _batches(self) -> list[tuple[int, int, int]]:
        """(batch, digits, rows) of all batches that were written, one row each."""
        if not exists(self.spark, f"{self.root}/batches"):
            return []
        by_digits = self.spark.read.parquet(f"{self.root}/batches").groupBy("digits").agg(F.max("batch"), F.sum("rows"))
        return [(r[1], r[0], r[2]) for r in by_digits.collect()]

    def seen(self, keys: DataFrame, but: int = -1) -> DataFrame:
        """The rows of ``keys`` that any batch but one holds."""
        hashed = stored(self._hashed(keys.select(*self.key).distinct()), "keys")
        found = []
        for _, digits, _ in self._batches():
            near = hashed.withColumns({**_places(digits), "piece": F.floor(F.col("_place") / PIECE_BITS)})
            maps = self._read("maps", digits, near.select("shelf"))
            if maps is None:
                continue
            at = F.col("_place") % PIECE_BITS
            byte = F.conv(F.hex(F.substring(F.col("bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = F.getbit(byte, (at % 8).cast("int")) == 1
            maybe = near.join(maps.where(F.col("batch") != but).select("bucket", "piece", "bits"), ["bucket", "piece"]).where(hit)
            maybe = stored(maybe.select(*self.key, "bucket").distinct(), "maybe")
            rows = self._read("keys", digits, maybe.select("bucket"))
            if rows is not None:
                found.append(maybe.join(rows.where(F.col("batch") != but), [*self.key, "bucket"], "left_semi").select(*self.key))
        return functools.reduce(DataFrame.unionByName, found) if found else keys.select(*self.key).where("false")

    def add(self, rows: DataFrame, batch: int) -> DataFrame:
        """The rows whose key no other batch has, one for each key, after their keys are kept as those of ``batch``.

        A batch that runs again replaces what it kept. Null keys are keys like any other.
        """
        one = stored(rows.dropDuplicates(self.key), "batch")
        old = self.seen(one, batch)
        same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in self.key])
        fresh = stored(one.join(old.select(*[F.col(k).alias(f"_{k}_") for k in self.key]), same, "left_anti"), "fresh")
        count, total = fresh.count(), sum(n for b, _, n in self._batches())
        digits = 1
        while (total + count) > self.bucket_rows * 16**digits:
            digits += 1
        hashed = self._hashed(fresh.select(*self.key)).withColumns(_places(digits))
        keyed = hashed.withColumns({"digits": F.lit(digits), "batch": F.lit(batch).cast("long")})
        pieces = keyed.groupBy("digits", "shelf", "bucket", "batch", F.floor(F.col("_place") / PIECE_BITS).alias("piece"))
        maps = pieces.agg(F.bitmap_construct_agg(F.col("_place") % PIECE_BITS).alias("bits"))
        # A stated number, or few small rows would be one task, which would write the files of all folders one after another.
        tasks = min(16**digits, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        for name, df, level in (("keys", keyed.select(*self.key, "digits", "bucket", "batch"), "bucket"), ("maps", maps, "shelf")):
            folders = ["digits", level, "batch"]
            df.repartition(tasks, *folders).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(f"{self.root}/{name}")
        line = self.spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(digits).alias("digits"), F.lit(count).cast("long").alias("rows"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/batches/part={batch}")
        return fresh
