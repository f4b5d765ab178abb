"""Shared pieces: the scratch area in the cluster's shared folder, and texts as bytes."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.session import ship
from keepstone.sources.shared import shared_folder


class Scratch:
    """Written tables of one query run. They cut lineage: a lost executor costs a reread, not a recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        ship(spark)
        self.root = f"{shared_folder(spark)}/keepstone-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame | None = None) -> DataFrame:
        reader = self.spark.read if like is None else self.spark.read.schema(like.schema)
        return reader.parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Delete a table that nothing reads any more."""
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: str | Column) -> Column:
    """A text column as its UTF-8 bytes; Python then skips decoding. Null stays null."""
    return (F.col(col) if isinstance(col, str) else col).cast("binary")


#: Rows and bytes of an Arrow batch of texts. Spark's own default of 10,000 rows of long texts takes hundreds of MB a task.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20


def texts(docs: DataFrame) -> DataFrame:
    """docs, with the session's Arrow batches bounded for rows of text (only ever made smaller)."""
    ship(docs.sparkSession)
    conf = docs.sparkSession.conf
    for name, least in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        number, unit = re.fullmatch(r"(-?\d+)([kmgtp]?)b?", conf.get(key).lower()).groups()
        if not 0 < int(number) << 10 * " kmgtp".index(unit or " ") <= least:
            conf.set(key, str(least))
    return docs


def hand_back() -> None:
    """Return freed memory to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a libc without it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run: Callable) -> Callable:
    """A function over Arrow batches that hands its memory back when a task ends: idle Python workers stay alive, and
    an executor's limit covers them."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            hand_back()

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Split record batches so that one slice holds about ``most`` bytes of ``column``; a long row stands alone."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)


_BLANKS = [bytes([c]) for c in b" \t\n\r\x0b\x0c"]


def segments(data: bytes, size: int) -> Iterator[bytes]:
    """Pieces of about ``size`` bytes, cut behind words; one word of any length stays whole."""
    at = 0
    while len(data) - at > size:
        ends = [data.rfind(b, at, at + size) for b in _BLANKS]
        cut = max(ends)
        if cut < 0:
            after = [x for x in (data.find(b, at + size) for b in _BLANKS) if x >= 0]
            cut = min(after, default=len(data))
        yield data[at : cut + 1]
        at = cut + 1
    yield data[at:]


def crc_mod(col: str, mod: int) -> Column:
    """crc32 of the id's decimal text, modulo ``mod``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % F.lit(mod)


#: Bits of a piece of a map, and of a map unless it is told otherwise (1 MB).
PIECE_BITS, MAP_BITS = 1 << 15, 1 << 23


def key_map(rows: DataFrame, key: str, scratch: Scratch, name: str, bits: int = MAP_BITS) -> DataFrame:
    """(k, words): a bit for each hashed ``key``, in pieces of 4 KB; at most ``bits`` / 32768 rows whatever the number of keys.

    A full map lets every row through ``in_map``, which costs time only.
    """
    place = rows.select(F.pmod(F.xxhash64(key), F.lit(bits)).alias("p"))
    parts = place.groupBy(F.expr(f"p div {PIECE_BITS}").alias("k")).agg(F.expr(f"bitmap_construct_agg(p % {PIECE_BITS})").alias("bits"))
    longs = F.expr(f"transform(sequence(0, {PIECE_BITS // 64 - 1}), i -> cast(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) as long))")
    return scratch.write(parts.select("k", longs.alias("words")), name)


def in_map(rows: DataFrame, key: str, found: DataFrame, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be in the map, and the others (a null key is in no map). The map's size is fixed, so it is broadcast."""
    keyed = rows.withColumn("_ks_p", F.pmod(F.xxhash64(key), F.lit(bits)))
    keyed = keyed.withColumn("_ks_k", F.expr(f"_ks_p div {PIECE_BITS}"))
    joined = keyed.join(F.broadcast(found.select(F.col("k").alias("_ks_k"), F.col("words").alias("_ks_words"))), "_ks_k", "left")
    # The bytes of a long stand most significant first, the bits of a byte least significant first.
    word = f"element_at(_ks_words, cast((_ks_p % {PIECE_BITS}) div 64 as int) + 1)"
    hit = F.expr(f"shiftright({word}, cast(56 - 8 * ((_ks_p div 8) % 8) + _ks_p % 8 as int)) & 1L") == 1
    flag = joined.withColumn("_ks_hit", F.col(key).isNotNull() & F.coalesce(hit, F.lit(False)))
    return flag.where("_ks_hit").select(*rows.columns), flag.where("not _ks_hit").select(*rows.columns)


def search_blocks(
    rows: DataFrame, queries: DataFrame, n_blocks: int, build: Callable[[pa.RecordBatch], Any], search: Callable[[Any, pa.RecordBatch], pa.RecordBatch],
    schema: str, query_rows: int = 512,
) -> DataFrame:
    """Search all ``rows`` for all ``queries`` (the same columns, but far fewer rows), block by block.

    Rows are dealt to blocks by a hash of all their columns, so that no id or value fills one, and queries are sent to
    every block. A task builds the index of a block once, by ``build``, and streams the queries through it: it holds a
    block and ``query_rows`` queries at a time, however many queries there are.
    """
    columns = rows.columns
    left = rows.select(F.pmod(F.xxhash64(*columns), F.lit(n_blocks)).cast("int").alias("_ks_b"), F.lit(0).alias("_ks_side"), *columns)
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    right = queries.select(every.alias("_ks_b"), F.lit(1).alias("_ks_side"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, index = -1, None
        held: list[pa.RecordBatch] = []
        for batch in batches:
            b, side = batch.column("_ks_b").to_numpy(), batch.column("_ks_side").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(b) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(b)]
            for start, stop in zip(cuts, cuts[1:], strict=False):
                if start == stop:
                    continue
                if b[start] != block:
                    block, index, held = b[start], None, []
                part = batch.slice(start, stop - start).select(columns)
                if side[start] == 0:
                    held.append(part)
                elif held or index is not None:
                    if index is None:
                        index, held = build(pa.Table.from_batches(held).combine_chunks().to_batches()[0]), []
                    for at in range(0, part.num_rows, query_rows):
                        yield search(index, part.slice(at, query_rows))

    dealt = left.unionByName(right).repartition(n_blocks, "_ks_b").sortWithinPartitions("_ks_b", "_ks_side")
    return dealt.mapInArrow(released(run), schema)
