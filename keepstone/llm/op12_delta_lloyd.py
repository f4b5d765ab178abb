"""Vector codes by a Lloyd iteration that is maintained by differences.

A vector is cut into 8 parts and every part position has a codebook of 16 entries. Vectors are packed into blocks once
and written in buckets; the assignments of a round are a small table in the same buckets, so that a round meets its
predecessor's assignments without a shuffle. Each round takes part sums only of parts whose assignment changed, minus for
the old entry and plus for the new one, and adds them to running integer sums. All arithmetic is in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import Scratch, released

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components saturate here, so squares and their sums stay within 64 bits.
LARGEST = 1 << 27
BLOCK_ROWS = 1024
#: Bytes of vectors in a bucket.
BUCKET_BYTES = 128 << 20
#: Labels up to which their sums are sent to all tasks; about 1 MB.
LABELS_SENT = 1 << 15
SALTS = 32
NONE = 255


def usable(vector: Column) -> Column:
    """Not null or empty, without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def whole(vector: Column) -> Column:
    """Components as integers, floor(4096 x), within ``LARGEST``."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(x * SCALE), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def assign(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part (rows x 8) and the squared distances, for v (rows x 8 x m) and books (8 x entries x m)."""
    code = np.empty(v.shape[:2], np.uint8)
    error = np.empty(v.shape[:2], np.int64)
    for p in range(v.shape[1]):
        best = near = None
        for e in range(books.shape[1]):
            gap = v[:, p] - books[p, e]
            far = np.einsum("ij,ij->i", gap, gap)
            if best is None:
                best, near = far, np.zeros(len(v), np.uint8)
            else:
                closer = far < best  # ties stay with the lower index
                best, near = np.where(closer, far, best), np.where(closer, np.uint8(e), near)
        code[:, p], error[:, p] = near, best
    return code, error


def changes(v: np.ndarray, old: np.ndarray, new: np.ndarray, entries: int) -> dict[tuple[int, int], np.ndarray]:
    """{(part, entry): count and sums}: what parts of a changed assignment take from their old entry and add to the new.

    An old assignment of ``NONE`` has nothing to take from.
    """
    found: dict[tuple[int, int], np.ndarray] = {}
    for p in range(v.shape[1]):
        moved = np.flatnonzero(old[:, p] != new[:, p])
        counted = np.concatenate([np.ones((len(moved), 1), np.int64), v[moved, p]], axis=1)
        total = np.zeros((entries, counted.shape[1]), np.int64)
        np.add.at(total, new[moved, p], counted)
        left = old[moved, p] != NONE
        np.subtract.at(total, old[moved, p][left], counted[left])
        found |= {(p, e): total[e] for e in np.flatnonzero(total.any(axis=1)).tolist()}
    return found


@dataclass
class Lloyd:
    """Codebooks and the running counts and sums of their entries."""

    books: np.ndarray  # 8 x entries x m
    sums: np.ndarray  # 8 x entries x (1 + m)

    @staticmethod
    def start(vectors: np.ndarray) -> Lloyd:
        books = vectors.reshape(len(vectors), PARTS, -1).transpose(1, 0, 2).astype(np.int64)
        return Lloyd(books, np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64))

    def add(self, part: int, entry: int, place: int, value: int) -> None:
        self.sums[part, entry, place] += value

    def move(self) -> None:
        """Every used entry becomes the floor of its mean."""
        used = self.sums[:, :, 0] > 0
        mean = self.sums[:, :, 1:] // np.maximum(self.sums[:, :, :1], 1)
        self.books = np.where(used[:, :, None], mean, self.books)

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _blocks(rows: DataFrame) -> DataFrame:
    """(block, ids, labels, v): rows of a task packed by ``BLOCK_ROWS``; the key of a block is made of task and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        size = 0

        def packed() -> pa.RecordBatch:
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = [pa.ListArray.from_arrays(pa.array([0, one.num_rows], pa.int32()), one.column(c)) for c in ("id", "label")]
            v = one.column("v").flatten().to_numpy().astype("<i4").tobytes()
            return pa.record_batch([pa.array([number]), *lists, pa.array([v])], names=["block", "ids", "labels", "v"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                take = min(BLOCK_ROWS - size, batch.num_rows - at)
                held.append(batch.slice(at, take))
                at, size = at + take, size + take
                if size == BLOCK_ROWS:
                    yield packed()
                    number, held, size = number + 1, [], 0
        if held:
            yield packed()

    label = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(released(run), f"block long, ids array<long>, labels array<{label}>, v binary")


def _matrix(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i4").astype(np.int64).reshape(-1, PARTS, dim // PARTS)


def _first_vectors(blocks: DataFrame, dim: int) -> np.ndarray:
    """Vectors of the ``ENTRIES`` smallest ids, ascending; each task tells its own few only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, ...]] = {}
        for batch in batches:
            for ids, data in zip(batch.column("ids"), batch.column("v"), strict=True):
                named = ids.values.drop_null().to_numpy()
                v = np.frombuffer(data.as_py(), "<i4").reshape(-1, dim)[ids.values.is_valid().to_numpy(zero_copy_only=False)]
                for i in np.unique(named)[:ENTRIES].tolist():
                    least = tuple(np.unique(v[named == i], axis=0)[0].tolist())
                    found[i] = min(found.get(i, least), least)
                found = dict(sorted(found.items())[:ENTRIES])
        yield pa.record_batch([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.list_(pa.int32()))], names=["id", "v"])

    told = blocks.select("ids", "v").mapInArrow(released(run), "id long, v array<int>")
    rows = told.groupBy("id").agg(F.min("v").alias("v")).orderBy("id").limit(ENTRIES).collect()
    return np.asarray([r["v"] for r in rows], np.int64).reshape(-1, dim)


def _assigned(blocks: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """(block, code, moved) over rows (block, v, old): new assignments, and what changed as counts and sums by entry."""
    moved = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("values", pa.list_(pa.int64()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, told = [], []
            for data, before in zip(batch.column("v"), batch.column("old"), strict=True):
                v = _matrix(data.as_py(), dim)
                new, _ = assign(v, books)
                old = np.frombuffer(before.as_py(), np.uint8).reshape(new.shape) if before.is_valid else np.full_like(new, NONE)
                codes.append(new.tobytes())
                delta = changes(v, old, new, books.shape[1])
                told.append([{"part": p, "entry": e, "values": x.tolist()} for (p, e), x in delta.items()])
            yield pa.record_batch([batch.column("block"), pa.array(codes), pa.array(told, moved)], names=["block", "code", "moved"])

    return blocks.mapInArrow(released(run), "block long, code binary, moved array<struct<part: int, entry: int, values: array<bigint>>>")


def _coded(blocks: DataFrame, books: np.ndarray, dim: int) -> DataFrame:
    """(vec_id, label, code, error) of every row of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, data in zip(*(batch.column(c) for c in ("ids", "labels", "v")), strict=True):
                code, error = assign(_matrix(data.as_py(), dim), books)
                text = code.tobytes().hex()
                width = 2 * PARTS
                codes = [text[i : i + width] for i in range(0, len(text), width)]
                columns = [ids.values, labels.values, pa.array(codes), pa.array(error.sum(axis=1))]
                yield pa.record_batch(columns, names=["vec_id", "label", "code", "error"])

    label = blocks.schema["labels"].dataType.elementType.simpleString()
    narrow = blocks.select("ids", "labels", "v")
    return narrow.mapInArrow(released(run), f"vec_id long, label {label}, code string, error long")


def _with_label_errors(spark: SparkSession, coded: DataFrame, scratch: Scratch) -> DataFrame:
    """``coded`` with the errors of its label added up, nulls together. One label may have most rows: its sum is either
    sent to all tasks, if labels are few, or stands once for each salt."""
    keyed = coded.withColumn("named", F.col("label").isNotNull()).withColumn("of", F.coalesce(F.col("label").cast("string"), F.lit("")))
    sums = scratch.write(keyed.groupBy("named", "of").agg(F.sum("error").alias("label_error")), "labels")
    if sums.count() <= LABELS_SENT:
        return keyed.join(F.broadcast(sums), ["named", "of"])
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return keyed.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")).join(salted, ["named", "of", "salt"])


def vector_codes(
    spark: SparkSession, rows: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every usable row; see the module for the method.

    Rows whose vector is null, empty or holds a null or non-finite component take no part. All vectors have as many
    components as most rows have among the multiples of 8 (ties to fewer); others get no row. Components beyond +-32,768
    saturate there. Repeated rows are rows of their own; for the first entries an id with several vectors gives its
    least one. A null id is kept and starts no entry; with no other ids there is no codebook and no row. Fewer than 16
    ids give fewer entries. Nulls among labels are one label. An empty table gives no row.
    """
    scratch = Scratch(spark, "lloyd")
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    clean = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = clean.where(usable(F.col("v")) & (F.size("v") % PARTS == 0))
    sizes = clean.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dim, count = sizes[0]["dim"], sizes[0]["count"]
    least = min(-(-count // BLOCK_ROWS), 2 * spark.sparkContext.defaultParallelism)
    buckets = max(least, -(-4 * count * dim // BUCKET_BYTES))
    made: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        """Write a table in the buckets of the blocks."""
        table = f"keepstone_{scratch.root.rsplit('-', 1)[1]}_{name}"
        df.write.format("parquet").bucketBy(buckets, "block").option("path", scratch.path(name)).option("compression", "zstd").saveAsTable(table)
        made.append(table)
        return spark.table(table)

    ints = clean.where(F.size("v") == dim).select("id", "label", whole(F.col("v")).alias("v"))
    try:
        blocks = keep(_blocks(ints).repartition(buckets, "block"), "blocks")
        first = _first_vectors(blocks, dim)
        if not len(first):
            return spark.createDataFrame([], schema)
        model, last = Lloyd.start(first), None
        for turn in range(rounds):
            old = blocks.select("block", "v")
            if last is None:
                old = old.withColumn("old", F.lit(None).cast("binary"))
            else:
                old = old.join(last.select("block", F.col("code").alias("old")).hint("shuffle_hash"), "block")
            now = keep(_assigned(old, model.books, dim), f"codes{turn}")
            if last is not None:
                spark.sql(f"DROP TABLE {made.pop(-2)}")
                scratch.drop(f"codes{turn - 1}")
            last = now
            each = now.select(F.inline("moved")).select("part", "entry", F.posexplode("values").alias("place", "value"))
            moved = each.groupBy("part", "entry", "place").agg(F.sum("value").alias("value")).collect()  # the size of the codebooks at most
            if not moved:
                break  # nothing changes any more
            for r in moved:
                model.add(r["part"], r["entry"], r["place"], r["value"])
            model.move()
        coded = scratch.write(_coded(blocks, model.books, dim), "coded")
    finally:
        for table in made:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
            scratch.drop(table.rsplit("_", 1)[1])
    found = _with_label_errors(spark, coded, scratch)
    return found.select("vec_id", "code", "error", "label_error", F.lit(model.sha256()).alias("codebooks_sha256"))
