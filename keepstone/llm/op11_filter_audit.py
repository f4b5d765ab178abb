"""Which of five filters removes what, in every order in which they can be applied.

A document is a mask of the filters that it fails. For every mask and order a table of 32 x 120 cells, made once, holds
the step at which the document goes, so nothing is filtered 120 times: tasks look masks up, count removals by part,
order and step with ``np.bincount``, and the partial arrays are summed.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import Scratch, released, segments, slices, texts, utf8

FILTERS = "ABCDE"
LEAST_WORDS = 200
#: Bytes of text that are split into words at a time.
SEGMENT = 1 << 20
#: Bytes of text whose different words are held at a time.
WORD_BYTES = 8 << 20
COPY = 1 << FILTERS.index("E")
ORDERS = list(itertools.permutations(range(len(FILTERS))))
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SYMBOLS = b"#$%&*|"
_CONTINUATION = bytes(range(0x80, 0xC0))


def first_failures() -> np.ndarray:
    """Step (0 to 4, 5 for none) at which a document of each mask goes, in each order (32 x 120)."""
    mask = np.arange(1 << len(FILTERS))[:, None, None]
    fails = (mask >> np.asarray(ORDERS)[None]) & 1 == 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), len(FILTERS))


#: Cells of a part: removals by order and step, then documents by mask.
STEP_CELLS, CELLS = len(ORDERS) * len(FILTERS), len(ORDERS) * len(FILTERS) + (1 << len(FILTERS))


def few_different(data: bytes) -> bool:
    """Whether fewer than half of the words are different.

    The words of a long text are held in shares, dealt by a checksum, so that a share has about ``WORD_BYTES`` of text.
    """
    shares = -(-len(data) // WORD_BYTES)
    total = different = 0
    for k in range(max(shares, 1)):
        seen: set[bytes] = set()
        total = 0
        for piece in segments(data, SEGMENT):
            words = piece.split()
            total += len(words)
            seen.update(words if shares <= 1 else (w for w in words if zlib.crc32(w) % shares == k))
        different += len(seen)
    return 100 * different < 50 * total


def content_mask(data: bytes) -> int:
    """The filters A to D that a text fails, as bits."""
    words = sum(len(piece.split()) for piece in segments(data, SEGMENT))
    upper = len(data) - len(data.translate(None, _UPPER))
    points = len(data.translate(None, _CONTINUATION))
    symbols = len(data.translate(None, _SYMBOLS)) < len(data)
    return (words < LEAST_WORDS) | few_different(data) << 1 | (100 * upper > 3 * points) << 2 | symbols << 3


def _facts(docs: DataFrame, id_col: str, part_col: str, text_col: str) -> DataFrame:
    """(id, part, key, mask): the text's SHA-256, and what it fails of A to D."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            keys, masks = [], []
            for value in batch.column("text"):
                data = value.as_py() or b""
                keys.append(hashlib.sha256(data).digest())
                masks.append(content_mask(data))
            columns = [batch.column("id"), batch.column("part"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())]
            yield pa.record_batch(columns, names=["id", "part", "key", "mask"])

    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    narrow = texts(docs).select(F.col(id_col).cast("long").alias("id"), part, utf8(text_col).alias("text"))
    return narrow.mapInArrow(released(run), "id long, part string, key binary, mask int")


def _tally(groups: DataFrame) -> DataFrame:
    """(part, cell, removed, good, toxic) over rows (part, mask, good, toxic, n), one set of cells a task and part."""
    table = first_failures()
    orders = np.arange(len(ORDERS))

    def arrays(batch: pa.RecordBatch) -> tuple[list[str], np.ndarray]:
        coded = batch.column("part").dictionary_encode()
        parts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        mask, n = batch.column("mask").to_numpy(), batch.column("n").to_numpy()
        found = np.zeros((3, len(parts), CELLS), np.int64)
        for k, name in enumerate((None, "good", "toxic")):
            counted = n if name is None else n * batch.column(name).to_numpy(zero_copy_only=False)
            # Weights of bincount are doubles, exact up to 2^53 documents.
            by_mask = np.bincount(code * 32 + mask, counted, len(parts) * 32).astype(np.int64)
            at = np.flatnonzero(by_mask)
            step = table[at % 32]
            cell = (at // 32)[:, None] * STEP_CELLS + orders * len(FILTERS) + np.minimum(step, len(FILTERS) - 1)
            weight = np.where(step < len(FILTERS), by_mask[at][:, None], 0)
            removed = np.bincount(cell.ravel(), weight.ravel(), len(parts) * STEP_CELLS).astype(np.int64)
            found[k] = np.concatenate([removed.reshape(len(parts), -1), by_mask.reshape(len(parts), -1)], axis=1)
        return parts, found

    def rows(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
        one = np.concatenate(list(sums.values()), axis=1)
        columns = [np.repeat(list(sums), CELLS).tolist(), np.tile(np.arange(CELLS, dtype=np.int32), len(sums)), *one]
        return pa.record_batch([pa.array(c) for c in columns], names=["part", "cell", "removed", "good", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                parts, found = arrays(batch.slice(at, 4096))
                for i, part in enumerate(parts):
                    sums[part] = sums[part] + found[:, i] if part in sums else found[:, i]
                if len(sums) > 64:  # a table may have any number of parts
                    yield rows(sums)
                    sums = {}
        if sums:
            yield rows(sums)

    return groups.mapInArrow(released(run), "part string, cell int, removed long, good long, toxic long")


def _report(cells: DataFrame) -> DataFrame:
    """The rows of every part from its summed cells (one row a part, ``CELLS`` entries in order)."""
    names = ["".join(FILTERS[f] for f in order) for order in ORDERS]
    which = np.asarray(ORDERS)
    bits = (np.arange(32)[:, None] >> np.arange(len(FILTERS))) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                removed, good, toxic = (np.asarray(row[c][:STEP_CELLS]).reshape(which.shape) for c in ("removed", "good", "toxic"))
                by_mask = np.asarray(row["removed"][STEP_CELLS:])
                fails = by_mask @ bits
                shapley = np.bincount(which.ravel(), removed.ravel(), len(FILTERS)).astype(np.int64)
                columns = {
                    "part": [row["part"]] * STEP_CELLS,
                    "filter_order": np.repeat(names, len(FILTERS)).tolist(),
                    "step": np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)),
                    "kept": by_mask.sum() - np.cumsum(removed, axis=1),
                    "removed": removed,
                    "redundant": fails[which] - removed,
                    "unique_fails": by_mask[1 << which],
                    "good_lost": good,
                    "toxic_lost": toxic,
                    "shapley": shapley[which],
                }
                yield pa.record_batch({k: pa.array(v if isinstance(v, list) else np.ravel(v)) for k, v in columns.items()})

    counts = "kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return cells.mapInArrow(released(run), f"part string, filter_order string, step int, {counts}")


def audit(
    spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """One row for each part, order of the five filters and step, zeros included.

    Filters: A under 200 words, B fewer than half of the words different, C over 3 % of code points in A-Z, D any of
    ``#$%&*|``, E the text of a smaller id anywhere in the table. A null text is an empty one, a null part the empty
    string. A row without id is never a copy and makes no other row one; rows that share id and text don't make each
    other copies. Repeated rows count as often as they stand. Labels: an id counts as good or toxic if any of its rows
    says so; a null label or id says nothing. An empty table gives no row. Texts of any length are read in segments.

    Texts are the same if their SHA-256 is. Documents go through two shuffles of some 80 bytes each and no join by text:
    rows of a text are counted before they meet, so the copies of one text never gather in a task.
    """
    scratch = Scratch(spark, "audit")
    facts = scratch.write(_facts(docs, id_col, part_col, text_col), "facts")
    one = facts.groupBy("id", "part", "key", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.select(F.col(id_col).cast("long").alias("id"), F.col("quality").alias("good"), F.col("toxic")).where("id is not null")
    known = known.groupBy("id").agg(says("good"), says("toxic")).where("good or toxic")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    # Rows without an id have no label; in the join they would all meet in one task.
    labelled = one.where("id is not null").join(known, "id", "left").select("id", "part", "key", "mask", "n", flag("good"), flag("toxic"))
    unnamed = one.where("id is null").select("*", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    each = ["key", "part", "mask", "good", "toxic"]
    grouped = labelled.unionByName(unnamed).groupBy(*each).agg(
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.sum("n").alias("all"),
        F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("unnamed"),
    )
    least = F.min("first.id").over(Window.partitionBy("key"))
    originals = F.col("unnamed") + F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(0)
    dealt = grouped.withColumn("least", least).withColumn("originals", originals)
    kinds = F.array(
        F.struct(F.col("mask"), F.col("originals").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(COPY)).alias("mask"), (F.col("all") - F.col("originals")).alias("n")),
    )
    groups = dealt.select("part", "good", "toxic", F.inline(kinds)).where("n > 0")
    summed = _tally(groups).groupBy("part", "cell").agg(*[F.sum(c).alias(c) for c in ("removed", "good", "toxic")])
    ordered = summed.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("cell", "removed", "good", "toxic"))).alias("c"))
    return _report(ordered.select("part", "c.removed", "c.good", "c.toxic"))
