"""Harmonic packing of token ids into sequences of a fixed capacity.

Classes are reciprocals of the capacity C: class k holds pieces of length in (C/(k+1), C/k], and a bin of class k
takes exactly k of them. Documents may be cut, so a document is first cut into pieces whose lengths are exact
reciprocals: whole sequences (k = 1), then halves, quarters and so on down to ``least`` ids; these classes fill their
bins without any padding. Only the tail, shorter than ``least``, keeps its own length; its class is k = C // length,
and a full bin of that class wastes less than one tail. Every worker keeps one open bin for each class and nothing
else, so no worker waits for another and memory doesn't grow with the input. What is left in open bins when a
worker's input ends is concatenated and cut at the capacity; the last remainder is cut into powers of two, which are
not padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.llm.common import released, slices, texts, utf8
from keepstone.llm.tokens import SLOTS, WordEncoder

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "size_class int, ids binary"
)
#: Sequences of one worker are numbered from its partition's number shifted by this.
WORKER_BITS = 36


def cut(n: int, capacity: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: exact reciprocals of the capacity, then one tail below ``least``."""
    pieces = [(at, capacity) for at in range(0, n - capacity + 1, capacity)]
    at, size = len(pieces) * capacity, capacity // 2
    while size >= least:
        if n - at >= size:
            pieces.append((at, size))
            at += size
        size //= 2
    if at < n:
        pieces.append((at, n - at))
    return pieces


class HarmonicPacker:
    """Bins of one worker. ``put`` takes a piece of ``cut``; it and ``finish`` yield closed bins: lists of (item, start, length)."""

    def __init__(self, capacity: int = 2048, least: int = 64):
        if capacity & (capacity - 1) or least & (least - 1) or not 0 < least <= capacity:
            raise ValueError("capacity and least must be powers of two, least at most capacity")
        self.capacity, self.least = capacity, least
        self.open: dict[int, list[tuple[object, int, int]]] = {}

    def put(self, item: object, start: int, length: int) -> Iterator[tuple[int, list[tuple[object, int, int]]]]:
        k = self.capacity // length
        held = self.open.setdefault(k, [])
        held.append((item, start, length))
        if len(held) == k:
            yield k, self.open.pop(k)

    def finish(self) -> Iterator[tuple[int, list[tuple[object, int, int]]]]:
        """Concatenate what is left, longest class first, and cut it at the capacity and then at powers of two."""
        left = [piece for k in sorted(self.open) for piece in self.open[k]]
        self.open = {}
        total = sum(length for _, _, length in left)
        sizes = [self.capacity] * (total // self.capacity)
        rest = total % self.capacity
        sizes += [1 << b for b in range(self.capacity.bit_length() - 1, -1, -1) if rest >> b & 1]
        pieces = iter(left)
        item, start, length = next(pieces, (None, 0, 0))
        for size in sizes:
            held = []
            while size:
                take = min(size, length)
                held.append((item, start, take))
                size, start, length = size - take, start + take, length - take
                if not length:
                    item, start, length = next(pieces, (None, 0, 0))
            yield 0, held


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    least: int = 64,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep_ids: bool = True,
) -> DataFrame:
    """One row for each piece, with its ids (``ids``, little-endian unsigned 32 bits) unless ``keep_ids`` is false.

    Only the id and text columns are read, so other columns can have any name. A null text counts as empty: its
    document is the end id alone. Rows that repeat are documents of their own; a null id is passed through. An empty
    table gives no row. ``size_class`` is k of the bin, 0 for a bin made of what was left over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # A table for each task: what outlived it would add to every later stage of a pipeline.
        encode, packer = WordEncoder(tokenizer, SLOTS // 4).encode_batch, HarmonicPacker(capacity, least)
        number = TaskContext.get().partitionId() << WORKER_BITS
        rows: list[tuple] = []

        def close(bins) -> None:
            nonlocal number
            for k, held in bins:
                offset = 0
                for (doc_id, total, first, ids), start, length in held:
                    part = ids[4 * (start - first) : 4 * (start - first + length)]
                    rows.append((doc_id, start, length, zlib.crc32(part), total, number, offset, k, part if keep_ids else None))
                    offset += length
                number += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            out = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in slices(batches, "text", 1 << 19):
            encoded = encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoded, strict=True):
                total = len(ids) // 4
                for start, length in cut(total, capacity, least):  # an open bin holds the pieces' ids alone
                    close(packer.put((doc_id, total, start, ids[4 * start : 4 * (start + length)]), start, length))
            if len(rows) >= 2048:
                yield flush()
        close(packer.finish())
        if rows:
            yield flush()

    narrow = texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    packed = narrow.mapInArrow(released(run), SCHEMA)
    return packed if keep_ids else packed.drop("ids")


def padding(lengths: np.ndarray, capacity: int = 2048) -> int:
    """Ids of padding for sequence lengths; a power of two isn't padded."""
    return int(np.where((lengths & (lengths - 1)) == 0, 0, capacity - lengths).sum())
