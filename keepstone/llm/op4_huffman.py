"""Token-id files: canonical length-limited Huffman codes from global counts, decoded by table in independent blocks.

Steps: (1) texts become ids, written once; (2) ids are counted over the whole corpus, pre-aggregated in each worker;
the driver sees at most one count for each id of the vocabulary; (3) package-merge gives code lengths of at most
``MAX_BITS``, from which canonical codes follow, so the header, a file beside the blocks, is the lengths alone; (4)
documents are ranged by ascending id into shards, and each shard is a file of blocks; (5) header and blocks are read
back, by another reader than the writer if need be, and decoded by table.

A block holds whole documents and about ``block_tokens`` ids, so a task's memory grows with the longest document. Its
payload begins with a bit-offset checkpoint for every ``STEP`` ids, so a reader can start at any of them; the decoder
runs all checkpoints of a block in step.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import released, Scratch, slices, texts, utf8
from keepstone.llm.tokens import encoder, vocabulary_size

#: Longest code. A decoding table has 2 to this power entries.
MAX_BITS = 18
#: Ids between two checkpoints of a block.
STEP = 128
MAGIC = b"KSH1"
BLOCK = struct.Struct("<4sIII")  # magic, documents, ids, bytes of the bit string


# --- codes -------------------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 where the count is 0. One symbol gets 1 bit."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n == 0:
        return lengths
    if n == 1:
        lengths[symbols] = 1
        return lengths
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols don't fit codes of {max_bits} bits")
    order = np.argsort(counts[symbols], kind="stable")
    weight = counts[symbols][order].astype(np.int64)
    # Each level merges the coins with the packages of the level before; is_coin remembers which is which.
    levels: list[np.ndarray] = []
    packages = np.empty(0, np.int64)
    for _ in range(max_bits):
        merged = np.concatenate([weight, packages])
        at = np.argsort(merged, kind="stable")
        levels.append(at < n)
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, used = 2 * n - 2, np.zeros(n + 1, np.int64)
    for is_coin in reversed(levels):
        coins = int(is_coin[:take].sum())
        used[coins] += 1  # the cheapest ``coins`` symbols gain one bit
        take = 2 * (take - coins)
    gained = np.cumsum(used[::-1])[::-1][1:]
    lengths[symbols[order]] = gained
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol), most significant bit first."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    for s in np.lexsort((np.arange(len(lengths)), lengths)):
        bits = int(lengths[s])
        if bits:
            code <<= bits - last
            codes[s] = code
            code, last = code + 1, bits
    return codes


def decoding_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """For each string of ``max_bits`` bits: the first symbol times 32 plus its length."""
    table = np.zeros(1 << max_bits, np.uint32)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (max_bits - lengths[used].astype(np.int64))
    if len(used):
        start = int(codes[used[0]]) << (max_bits - int(lengths[used[0]]))
        table[start : start + int(spans.sum())] = np.repeat(used.astype(np.uint32) * 32 + lengths[used], spans)
    return table


def stored_type(vocabulary: int) -> str:
    """Ids on their way from tokenizer to encoder: vocabularies of up to 65,536 ids take two bytes, others four."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pack_bits(codes: np.ndarray, bits: np.ndarray, starts: np.ndarray) -> bytes:
    """Codes one after another, most significant bit first. They enter 64-bit words whole; what crosses a word's end
    is put into the next one. No code is longer than a word, so each word but the last has a code that starts in it."""
    if not len(codes):
        return b""
    total = int(starts[-1] + bits[-1])
    word, room = starts >> 6, 64 - (starts & 63) - bits
    wide = codes.astype(np.uint64)
    high = np.where(room >= 0, wide << np.maximum(room, 0).astype(np.uint64), wide >> np.maximum(-room, 0).astype(np.uint64))
    first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    words = np.zeros((total + 63) // 64 + 1, np.uint64)
    words[word[first]] = np.bitwise_or.reduceat(high, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= wide[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: (total + 7) // 8]


# --- blocks ------------------------------------------------------------------------------------------------------


def encode_block(documents: list[bytes], lengths: np.ndarray, codes: np.ndarray, stored: str = "<u2") -> bytes:
    """Documents (ids as ``stored``) as one payload, which the header's lengths alone decode."""
    ids = np.frombuffer(b"".join(documents), stored)
    bits = lengths[ids].astype(np.int64)
    starts = np.cumsum(bits) - bits
    stream = pack_bits(codes[ids], bits, starts)
    head = BLOCK.pack(MAGIC, len(documents), len(ids), len(stream))
    width = np.dtype(stored).itemsize
    sizes = np.asarray([len(d) // width for d in documents], "<u4").tobytes()
    return head + sizes + starts[::STEP].astype("<u8").tobytes() + stream


def decode_block(payload: bytes, table: np.ndarray, max_bits: int = MAX_BITS) -> list[np.ndarray]:
    """The ids of each document. All checkpoints advance together, one id at a time."""
    magic, n_docs, n_ids, n_bytes = BLOCK.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    sizes = np.frombuffer(payload, "<u4", n_docs, BLOCK.size)
    lanes = -(-n_ids // STEP)
    at = BLOCK.size + 4 * n_docs
    position = np.frombuffer(payload, "<u8", lanes, at).astype(np.int64)
    bits = np.frombuffer(payload[at + 8 * lanes : at + 8 * lanes + n_bytes] + bytes(8), np.uint8)
    windows = np.ndarray((len(bits) - 3,), ">u4", bits, 0, (1,))  # a 32-bit word at every byte
    out = np.zeros((STEP, lanes), np.uint32)
    last = n_ids - (lanes - 1) * STEP if lanes else 0
    for i in range(STEP if lanes > 1 else last):
        live = position if i < last else position[: lanes - 1]
        word = windows[live >> 3].astype(np.uint32) << (live & 7).astype(np.uint32)
        entry = table[word >> np.uint32(32 - max_bits)]
        out[i, : len(live)] = entry >> 5
        live += (entry & 31).astype(np.int64)
    flat = out.T.reshape(-1)[:n_ids]
    return np.split(flat, np.cumsum(sizes)[:-1]) if n_docs else []


# --- Spark -------------------------------------------------------------------------------------------------------


def encode_ids(docs: DataFrame, tokenizer: str, stored: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): ids of each whole text with the end id, as ``stored``; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode_batch
        for batch in slices(batches, "text", 1 << 20):
            ids = pa.array(encode(batch.column("text").to_pylist(), stored), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), ids], names=["doc_id", "ids"])

    narrow = texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return narrow.mapInArrow(released(run), "doc_id long, ids binary")


def count_ids(encoded: DataFrame, stored: str) -> DataFrame:
    """(id, n) over the whole corpus: each worker sums its own part, then one row for each id and worker is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in slices(batches, "ids"):
            found = np.bincount(np.frombuffer(b"".join(batch.column("ids").to_pylist()), stored))
            if len(found) > len(total):
                total = np.concatenate([total, np.zeros(len(found) - len(total), np.int64)])
            total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    partial = encoded.select("ids").mapInArrow(released(run), "id long, n long")
    return partial.groupBy("id").agg(F.sum("n").alias("n"))


def write_files(
    docs: DataFrame,
    tokenizer: str,
    scratch: Scratch,
    block_tokens: int = 1 << 16,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> None:
    """Write ``header`` (magic, max_bits, lengths) and ``blocks`` (shard, block, before, doc_ids, n_tokens, payload)
    under the scratch folder."""
    vocabulary = vocabulary_size(tokenizer)
    stored = stored_type(vocabulary)
    width = np.dtype(stored).itemsize
    encoded = scratch.write(encode_ids(docs, tokenizer, stored, id_col, text_col), "ids")
    counts = np.zeros(vocabulary, np.int64)
    for row in count_ids(encoded, stored).toLocalIterator():  # at most one row for each id of the vocabulary
        counts[row["id"]] = row["n"]
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    header = [(bytearray(MAGIC), MAX_BITS, bytearray(lengths.tobytes()))]
    scratch.write(scratch.spark.createDataFrame(header, "magic binary, max_bits int, lengths binary"), "header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        names: list[int | None] = []
        size = before = 0

        def close() -> pa.RecordBatch:
            nonlocal block, held, names, size, before
            row = pa.record_batch(
                [
                    pa.array([shard], pa.int32()),
                    pa.array([block], pa.int64()),
                    pa.array([before], pa.int64()),
                    pa.array([names], pa.list_(pa.int64())),
                    pa.array([size], pa.int64()),
                    pa.array([encode_block(held, lengths, codes, stored)], pa.binary()),
                ],
                names=["shard", "block", "before", "doc_ids", "n_tokens", "payload"],
            )
            block, before, held, names, size = block + 1, before + size, [], [], 0
            return row

        for batch in slices(batches, "ids"):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                held.append(ids)
                names.append(doc_id)
                size += len(ids) // width
                if size >= block_tokens:
                    yield close()
        if held:
            yield close()

    # Equal ids are told apart by their content, so that repeated rows have one order and many nulls don't share a task.
    keyed = encoded.withColumn("h", F.xxhash64("ids"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "ids").drop("h")
    blocks = ordered.mapInArrow(released(run), "shard int, block long, before long, doc_ids array<long>, n_tokens long, payload binary")
    blocks.write.mode("overwrite").option("compression", "none").parquet(scratch.path("blocks"))
    scratch.drop("ids")


@functools.lru_cache(maxsize=1)
def _table(lengths: bytes, max_bits: int) -> np.ndarray:
    return decoding_table(np.frombuffer(lengths, np.uint8), max_bits)


def read_files(scratch: Scratch) -> DataFrame:
    """(doc_id, start, ids) from the written files alone: start counts the ids of all documents before.

    Sums by shard (as many rows as shards) give where a shard begins; a block knows its own start in the shard.
    """
    spark = scratch.spark
    blocks = scratch.read("blocks")
    head = scratch.read("header").first()  # one row of a byte for each id of the vocabulary
    if bytes(head["magic"]) != MAGIC:
        raise ValueError("not a header of this format")
    lengths, max_bits = bytes(head["lengths"]), head["max_bits"]
    shard_starts, at = {}, 0
    for row in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():  # one for a shard
        shard_starts[row["shard"]] = at
        at += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(lengths, max_bits)
        for batch in slices(batches, "payload", 1 << 20):
            for shard, before, names, payload in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = [x.astype("<u4").tobytes() for x in decode_block(payload, table, max_bits)]
                at = shard_starts[shard] + before
                starts = at + np.cumsum([0, *(len(x) // 4 for x in ids)])[:-1]
                yield pa.record_batch(
                    [pa.array(names, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "ids"],
                )

    if not shard_starts:
        return spark.createDataFrame([], "doc_id long, start long, ids binary")
    return blocks.select("shard", "before", "doc_ids", "payload").mapInArrow(released(run), "doc_id long, start long, ids binary")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of decoded documents, without shipping the ids out of the worker."""

    return decoded.select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) / 4 as long)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def huffman_round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, block_tokens: int = 1 << 16) -> DataFrame:
    """Write the files of ``docs`` and read them back.

    Null text counts as empty (the end id alone). Null ids come first; rows that share an id are ordered by a
    hash of their token ids, then by their bytes. An empty table gives empty files and no row. Only id and text are read.
    """
    scratch = Scratch(spark, "huffman")
    write_files(docs, tokenizer, scratch, block_tokens)
    return digests(read_files(scratch))
