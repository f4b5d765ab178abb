"""SimHash near-duplicates with pivot distance tables.

Texts become 64-bit fingerprints; equal fingerprints form one class, so copies are counted once and never paired.
Class fingerprints at three bits or fewer agree in at least one of four 16-bit segments, so each class is posted under
its four segment values and only classes that share a posting are looked at. There the pivot table does the work: the
Hamming distances of a fingerprint to many reference fingerprints are its coordinates, and by the triangle inequality
two fingerprints whose coordinates differ by more than the threshold anywhere can't be linked. Pairs that survive the
largest coordinate difference are verified on the fingerprints. A posting with many classes is split into blocks by
salt, and pairs of blocks are dealt to different tasks. Links go to connected components.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import released, Scratch, slices, texts, utf8
from keepstone.llm.components import components

SEED = 42
SHINGLE = 3
MOST_BITS = 3
#: Reference fingerprints of the pivot table.
PIVOTS = 24
#: Classes of one posting that meet in one block.
BLOCK = 1024
#: Words whose shingles are hashed at a time.
CHUNK = 1 << 16


def fingerprint(text: bytes | None) -> int:
    """SimHash over 3-word shingles, repeats included; 0 without words."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    count = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, count, CHUNK):
        part = words[at : at + CHUNK + SHINGLE - 1]
        line = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
        starts = (ends[: max(1, len(part) - SHINGLE + 1)] - np.fromiter(map(len, part[: max(1, len(part) - SHINGLE + 1)]), np.int64) - 1).tolist()
        stops = (ends[min(SHINGLE, len(part)) - 1 :] - 1).tolist()
        hashes = np.asarray([hash_of(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > count).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, for every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = [_signed(fingerprint(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    narrow = texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))
    return narrow.mapInArrow(released(run), "doc_id long, fp long")


def references() -> np.ndarray:
    """The fixed reference fingerprints."""
    return np.random.default_rng(8).integers(0, 1 << 64, PIVOTS, np.uint64)


def coordinates(fp: Column) -> list[Column]:
    """The pivot table's row of a fingerprint: Hamming distances to the reference fingerprints, eight to a long."""
    distance = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(int(r))))).cast("long") for r in references()]
    eights = [distance[i : i + 8] for i in range(0, PIVOTS, 8)]
    return [functools.reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * i) for i, d in enumerate(part)]) for part in eights]


def unpacked(longs: list[np.ndarray]) -> np.ndarray:
    """The pivot table of packed coordinates: a row for each pivot."""
    return np.concatenate([np.ascontiguousarray(x).view(np.int8).reshape(-1, 8).T for x in longs])


def close_pairs(left: np.ndarray, right: np.ndarray, fps: np.ndarray, table: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Which of the index pairs are linked: coordinates first, pivot by pivot, then the fingerprints of survivors."""
    alive = np.arange(len(left))
    for row in table:
        alive = alive[np.abs(row[left[alive]] - row[right[alive]]) <= most]
        if not len(alive):
            return alive
    return alive[np.bitwise_count(fps[left[alive]] ^ fps[right[alive]]) <= most]


def _pairs_in_runs(key: np.ndarray, fps: np.ndarray, side: np.ndarray, table: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among rows of equal key (sorted); rows of side 1 and 2 meet each other only, side 0 meets all."""
    active = np.arange(len(key))
    out_a, out_b = [], []
    step = 1
    while True:
        active = active[active + step < len(key)]
        active = active[key[active] == key[active + step]]
        if not len(active):
            break
        left = active[(side[active] == 0) | (side[active] != side[active + step])]
        hit = left[close_pairs(left, left + step, fps, table, most)]
        out_a.append(hit)
        out_b.append(hit + step)
        step += 1
    none = np.empty(0, np.int64)
    return np.concatenate([*out_a, none]), np.concatenate([*out_b, none])


def links(spark: SparkSession, classes: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): ids of linked classes (id, fp); fingerprints are distinct. Every link is found, some more than once.

    ``most`` must be below the number of segments, four.
    """
    if most > 3:
        raise ValueError("four segments cover three bits at most")
    packed = [c.alias(f"c{i}") for i, c in enumerate(coordinates(F.col("fp")))]  # once for a class, before it is posted
    coords = [f"c{i}" for i in range(len(packed))]
    posted = classes.select("id", "fp", *packed).select(
        "id",
        "fp",
        *coords,
        F.posexplode(F.array(*[F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF) for i in range(4)])).alias("seg", "val"),
    )
    # Postings beyond one block; as many rows as such postings, each of which has over ``block`` classes.
    large = posted.groupBy("seg", "val").count().where(F.col("count") > block)
    salts = F.coalesce(F.ceil(F.col("count") / block).cast("int"), F.lit(1))
    dealt = posted.join(large, ["seg", "val"], "left").select("id", "fp", *coords, "seg", "val", salts.alias("n"))
    dealt = dealt.withColumn("s", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    # A block meets itself and every other block of its posting.
    grid = dealt.withColumn("t", F.explode(F.expr("sequence(0, n - 1)"))).select(
        "id",
        "fp",
        F.expr("seg * 65536L + val").alias("posting"),
        F.least("s", "t").alias("x"),
        F.greatest("s", "t").alias("y"),
        F.expr("case when s = t then 0 when s < t then 1 else 2 end").alias("side"),
        *coords,
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def solve(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            ids, fps, posting, x, y, side, *longs = rows
            key = np.cumsum(np.concatenate([[0], (np.diff(posting) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)]))
            a, b = _pairs_in_runs(key, fps.view(np.uint64), side, unpacked(longs), most)
            return pa.record_batch([pa.array(ids[a], pa.int64()), pa.array(ids[b], pa.int64())], names=["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows = tuple(np.concatenate(c) for c in zip(*held, strict=True))
            ends = np.flatnonzero((np.diff(rows[2]) != 0) | (np.diff(rows[3]) != 0) | (np.diff(rows[4]) != 0)) + 1
            cut = int(ends[-1]) if len(ends) else 0  # the last group may go on in the next batch
            if cut:
                yield solve(tuple(c[:cut] for c in rows))
            held = [tuple(c[cut:] for c in rows)]
        if held and len(held[0][0]):
            yield solve(tuple(np.concatenate(c) for c in zip(*held, strict=True)))

    keys = ["posting", "x", "y"]
    spread = grid.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return spread.mapInArrow(released(run), "a long, b long")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id, class_id, n_links) for every row.

    component_id is the least id that can be reached over links; class_id the least id with the same fingerprint, and
    n_links the number of other fingerprints linked to it, so copies need no pairs. Null and blank texts have
    fingerprint 0 and are linked like any other. A row with a null id gets its fingerprint's class, but is never its
    least id; a class of null ids alone has no component. Repeated rows are returned as often. Only id and text are read.
    """
    scratch = Scratch(spark, "simhash")
    prints = scratch.write(fingerprints(docs, id_col, text_col), "prints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("id"))
    classes = scratch.write(classes, "classes")
    found = scratch.write(links(spark, classes.where("id is not null")).distinct(), "links")
    comps = components(found, scratch)
    degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = (
        classes.join(comps, F.col("id") == F.col("node"), "left")
        .drop("node")
        .join(degree, F.col("id") == F.col("node"), "left")
        .select(
            "fp",
            F.col("id").alias("class_id"),
            F.coalesce("component", "id").alias("component_id"),
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
        )
    )
    named = scratch.write(named, "named")
    for name in ("classes", "links", "cc"):
        scratch.drop(name)
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "class_id", "n_links"
    )
