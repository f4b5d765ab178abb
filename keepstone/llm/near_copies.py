"""Near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, every such link and no other.

Nodes are distinct shingle sets, so copies are counted once and never paired. Candidates come from two sides and are all
verified on the whole sets.

(1) SimHash with pivot distance tables (``op8_simhash.links``): nodes whose fingerprints over the same shingles differ
in three bits or fewer. These join most of a large group of copies cheaply, but reach no pair near the threshold.

(2) What fingerprints miss: a set of n shingles that reaches the similarity with another shares ceil(4n/5) of them at
least, so under any one order of all shingles the first n - ceil(4n/5) + 1 of both sets have one in common. The order
puts shingles that only one node has first, which needn't be posted, as they meet nothing. Whether a shingle stands
alone is counted for the quarter of shingles whose hash ends in two zero bits. Then come the other three quarters, then
those of the quarter that several nodes have, and at the end the frequent ones of a sample, by count. A text that is
mostly its own has a fifth of its shingles alone and is done. The sample and the quarter decide how many postings there
are, never what is found.

Nodes of one posting meet in two rounds. First each meets the next one in an order that is different in every posting;
verified pairs, with those of (1), give components. Then all pairs of a posting meet that these components don't join
yet, so a large group of copies costs its square only as far as its members aren't linked. A posting that the sample
shows to be large is dealt to several tasks by salt, in blocks. Pairs are ruled out by counts of shingles in 256 cells
before whole sets are read. Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm import op8_simhash
from keepstone.llm.common import Scratch, in_map, key_map, released, slices, texts, utf8
from keepstone.llm.components import components

SHINGLE = 5
#: One text of so many is sampled for counts; so many of the most frequent shingles are told to all tasks.
SAMPLE, COMMON = 16, 1 << 18
#: Shingles whose last bits are zero are counted over all nodes.
COUNTED = np.uint64(3)
#: Nodes of one posting that meet in one block.
BLOCK = 1024
#: Cells of the shingle counts that rule out pairs before their sets are compared.
CELLS = 256
#: A cell counts no further; two sets with such cells aren't ruled out by them.
FULL = 255
#: Shingles whose bits are summed at a time for a fingerprint.
CHUNK = 1 << 16
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_NONE = np.zeros(0, np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """Distinct hashes of the 5-word shingles, sorted; a shorter text is one shingle, a blank one has none."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return _NONE
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        out = out * _FACTOR + h[i : i + len(out)]
    out = (out ^ (out >> np.uint64(31))) * _MIX
    return np.unique(out ^ (out >> np.uint64(29)))


def posted(n: int) -> int:
    """How many of n shingles, in the order of all shingles, two sets that reach the similarity can't both differ in."""
    return n + (-4 * n) // 5 + 1 if n else 0


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set: a bit is 1 if over half of the hashes have it; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


class Frequent:
    """The frequent shingles of the sample, sorted by hash, with their counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Count of each hash, 0 where it isn't frequent."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.counts[at], 0)

    def counted(self, hashes: np.ndarray) -> np.ndarray:
        """Those of the quarter that is counted over all nodes."""
        some = hashes[(hashes & COUNTED) == 0]
        return some[self.count(some) == 0]

    def prefix(self, hashes: np.ndarray, several: np.ndarray) -> np.ndarray:
        """What has to be posted: ``several`` are the counted shingles that other nodes have as well."""
        counts = self.count(hashes)
        quarter = (hashes & COUNTED) == 0
        alone = quarter & (counts == 0) & ~np.isin(hashes, several)
        rest, seen = hashes[~alone], counts[~alone]
        order = np.lexsort((rest, quarter[~alone], seen))
        return rest[order[: max(0, posted(len(hashes)) - int(alone.sum()))]]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return _long(xxhash.xxh64_intdigest(hashes.tobytes()))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), _longs(np.concatenate([*parts, _NONE])))


def _cells(hashes: np.ndarray) -> bytes:
    return np.minimum(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=CELLS), FULL).astype(np.uint8).tobytes()


def _of_texts(rows: DataFrame, make, schema: str) -> DataFrame:
    """``make`` of a slice and its shingle sets gives columns of ``schema``."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            yield pa.record_batch(make(batch, [shingles(t) for t in batch.column("text").to_pylist()]), names=names)

    return rows.mapInArrow(released(run), schema)


def _frequent(rows: DataFrame, sample: int) -> DataFrame:
    """(h, count): the most frequent shingles of a sample of distinct texts, at most ``COMMON``."""
    part = rows.where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0).select("text").distinct()
    found = _of_texts(part, lambda batch, sets: [_longs(np.concatenate([*sets, _NONE]))], "h long")
    return found.groupBy("h").count().where("count > 1").orderBy(F.desc("count"), "h").limit(COMMON)


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that cells and sizes don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, CELLS) for c in ("ca", "cb"))
            n = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            open_end = ((a == FULL) & (b == FULL)).any(axis=1)
            keep = open_end | (9 * np.minimum(a, b).sum(axis=1, dtype=np.int64) >= 4 * n)
            yield pa.record_batch([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("cells").alias(f"c{x}"))
    near = F.expr("5 * least(na, nb) >= 4 * greatest(na, nb)")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(near)
    return both.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(released(run), "a long, b long")


def _verified(pairs: DataFrame, rows: DataFrame, nodes: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (a, b) of nodes whose whole sets reach the similarity. The texts of their nodes are read once more."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    keys = scratch.write(nodes.join(named, "node").select("node", "key"), f"{name}-keys")
    maybe, _ = in_map(rows, "key", key_map(keys, "key", scratch, f"{name}-map"))
    wanted = maybe.join(keys, "key").groupBy("node").agg(F.first("text").alias("text"))  # one of its copies
    sets = _of_texts(wanted, lambda batch, sets: [batch.column("node"), _lists(sets)], "node long, h array<long>")
    sets = scratch.write(sets, f"{name}-sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    same = F.size(F.array_intersect("ha", "hb"))
    found = both.where(9 * same >= 4 * (F.size("ha") + F.size("hb"))).select("a", "b")
    found = scratch.write(found, name)
    for part in ("keys", "map", "sets"):
        scratch.drop(f"{name}-{part}")
    return found


def _unjoined(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of one posting in different components that sizes and cells don't rule out, some more than once.

    rows: (h, s, k, node, n, c, cells), where s is the salt of k of the posting h and c the component.
    """
    grid = rows.withColumn("t", F.explode(F.expr("sequence(0, k - 1)"))).select(
        "h", F.least("s", "t").alias("x"), F.greatest("s", "t").alias("y"),
        F.expr("case when s = t then 0 when s < t then 1 else 2 end").alias("side"), F.col("node").alias("id"), "n", "c", "cells",
    )

    def solve(part: pa.RecordBatch) -> pa.RecordBatch:
        side, ids, n, c = (part.column(i).to_numpy() for i in ("side", "id", "n", "c"))
        cells = np.frombuffer(b"".join(part.column("cells").to_pylist()), np.uint8).reshape(-1, CELLS)
        full = (cells == FULL).any(axis=1)
        out_a, out_b = [], []
        for i in range(len(ids) - 1):
            j = np.arange(i + 1, len(ids))
            j = j[(c[j] != c[i]) & (5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i])) & ((side[j] == 0) | (side[j] != side[i]))]
            if len(j):
                j = j[(full[j] & full[i]) | (9 * np.minimum(cells[j], cells[i]).sum(axis=1, dtype=np.int64) >= 4 * (n[j] + n[i]))]
                out_a.append(np.minimum(ids[j], ids[i]))
                out_b.append(np.maximum(ids[j], ids[i]))
        none = [np.zeros(0, np.int64)]
        return pa.record_batch([pa.array(np.concatenate(out_a + none)), pa.array(np.concatenate(out_b + none))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            held = table.to_batches()[0] if len(table) else None
            if held is None:
                continue
            keys = [held.column(i).to_numpy() for i in ("h", "x", "y")]
            ends = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            for a, b in zip([0, *ends[:-1]], ends, strict=False):
                yield solve(held.slice(a, b - a))
            held = held.slice(ends[-1]) if len(ends) else held  # the last group may go on in the next batch
        if held is not None:
            yield solve(held)

    keys = ["h", "x", "y"]
    return grid.repartition(*keys).sortWithinPartitions(*keys, "id").mapInArrow(released(run), "a long, b long")


def groups(
    spark: SparkSession, docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """(doc_id, key, component_id, first_key) for every row: ``key`` is a hash of id and text, ``component_id`` the least
    id that links reach, and ``first_key`` the key of its row (the least one if that id has several texts there).

    Rows without words (null and blank texts) are one group. A null id comes behind all others. Only id and text are read.
    """
    narrow = texts(docs).select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("text"))
    rows = narrow.withColumn("key", F.xxhash64("id", "text"))
    frequent = scratch.write(_frequent(rows, sample), "frequent")
    top = frequent.toArrow()  # at most COMMON rows
    told = spark.sparkContext.broadcast(Frequent(top.column("h").to_numpy().astype(np.int64).view(np.uint64), top.column("count").to_numpy()))

    def mark(batch: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        node, fp = pa.array(map(_node, sets), pa.int64()), pa.array([_long(fingerprint(s)) for s in sets], pa.int64())
        sizes = [pa.array(map(len, x), pa.int32()) for x in (sets, map(told.value.counted, sets))]
        return [batch.column("id"), batch.column("key"), node, fp, *sizes, pa.array(map(_cells, sets), pa.binary())]

    def count(batch: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        parts = [told.value.counted(s) for s in sets]
        nodes = np.asarray([_node(s) for s in sets], np.int64)
        return [_longs(np.concatenate([*parts, _NONE])), pa.array(np.repeat(nodes, [len(p) for p in parts]), pa.int64())]

    def post(batch: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        several = [np.asarray(x or [], np.int64).view(np.uint64) for x in batch.column("several").to_pylist()]
        return [batch.column("node"), batch.column("n"), _lists([told.value.prefix(*x) for x in zip(sets, several, strict=True)])]

    marks = scratch.write(_of_texts(rows, mark, "id long, key long, node long, fp long, n int, m int, cells binary"), "marks")
    one = marks.groupBy("node").agg(*(F.first(c).alias(c) for c in ("fp", "n", "m", "cells")), F.min("key").alias("key"))
    nodes = scratch.write(one, "nodes")

    # (1) fingerprints
    classes = nodes.groupBy("fp").agg(F.min("node").alias("id"))
    close = op8_simhash.links(spark, classes)
    same = nodes.select("node", "fp").join(classes, "fp").where("node != id").select(F.col("id").alias("a"), F.col("node").alias("b"))

    # (2) postings. Frequent shingles aren't counted here, so no shingle has a large window.
    alike = Window.partitionBy("h")
    counted = _of_texts(rows, count, "h long, node long").select("h", "node", F.min("node").over(alike).alias("lo"), F.max("node").over(alike).alias("hi"))
    several = scratch.write(counted.where("lo < hi").select("h", "node").distinct(), "several")
    lists = several.groupBy("node").agg(F.collect_list("h").alias("several"))
    short = F.expr("n + floor(-4 * n / 5) + 1 - (m - coalesce(size(several), 0))")
    todo = nodes.where("n > 0").select("node", "key", "n", "m").join(lists, "node", "left").where(short > 0)
    todo = scratch.write(todo.select("node", "key", "n", "several"), "todo")
    maybe, _ = in_map(rows, "key", key_map(todo, "key", scratch, "map"))
    found = _of_texts(maybe.join(todo, "key").select("node", "n", "several", "text"), post, "node long, n int, h array<long>")
    large = frequent.select("h", F.ceil(F.col("count") * sample / block).cast("int").alias("k")).where("k > 1")
    postings = found.select("node", "n", F.explode("h").alias("h")).join(F.broadcast(large), "h", "left").withColumn("k", F.coalesce("k", F.lit(1)))
    postings = postings.withColumn("s", F.pmod(F.xxhash64("node"), "k").cast("int")).distinct()
    part = Window.partitionBy("h", "s")
    order = part.orderBy(F.xxhash64("node", "h"), "node")
    shared = postings.select("*", F.count("*").over(part).alias("g"), F.lead("node").over(order).alias("next"))
    shared = scratch.write(shared.where("g > 1 or k > 1"), "shared")
    pairs = shared.where("next is not null").select(F.col("node").alias("a"), F.col("next").alias("b")).unionByName(close).unionByName(same)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pairs = scratch.write(_possible(pairs, nodes), "pairs")
    links = _verified(pairs, rows, nodes, scratch, "links")
    comps = components(links, scratch, "first")
    again = shared.where("g > 2 or k > 1").select("h", "s", "k", "node", "n").join(comps, "node", "left")
    again = again.withColumn("c", F.coalesce("component", "node")).drop("component")
    # A posting whose nodes lie in one component has nothing left to join.
    split = again.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("h")
    again = again.join(split, "h", "left_semi").join(nodes.select("node", "cells"), "node")
    more = scratch.write(_unjoined(again).distinct(), "more")
    every = comps.select(F.col("component").alias("a"), F.col("node").alias("b"))
    if not more.isEmpty():
        every = every.unionByName(_verified(more, rows, nodes, scratch, "late"))
        comps = components(scratch.write(every, "all"), scratch)

    named = marks.select("id", "key", "node").join(comps, "node", "left").select("id", "key", F.coalesce("component", "node").alias("c"))
    named = scratch.write(named, "named")
    first = named.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "key")).alias("x"))
    first = first.select(F.bitwise_not("c").alias("k"), F.col("x.id").alias("component_id"), F.col("x.key").alias("first_key"))
    out = named.withColumn("k", F.bitwise_not("c")).join(first, "k").select(F.col("id").alias("doc_id"), "key", "component_id", "first_key")
    out = scratch.write(out, "groups")
    for name in ("frequent", "marks", "nodes", "several", "todo", "map", "shared", "pairs", "links", "first", "more", "late", "all", "cc", "named"):
        scratch.drop(name)
    return out


def drop_near_copies(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of docs, one for each group of linked texts: the one with the least id (a null id comes behind all others;
    the least hash of the text decides between texts of one id). Of rows that repeat id and text, one stays: the least
    by a hash of their other columns. Texts that are linked to nothing stay, whatever ids they share. Null and blank
    texts are copies of each other. Columns of any name are passed through.
    """
    scratch = Scratch(spark, "near")
    found = groups(spark, docs, scratch, id_col, text_col, **options)
    per_key = found.groupBy("key").agg(F.count("*").alias("rows"), F.min(F.col("key") != F.col("first_key")).alias("later"))
    touched = scratch.write(per_key.where("rows > 1 or later").select("key", "later"), "touched")
    keyed = docs.withColumn("_ks_key", F.xxhash64(F.col(id_col).cast("long"), utf8(text_col)))
    maybe, others = in_map(keyed, "_ks_key", key_map(touched, "key", scratch, "touched-map"))
    gone = touched.where("later").select(F.col("key").alias("_ks_key"))
    rest = maybe.join(gone, "_ks_key", "left_anti")
    whole = F.struct(*docs.columns)
    # Repeats are reduced within each task first; a row that doesn't repeat is a group of its own.
    rest = rest.groupBy("_ks_key").agg(F.min_by(whole, F.xxhash64(*_hashable(docs))).alias("_ks_row")).select("_ks_row.*")
    return others.select(*docs.columns).unionByName(rest)


def _hashable(docs: DataFrame) -> list[str]:
    return [f.name for f in docs.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
