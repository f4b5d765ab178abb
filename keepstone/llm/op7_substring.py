"""Substring deduplication: runs of words that already stand in an earlier document are found with FM-indexes.

Windows of ``WINDOW`` consecutive words are judged. Comparing every document with an index of every other would grow
with the square of the corpus, so windows first meet by content: the least hash among the word groups inside a window
is its anchor, equal windows have equal anchors, and neighbouring windows with one anchor form a region of a document.
Only anchors of two or more documents are looked at further. Equal regions (copies) collapse to one content with the
least document as its owner. The contents are dealt to shards by anchor; each shard builds a compressed FM-index
(wavelet matrix) of its contents, streams them through it by backward search, and the matching statistics report
the runs of at least a window whose least owner is an earlier document. An anchor with very many contents is
compared by hashes of whole windows instead, which can be spread over any number of tasks. A copy of a content in a
document behind its owner is covered whole; nothing needs to be searched for it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import hand_back, in_map, key_map, released, Scratch, slices, texts, utf8
from keepstone.llm.fm_index import FmIndex

WINDOW = 50
#: Words of the group whose hash makes an anchor.
GROUP = 16
#: Words that a shard's index holds, about.
SHARD_WORDS = 150_000
#: Contents of one anchor that share a shard; anchors with more are compared by hashes of windows.
ANCHOR_CONTENTS = 1024
#: Bits of the map of anchors that stand in several documents (4 MB); a full map costs time only.
ANCHOR_BITS = 1 << 25

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; words are runs without ASCII white space."""
    data = np.frombuffer(text, np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    blank = np.concatenate([[True], _BLANK[data], [True]])
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    inside = np.flatnonzero(~blank[1:-1])
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(inside), dtype=np.uint64) - np.repeat(first, sizes).astype(np.uint64)
    letters = _mix((place << np.uint64(8)) + data[inside] + np.uint64(1))
    return _mix(np.add.reduceat(letters, first) + sizes.astype(np.uint64) * _ODD)


def group_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each group of ``size`` consecutive words, by doubling."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    powers, k = {1: words}, 1
    factor = {1: _STEP}
    with np.errstate(over="ignore"):
        while 2 * k <= size:
            h = powers[k]
            powers[2 * k] = h[: len(h) - k] * factor[k] + h[k:]
            factor[2 * k] = factor[k] * factor[k]
            k *= 2
        out, have = None, 0
        for part in sorted(powers, reverse=True):
            if size & part:
                n = len(words) - size + 1
                h = powers[part][have : have + n]
                out = h if out is None else out * factor[part] + h
                have += part
    return _mix(out)


def anchors(words: np.ndarray, window: int = WINDOW, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, first window, windows) for each run of neighbouring windows with one anchor."""
    g = group_hashes(words, group)
    span = window - group + 1
    n = len(words) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, size = np.arange(len(g)), 1
    pick = lambda a, b: np.where(g[b] <= g[a], b, a)  # noqa: E731  the last of the least
    while 2 * size <= span:
        at, size = pick(at[: len(at) - size], at[size:]), 2 * size
    at = pick(at[:n], at[span - size : span - size + n])
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return g[at[first]], first, np.diff(np.append(first, n))


def _region_hash(words: np.ndarray, first: np.ndarray, count: np.ndarray, window: int) -> np.ndarray:
    """Hash of the words of each region, from sums of the hashes of its windows at their places."""
    w = group_hashes(words, window)
    place = np.arange(len(w), dtype=np.uint64) - np.repeat(first, count).astype(np.uint64)
    return _mix(np.add.reduceat(_mix(w + place * _ODD), first) + count.astype(np.uint64)) if len(first) else w


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))


def _tag(text: bytes) -> int:
    """Tells rows with one id and different texts apart."""
    return zlib.crc32(text) - (1 << 31)


def find_anchors(rows: DataFrame, window: int, group: int) -> DataFrame:
    """(h, r, doc_id, tag, s, n): anchor, hash of the region's words, document, first window and windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = word_hashes(text)
                h, s, n = anchors(words, window, group)
                if len(h):
                    size = len(h)
                    out.append((h, _region_hash(words, s, n, window), np.full(size, doc_id), np.full(size, _tag(text)), s, n))
            if out:
                h, r, d, t, s, n = (np.concatenate(c) for c in zip(*out, strict=True))
                arrays = [_signed(h), _signed(r), pa.array(d), pa.array(t.astype(np.int32)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.record_batch(arrays, names=["h", "r", "doc_id", "tag", "s", "n"])

    narrow = rows.where("doc_id is not null and text is not null")
    return narrow.mapInArrow(released(run), "h long, r long, doc_id long, tag int, s int, n int")


def read_contents(rows: DataFrame, wanted: DataFrame, scratch: Scratch, window: int) -> DataFrame:
    """(h, r, owner, words): words of the wanted regions (h, r, doc_id, tag, s, n) as 64-bit hashes."""
    lists = wanted.groupBy("doc_id", F.col("tag").alias("want")).agg(F.collect_list(F.struct("h", "r", "s", "n")).alias("regions"))
    maybe, _ = in_map(rows.where("text is not null"), "doc_id", key_map(wanted, "doc_id", scratch, "wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            out: list[tuple] = []
            for doc_id, tag, text, regions in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if _tag(text) == tag:
                    words = word_hashes(text)
                    out += [(x["h"], x["r"], doc_id, words[x["s"] : x["s"] + x["n"] + window - 1].tobytes()) for x in regions]
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.record_batch(arrays, names=["h", "r", "owner", "words"])

    joined = maybe.join(lists, "doc_id").select("doc_id", "want", "text", "regions")
    # Two equal rows of one id read the same region twice.
    return joined.mapInArrow(released(run), "h long, r long, owner long, words binary")


def _spans(starts: np.ndarray, window: int) -> list[dict[str, int]]:
    """Windows (sorted first words) as spans of words."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window) + 1
    a, b = starts[np.concatenate([[0], cut])], starts[np.concatenate([cut - 1, [-1]]).astype(int)] + window
    return [{"a": int(x), "b": int(y)} for x, y in zip(a, b, strict=True)]


def search_shards(contents: DataFrame, shards: int, window: int) -> DataFrame:
    """(h, r, spans): runs of each content that stand in a content of a smaller owner, by one FM-index for each shard."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["h", "r"])
        words = [np.frombuffer(w, np.uint64) for w in rows["words"]]
        owner = rows["owner"].to_numpy(np.int64)
        index = FmIndex(words, np.searchsorted(np.unique(owner), owner), window)
        rank = np.searchsorted(np.unique(owner), owner)
        _, least, at = index.stream(words)
        spans = []
        for i, (a, w) in enumerate(zip(at, words, strict=True)):
            found = least[a : a + len(w)]
            spans.append(_spans(np.flatnonzero((found >= 0) & (found < rank[i])) - window + 1, window))
        out = pd.DataFrame({"h": rows["h"], "r": rows["r"], "owner": owner, "spans": spans})
        del index, words, least
        hand_back()  # a worker stays alive behind its task
        return out

    keyed = contents.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    return keyed.groupBy("shard").applyInPandas(run, "h long, r long, owner long, spans array<struct<a:int,b:int>>")


def search_windows(contents: DataFrame, window: int) -> DataFrame:
    """The same for anchors with very many contents: the least owner of every window, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, r, owner, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                w = group_hashes(np.frombuffer(words, np.uint64), window)
                n = len(w)
                arrays = [_signed(w), pa.array([h] * n, pa.int64()), pa.array([r] * n, pa.int64()), pa.array([owner] * n, pa.int64()), pa.array(range(n), pa.int32())]
                yield pa.record_batch(arrays, names=["w", "h", "r", "owner", "j"])

    at = contents.select("h", "r", "owner", "words").mapInArrow(released(run), "w long, h long, r long, owner long, j int")
    least = at.groupBy("h", "w").agg(F.min("owner").alias("least"), F.max("owner").alias("most")).where("least < most")
    found = at.join(least.select("h", "w", "least"), ["h", "w"]).where("least < owner")
    span = F.struct(F.col("j").alias("a"), (F.col("j") + window).cast("int").alias("b"))
    return found.groupBy("h", "r", "owner").agg(F.collect_set(span).alias("spans"))


def covered(spark: SparkSession, rows: DataFrame, scratch: Scratch, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(doc_id, tag, spans): spans of words of each document that stand in a document with a smaller id."""
    found = scratch.write(find_anchors(rows, window, group), "anchors")
    shared = found.groupBy("h").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), (F.min("r") == F.max("r")).alias("single")
    )
    shared = scratch.write(shared.where("lo < hi").select("h", "lo", "single"), "shared")
    # Most anchors stand in one document only; the map keeps them out of the join.
    maybe, _ = in_map(found, "h", key_map(shared, "h", scratch, "map", ANCHOR_BITS), ANCHOR_BITS)
    places = scratch.write(maybe.join(shared, "h"), "places")
    scratch.drop("anchors")
    whole = F.array(F.struct(F.col("s").alias("a"), (F.col("s") + F.col("n") + (window - 1)).cast("int").alias("b")))
    # Every content with its least document, and those of anchors with several contents, which have to be searched.
    first = places.groupBy("h", "r").agg(F.min(F.struct("doc_id", "tag", "s", "n")).alias("x"), F.first("single").alias("single"))
    first = scratch.write(first.select("h", "r", "single", "x.*"), "first")
    several = first.where("not single")
    per_anchor = several.groupBy("h").agg(F.count("*").alias("contents"), F.sum(F.col("n") + window - 1).alias("words"))
    many = scratch.write(per_anchor.where(F.col("contents") > ANCHOR_CONTENTS).select("h"), "many")
    total = per_anchor.where(F.col("contents") <= ANCHOR_CONTENTS).agg(F.sum("words")).first()[0] or 0
    contents = scratch.write(read_contents(rows, several, scratch, window), "contents")
    few = contents.join(many, "h", "left_anti")
    results = search_shards(few, max(1, -(-int(total) // SHARD_WORDS)), window)
    if not many.isEmpty():
        lots = contents.join(many, "h", "left_semi").dropDuplicates(["h", "r"])
        results = results.unionByName(search_windows(lots, window))
    results = scratch.write(results.where(F.size("spans") > 0), "results")
    scratch.drop("contents")
    # The owner of a content has what the search found; every later document has all of it.
    owners = first.select("h", "r", F.col("doc_id").alias("owner"))
    known = owners.join(results.select("h", "r", "spans"), ["h", "r"], "left").select(F.bitwise_not("h").alias("k"), "r", "owner", "spans")
    shift = F.transform("spans", lambda x: F.struct((x["a"] + F.col("s")).alias("a"), (x["b"] + F.col("s")).alias("b")))
    mine = F.when(F.col("doc_id") > F.col("owner"), whole).otherwise(shift)
    # A key of its own: both sides are dealt anew, so a content with very many places can be split among tasks.
    spans = places.withColumn("k", F.bitwise_not("h")).join(known, ["k", "r"]).select("doc_id", "tag", mine.alias("spans"))
    grouped = spans.groupBy("doc_id", "tag").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = scratch.write(grouped.where(F.size("spans") > 0), "covered")
    for name in ("shared", "map", "places", "first", "many", "results", "wanted"):
        scratch.drop(name)
    return out


def _kept(text: bytes, spans: list[dict[str, int]]) -> tuple[int, list[bytes]]:
    words = text.split()
    keep = np.ones(len(words) + 1, np.int64)
    if spans:
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, [x["a"] for x in spans], 1)
        np.add.at(edge, [x["b"] for x in spans], -1)
        keep = np.cumsum(edge) == 0
    return len(words), [w for w, k in zip(words, keep.tolist(), strict=False) if k]


def apply_spans(rows: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    Only rows that may have spans are shuffled; a map of fixed size tells which.
    """
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            marks = batch.column("spans").to_pylist() if "spans" in batch.schema.names else [None] * batch.num_rows
            out = []
            for doc_id, text, by_tag in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), marks, strict=True):
                n, kept = _kept(text or b"", _own_spans(text or b"", by_tag))
                out.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 3 + [pa.string()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    maybe, others = in_map(rows, "doc_id", key_map(spans, "doc_id", scratch, "marked"))
    read = maybe.join(_by_document(spans), "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(released(run), schema)
    return read.unionByName(others.select("doc_id", "text").mapInArrow(released(run), schema))


def _by_document(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "spans")).alias("spans"))


def _own_spans(text: bytes, by_tag: list[dict] | None) -> list[dict[str, int]]:
    return [x for m in by_tag or [] if m["tag"] == _tag(text) for x in m["spans"]]


def cut_repeats(spark: SparkSession, docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of documents (doc_id, text, n_chars and any others) without words that stand in an earlier document.

    A text that loses words becomes its kept words, one blank apart, with a new n_chars; a row that keeps none is
    dropped. Rows that lose nothing are returned as they are, null and blank texts among them.
    """
    scratch = Scratch(spark, "cut")
    spans = covered(spark, _rows(docs, "doc_id", "text"), scratch, window)
    named = spans.select(F.col("doc_id").alias("_ks_id"), F.col("tag").alias("_ks_tag"), F.col("spans").alias("_ks_spans"))
    named = named.groupBy("_ks_id").agg(F.collect_list(F.struct(F.col("_ks_tag").alias("tag"), F.col("_ks_spans").alias("spans"))).alias("_ks_spans"))

    @F.pandas_udf("string")
    def rest(texts: pd.Series, marks: pd.Series) -> pd.Series:
        out = []
        for text, by_tag in zip(texts, marks, strict=True):
            own = _own_spans(text, by_tag) if text is not None else []
            out.append(b" ".join(_kept(text, own)[1]).decode("utf-8", "replace") if own else None)
        hand_back()
        return pd.Series(out, dtype=object)

    maybe, others = in_map(docs, "doc_id", key_map(spans, "doc_id", scratch, "marked"))
    joined = maybe.join(named, F.col("doc_id") == F.col("_ks_id"), "left")
    marked = joined.where("_ks_spans is not null").withColumn("_ks_rest", rest(utf8("text"), F.col("_ks_spans")))
    kept = marked.where("_ks_rest is null or _ks_rest != ''").withColumns(
        {
            "n_chars": F.when(F.col("_ks_rest").isNull(), F.col("n_chars")).otherwise(F.length("_ks_rest")).cast(docs.schema["n_chars"].dataType),
            "text": F.coalesce("_ks_rest", "text"),
        }
    )
    same = joined.where("_ks_spans is null")
    return others.unionByName(same.select(*docs.columns)).unionByName(kept.select(*docs.columns))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row.

    A null text has no words. A row with a null id neither loses words nor makes others lose any; rows that share an
    id never make each other lose words, and each is judged by its own text. Texts shorter than a window stay whole.
    An empty table gives no row. Only id and text are read.
    """
    scratch = Scratch(spark, "substring")
    rows = _rows(docs, id_col, text_col)
    return apply_spans(rows, covered(spark, rows, scratch, window), scratch)
