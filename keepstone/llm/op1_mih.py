"""Exact top-k search over binary codes by incremental multi-index hashing.

Codes of 64 bits are cut into four segments of 16 bits, and each distinct code is posted under its segment values.
Round r probes, in every segment, all values at exactly r bits from the query's segment. A code at Hamming distance
d has a segment at d / 4 bits or fewer, so after round r every code at distance 4r + 3 or less has been verified: a
query whose k-th verified distance is within that radius is done; the others grow their radius by one.

Rows are dealt at random into shards. A task builds the tables of a shard once, streams all queries through them and
passes on the k best of each query, of which the k best over all shards are the answer. In a
shard, equal codes are one posting that carries its k + 1 least ids, which is all that ties can ask for, so copies
neither crowd a bucket nor repeat among the candidates. A code is verified by the first probe that meets it.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import Scratch, search_blocks

SEGMENTS, SEGMENT_BITS = 4, 16
#: Rows of a shard, whose codes and tables take a few MB.
SHARD_ROWS = 1 << 17
#: Probes that are held at a time.
PROBES = 1 << 21


def sign_code(vector: Column) -> Column:
    """64-bit code of a vector: bit i is set if component i is above zero. Null unless 64 components that are numbers
    exist."""
    whole = (F.size(vector) == 64) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x))
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.expr("1L")).otherwise(F.lit(0)))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(x))
    return F.when(F.coalesce(whole, F.lit(False)), code)


@functools.cache
def _masks(r: int) -> np.ndarray:
    """All segment masks of r bits."""
    every = np.arange(1 << SEGMENT_BITS, dtype=np.int64)
    return every[np.bitwise_count(every) == r]


def _segments(codes: np.ndarray) -> np.ndarray:
    """Segment values, a row for each segment."""
    return np.stack([((codes >> np.uint64(SEGMENT_BITS * s)) & np.uint64(0xFFFF)).astype(np.int64) for s in range(SEGMENTS)])


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """Segment tables over distinct codes, with the least ids of each."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray, k: int):
        order = np.lexsort((ids, codes))
        ids, codes = ids[order], codes[order]
        again = np.concatenate([[False], (codes[1:] == codes[:-1]) & (ids[1:] == ids[:-1])])
        ids, codes = ids[~again], codes[~again]
        self.codes, first, count = np.unique(codes, return_index=True, return_counts=True)
        self.ids, self.first, self.count = ids, first, np.minimum(count, k + 1)
        self.k = k
        self.segments = _segments(self.codes)
        self.order = np.stack([np.argsort(s, kind="stable") for s in self.segments])
        self.starts = np.stack([np.searchsorted(s[o], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in zip(self.segments, self.order, strict=True)])

    def search(self, query_ids: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, distance, id): the k least of each query by (distance, id), its own id left out."""
        own = _segments(queries)
        open_queries = np.arange(len(queries))
        pool = tuple(np.empty(0, np.int64) for _ in range(3))
        for r in range(SEGMENT_BITS + 1):
            masks = _masks(r)
            for at in range(0, len(open_queries), step := max(1, PROBES // len(masks))):
                some = open_queries[at : at + step]
                pool = self._best(pool, *(self._probe(some, own, queries, query_ids, s, r, masks) for s in range(SEGMENTS)))
            number, distance, _ = pool
            full = np.bincount(number, distance <= SEGMENTS * r + SEGMENTS - 1, len(queries)) >= self.k
            open_queries = open_queries[~full[open_queries]]
            if not len(open_queries):
                break
        return pool

    def _probe(self, some, own, queries, query_ids, segment, r, masks):
        value = (own[segment][some][:, None] ^ masks[None, :]).ravel()
        start, stop = self.starts[segment][value], self.starts[segment][value + 1]
        hit = np.flatnonzero(stop > start)
        size = (stop - start)[hit]
        code = self.order[segment][_spread(start[hit], size)]
        number = np.repeat(some[hit // len(masks)], size)
        met = np.zeros(len(code), bool)  # by a round or a segment before
        for s in range(SEGMENTS):
            if s != segment:
                apart = np.bitwise_count(self.segments[s][code] ^ own[s][number])
                met |= apart < r + (s < segment)
        code, number = code[~met], number[~met]
        distance = np.bitwise_count(self.codes[code] ^ queries[number]).astype(np.int64)
        count = self.count[code]
        number, distance = np.repeat(number, count), np.repeat(distance, count)
        ids = self.ids[_spread(self.first[code], count)]
        keep = ids != query_ids[number]
        return number[keep], distance[keep], ids[keep]

    def _best(self, *parts):
        number, distance, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((ids, distance, number))
        number, distance, ids = number[order], distance[order], ids[order]
        first = np.searchsorted(number, number)
        keep = np.arange(len(number)) - first < self.k
        return number[keep], distance[keep], ids[keep]


def nearest_codes(spark: SparkSession, rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(query_id, rank, vec_id, distance): for each query row the k rows of least Hamming distance, exactly.

    Every row but those with the query's own id is a candidate; ties go to the smaller id. Rows with a null id or code
    take no part; a row that repeats counts once, and an id with two codes may be found by either; fewer than k
    candidates give fewer rows. Only id and code are read.
    """
    scratch = Scratch(spark, "mih")
    clean = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(code_col).cast("long").alias("code")).dropna()
    queries = clean.where(is_query).distinct()
    n_shards = max(1, -(-clean.count() // SHARD_ROWS))
    numbers = lambda batch: (batch.column("vec_id").to_numpy(), batch.column("code").to_numpy().view(np.uint64))

    def search(shard: Shard, asked: pa.RecordBatch) -> pa.RecordBatch:
        query_ids, wanted = numbers(asked)
        number, distance, ids = shard.search(query_ids, wanted)
        found = (query_ids[number], wanted[number].view(np.int64), ids, distance.astype(np.int32))
        return pa.record_batch([pa.array(x) for x in found], names=["query_id", "q", "vec_id", "distance"])

    build = lambda batch: Shard(*numbers(batch), k)
    found = search_blocks(clean, queries, n_shards, build, search, "query_id long, q long, vec_id long, distance int")
    # Shards may hold one id with two codes, and one query id may stand for two: the nearer counts.
    nearest = scratch.write(found, "found").groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = nearest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "distance")
