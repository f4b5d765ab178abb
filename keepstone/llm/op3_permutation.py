"""Approximate nearest neighbours with a permutation index.

A bounded sample of vectors serves as pivots. A vector is represented by its nearest pivots in order, a prefix of the
permutation of all pivots. The vectors are dealt at random into blocks, and a block keeps an inverted file for each
pivot: the vectors that have it in their prefix, with its position there. A query reads the files of the pivots in its
own prefix and no others. With positions counted from 0, prefixes of m pivots and position m for every pivot outside,
the footrule distance (the sum over pivots of the difference in position) of two prefixes is a constant less twice the
sum of m - max(position, position) over the pivots that both have, so the postings that are read give it exactly. The
nearest share of a block by footrule is compared with the query on the original vectors, in double precision; the k
best of those over all blocks are the answer.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.llm.common import Scratch, search_blocks

#: Pivots, and how many of them a prefix has.
PIVOTS, PREFIX = 1024, 64
#: Share of a block that is compared exactly, and the least number.
RERANK_SHARE, RERANK_LEAST = 0.1, 128
#: Rows of a block of vectors.
BLOCK_ROWS = 1 << 15
#: Vectors whose distances to all pivots are held at a time.
CHUNK = 4096


def prefixes(unit: np.ndarray, pivots: np.ndarray, size: int = PREFIX) -> np.ndarray:
    """The nearest pivots of each vector in order, nearest first; ties go to the first pivot."""
    size = min(size, len(pivots))
    out = np.empty((len(unit), size), np.int32)
    for at in range(0, len(unit), CHUNK):
        away = -(unit[at : at + CHUNK] @ pivots.T)
        if size < len(pivots):  # all that are as near as the last one of the prefix, then in order
            last = np.partition(away, size - 1, axis=1)[:, size - 1 : size]
            away = np.where(away <= last, away, np.inf)
        out[at : at + CHUNK] = np.argsort(away, axis=1, kind="stable")[:, :size]
    return out


class Block:
    """Vectors of a block in the order of their ids, and its inverted files."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.pivots = ids[by_id], vectors[by_id], pivots
        self.length = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        near = prefixes(self.vectors / self.length[:, None], pivots)
        self.size = near.shape[1]
        flat = near.ravel()
        order = np.argsort(flat, kind="stable")
        self.row = (order // self.size).astype(np.int32)
        self.position = (order % self.size).astype(np.int16)
        self.start = np.searchsorted(flat[order], np.arange(len(pivots) + 1))

    def closeness(self, prefix: np.ndarray) -> np.ndarray:
        """For each vector the sum over shared pivots of m less the larger position: half of what the footrule distance
        to the query's prefix falls short of its largest value."""
        out = np.zeros(len(self.ids), np.int32)
        for at, pivot in enumerate(prefix.tolist()):
            a, b = self.start[pivot], self.start[pivot + 1]
            out[self.row[a:b]] += self.size - np.maximum(self.position[a:b], at)  # a vector stands once in a file
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, cosine) of the k best of the block for each query; a query never finds its own id."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        n = len(self.ids)
        most = min(n, max(RERANK_LEAST, k + 1, int(np.ceil(RERANK_SHARE * n))))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for name, query, size, prefix in zip(query_ids, queries, lengths, prefixes(queries / lengths[:, None], self.pivots), strict=True):
            own = self.ids == name
            # In the order of (footrule, id): rows are in the order of ids. Its own rows take no place.
            key = np.arange(n) - self.closeness(prefix).astype(np.int64) * n
            key[own] = np.iinfo(np.int64).max
            near = np.argpartition(key, most - 1)[:most] if most < n else np.arange(n)
            near = near[~own[near]]
            cosine = (self.vectors[near] * query).sum(axis=1) / (self.length[near] * size)
            best = np.lexsort((self.ids[near], -cosine))[:k]
            found.append((np.full(len(best), name), self.ids[near][best], cosine[best]))
        empty = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return tuple(np.concatenate(x) for x in zip(*(found or [empty]), strict=True))


def usable(vector: Column) -> Column:
    """Not null or empty, no null or non-finite component, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(
        vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False)
    )


def nearest(
    spark: SparkSession,
    rows: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row among all rows but its own id.

    Rows with a null id or an unusable vector take no part. Vectors are compared with those of as many components only,
    in a search for each such number. Ties go to the smaller id; a row that repeats a (id, vector) counts once, and of an
    id with several vectors the nearest counts. Fewer candidates than k give fewer rows. Only id and vector are read.
    """
    scratch = Scratch(spark, "permutation")
    clean = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = clean.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    # Repeats go before anything is cut to a number of rows: they would take the places of other neighbours.
    distinct = clean.dropDuplicates(["vec_id", "v"])
    schema = "query_id long, vec_id long, score double"
    found = [
        _search(distinct.where(F.size("v") == dim), is_query, n, dim, k, pivots, schema)
        for dim, n in clean.groupBy(F.size("v").alias("dim")).count().orderBy("dim").collect()
    ]
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = scratch.write(functools.reduce(DataFrame.unionByName, found), "found").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(rows: DataFrame, is_query: Column, count: int, dim: int, k: int, pivots: int, schema: str) -> DataFrame:
    """(query_id, vec_id, score) over vectors of ``dim`` components: the k best of each block."""
    sample = rows.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(pivots).collect()
    points = np.asarray([r["v"] for r in sample])
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("vec_id").to_numpy(), batch.column("v").flatten().to_numpy().reshape(-1, dim)

    def search(block: Block, asked: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x) for x in block.search(*numbers(asked), k)], names=["query_id", "vec_id", "score"])

    build = lambda batch: Block(*numbers(batch), points)
    return search_blocks(rows, rows.where(is_query), max(1, -(-count // BLOCK_ROWS)), build, search, schema)
