"""Blocks of vectors that lie together, and which pairs of blocks can hold a similar pair.

Vectors go to their nearest of a few pivots, and what gathers at one pivot is cut by hash into blocks of a bounded size.
With a block's centre c and radius r, no vector of it and no vector of another block (d, s) have a product above
c.d + |c| s + |d| r + r s, so pairs of blocks below the least similarity that counts are never multiplied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.functions.scalars import dot
from keepstone.session import ship, small_batches
from keepstone.sources.shared import stored

#: Pivots at most, and parts in which the blocks of a side are written.
PIVOTS, PARTS = 1024, 16
#: Parts at least in which a side is searched, and blocks of a part while there are fewer than ``PARTS``.
FEW, PART_BLOCKS = 4, 128
#: What rounding may add to a product of unit vectors.
SLACK = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


class Balls:
    """Rows (id, v, other whole numbers) dealt to blocks: ``rows`` has them with ``block``, ``stats`` (block, centre, radius,
    n), and ``packed`` a row for each block, with its vectors (``vs``) and its numbers (``ids``, ...) as bytes."""

    def __init__(self, rows: DataFrame, block: int):
        spark = rows.sparkSession
        ship(spark)
        rows = stored(rows, "vectors")
        count = rows.count()
        n_pivots = min(PIVOTS, max(1, -(-count // block)))
        pivots = np.asarray([r["v"] for r in rows.select("v", F.xxhash64("id").alias("_h")).orderBy("_h").limit(n_pivots).collect()], float)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = _matrix(batch.column("v")) @ pivots.T - 0.5 * (pivots * pivots).sum(axis=1)
                cell = far.argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=[*batch.schema.names, "cell"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
        celled = stored(rows.mapInArrow(nearest, f"{schema}, cell int"), "celled") if count else rows.withColumn("cell", F.lit(0))
        sizes = {r["cell"]: r["count"] for r in celled.groupBy("cell").count().collect()}  # a row for each pivot
        starts, at = {}, 0
        for cell, n in sorted(sizes.items()):
            starts[cell] = (at, -(-n // block))
            at += -(-n // block)
        table = spark.createDataFrame([(c, a, n) for c, (a, n) in starts.items()], "cell int, _start int, _parts int")
        dealt = celled.join(F.broadcast(table), "cell").withColumn("block", (F.col("_start") + F.pmod(F.xxhash64("id"), F.col("_parts"))).cast("int"))
        self.rows = stored(dealt.select(*rows.columns, "block"), "dealt")

        def packed(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("id")
            v = np.stack(frame["v"].to_numpy()).astype(float)
            centre = v.mean(axis=0)
            radius = float(np.sqrt(((v - centre) ** 2).sum(axis=1).max()))
            told = {"block": [frame["block"].iloc[0]], "centre": [centre], "length": [float(np.sqrt(centre @ centre))], "radius": [radius], "n": [len(v)]}
            return pd.DataFrame({**told, "vs": [v.tobytes()], **{f"{c}s": [frame[c].to_numpy().astype(np.int64).tobytes()] for c in longs}})

        longs = [c for c in rows.columns if c != "v"]
        schema = "block int, centre array<double>, length double, radius double, n long, vs binary" + "".join(f", {c}s binary" for c in longs)
        dealt = self.rows.repartition(max(1, min(PARTS, at)), "block")
        self.packed = stored(dealt.groupBy("block").applyInPandas(packed, schema), "packed")
        self.parts = min(PARTS, max(FEW, -(-at // PART_BLOCKS)))
        self.stats = self.packed.select("block", "centre", "radius", "n")


def bounds(a: Balls, b: Balls) -> DataFrame:
    """(i, j, most, near): for each pair of blocks the most that a product can be, and that of their centres.

    The blocks of one side, one row for some thousand vectors, are sent to the tasks of the other."""
    found = b.stats.collect()
    names = np.asarray([r["block"] for r in found], np.int32)
    centres, radii = np.asarray([r["centre"] for r in found], float), np.asarray([r["radius"] for r in found])
    lengths = np.sqrt((centres * centres).sum(axis=1)) if len(found) else radii

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, c, r in zip(batch.column("block").to_pylist(), _matrix(batch.column("centre")), batch.column("radius").to_pylist(), strict=True):
                near = centres @ c
                most = near + np.sqrt(c @ c) * radii + lengths * r + r * radii
                yield pa.record_batch([pa.array(np.full(len(names), name, np.int32)), pa.array(names), pa.array(most), pa.array(near)], names=["i", "j", "most", "near"])

    schema = "i int, j int, most double, near double"
    if not found:
        return a.rows.sparkSession.createDataFrame([], schema)
    return stored(a.stats.select("block", "centre", "radius").mapInArrow(run, schema), "bounds")


def crossed(a: DataFrame, b: DataFrame, least: Column, also: Column | None = None) -> DataFrame:
    """Each packed block of ``a`` beside each of ``b`` (columns with the prefix r_) that may hold a product of ``least``.

    Parts of both sides, at most ``PARTS``, are read as they were written, each by the tasks that need it, so no vector is
    shuffled or written again, however many blocks there are. A block of ``a`` meets the blocks of a part one after another.
    """
    small_batches(a.sparkSession, 64, 4 << 20)
    b = b.select(*[F.col(c).alias(f"r_{c}") for c in b.columns])
    reach = F.col("length") * F.col("r_radius") + F.col("r_length") * F.col("radius") + F.col("radius") * F.col("r_radius")
    on = dot(F.col("centre"), F.col("r_centre")) + reach >= least - SLACK
    both = a.join(b.hint("shuffle_replicate_nl"), on if also is None else also & on)
    return both.drop("centre", "r_centre")


def beside(a: Balls, b: Balls, pairs: DataFrame) -> DataFrame:
    """The packed blocks of a few ``pairs`` (i, j) beside each other, as ``crossed`` has them."""
    small_batches(a.rows.sparkSession, 64, 4 << 20)
    named = pairs.groupBy(F.col("i").alias("block")).agg(F.collect_list("j").alias("js"))  # a row for each block
    right = b.packed.select(*[F.col(c).alias(f"r_{c}") for c in b.packed.columns])
    return a.packed.join(F.broadcast(named), "block").join(right.hint("shuffle_replicate_nl"), F.array_contains("js", F.col("r_block")))


def unpacked(vs: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, ids) of a packed block, by ascending id."""
    found = np.frombuffer(ids, np.int64)
    return np.frombuffer(vs, float).reshape(len(found), -1), found
