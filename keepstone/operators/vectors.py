"""Similarity over unit vectors: labelling from named examples, mutual nearest neighbours, groups, typicality.

Vectors are compared block against block: each side is dealt into blocks of vectors that lie together and packed, a row
for each block, and parts of both sides meet by a Cartesian product of those rows, which shuffles nothing. A task sees two
blocks at a time, and only the best of a part leave it. Pairs of blocks that can't hold a similar pair are left out (``balls``). Results are exact; where vectors don't cluster, hardly a
pair is left out and the work is the product of both sides, which is meant for some ten million vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.functions.scalars import dot
from keepstone.operators import balls
from keepstone.operators.graph import connected_components
from keepstone.sources.shared import stored

BLOCK = 2048
#: Parts of the left side of a search.
LEFT_PARTS = 64


def _best(found: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """Of (row, other, similarity) the k most similar of each row, ties of 12 digits to the smaller id."""
    rows, others, sims = found
    order = np.lexsort((others, -np.round(sims, 12), rows))
    rows = rows[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    kept = order[place < k]
    return found[0][kept], others[kept], sims[kept]


def _reaching(v: np.ndarray, w: np.ndarray, least: np.ndarray, k: int = 0) -> tuple[np.ndarray, ...]:
    """(row, column, product) of what reaches ``least``, one number for each row of ``v``; with ``k``, where very much does,
    the k largest of each row, ties to the first column.

    Single precision and what it can be off by leave few products out of which double precision chooses.
    """
    off = (v.shape[1] + 4) * 2.0**-23 * np.sqrt((v * v).sum(axis=1).max() * (w * w).sum(axis=1).max()) + 1e-30
    low = np.nextafter((least - off).astype(np.float32), np.float32(-np.inf))
    at = np.flatnonzero(~(v.astype(np.float32) @ w.astype(np.float32).T < low[:, None]))
    if len(at) * 64 > len(v) * len(w):
        sims = v @ w.T
        if len(at) * 8 > sims.size and 0 < k < len(w):
            i, j = np.repeat(np.arange(len(v)), k), np.argsort(-np.round(sims, 12), axis=1, kind="stable")[:, :k].ravel()
            return i, j, sims[i, j]
        i, j = np.divmod(np.flatnonzero(sims >= least[:, None]), len(w))
        return i, j, sims[i, j]
    i, j = np.divmod(at, len(w))
    sims = np.einsum("ij,ij->i", v[i], w[j])
    hit = sims >= least[i]
    return i[hit], j[hit], sims[hit]


def nearest(left: DataFrame, right: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """(id, other, similarity): for each left (id, v) the k most similar right rows, itself included; ties to the
    smaller id.

    Each block is compared with the two whose centres are nearest first. The k-th similarity found there is what another
    row has to reach, and the least of a block what another block has to be able to reach to be compared at all.
    """

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k largest similarities of each row of a left block in one block."""
        for batch in batches:
            for r in batch.to_pylist():
                sims = balls.unpacked(r["vs"], r["ids"])[0] @ balls.unpacked(r["r_vs"], r["r_ids"])[0].T
                top = np.full((len(sims), k), -np.inf)
                n = min(k, sims.shape[1])
                top[:, :n] = np.partition(sims, -n, axis=1)[:, -n:]
                yield pa.record_batch([pa.array([r["block"]], pa.int32()), pa.array([top.tobytes()])], names=["block", "top"])

    def known(frame: pd.DataFrame) -> pd.DataFrame:
        """The k-th similarity of each row of a left block in the blocks beside it."""
        tops = np.concatenate([np.frombuffer(t, float).reshape(-1, k) for t in frame["top"]], axis=1)
        kth = np.partition(tops, -k, axis=1)[:, -k]
        return pd.DataFrame({"block": [frame["block"].iloc[0]], "least": [float(kth.min())], "kths": [kth.tobytes()]})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, waiting = None, [], 0

        def merged() -> tuple[np.ndarray, ...]:
            return _best(tuple(np.concatenate(x) for x in zip(*held, strict=True)), k)

        def told() -> pa.RecordBatch:
            i, others, sims = merged()
            return pa.record_batch([pa.array(ids[i]), pa.array(others), pa.array(sims)], names=["id", "other", "similarity"])

        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != here:
                    if held:
                        yield told()
                    v, ids = balls.unpacked(r["vs"], r["ids"])
                    least = np.frombuffer(r["kths"], float) - balls.SLACK
                    here, held, waiting = r["block"], [], 0
                w, others = balls.unpacked(r["r_vs"], r["r_ids"])
                i, j, sims = _reaching(v, w, least, k)
                held.append((i, others[j], sims))
                waiting += len(i)
                if waiting > k * len(ids):
                    held, waiting = [merged()], 0
                    i, _, sims = held[0]
                    low = np.full(len(ids), np.inf)
                    np.minimum.at(low, i, sims)
                    least = np.where(np.bincount(i, minlength=len(ids)) == k, np.maximum(least, low - balls.SLACK), least)
        if held:
            yield told()

    x = balls.Balls(left.select("id", "v"), block)
    y = x if left is right else balls.Balls(right.select("id", "v"), block)
    ranked = balls.bounds(x, y).withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy(F.desc("near"), "j")))
    first = balls.beside(x, y, ranked.where("_r <= 2")).select("block", "vs", "ids", "r_vs", "r_ids")
    tops = first.mapInArrow(ahead, "block int, top binary").groupBy("block").applyInPandas(known, "block int, least double, kths binary")
    parts = [z.repartition(LEFT_PARTS, "block") for z in (x.packed, tops)]
    told = stored(parts[0].join(parts[1], "block"), "near")
    met = balls.crossed(told, y.packed.coalesce(y.parts), F.col("least")).select("block", "vs", "ids", "kths", "r_vs", "r_ids")
    found = met.mapInArrow(best, "id long, other long, similarity double")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "other")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def similar_pairs(vectors: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """(id, other, similarity) of all pairs of vectors (id, v) with at least a similarity, id < other."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v, ids = balls.unpacked(r["vs"], r["ids"])
                w, others = balls.unpacked(r["r_vs"], r["r_ids"])
                i, j, sims = _reaching(v, w, np.full(len(v), least))
                if r["block"] == r["r_block"]:
                    below = ids[i] < others[j]
                    i, j, sims = i[below], j[below], sims[below]
                a, b = ids[i], others[j]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(sims)], names=["id", "other", "similarity"])

    x = balls.Balls(vectors.select("id", "v"), block).packed
    met = balls.crossed(x, x, F.lit(least), F.col("block") <= F.col("r_block")).select("block", "vs", "ids", "r_block", "r_vs", "r_ids")
    return met.mapInArrow(pairs, "id long, other long, similarity double")


def label_from_examples(todo: DataFrame, named: DataFrame, rejected: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(id, person_id, similarity): the person whose named vectors a vector resembles most, if near enough.

    todo (id, v), named (id, v, person_id), rejected (id, person_id): a rejected person is never given.
    """

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                v, ids = balls.unpacked(r["vs"], r["ids"])
                w, _ = balls.unpacked(r["r_vs"], r["r_ids"])
                sims = v @ w.T
                people, at = np.unique(np.frombuffer(r["r_person_ids"], np.int64), return_inverse=True)
                top = np.stack([sims[:, at == p].max(axis=1) for p in range(len(people))], axis=1)
                rows, cols = np.nonzero(top >= threshold)
                yield pa.record_batch([pa.array(ids[rows]), pa.array(people[cols]), pa.array(top[rows, cols])], names=["id", "person_id", "similarity"])

    x, y = balls.Balls(todo.select("id", "v"), block), balls.Balls(named.select("id", "v", "person_id"), block)
    met = balls.crossed(x.packed, y.packed, F.lit(threshold)).select("vs", "ids", "r_vs", "r_ids", "r_person_ids")
    found = met.mapInArrow(best, "id long, person_id long, similarity double").groupBy("id", "person_id").agg(F.max("similarity").alias("similarity"))
    allowed = found.join(rejected.select("id", "person_id"), ["id", "person_id"], "left_anti")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("similarity", 12)), "person_id")
    return allowed.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def mutual_groups(vectors: DataFrame, k: int, threshold: float) -> DataFrame:
    """(id, group_id): components of links where each is among the other's k nearest (itself counts as one) and near
    enough; a vector without a link is its own group. The group's id is its least member."""
    links = nearest(vectors, vectors, k).where((F.col("similarity") >= threshold) & (F.col("id") != F.col("other")))
    back = links.select(F.col("other").alias("x"), F.col("id").alias("y"))
    mutual = links.select("id", "other").join(back, (F.col("id") == F.col("x")) & (F.col("other") == F.col("y")), "left_semi").where("id < other")
    groups = connected_components(mutual, "id", "other")
    return vectors.select("id").join(groups, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group_id"))


def label_state(vectors: DataFrame, auto: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, person_id, label_source, similarity, group_id): user labels stay, ignored ones are blank, then automatic
    labels, then groups."""
    a = auto.select(F.col("id").alias("_a"), F.col("person_id").alias("_p"), F.col("similarity").alias("_s"))
    g = groups.select(F.col("id").alias("_g"), "group_id")
    base = vectors.select("id", "person_id", "label_source", "ignored")
    joined = base.join(a, F.col("id") == F.col("_a"), "left").join(g, F.col("id") == F.col("_g"), "left")
    user, ignored = F.coalesce(F.col("label_source") == "user", F.lit(False)), F.coalesce("ignored", F.lit(False))
    auto_here = ~user & ~ignored & F.col("_p").isNotNull()
    return joined.select(
        "id",
        F.when(user, F.col("person_id")).when(auto_here, F.col("_p")).alias("person_id"),
        F.when(user, "user").when(auto_here, "auto").alias("label_source"),
        F.when(auto_here, F.col("_s")).alias("similarity"),
        F.when(~user & ~ignored & F.col("_p").isNull(), F.col("group_id")).alias("group_id"),
    )


def assign(vectors: DataFrame, rejected: DataFrame, match: float, group: float, k: int) -> DataFrame:
    """Labels from scratch: only user labels teach; automatic ones never do; ignored vectors take no part."""
    v = vectors.withColumn("v", F.col("embedding").cast("array<double>"))
    user = F.coalesce(F.col("label_source") == "user", F.lit(False))
    todo = v.where(~user & ~F.coalesce("ignored", F.lit(False)))
    auto = label_from_examples(todo, v.where(user & F.col("person_id").isNotNull()), rejected, match)
    found = auto.select(F.col("id").alias("_id"))
    unknown = todo.join(found, F.col("id") == F.col("_id"), "left_anti").select("id", "v")
    return label_state(vectors, auto, mutual_groups(unknown, k, group))


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, centroid): mean of each component, scaled to length one unless it is zero."""
    parts = vectors.select(*keys, F.posexplode("v").alias("pos", "x"))
    mean = parts.groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    made = mean.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("c"))
    raw = made.select(*keys, F.col("c.m").alias("c"))
    norm = F.sqrt(dot(F.col("c"), F.col("c")))
    return raw.select(*keys, F.transform("c", lambda x: x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).alias("centroid"))


def typicality(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """vectors plus similarity to their group's centroid and rank, most typical first."""
    near = vectors.join(centroids(vectors, keys), keys).withColumn("similarity", dot(F.col("v"), F.col("centroid")))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("similarity", 12)), "id")
    return near.withColumn("rank", F.row_number().over(order)).drop("centroid")


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.25) -> Column:
    """Pixels of a box given in shares of an image, padded and clamped to the image."""
    left, top = (x - w * pad) * width, (y - h * pad) * height
    right, bottom = (x + w * (1 + pad)) * width, (y + h * (1 + pad)) * height
    return F.struct(
        F.greatest(F.lit(0), F.floor(left)).cast("int").alias("left"),
        F.greatest(F.lit(0), F.floor(top)).cast("int").alias("top"),
        F.least(width, F.ceil(right)).cast("int").alias("right"),
        F.least(height, F.ceil(bottom)).cast("int").alias("bottom"),
    )
