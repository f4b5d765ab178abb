"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.llm.common import Scratch


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the m of their u. The key is one that neither side is dealt by yet, so that both are shuffled
    for the join and the edges of a node with very many neighbours can be split among tasks."""
    keyed = least.select(F.bitwise_not("u").alias("k"), "m")
    return edges.withColumn("k", F.bitwise_not("u")).join(keyed, "k").drop("k")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v. Neighbourhoods are only ever reduced to their minimum, never gathered.

    Large star: every neighbour above a node is linked to the least of the node and its neighbours. Small star: every
    neighbour below a node, and the node, are linked to the least neighbour.
    """
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = _with_least(edges, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u != v").distinct()


def components(links: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node that can be reached.

    Nodes without a link don't appear. Each round is written to the shared folder and the one before is deleted; the
    loop ends when a round changes nothing, after a number of rounds that grows with the logarithm of the nodes.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    edges = scratch.write(edges, f"{name}-0")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum("h"), F.bit_xor("h")).first())
    hashed = lambda e: e.withColumn("h", F.xxhash64("u", "v") % 1_000_000_007)
    seen, turn = mark(hashed(edges)), 0
    while seen[0]:
        turn += 1
        mid = scratch.write(_star(edges, True), f"{name}-{turn}-l")
        scratch.drop(f"{name}-{turn - 1}")
        edges = scratch.write(_star(mid, False), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn}-l")
        now = mark(hashed(edges))
        if now == seen:
            break
        seen = now
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    both = ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
    out = scratch.write(both, name)
    scratch.drop(f"{name}-{turn}")
    return out
