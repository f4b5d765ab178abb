"""Connected components without gathering a neighbourhood anywhere."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.sources.shared import shared_folder


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node reachable from each node of a link. Links with a null end are ignored.

    Each round hooks every node to the least label among its neighbours and then jumps to that label's own label, so
    the number of rounds grows with the logarithm of a path's length. Rounds are written to the shared folder.
    """
    spark = links.sparkSession
    root = f"{shared_folder(spark)}/components-{uuid.uuid4().hex[:12]}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")

    clean = links.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    both = kept(clean.unionByName(clean.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "links")
    labels = kept(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.first("x")).alias("label")), "labels-0")
    turn = 0
    while True:
        turn += 1
        near = both.join(labels.select(F.col("node").alias("y"), F.col("label").alias("other")), "y")
        least = near.groupBy("x").agg(F.min("other").alias("least"))
        hooked = labels.join(least, labels["node"] == least["x"]).select("node", "label", F.least("label", "least").alias("next"))
        jump = labels.select(F.col("node").alias("j"), F.col("label").alias("further"))
        moved = hooked.join(jump, hooked["next"] == jump["j"], "left").select("node", "label", F.least("next", F.coalesce("further", "next")).alias("next"))
        moved = kept(moved, f"labels-{turn}")
        changed = moved.where("label != next").limit(1).count()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
