"""Beginnings of long ids, which tell them apart in the same order and are a fraction of what is shuffled and written."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_length(ids: DataFrame, column: str) -> int:
    """Characters after which no two ids agree: at first as many as hashes need, twice as many whenever that doesn't do. If
    an id stands several times, that is the longest one's length, and nothing is cut."""
    rows, longest = ids.agg(F.count(column), F.max(F.length(column))).first()
    length = 2 * math.ceil(math.log(max(rows, 2), 16)) + 2
    while length < (longest or 0):
        met = ids.where(F.col(column).isNotNull()).groupBy(F.substring(column, 1, length)).count().where("count > 1")
        if met.isEmpty():
            return length
        length *= 2
    return longest or 0


def lengthened(df: DataFrame, ids: DataFrame, column: str, length: int, columns: list[str]) -> DataFrame:
    """df with the whole ids in columns that hold their first ``length`` characters (``least_length``); what is no beginning
    of an id (null, a name given by hand) stays."""
    whole = ids.where(F.length(column) > length).select(F.col(column).alias("_whole"), F.substring(column, 1, length).alias("_short"))
    for name in columns:
        known = df.where(F.col(name).isNotNull()).join(whole, F.col(name) == F.col("_short"), "left")
        known = known.withColumn(name, F.coalesce("_whole", name)).select(*df.columns)
        df = known.unionByName(df.where(F.col(name).isNull()))
    return df
