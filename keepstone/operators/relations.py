"""Small relational tools: as-of joins, optional filters, scopes, dynamic columns, path reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.operators.ordering import last_values


def as_of(
    left: DataFrame, right: DataFrame, keys: list[str], time: str, take: list[str], direction: str = "backward", tolerance: float | None = None
) -> DataFrame:
    """left plus ``take`` of one right row of its keys: the last at or before its time (backward), the first at or after
    it (forward), or the nearer of the two (nearest; backward if they are as near). None within ``tolerance`` seconds
    gives nulls, as does none at all. Of right rows at one time the largest counts.

    Both sides lie in one order by key and time, in ranges that carry their last row on, so nothing is paired and a
    single key is many tasks.
    """
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    one = right.groupBy(*keys, time).agg(F.max(F.struct(*take)).alias("_take")).select(*keys, F.struct(micros.alias("t"), "_take").alias("_right"), micros.alias("_t"))
    rows = left.withColumns({"_right": F.lit(None).cast(one.schema["_right"].dataType), "_own": F.lit(1), "_t": micros})
    both = rows.unionByName(one.withColumn("_own", F.lit(0)), allowMissingColumns=True)
    if direction in ("backward", "nearest"):
        both = last_values(both, keys, ["_t", "_own"], {"_back": F.col("_right")})
    if direction in ("forward", "nearest"):
        both = last_values(both, keys, [F.desc("_t"), "_own"], {"_ahead": F.col("_right")})
    far = lambda c: F.abs(F.col(f"{c}.t") - F.col("_t"))
    found = {"backward": F.col("_back") if direction != "forward" else None, "forward": F.col("_ahead") if direction != "backward" else None}.get(direction)
    if direction == "nearest":
        found = F.when(F.col("_ahead").isNull() | (far("_back") <= far("_ahead")), F.col("_back")).otherwise(F.col("_ahead"))
    out = both.where("_own = 1").withColumn("_found", found)
    if tolerance is not None:
        out = out.withColumn("_found", F.when(far("_found") <= int(tolerance * 1_000_000), F.col("_found")))
    return out.select(*left.columns, *[F.col(f"_found._take.{c}").alias(f"as_of_{c}") for c in take])


def matching(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows with the given values; an empty text or None asks for nothing."""
    for column, value in wanted.items():
        if value not in ("", None):
            df = df.where(F.col(column) == value)
    return df


def in_scope(df: DataFrame, key: str, scope: DataFrame | None) -> DataFrame:
    """Rows whose key is in the scope; no scope means all rows, an empty one none."""
    return df if scope is None else df.join(scope.select(key).distinct(), key, "left_semi")


def known_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Those of the named columns that there are, in the table's order."""
    return df.select(*[c for c in df.columns if c in names])


def exists(df: DataFrame) -> bool:
    return not df.isEmpty()


def path_report(named: dict[str, str], listing: DataFrame) -> DataFrame:
    """(label, path, there) for a few named places; listing (path)."""
    rows = listing.sparkSession.createDataFrame(list(named.items()), "label string, path string")
    have = listing.select("path", F.lit(True).alias("_there")).distinct()
    return rows.join(have, "path", "left").select("label", "path", F.coalesce("_there", F.lit(False)).alias("there"))
