"""Rows of Spark and DuckDB in one form."""

from __future__ import annotations

import decimal


def plain(value):
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    if isinstance(value, (float, decimal.Decimal)):
        return float(f"{float(value):.9g}")
    if isinstance(value, (list, tuple)):
        return [plain(x) for x in value]
    if isinstance(value, dict):
        return {k: plain(x) for k, x in value.items()}
    return value


def spark_rows(df) -> list[str]:
    columns = sorted(df.columns)
    return sorted(repr([plain(x) for x in r]) for r in df.select(*columns).collect())


def duck_rows(connection, sql: str) -> list[str]:
    relation = connection.sql(sql)
    columns = ", ".join(f'"{c}"' for c in sorted(relation.columns))
    return sorted(repr([plain(x) for x in r]) for r in relation.project(columns).fetchall())
