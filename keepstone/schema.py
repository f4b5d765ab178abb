"""Schemas of the domain relations, and additive evolution of stored ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(),
    "time": T.TimestampNTZType(), "vector": T.ArrayType(T.FloatType()),
}


def _relation(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


RECORDS = _relation(
    sha256="string", ext="string", taken_at="time", date_source="string", camera="string", width="int", height="int", phash="string",
    sharpness="double", exposure="double", faces="int", face_sharpness="double", user_best="boolean", private="boolean",
)
SOURCES = _relation(path="string", batch="string", size="long", mtime="double", status="string", reason="string", sha256="string")
RANGES = _relation(slug="string", start="time", end="time", parent="string")
VECTORS = _relation(id="long", embedding="vector", person_id="long", label_source="string", ignored="boolean")


def evolve(stored: DataFrame, target: T.StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A stored relation under the current schema: new columns get their default or null, unknown ones are dropped."""
    defaults = defaults or {}
    columns = []
    for f in target.fields:
        value = F.col(f.name) if f.name in stored.columns else F.lit(defaults.get(f.name))
        columns.append(value.cast(f.dataType).alias(f.name))
    return stored.select(*columns)
