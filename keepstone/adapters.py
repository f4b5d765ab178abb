"""The driver's tables as domain relations; ``SQL`` has the same relations for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as records, of which hashes recur."""
    e = F.col("event_id")
    kind = F.pmod(e, F.lit(11))
    source = F.when(kind == 0, "mtime").when(kind == 1, "folder").when(kind == 2, "folder-month").when(kind == 3, "filename").otherwise("exif")
    shape = F.pmod(e, F.lit(3))
    return table(spark, sf_dir, "events").select(
        e,
        "user_id",
        F.sha2(e.cast("string"), 256).alias("sha256"),
        F.when(shape == 0, ".heic").otherwise(".jpg").alias("ext"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("taken_at"),
        source.alias("date_source"),
        F.concat(F.lit("cam"), (F.col("user_id") % 5).cast("string")).alias("camera"),
        F.when(shape == 0, 4000).when(shape == 1, 2000).otherwise(3000).alias("width"),
        F.when(shape == 0, 3000).when(shape == 1, 1500).otherwise(4000).alias("height"),
        F.substring(F.md5(F.concat("event_type", (F.col("user_id") % 3).cast("string"))), 1, 16).alias("phash"),
        F.round(F.abs("value"), 6).alias("sharpness"),
        (F.pmod(e, F.lit(100)) / 100).alias("exposure"),
        F.pmod(e, F.lit(4)).cast("int").alias("faces"),
        F.when(F.pmod(e, F.lit(4)) > 0, F.round(F.abs("value"), 6) / 2).alias("face_sharpness"),
        (F.pmod(e, F.lit(97)) == 0).alias("user_best"),
        (F.pmod(e, F.lit(17)) == 0).alias("favorite"),
        (F.pmod(e, F.lit(34)) == 0).alias("top"),
        (F.pmod(e, F.lit(23)) == 0).alias("private"),
        (F.pmod(e, F.lit(101)) == 0).alias("deleted"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records plus moment_id: the earliest record of each camera and hour; every 13th copies the group's earliest."""
    r = records(spark, sf_dir)
    keys = ["camera", "hour"]
    r = r.withColumn("hour", F.date_trunc("hour", "taken_at"))
    first = r.groupBy(*keys).agg(F.min_by("sha256", F.struct("taken_at", "sha256")).alias("moment_id"))
    g = r.join(first, keys).drop("hour")
    copy = (F.pmod("event_id", F.lit(13)) == 0) & (F.col("sha256") != F.col("moment_id"))
    return g.withColumn("duplicate_of", F.when(copy, F.col("moment_id")))


#: Ranges of January 2024, two of them within the first.
RANGES = [
    ("winter-trip", "2024-01-05 08:00:00", "2024-01-09 20:00:00", None),
    ("winter-trip/museum", "2024-01-06 10:00:00", "2024-01-06 14:00:00", "winter-trip"),
    ("winter-trip/lake", "2024-01-08 09:00:00", "2024-01-08 18:30:00", "winter-trip"),
    ("birthday", "2024-01-12 12:00:00", "2024-01-12 23:59:59", None),
    ("long-weekend", "2024-01-19 00:00:00", "2024-01-22 06:00:00", None),
]


def ranges(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(RANGES, "slug string, s string, e string, parent string")
    return rows.select("slug", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"), "parent")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files; exact copies share a content."""
    d = F.col("doc_id")
    status = F.when(d % 29 == 0, "error").when(d % 31 == 0, "other").when(d % 37 == 0, "junk").otherwise("image")
    ext = F.when(d % 5 == 0, ".HEIC").when(d % 5 == 1, ".mov").when(d % 5 == 2, ".nar").when(d % 5 == 3, ".txt").otherwise(".jpeg")
    path = F.concat("source", F.lit("/img_"), (d % 7).cast("string"), F.lit("_"), d.cast("string"), ext)
    return table(spark, sf_dir, "documents").select(
        path.alias("path"), F.col("n_chars").alias("size"), (d * 10).cast("double").alias("mtime"), status.alias("status"),
        F.lit(None).cast("string").alias("reason"), F.sha2("text", 256).alias("sha256"), d,
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors, a fifth of them named by their label, some ignored."""
    v = F.col("vec_id")
    named = v % 5 == 0
    return table(spark, sf_dir, "embeddings").select(
        v.alias("id"), "embedding", F.when(named, F.col("label").cast("long")).alias("person_id"), F.when(named, "user").alias("label_source"),
        (~named & (v % 19 == 0)).alias("ignored"), F.col("label"),
    )


_RANGE_ROWS = ", ".join(
    f"('{s}', TIMESTAMP '{a}', TIMESTAMP '{b}', {'NULL' if p is None else repr(p)})" for s, a, b, p in RANGES
)

SQL = f"""
records AS (
    SELECT event_id, user_id, sha256(CAST(event_id AS VARCHAR)) AS sha256,
        CASE WHEN event_id % 3 = 0 THEN '.heic' ELSE '.jpg' END AS ext,
        CAST(date_trunc('second', ts) AS TIMESTAMP) AS taken_at,
        CASE event_id % 11 WHEN 0 THEN 'mtime' WHEN 1 THEN 'folder' WHEN 2 THEN 'folder-month' WHEN 3 THEN 'filename' ELSE 'exif' END AS date_source,
        'cam' || CAST(user_id % 5 AS VARCHAR) AS camera,
        CASE event_id % 3 WHEN 0 THEN 4000 WHEN 1 THEN 2000 ELSE 3000 END AS width,
        CASE event_id % 3 WHEN 0 THEN 3000 WHEN 1 THEN 1500 ELSE 4000 END AS height,
        substr(md5(event_type || CAST(user_id % 3 AS VARCHAR)), 1, 16) AS phash,
        round(abs(value), 6) AS sharpness, (event_id % 100) / 100.0::DOUBLE AS exposure, CAST(event_id % 4 AS INTEGER) AS faces,
        CASE WHEN event_id % 4 > 0 THEN round(abs(value), 6) / 2 END AS face_sharpness,
        event_id % 97 = 0 AS user_best, event_id % 17 = 0 AS favorite, event_id % 34 = 0 AS top, event_id % 23 = 0 AS private,
        event_id % 101 = 0 AS deleted
    FROM events
), hashed AS (
    SELECT *, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM records
), grouped AS (
    SELECT *, CASE WHEN event_id % 13 = 0 AND sha256 != moment_id THEN moment_id END AS duplicate_of FROM (
        SELECT *, first_value(sha256) OVER (PARTITION BY camera, date_trunc('hour', taken_at) ORDER BY taken_at, sha256) AS moment_id FROM records)
), ranges AS (
    SELECT * FROM (VALUES {_RANGE_ROWS}) AS t(slug, "start", "end", parent)
), sources AS (
    SELECT source || '/img_' || CAST(doc_id % 7 AS VARCHAR) || '_' || CAST(doc_id AS VARCHAR) ||
            CASE doc_id % 5 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.mov' WHEN 2 THEN '.nar' WHEN 3 THEN '.txt' ELSE '.jpeg' END AS path,
        n_chars AS size, CAST(doc_id * 10 AS DOUBLE) AS mtime,
        CASE WHEN doc_id % 29 = 0 THEN 'error' WHEN doc_id % 31 = 0 THEN 'other' WHEN doc_id % 37 = 0 THEN 'junk' ELSE 'image' END AS status,
        sha256(text) AS sha256, doc_id
    FROM documents
), vectors AS (
    SELECT vec_id AS id, embedding, CASE WHEN vec_id % 5 = 0 THEN CAST(label AS BIGINT) END AS person_id,
        CASE WHEN vec_id % 5 = 0 THEN 'user' END AS label_source, vec_id % 5 != 0 AND vec_id % 19 = 0 AS ignored, label
    FROM embeddings
)"""
