"""Scalar functions and file classification over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import SQL, sources, table
from keepstone.catalog import query
from keepstone.functions import scalars as S

YEAR = 2026


@query("""
WITH names AS (
    SELECT o_orderkey, o_orderdate AS d, o_orderkey % 6 AS k FROM orders
), texts AS (
    SELECT o_orderkey, CASE k
        WHEN 0 THEN 'IMG_' || strftime(d, '%Y%m%d_%H%M%S') || '.jpg'
        WHEN 1 THEN 'WP_' || strftime(d, '%Y%m%d_%H_%M_%S') || '.jpg'
        WHEN 2 THEN 'Screenshot_' || strftime(d, '%Y-%m-%d-%H-%M-%S') || '.png'
        WHEN 3 THEN 'x9' || strftime(d, '%Y%m%d_%H%M%S') || '.jpg'
        WHEN 4 THEN '20261399_999999 ' || strftime(d, '%Y-%m-%d %H.%M.%S')
        ELSE 'photo' || CAST(o_orderkey AS VARCHAR) END AS name, d, k FROM names
)
SELECT o_orderkey, name, CASE WHEN k IN (0, 1, 2, 4) AND year(d) BETWEEN 1990 AND 2027
    THEN CAST(date_trunc('second', d) AS TIMESTAMP) END AS taken_at FROM texts
""")
def k_name_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    f = lambda p: F.date_format(d, p)
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), f("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(k == 1, F.concat(F.lit("WP_"), f("yyyyMMdd_HH_mm_ss"), F.lit(".jpg")))
        .when(k == 2, F.concat(F.lit("Screenshot_"), f("yyyy-MM-dd-HH-mm-ss"), F.lit(".png")))
        .when(k == 3, F.concat(F.lit("x9"), f("yyyyMMdd_HHmmss"), F.lit(".jpg")))
        .when(k == 4, F.concat(F.lit("20261399_999999 "), f("yyyy-MM-dd HH.mm.ss")))
        .otherwise(F.concat(F.lit("photo"), F.col("o_orderkey").cast("string")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("taken_at", S.name_time(F.col("name"), YEAR))


@query("""
WITH t AS (
    SELECT o_orderkey, o_orderdate AS d, o_orderkey % 5 AS k FROM orders
)
SELECT o_orderkey, CASE k WHEN 0 THEN strftime(d, '%Y:%m:%d %H:%M:%S') WHEN 1 THEN '  ' || strftime(d, '%Y:%m:%d %H:%M:%S') || '.123'
        WHEN 2 THEN '0000:00:00 00:00:00' WHEN 3 THEN '1970:01:01 00:00:00' END AS value,
    CASE WHEN k IN (0, 1) AND year(d) BETWEEN 1990 AND 2027 THEN CAST(date_trunc('second', d) AS TIMESTAMP) END AS taken_at FROM t
""")
def k_header_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, k = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), F.col("o_orderkey") % 5
    value = F.when(k == 0, d).when(k == 1, F.concat(F.lit("  "), d, F.lit(".123"))).when(k == 2, "0000:00:00 00:00:00").when(k == 3, "1970:01:01 00:00:00")
    return table(spark, sf_dir, "orders").select("o_orderkey", value.alias("value")).withColumn("taken_at", S.header_time(F.col("value"), YEAR))


@query("""
WITH t AS (SELECT o_orderkey, o_orderdate AS d, o_orderkey % 5 AS k FROM orders), p AS (
    SELECT o_orderkey, d, k, CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' - run/raw/a.jpg' WHEN 1 THEN strftime(d, '%Y-%m') || ' trip/a.jpg'
        WHEN 2 THEN '2001-01-01/' || strftime(d, '%Y_%m_%d') || '/a.jpg' WHEN 3 THEN '2026-13-45/a.jpg'
        ELSE strftime(d, '%Y-%m-%d') || '.jpg' END AS path FROM t)
SELECT o_orderkey, path,
    CASE WHEN year(d) BETWEEN 1990 AND 2027 OR k > 2 THEN CASE WHEN k IN (0, 2) THEN date_trunc('day', d) + INTERVAL 12 HOUR WHEN k = 1 THEN date_trunc('month', d) + INTERVAL 12 HOUR END END AS taken_at,
    CASE WHEN k IN (0, 2) THEN 'folder' WHEN k = 1 THEN 'folder-month' END AS source FROM p
""")
def k_folder_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, f = F.col("o_orderkey") % 5, lambda p: F.date_format("o_orderdate", p)
    path = (
        F.when(k == 0, F.concat(f("yyyy-MM-dd"), F.lit(" - run/raw/a.jpg")))
        .when(k == 1, F.concat(f("yyyy-MM"), F.lit(" trip/a.jpg")))
        .when(k == 2, F.concat(F.lit("2001-01-01/"), f("yyyy_MM_dd"), F.lit("/a.jpg")))
        .when(k == 3, "2026-13-45/a.jpg")
        .otherwise(F.concat(f("yyyy-MM-dd"), F.lit(".jpg")))
    )
    found = S.folder_time(F.col("path"), YEAR)
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path")).withColumn("f", found).select("o_orderkey", "path", "f.taken_at", "f.source")


@query("""
SELECT p_partkey, p_name, nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug,
    coalesce(nullif(regexp_replace(regexp_replace(trim(p_name || ' - ' || p_brand), '\\s*-\\s*|\\s+', '-', 'g'), '-{2,}', '-', 'g'), ''), '_') AS plain,
    CASE WHEN lower(p_brand || ' ' || p_type) LIKE lower(p_brand) || '%' THEN trim(p_brand || ' ' || p_type) END AS camera,
    CASE WHEN p_size >= 36 THEN printf('%d:%02d:%02d', p_size * 100 // 3600, p_size * 100 % 3600 // 60, p_size * 100 % 60)
        ELSE printf('%d:%02d', p_size * 100 // 60, p_size * 100 % 60) END AS clock
FROM part
""")
def k_text_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "part").select(
        "p_partkey", "p_name", S.slugify(c("p_name")).alias("slug"), S.without_spaces(F.concat("p_name", F.lit(" - "), "p_brand")).alias("plain"),
        S.camera_name(c("p_brand"), F.concat("p_brand", F.lit(" "), "p_type")).alias("camera"), S.clock(c("p_size") * 100).alias("clock"),
    )


_PATHS = """
WITH p AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '_undated/x' WHEN 1 THEN strftime(ts, '%Y/%Y-%m') || '_unknown-day/x'
    WHEN 2 THEN strftime(ts, '%Y/%Y-%m-%d') || '_lake-tour/x' WHEN 3 THEN strftime(ts, '%Y/%Y-%m-%d') || '/_alternates/y/x'
    ELSE strftime(ts, '%Y/%Y-%m-%d') || '/_duplicates/y/x' END || CAST(event_id AS VARCHAR) || '.heic' AS path, ts, event_id % 5 AS k FROM events)
"""


@query(_PATHS + """
SELECT event_id, path, CASE WHEN k > 1 THEN strftime(ts, '%Y-%m-%d') END AS day,
    CASE WHEN k = 0 THEN '_undated' ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END AS folder,
    CASE WHEN k > 1 THEN strftime(ts, '%a ') || CAST(day(ts) AS VARCHAR) || strftime(ts, ' %b %Y') END AS pretty,
    CASE WHEN k > 1 THEN strftime(ts, '%B %Y') END AS month,
    CASE WHEN k = 0 THEN '_undated' ELSE split_part(path, '/', 1) || '/' || split_part(path, '/', 2) END || '/n' || CAST(event_id AS VARCHAR) || '.jpg' AS highlight,
    sha256(path || '|a;b') AS stamp
FROM p
""")
def k_path_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, f = F.col("event_id") % 5, lambda p: F.date_format("ts", p)
    head = (
        F.when(k == 0, "_undated/x")
        .when(k == 1, F.concat(f("yyyy/yyyy-MM"), F.lit("_unknown-day/x")))
        .when(k == 2, F.concat(f("yyyy/yyyy-MM-dd"), F.lit("_lake-tour/x")))
        .when(k == 3, F.concat(f("yyyy/yyyy-MM-dd"), F.lit("/_alternates/y/x")))
        .otherwise(F.concat(f("yyyy/yyyy-MM-dd"), F.lit("/_duplicates/y/x")))
    )
    e = table(spark, sf_dir, "events").select("event_id", F.concat(head, F.col("event_id").cast("string"), F.lit(".heic")).alias("path"))
    day = S.day_of(F.col("path"))
    return e.select(
        "event_id", "path", day.alias("day"), S.folder_of(F.col("path")).alias("folder"), S.pretty_day(day).alias("pretty"),
        S.month_label(F.substring(day, 1, 7)).alias("month"), S.highlight_path(F.col("path"), F.concat(F.lit("n"), F.col("event_id").cast("string"))).alias("highlight"),
        F.sha2(F.concat("path", F.lit("|"), F.array_join(F.array(F.lit("a"), F.lit("b")), ";")), 256).alias("stamp"),
    )


@query(f"""
WITH {SQL}, e AS (SELECT path, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext FROM sources)
SELECT path, ext, CASE ext WHEN '.jpeg' THEN '.jpg' ELSE ext END AS normal,
    CASE WHEN ext IN ('.heic', '.jpeg') THEN 'image' WHEN ext = '.mov' THEN 'video' WHEN ext = '.nar' THEN 'rich' ELSE 'other' END AS kind,
    split_part(path, '/', 1) AS batch, CASE WHEN length(path) % 3 = 0 THEN path ELSE '_inbox_' || CAST(length(path) % 3 AS VARCHAR) || '/' || path END AS key,
    CAST(length(path) % 3 AS INTEGER) AS root FROM e
""")
def a_classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, prefix = F.col("path"), "_inbox_"
    out = sources(spark, sf_dir).select(
        "path", S.extension(p).alias("ext"), S.normal_extension(p).alias("normal"), S.file_kind(p).alias("kind"), S.batch_name(p).alias("batch"),
        S.root_key(F.length("path") % 3, p, prefix).alias("key"),
    )
    return out.withColumn("root", S.root_of_key(F.col("key"), prefix)["root"])


@query(f"""
WITH {SQL} SELECT r.event_id, s.event_id AS other, bit_count(xor(r.hi, s.hi)) + bit_count(xor(r.lo, s.lo)) AS bits
FROM hashed r JOIN hashed s ON s.event_id = r.event_id + 1
""")
def i_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.adapters import records

    r = records(spark, sf_dir).select("event_id", "phash")
    s = r.select((F.col("event_id") - 1).alias("event_id"), F.col("event_id").alias("other"), F.col("phash").alias("p2"))
    return r.join(s, "event_id").select("event_id", "other", S.hamming(F.col("phash"), F.col("p2")).alias("bits"))


@query("""
SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 9) AS norm2,
    round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS first FROM embeddings
""")
def i_unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.dot(e, e), 9).alias("norm2"), F.round(S.unit(e)[0], 9).alias("first"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k, '{"event_id":' || CAST(event_id AS VARCHAR) || ',"event_type":"' || event_type || '"}' AS entry FROM events
""")
def k_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("entry")
    )


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS x, l_tax AS y, l_quantity / 100.0 AS w FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(greatest(0, floor((x - w * 0.25) * 1000)) AS INTEGER) AS "left", CAST(greatest(0, floor((y - w * 0.25) * 800)) AS INTEGER) AS top,
    CAST(least(1000, ceil((x + w * 1.25) * 1000)) AS INTEGER) AS "right", CAST(least(800, ceil((y + w * 1.25) * 800)) AS INTEGER) AS bottom FROM b
""")
def i_crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.operators.vectors import crop_box

    w = F.col("l_quantity") / 100.0
    box = crop_box(F.col("l_discount"), F.col("l_tax"), w, w, F.lit(1000), F.lit(800))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", box.alias("b")).select("l_orderkey", "l_linenumber", "b.*")
