"""Desired state against what is there: paths, curate, sync, publish, verify, manifests; and incremental runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import SQL, grouped, ranges, records, sources, table
from keepstone.catalog import query
from keepstone.catalog.curation import _SCORED
from keepstone.config import Curation
from keepstone.operators.ranking import score_groups
from keepstone.plans import diffs, paths
from keepstone.sources.shared import shared_folder
from keepstone.streaming import incremental

_PATHS = f"""{_SCORED}, hit AS (SELECT e.sha256, r.* FROM records e JOIN ranges r ON e.taken_at BETWEEN r.start AND r."end"),
slug AS (SELECT sha256, coalesce(arg_min(slug, start) FILTER (parent IS NOT NULL), arg_max(slug, start) FILTER (parent IS NULL)) AS slug FROM hit GROUP BY sha256),
b AS (SELECT s.moment_id, s.event_id AS best, strftime(taken_at, '%Y/%Y-%m-%d') || CASE WHEN slug IS NOT NULL AND date_source NOT IN ('mtime', 'folder', 'folder-month', 'user-day') THEN '_' || slug ELSE '' END AS folder FROM scored s LEFT JOIN slug USING (sha256) WHERE is_best),
k AS (SELECT sha256, event_id AS kept FROM records),
paths AS (SELECT s.sha256, s.event_id, CASE WHEN date_source = 'mtime' THEN '_undated/' WHEN date_source = 'folder-month' THEN strftime(taken_at, '%Y/%Y-%m') || '_unknown-day/' WHEN is_best THEN folder || '/'
    WHEN duplicate_of IS NOT NULL THEN folder || '/_duplicates/n' || CAST(kept AS VARCHAR) || '/' ELSE folder || '/_alternates/n' || CAST(best AS VARCHAR) || '/' END || 'n' || CAST(s.event_id AS VARCHAR) || ext AS path
    FROM scored s JOIN b USING (moment_id) LEFT JOIN k ON k.sha256 = s.duplicate_of)"""


def _desired(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_groups(grouped(spark, sf_dir), Curation()).withColumn("name", F.concat(F.lit("n"), F.col("event_id").cast("string")))
    return paths.desired_paths(scored, ranges(spark))


@query(f"WITH {_PATHS} SELECT sha256, path FROM paths")
def l_desired_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _desired(spark, sf_dir)


_STORED = f"""{SQL}, paths AS (SELECT sha256, event_id, strftime(taken_at, '%Y/%Y-%m-%d') || '/n' || CAST(event_id AS VARCHAR) || ext AS path FROM records)"""


@query(f"""
WITH {_STORED}, cur AS (SELECT sha256, CASE WHEN event_id % 5 = 0 THEN 'old/' || path ELSE path END AS path FROM paths WHERE event_id % 4 != 0),
src AS (SELECT sha256, 'in/' || CAST(event_id AS VARCHAR) AS path FROM paths WHERE event_id % 3 = 0),
lib AS (SELECT path, sha256 FROM cur WHERE substr(sha256, 1, 1) != 'a' UNION ALL SELECT path, 'someone' FROM paths WHERE event_id % 40 = 8),
j AS (SELECT p.sha256, p.path, c.path AS have, s.path AS source, w.sha256 AS at_want, h.sha256 AS at_have FROM paths p LEFT JOIN cur c USING (sha256) LEFT JOIN src s USING (sha256) LEFT JOIN lib w ON w.path = p.path LEFT JOIN lib h ON h.path = c.path),
a AS (SELECT *, CASE WHEN at_want != sha256 THEN 'conflict' WHEN at_want IS NOT NULL AND have = path THEN 'unchanged' WHEN at_want IS NOT NULL THEN 'adopt' WHEN at_have IS NOT NULL THEN 'move' WHEN source IS NOT NULL AND have = path THEN 'repaired' WHEN source IS NOT NULL THEN 'copy' ELSE 'missing' END AS action FROM j)
SELECT sha256, path, CASE action WHEN 'move' THEN have WHEN 'copy' THEN source WHEN 'repaired' THEN source END AS from_path, action FROM a
""")
def l_curate_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Desired paths as they are stored (l_desired_paths makes them), against what is recorded and what is there."""
    k = F.col("event_id")
    path = F.concat(F.date_format("taken_at", "yyyy/yyyy-MM-dd"), F.lit("/n"), k.cast("string"), "ext")
    d = records(spark, sf_dir).select("sha256", k, path.alias("path"))
    current = d.where(k % 4 != 0).select("sha256", F.when(k % 5 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"))
    source = d.where(k % 3 == 0).select("sha256", F.concat(F.lit("in/"), k.cast("string")).alias("path"))
    strange = d.where(k % 40 == 8).select("path", F.lit("someone").alias("sha256"))
    listing = current.where(~F.col("sha256").startswith("a")).select("path", "sha256").unionByName(strange)
    return diffs.curate_plan(d, current, listing, source)


_STAMPED = f"{SQL}, w AS (SELECT sha256, 'p' || CAST(event_id % 50 AS VARCHAR) AS path, CAST(event_id % 7 AS VARCHAR) AS stamp FROM records WHERE favorite), h AS (SELECT sha256, 'p' || CAST(event_id % 50 + event_id % 3 AS VARCHAR) AS path, CAST(event_id % 7 + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS stamp FROM records WHERE event_id % 34 = 0 OR event_id % 51 = 1)"


@query(f"""
WITH {_STAMPED} SELECT coalesce(w.sha256, h.sha256) AS sha256, coalesce(w.path, h.path) AS path, CASE WHEN w.path IS NULL THEN 'removed' WHEN w.path = h.path AND w.stamp = h.stamp THEN 'unchanged' WHEN w.stamp = h.stamp THEN 'moved' ELSE 'written' END AS action
FROM w FULL JOIN h ON w.sha256 = h.sha256
""")
def l_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = records(spark, sf_dir), F.col("event_id")
    text = lambda c: c.cast("string")
    wanted = r.where("favorite").select("sha256", F.concat(F.lit("p"), text(e % 50)).alias("path"), text(e % 7).alias("stamp"))
    have = r.where((e % 34 == 0) | (e % 51 == 1)).select(
        "sha256", F.concat(F.lit("p"), text(e % 50 + e % 3)).alias("path"), text(e % 7 + F.when(e % 5 == 0, 1).otherwise(0)).alias("stamp")
    )
    return diffs.sync_plan(wanted, have)


_PUBLISH = f"""{SQL}, w AS (SELECT 'n' || CAST(event_id AS VARCHAR) AS name, sha256 FROM records WHERE favorite AND NOT private),
p AS (SELECT 'n' || CAST(event_id AS VARCHAR) AS name, sha256, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS version FROM records WHERE event_id % 17 = 0 AND event_id % 2 = 0 OR event_id % 91 = 0),
plan AS (SELECT coalesce(w.name, p.name) AS name, CASE WHEN w.sha256 IS NULL THEN 'gone' WHEN w.sha256 = p.sha256 AND version = 2 THEN 'unchanged' ELSE 'new' END AS action FROM w FULL JOIN p ON w.name = p.name)"""


def _publish(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = F.col("event_id")
    r = records(spark, sf_dir).withColumn("name", F.concat(F.lit("n"), e.cast("string")))
    wanted = r.where("favorite and not private").select("name", "sha256")
    published = r.where(((e % 17 == 0) & (e % 2 == 0)) | (e % 91 == 0)).select("name", "sha256", F.when(e % 3 == 0, 1).otherwise(2).alias("version"))
    return wanted, published, r


@query(f"WITH {_PUBLISH} SELECT name, action FROM plan")
def l_publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, published, _ = _publish(spark, sf_dir)
    return diffs.publish_plan(wanted, published, 2)


@query(f"""
WITH {_PUBLISH}, remote AS (SELECT s AS size, 'n' || CAST(event_id AS VARCHAR) AS name FROM records, (VALUES (1), (2), (3)) v(s) WHERE event_id % 17 = 0 AND (event_id % 5 != 1 OR s < 3)),
full_names AS (SELECT name FROM remote GROUP BY name HAVING count(DISTINCT size) = 3), n AS (SELECT name FROM plan UNION SELECT name FROM remote UNION SELECT name FROM p),
a AS (SELECT n.name, (SELECT action FROM plan WHERE plan.name = n.name) AS action, n.name IN (SELECT name FROM full_names) AS complete, n.name IN (SELECT name FROM p) AS recorded, n.name IN (SELECT name FROM remote) AS there, n.name IN (SELECT name FROM w) AS wanted FROM n),
f AS (SELECT name, CASE WHEN NOT wanted THEN CASE WHEN there OR action = 'gone' THEN 'gone' END WHEN recorded AND NOT complete THEN 'new' WHEN action = 'new' AND complete AND NOT recorded THEN 'adopted' ELSE action END AS action FROM a)
SELECT name, action FROM f WHERE action IS NOT NULL
""")
def l_verified_publish_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted, published, r = _publish(spark, sf_dir)
    remote = r.where("event_id % 17 = 0").select("event_id", "name", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("size"))
    remote = remote.where("event_id % 5 != 1 or size < 3")
    return diffs.verified_plan(diffs.publish_plan(wanted, published, 2), published, remote, wanted, 3)


@query(f"""
WITH {SQL}, j AS (SELECT s.path, s.doc_id, s.size AS size, k.path IS NOT NULL AS known, k.size AS ks, k.status, k.sha256, CASE WHEN pl.sha256 IS NOT NULL THEN 'lib/' || pl.sha256 END AS lib, t.purged
    FROM sources s LEFT JOIN (SELECT path, status, sha256, size + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS size FROM sources WHERE doc_id % 8 != 0) k ON k.path = s.path
    LEFT JOIN (SELECT DISTINCT sha256 FROM sources WHERE doc_id % 5 != 0) pl ON pl.sha256 = k.sha256 LEFT JOIN (SELECT sha256, bool_and(doc_id % 2 = 0) AS purged FROM sources WHERE doc_id % 13 = 0 GROUP BY sha256) t ON t.sha256 = k.sha256)
SELECT path, coalesce(known AND size = ks AND (status = 'junk' OR purged IS NOT NULL OR lib IS NOT NULL), FALSE) AS ok,
    CASE WHEN NOT known THEN 'not ingested yet' WHEN size != ks THEN 'changed since it was ingested' WHEN status = 'junk' THEN 'junk' WHEN purged THEN 'deleted for good' WHEN NOT purged THEN 'deleted, in the trash' WHEN lib IS NOT NULL THEN lib ELSE 'not copied yet' END AS message FROM j
""")
def l_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = sources(spark, sf_dir), F.col("doc_id")
    known = s.where(d % 8 != 0).withColumn("size", F.col("size") + F.when(d % 6 == 0, 1).otherwise(0))
    placed = s.where(d % 5 != 0).select("sha256").distinct().withColumn("library_path", F.concat(F.lit("lib/"), "sha256"))
    stones = s.where(d % 13 == 0).groupBy("sha256").agg(F.bool_and(d % 2 == 0).alias("purged"))
    return diffs.verify_files(s, known, placed, stones)


@query(f"""
WITH {SQL}, f AS (SELECT *, 'n' || CAST(event_id AS VARCHAR) AS name FROM records WHERE favorite AND NOT private), hit AS (SELECT f.sha256, r.* FROM f JOIN ranges r ON f.taken_at BETWEEN r.start AND r."end"),
slug AS (SELECT sha256, coalesce(arg_min(slug, start) FILTER (parent IS NOT NULL), arg_max(slug, start) FILTER (parent IS NULL)) AS slug FROM hit GROUP BY sha256)
SELECT name, '{{"id":"' || name || '","taken_at":"' || strftime(taken_at, '%Y-%m-%dT%H:%M:%S') || '","people":' || CASE WHEN event_id % 2 = 0 THEN '["ann","' || camera || '"]' ELSE '[]' END || ',"event":' ||
    coalesce('"' || split_part(slug, '/', 1) || '"', 'null') || CASE WHEN slug LIKE '%/%' THEN ',"sub_event":"' || slug || '"' ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ',"tags":["x"]' ELSE '' END ||
    CASE WHEN top THEN ',"top":true' ELSE '' END || '}}' AS entry FROM f LEFT JOIN slug USING (sha256)
""")
def l_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    f = records(spark, sf_dir).where("favorite").withColumn("name", F.concat(F.lit("n"), e.cast("string")))
    people = f.where(e % 2 == 0).select("sha256", F.explode(F.array(F.col("camera"), F.lit("ann"))).alias("person"))
    return diffs.manifest(f, people, f.where(e % 3 == 0).select("sha256", F.lit("x").alias("tag")), ranges(spark))


@query("""
SELECT p_partkey, array_to_string(list_sort(list_distinct([least(p_size * 50, s) for s in [640, 1024, 2048]])), ',') AS widths, p_brand AS kept, 1 AS tags FROM part
""")
def l_export_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.create_map(F.lit("make"), F.col("p_brand"), F.lit("place"), F.lit("secret"))
    allowed = diffs.allowed_metadata(tags, ["make"])
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(F.array_sort(diffs.render_sizes(F.col("p_size") * 50, [640, 1024, 2048])), ",").alias("widths"),
        allowed["make"].alias("kept"),
        F.size(allowed).alias("tags"),
    )


@query("SELECT DISTINCT sha256(text) AS sha256 FROM documents")
def m_exact_copies_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each content once, read as a stream of files to its end; what is stored is the state."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    stream = incremental.stream_table(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "documents").schema)
    incremental.store_new(stream.select(F.sha2("text", 256).alias("sha256")), ["sha256"], f"{root}/out", f"{root}/log")
    return spark.read.parquet(f"{root}/out").select("sha256")


@query("""
WITH t AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), i AS (SELECT *, sum(CASE WHEN gap > INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM t),
s AS (SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM i GROUP BY user_id, s)
SELECT * FROM s WHERE "end" + INTERVAL 3 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
""")
def m_sessions_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user that the watermark has closed when the stream's end is reached."""
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex[:12]}"
    schema = table(spark, sf_dir, "events").schema
    stream = incremental.stream_table(spark, f"{sf_dir}/events.parquet", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    incremental.run_available(incremental.stream_sessions(stream, "ts", ["user_id"], "3 hours", "1 hour"), f"{root}/out", f"{root}/log")
    out = spark.read.parquet(f"{root}/out")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query(f"""
WITH {_SCORED}, touched AS (SELECT DISTINCT moment_id FROM grouped WHERE event_id % 500 = 3) SELECT sha256, round(score, 9) AS score, is_best, close_call FROM scored WHERE moment_id IN (SELECT moment_id FROM touched)
""")
def m_scoped_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups that a change touched, derived alone: the same rows as in a full run."""
    g = grouped(spark, sf_dir)
    part = incremental.touched(g, g.where("event_id % 500 = 3"), "moment_id")
    return score_groups(part, Curation()).select("sha256", F.round("score", 9).alias("score"), "is_best", "close_call")
