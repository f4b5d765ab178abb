"""Intake: files to rows, packages, companions, dates of capture, recoveries and clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import SQL, records, sources, table
from keepstone.catalog import query
from keepstone.config import EMPTY_SHA256
from keepstone.functions.scalars import capture_time, is_screenshot
from keepstone.operators import ingest, intake

_PATH = "CASE WHEN doc_id % 30 = 1 THEN replace(path, '/img_', '/.TEMP-') ELSE path END"
_LISTED = f"""{SQL}, l AS (SELECT {_PATH} AS path, CASE WHEN doc_id % 41 = 0 THEN 0 ELSE size END AS size, mtime, CASE WHEN doc_id % 50 = 7 THEN 1e9 ELSE mtime END AS ctime,
    CASE WHEN doc_id % 58 != 0 THEN sha256 END AS sha256, doc_id, CASE doc_id % 5 WHEN 1 THEN 'video' WHEN 2 THEN 'rich' WHEN 3 THEN 'other' ELSE 'image' END AS kind FROM sources),
todo AS (SELECT * FROM l WHERE NOT (doc_id % 4 = 0 AND doc_id % 41 != 0) AND doc_id % 50 != 7),
named AS (SELECT path, kind, CASE WHEN size = 0 THEN '{EMPTY_SHA256}' ELSE sha256 END AS sha256,
    CASE WHEN size = 0 THEN 'junk' WHEN doc_id % 43 = 0 THEN 'arriving' WHEN doc_id % 30 = 1 THEN 'other' WHEN doc_id % 29 = 0 THEN 'error' WHEN kind = 'video' AND doc_id % 10 = 1 THEN 'clip'
        WHEN kind = 'rich' AND doc_id % 3 != 0 THEN 'package' WHEN kind IN ('image', 'video') THEN kind ELSE 'other' END AS status,
    CASE WHEN size = 0 THEN 'empty file' WHEN doc_id % 43 = 0 THEN 'changed while it was read' WHEN doc_id % 30 = 1 THEN 'unfinished recording' WHEN doc_id % 29 = 0 THEN 'unreadable: broken'
        WHEN kind = 'other' THEN 'not a photo or video (.txt)' WHEN kind = 'rich' AND doc_id % 3 = 0 THEN 'not a photo or video (.nar)' END AS reason FROM todo),
good AS (SELECT path, sha256 FROM named WHERE sha256 IS NOT NULL AND status NOT IN ('junk', 'arriving')),
routed AS (SELECT path, CASE WHEN sha256 IN (SELECT sha256 FROM sources WHERE doc_id % 50 = 1) THEN 'deleted' WHEN sha256 IN (SELECT sha256 FROM sources WHERE doc_id % 9 = 0) THEN 'duplicate'
    WHEN path = min(path) OVER (PARTITION BY sha256) THEN 'new' ELSE 'duplicate' END AS outcome FROM good),
rows_ AS (SELECT n.*, outcome FROM named n LEFT JOIN routed r ON r.path = n.path)"""


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed files of all kinds: empty, broken with and without a hash, changed while read, unfinished recordings,
    packages with and without frames."""
    s, d = sources(spark, sf_dir), F.col("doc_id")
    path = F.when(d % 30 == 1, F.replace("path", F.lit("/img_"), F.lit("/.TEMP-"))).otherwise(F.col("path"))
    s = s.withColumns({"path": path, "size": F.when(d % 41 == 0, 0).otherwise(F.col("size")), "ctime": F.when(d % 50 == 7, 1e9).otherwise(F.col("mtime"))})
    known = s.where((d % 4 == 0) & (d % 41 != 0)).select("path", "size", "mtime", F.lit("image").alias("status"), "sha256")
    known = known.withColumn("status", F.when(F.col("path").rlike(r"\.(nar|HEIC|jpeg)$"), "image").otherwise("video"))
    plan = ingest.ingest_plan(s.select("path", "size", "mtime", "ctime"), known, 1e9)
    sha = F.when(d % 58 != 0, F.col("sha256")).alias("sha256")
    read = s.select("path", sha, F.when(d % 29 == 0, "broken").alias("error"), (F.col("size") + (d % 43 == 0).cast("int")).alias("read_size"), F.col("mtime").alias("read_mtime"))
    clips = s.where(d % 10 == 1).select("path", F.lit("p").alias("photo_path"))
    return intake.ingest_rows(plan, read, clips, s.where(d % 9 == 0), s.where(d % 50 == 1), s.where(d % 3 != 0).select("path"))


@query(f"WITH {_LISTED} SELECT path, kind, sha256, status, reason, outcome FROM rows_")
def b_ingest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir)


@query(f"""
WITH {_LISTED}, f AS (SELECT sha256 AS package_sha, m AS member, sha256(sha256 || CASE WHEN doc_id % 3 = 0 THEN '' ELSE m END) AS sha256 FROM (SELECT DISTINCT ON (sha256) sha256, doc_id FROM sources WHERE doc_id % 5 = 2 ORDER BY sha256, doc_id), (VALUES ('a.jpg'), ('b.jpg')) v(m)),
mine AS (SELECT * FROM f WHERE package_sha IN (SELECT sha256 FROM rows_ WHERE status = 'package' AND outcome = 'new'))
SELECT package_sha, member, sha256, CASE WHEN package_sha || '!' || member = min(package_sha || '!' || member) OVER (PARTITION BY sha256) THEN 'new' ELSE 'duplicate' END AS outcome FROM mine
""")
def b_package_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    packages = s.where("doc_id % 5 = 2").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    member = F.explode(F.array(F.lit("a.jpg"), F.lit("b.jpg"))).alias("member")
    frames = packages.select(F.col("sha256").alias("package_sha"), "doc_id", member)
    data = F.concat("package_sha", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("member")))
    none = s.where("false")
    return intake.package_frames(_rows(spark, sf_dir), frames.select("package_sha", "member", F.sha2(data, 256).alias("sha256")), none, none)


@query("""
SELECT CAST(doc_id AS VARCHAR) AS package_sha, 'a.jpg' AS member, CASE WHEN doc_id % 6 = 0 THEN 'bad' ELSE sha256(text) END AS sha256, doc_id % 6 != 0 AND doc_id % 7 != 0 AS ok FROM documents
""")
def a_checked_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("package_sha"), F.lit("a.jpg").alias("member"), F.col("text").cast("binary").alias("data"))
    wanted = d.select("package_sha", "member", F.when(F.col("doc_id") % 6 == 0, "bad").otherwise(F.sha2("data", 256)).alias("sha256"))
    return intake.checked_frames(d.where("doc_id % 7 != 0"), wanted)


@query("SELECT 'v' || CAST(p_partkey AS VARCHAR) AS path, CASE WHEN p_size % 10 > 0 THEN p_partkey * 1.0 / (p_size % 10) END AS duration, p_size AS width, 2 * p_size AS height FROM part")
def a_video_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    probed = table(spark, sf_dir, "part").select(
        F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").cast("double").alias("frames"), (size % 10).cast("double").alias("fps"), size.alias("width"), (2 * size).alias("height")
    )
    return intake.video_facts(probed)


@query("""
SELECT 'd/' || CAST(doc_id AS VARCHAR) || '.MOV' AS path, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 != 0 AND doc_id % 5 != 0 THEN TIMESTAMP '2015-06-07 08:09:10' ELSE TIMESTAMP '2020-01-01' END AS taken_at,
    CASE WHEN doc_id % 3 = 0 AND doc_id % 4 != 0 AND doc_id % 5 != 0 THEN 'meta' WHEN doc_id % 5 = 0 THEN 'exif' ELSE 'mtime' END AS date_source FROM documents
""")
def b_companion_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos without a real time take the date of the .thm file beside them, where it can be read."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("stem"))
    video, side = F.concat("stem", F.lit(".MOV")), F.concat("stem", F.lit(".thm"))
    listing = d.select(video.alias("path")).unionByName(d.where("doc_id % 3 = 0").select(side.alias("path")))
    headers = d.where("doc_id % 3 = 0").select(side.alias("path"), F.when(F.col("doc_id") % 4 != 0, "2015:06:07 08:09:10").otherwise("0000:00:00 00:00:00").alias("header"))
    times = intake.companion_times(listing, headers, 2026).select(F.col("path").alias("sha256"), "companion_time")
    source = F.when(F.col("doc_id") % 5 == 0, "exif").otherwise("mtime")
    videos = d.select(video.alias("sha256"), F.lit("2020-01-01").cast("timestamp_ntz").alias("taken_at"), source.alias("date_source"))
    return ingest.redate_from_companions(videos, times).select(F.col("sha256").alias("path"), "taken_at", "date_source")


@query("""
WITH a AS (SELECT doc_id, t AS attempt, CASE WHEN (doc_id + t) % 4 > 0 THEN (doc_id * t) % 40 END AS w, 20 + t AS h, (doc_id % 7) * t * 0.5 AS spread FROM documents, (VALUES (1), (2), (3)) v(t)),
f AS (SELECT doc_id, min(CASE WHEN least(w, h) >= 16 AND w IS NOT NULL AND spread >= 2 THEN attempt END) AS attempt FROM a GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS sha256, CASE WHEN attempt IS NULL THEN 'failed' ELSE 'recovered' END AS outcome FROM f UNION ALL SELECT 'old', 'failed'
""")
def b_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of attempts at damaged images replace what was recorded."""
    d, t = F.col("doc_id"), F.col("attempt")
    a = table(spark, sf_dir, "documents").select(d, F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("attempt"))
    a = a.select(d.cast("string").alias("sha256"), t, F.when((d + t) % 4 > 0, (d * t) % 40).alias("width"), (t + 20).cast("long").alias("height"), ((d % 7) * t * 0.5).alias("spread"))
    before = a.select("sha256", F.lit("failed").alias("outcome")).distinct().unionByName(spark.createDataFrame([("old", "failed")], "sha256 string, outcome string"))
    return ingest.record_outcomes(before, intake.recover(a).select("sha256", "outcome"))


@query("""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN TIMESTAMP '2021-03-04 05:06:07' WHEN 1 THEN TIMESTAMP '2020-01-02 03:04:05' WHEN 2 THEN TIMESTAMP '2019-07-04 12:00:00' ELSE make_timestamp(CAST(doc_id * 1000 AS BIGINT) * 1000000) END AS taken_at,
    CASE doc_id % 4 WHEN 0 THEN 'exif' WHEN 1 THEN 'filename' WHEN 2 THEN 'folder' ELSE 'mtime' END AS source FROM documents
""")
def b_capture_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header, then file name, then folder, then the file's own time."""
    k = F.col("doc_id") % 4
    path = F.when(k == 0, "2019-07-04 - picnic/IMG_20200102_030405.jpg").when(k == 1, "2019-07-04 - picnic/IMG_20200102_030405.jpg").when(k == 2, "2019-07-04 - picnic/a.jpg").otherwise("x/a.jpg")
    rows = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), F.when(k == 0, "2021:03:04 05:06:07").alias("header"), (F.col("doc_id") * 1000).cast("double").alias("mtime"))
    return rows.withColumn("c", capture_time(F.col("header"), F.col("path"), F.col("mtime"), 2026)).select("doc_id", "c.taken_at", "c.source")


@query("SELECT doc_id, doc_id % 3 = 0 OR doc_id % 3 = 1 AND doc_id % 2 = 0 AS flag FROM documents")
def b_screenshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.when(d % 3 == 0, "a/Screenshot_1.jpg").when(d % 3 == 1, "a/b.PNG").otherwise("screenshots/c.jpg")
    rows = table(spark, sf_dir, "documents").select(d, path.alias("path"), F.when(d % 2 == 1, "cam").alias("camera"))
    return rows.select("doc_id", is_screenshot(F.col("path"), F.col("camera")).alias("flag"))


@query(f"WITH {SQL} SELECT path FROM sources WHERE doc_id % 5 = 3 AND sha256 NOT IN (SELECT sha256 FROM sources WHERE doc_id % 4 = 1)")
def b_drop_replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    return ingest.drop_replaced(s.where("doc_id % 5 = 3").select("path", "sha256"), s.where("doc_id % 4 = 1").select("sha256").distinct()).select("path")


@query(f"WITH {SQL} SELECT path, CASE WHEN doc_id % 6 = 0 THEN 'junk' ELSE status END AS status, CASE WHEN doc_id % 6 = 0 AND status != 'junk' THEN 'empty file' END AS reason FROM sources")
def b_empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).withColumn("sha256", F.when(F.col("doc_id") % 6 == 0, EMPTY_SHA256).otherwise(F.col("sha256")))
    return ingest.empties_as_junk(s).select("path", "status", "reason")


@query(f"WITH {SQL} SELECT camera AS kind, date_source AS action, count(*) AS n FROM records GROUP BY ALL")
def b_run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.ingest_counts(records(spark, sf_dir).select(F.col("camera").alias("kind"), F.col("date_source").alias("action")))


@query("""
WITH e AS (SELECT doc_id % 3 AS root, 'p' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size FROM documents WHERE doc_id % 2 = 0), l AS (SELECT doc_id % 3 AS root, 'p' || CAST(doc_id AS VARCHAR) AS path, n_chars AS size FROM documents WHERE doc_id % 4 != 0)
SELECT l.* FROM l WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.root = l.root AND e.path = l.path) AND EXISTS (SELECT 1 FROM e WHERE e.root = l.root AND e.size = l.size AND NOT EXISTS (SELECT 1 FROM l m WHERE m.root = e.root AND m.path = e.path))
""")
def d_hash_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only unknown files of a missing file's size have to be hashed."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select(d, (d % 3).alias("root"), F.concat(F.lit("p"), d.cast("string")).alias("path"), F.col("n_chars").alias("size"))
    return ingest.hash_candidates(rows.where(d % 2 == 0).drop("doc_id"), rows.where(d % 4 != 0).drop("doc_id"))


@query(f"WITH {SQL} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'retry' END AS status FROM sources WHERE doc_id % 3 = 0 OR status = 'error'")
def m_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    new = s.where("doc_id % 3 = 0").select("path", F.lit("new").alias("status"))
    return ingest.with_retries(new, s.where("status = 'error'").select("path", F.lit("retry").alias("status")))


@query(f"""
WITH {SQL}, v AS (SELECT path, min(doc_id) OVER (PARTITION BY sha256) AS k, sha256, doc_id FROM sources WHERE doc_id % 5 = 1), d AS (SELECT DISTINCT sha256, k FROM v)
SELECT sha256, 'videos/' || CAST(k AS VARCHAR) || '.mov' AS path, CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'old.mov' || CAST(k AS VARCHAR) ELSE (SELECT min(path) FROM v w WHERE w.sha256 = d.sha256) END AS from_path, CASE k % 4 WHEN 0 THEN 'unchanged' WHEN 1 THEN 'move' ELSE 'copy' END AS action FROM d
""")
def l_video_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Videos by what is recorded, without a look at the files."""
    from keepstone.plans import diffs

    v = sources(spark, sf_dir).where("doc_id % 5 = 1")
    k = F.col("k")
    d = v.groupBy("sha256").agg(F.min("doc_id").alias("k")).withColumn("path", F.concat(F.lit("videos/"), k.cast("string"), F.lit(".mov")))
    now = d.where(k % 4 < 2).select("sha256", F.when(k % 4 == 0, F.col("path")).otherwise(F.concat(F.lit("old.mov"), k.cast("string"))).alias("path"))
    return diffs.curate_plan(d.select("sha256", "path"), now, None, v)


@query(f"WITH {SQL} SELECT 'p' || sha256 AS package_sha, 'lib/' || CAST(event_id AS VARCHAR) || '.nar' AS path FROM records WHERE event_id % 5 = 0")
def l_companion_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.plans import diffs

    r = records(spark, sf_dir)
    placed = r.where("event_id % 5 = 0").select("sha256", F.concat(F.lit("lib/"), F.col("event_id").cast("string"), "ext").alias("path"))
    return diffs.companion_paths(r.select(F.concat(F.lit("p"), "sha256").alias("package_sha"), "sha256"), placed, ".nar")


@query(f"""
WITH {SQL}, n AS (SELECT sha256, event_id, row_number() OVER (PARTITION BY event_id % 300 ORDER BY sha256) AS r FROM records WHERE event_id % 2 = 0)
SELECT sha256, 'a/' || CAST(event_id % 300 AS VARCHAR) || CASE WHEN r = 1 THEN '' ELSE '_live' || CAST(r AS VARCHAR) END || '.mov' AS target FROM n
""")
def f_clip_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips beside their photo; further ones of a photo are numbered."""
    from keepstone.operators.naming import number_paths

    r = records(spark, sf_dir).where("event_id % 2 = 0")
    path = F.concat(F.lit("a/"), (F.col("event_id") % 300).cast("string"), F.lit(".mov"))
    return number_paths(r.select("sha256", path.alias("path")), "path", ["sha256"], "_live").select("sha256", "target")


@query("""
SELECT p_partkey, p_brand AS top, p_brand || ' › ' || replace(replace(lower(p_type), ' ', '-'), '-', ' ') AS pretty, list_sum([x * x for x in range(1, p_size % 5 + 2)])::BIGINT AS squares, list_max([p_size % 7, p_size % 11, 3]) AS most, p_size % 7 > 2 AND p_size % 11 > 2 AS all_above,
    array_to_string(list_sort([x for x in [p_size % 7, p_size % 11, 3] if x > 2]), ',') AS above, round(abs(sin(p_size)), 9) AS wave, CAST(ceil(p_size / 7.0) AS BIGINT) AS up FROM part
""")
def k_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs of two levels, functions over arrays and maps, arithmetic."""
    from keepstone.functions.scalars import pretty_slug, top_slug

    size = F.col("p_size")
    slug = F.concat("p_brand", F.lit("/"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-"))))
    three = F.array(size % 7, size % 11, F.lit(3))
    named = F.create_map(F.lit("a"), size % 7, F.lit("b"), size % 11)
    return table(spark, sf_dir, "part").select(
        "p_partkey", top_slug(slug).alias("top"), pretty_slug(slug).alias("pretty"), F.aggregate(F.sequence(F.lit(1), size % 5 + 1), F.lit(0).cast("long"), lambda a, x: a + x * x).alias("squares"),
        F.array_max(three).alias("most"), F.forall(F.map_values(named), lambda x: x > 2).alias("all_above"), F.array_join(F.array_sort(F.filter(three, lambda x: x > 2)), ",").alias("above"),
        F.round(F.abs(F.sin(size)), 9).alias("wave"), F.ceil(size / 7).alias("up"),
    )
