"""Read views, late edits and side plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import SQL, grouped, ranges, records, sources, table, vectors
from keepstone.catalog import query
from keepstone.catalog.curation import _SCORED, _digest
from keepstone.config import Curation
from keepstone.operators import edits, ingest, status, views
from keepstone.operators.ranking import score_groups
from keepstone.plans import diffs


@query(f"""
WITH {SQL}, p AS (SELECT sha256, string_agg(DISTINCT person, ', ' ORDER BY person) AS people FROM (SELECT sha256, camera AS person FROM records WHERE event_id % 2 = 0 UNION ALL SELECT sha256, 'ann' FROM records WHERE event_id % 2 = 0) GROUP BY sha256),
m AS (SELECT moment_id, count(*) AS members, count(*) FILTER (duplicate_of IS NULL) AS alternates FROM grouped GROUP BY moment_id)
SELECT g.sha256, members, alternates, people, CASE WHEN event_id % 3 = 0 THEN 'x' END AS tags, event_id % 7 = 0 AS noted FROM grouped g JOIN m USING (moment_id) LEFT JOIN p USING (sha256)
""")
def o_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = grouped(spark, sf_dir), F.col("event_id")
    people = g.where(e % 2 == 0).select("sha256", F.explode(F.array(F.col("camera"), F.lit("ann"))).alias("person"))
    out = views.cards(g, people, g.where(e % 3 == 0).select("sha256", F.lit("x").alias("tag")), g.where(e % 7 == 0))
    return out.select("sha256", "members", "alternates", "people", "tags", "noted")


@query(f"""
WITH {SQL} SELECT sha256 FROM records WHERE favorite OR event_id % 2 = 1
""")
def c_card_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = F.when(F.col("event_id") % 2 == 0, "someone")
    return records(spark, sf_dir).withColumn("people", people).where(views.card_filter("favorite", "nobody")).select("sha256")


_INSIDE = f"""{_SCORED}, i AS (SELECT r.slug, s.sha256, s.taken_at, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY r.slug) AS n FROM scored s JOIN ranges r ON s.taken_at BETWEEN r.start AND r."end"
    WHERE is_best AND date_source NOT IN ('mtime', 'folder', 'folder-month', 'user-day') WINDOW w AS (PARTITION BY r.slug ORDER BY s.taken_at, s.sha256))"""


@query(f"WITH {_INSIDE} SELECT slug, sha256, taken_at FROM i WHERE n <= 8 OR list_contains([CAST(round_even(k * (n - 1) / 7.0::DOUBLE, 0) AS BIGINT) for k in range(8)], i)")
def o_range_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = score_groups(grouped(spark, sf_dir), Curation()).where("is_best")
    return views.range_preview(best, ranges(spark))[0]


@query(f"WITH {_INSIDE} SELECT slug, count(*) AS moments, count(DISTINCT strftime(taken_at, '%Y-%m-%d')) AS days FROM i GROUP BY slug")
def o_range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = score_groups(grouped(spark, sf_dir), Curation()).where("is_best")
    return views.range_preview(best, ranges(spark))[1]


@query(f"""WITH {SQL} SELECT min(taken_at) AS start, max(taken_at) AS "end" FROM records WHERE top AND date_source NOT IN ('mtime', 'folder', 'folder-month', 'user-day')""")
def j_selected_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return views.selected_range(r, r.where("top"))


@query("""
SELECT p_partkey, '["' || p_brand || '", "' || p_type || '"]' AS listed, replace(p_type, ' ', '%20') AS part,
    CASE WHEN p_size * p_size * 9999 >= 1048576 THEN printf('%.1f MB', p_size * p_size * 9999 / 1048576.0::DOUBLE) WHEN p_size * p_size * 9999 >= 1024 THEN printf('%.1f KB', p_size * p_size * 9999 / 1024.0::DOUBLE) ELSE printf('%d B', p_size * p_size * 9999) END AS size,
    'C:\\x\\' || CAST(p_partkey AS VARCHAR) AS shown, '2024-02-03-' || lower(replace(p_type, ' ', '-')) || '.md' AS post FROM part
""")
def k_post_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", views.yaml_list(F.array("p_brand", "p_type")).alias("listed"), views.url_part(F.col("p_type")).alias("part"),
        views.human_size((F.col("p_size") * F.col("p_size") * 9999).cast("long")).alias("size"), views.shown_path(F.concat(F.lit("/mnt/c/x/"), F.col("p_partkey").cast("string"))).alias("shown"),
        views.post_name(F.lit("2024-02-03").cast("date"), F.lower(F.replace("p_type", F.lit(" "), F.lit("-")))).alias("post"),
    )


@query(f"""
WITH {SQL}, f AS (SELECT sha256, top, event_id FROM records WHERE favorite) SELECT sha256, top FROM f WHERE event_id % 3 != 0 UNION ALL SELECT sha256, TRUE FROM records WHERE event_id % 51 = 0
""")
def j_favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unstar every third favourite, then mark others as top."""
    r = records(spark, sf_dir)
    left = edits.set_favourites(r.where("favorite").select("sha256", "top"), r.where("favorite and event_id % 3 = 0"), False, None)
    return edits.set_favourites(left, r.where("event_id % 51 = 0"), True, True)


@query(f"WITH {SQL} SELECT sha256, CASE WHEN event_id % 10 = 0 THEN NOT private ELSE private END AS private FROM records")
def j_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return edits.set_flag(r, r.where("event_id % 10 = 0"), "private").select("sha256", "private")


@query(f"""
WITH {SQL} SELECT id, coalesce(CASE WHEN id % 10 IN (0, 1) THEN NULL ELSE person_id END, -1) AS person_id, CASE WHEN id % 10 IN (0, 1) THEN NULL ELSE label_source END AS label_source, id % 10 = 1 OR ignored AS ignored, FALSE AS rejected FROM vectors
UNION ALL SELECT id, person_id, NULL, NULL, TRUE FROM vectors WHERE id % 10 = 0 AND person_id IS NOT NULL UNION ALL SELECT id, label, NULL, NULL, TRUE FROM vectors WHERE id % 15 = 1
""")
def j_unlabel_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after some lost their names and others were ignored, and the rejections that this leaves."""
    v = vectors(spark, sf_dir)
    before = v.where("id % 15 = 1").select("id", F.col("label").cast("long").alias("person_id"))
    plain, rejected = edits.unlabel(v, before, v.where("id % 10 = 0"))
    rows = edits.ignore(plain, v.where("id % 10 = 1")).fillna(-1, ["person_id"])
    rows = rows.select("id", "person_id", "label_source", "ignored", F.lit(False).alias("rejected"))
    return rows.unionByName(rejected.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


@query(f"""
WITH {SQL}, m AS (SELECT strftime(taken_at, '%Y-%m-%d') AS day, CAST(strftime(taken_at, '%d') AS INTEGER) AS n, {_digest('sha256')} AS members_sig, count(*) AS records FROM grouped GROUP BY 1, 2)
SELECT day, CASE WHEN n % 2 = 1 AND n % 7 = 0 AND n % 3 != 0 THEN 'other' ELSE members_sig END AS members_sig, records FROM m WHERE n % 2 = 1 AND n % 3 != 0 OR n % 2 = 0 AND n % 3 = 0 OR n % 2 = 1 AND n % 3 = 0 AND n % 7 = 0
""")
def j_toggle_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked odd days, of which every seventh has changed since; every third day is clicked."""
    now = status.fingerprints(grouped(spark, sf_dir).withColumn("day", F.date_format("taken_at", "yyyy-MM-dd")))
    n = F.substring("day", 9, 2).cast("int")
    marks = now.where(n % 2 == 1).withColumn("members_sig", F.when(n % 7 == 0, "other").otherwise(F.col("members_sig")))
    return status.toggle_reviewed(marks, now, now.where(n % 3 == 0)).select("day", "members_sig", "records")


@query(f"""
WITH {SQL} SELECT 'n' || CAST(event_id AS VARCHAR) || ext AS target, sha256, CASE WHEN event_id % 4 = 0 THEN 'skip' ELSE 'copy' END AS action FROM records WHERE top
""")
def l_export_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).where("top").withColumn("name", F.concat(F.lit("n"), F.col("event_id").cast("string")))
    there = r.where("event_id % 4 = 0").select(F.concat("name", "ext").alias("path"))
    return diffs.export_plan(r.select("sha256", "name", F.concat(F.lit("a/"), "name", "ext").alias("path")), there, originals=True)


@query(f"""
WITH {SQL} SELECT sha256, '2024/2024-01-02/n' || CAST(event_id AS VARCHAR) || '.jpg' AS path, '2024/2024-01-02_x/_alternates/n/n' || CAST(event_id AS VARCHAR) || '.jpg' AS found FROM records WHERE event_id % 6 = 0 AND event_id % 9 != 0
""")
def l_strays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    file = F.concat(F.lit("n"), e.cast("string"), F.lit(".jpg"))
    r = records(spark, sf_dir)
    desired = r.where(e % 6 == 0).select("sha256", F.concat(F.lit("2024/2024-01-02/"), file).alias("path"))
    moved = r.select("sha256", F.concat(F.lit("2024/2024-01-02_x/_alternates/n/"), file).alias("path"))
    return diffs.strays(desired, moved.union(r.where(e % 9 == 0).select("sha256", F.concat(F.lit("2024/2024-01-02/"), file))))


@query("SELECT 'region' AS relation, '{\"r_regionkey\":' || CAST(r_regionkey AS VARCHAR) || ',\"r_name\":\"' || r_name || '\"}' AS row FROM region UNION ALL SELECT 'nation', '{\"n_nationkey\":' || CAST(n_nationkey AS VARCHAR) || '}' FROM nation")
def l_tables_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.tables_as_json({"region": table(spark, sf_dir, "region").select("r_regionkey", "r_name"), "nation": table(spark, sf_dir, "nation").select("n_nationkey")})


@query(f"""
WITH {SQL}, l AS (SELECT 'd/' || CAST(doc_id // 3 AS VARCHAR) || CASE doc_id % 3 WHEN 0 THEN '.THM' WHEN 1 THEN '.mov' ELSE '.txt' END AS path, doc_id FROM sources WHERE doc_id % 7 != 0)
SELECT v.path, t.path AS companion FROM l v JOIN l t ON v.doc_id // 3 = t.doc_id // 3 WHERE v.doc_id % 3 = 1 AND t.doc_id % 3 = 0
""")
def a_companions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ext = F.when(d % 3 == 0, ".THM").when(d % 3 == 1, ".mov").otherwise(".txt")
    listing = sources(spark, sf_dir).where(d % 7 != 0).select(F.concat(F.lit("d/"), F.floor(d / 3).cast("string"), ext).alias("path"))
    return ingest.companions(listing, ".thm", [".mov", ".mp4"])
