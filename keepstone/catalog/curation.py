"""Curation: bursts, copies, scores, sessions, names, vectors, ingest and edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import SQL, grouped, ranges, records, sources, table, vectors
from keepstone.catalog import query
from keepstone.config import Curation
from keepstone.operators import bursts, copies, edits, ingest, naming, ranking, status
from keepstone.operators import vectors as V
from keepstone.sources.shared import stored

#: Events are minutes apart, so gaps are wider here than the defaults.
WIDE = Curation(burst_gap_seconds=3600, copy_gap_seconds=1800)
NO_TIME_SQL = "('mtime', 'folder', 'folder-month', 'user-day')"


@query(f"""
WITH RECURSIVE {SQL}, t AS (SELECT *, epoch(taken_at) - epoch(lag(taken_at) OVER (PARTITION BY camera ORDER BY taken_at, sha256)) AS gap FROM hashed WHERE date_source NOT IN {NO_TIME_SQL}),
i AS (SELECT *, sum(CASE WHEN gap > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY camera ORDER BY taken_at, sha256) AS island FROM t),
n AS (SELECT camera, island, sha256, hi, lo, row_number() OVER (PARTITION BY camera, island ORDER BY taken_at, sha256) AS rn FROM i),
fold AS (
    SELECT camera, island, rn, sha256, sha256 AS moment_id, [struct_pack(hi := hi, lo := lo)] AS held FROM n WHERE rn = 1
    UNION ALL
    SELECT n.camera, n.island, n.rn, n.sha256, CASE WHEN ok THEN f.moment_id ELSE n.sha256 END, CASE WHEN ok THEN list_append(f.held, struct_pack(hi := n.hi, lo := n.lo)) ELSE [struct_pack(hi := n.hi, lo := n.lo)] END
    FROM (SELECT f.*, n.sha256 AS ns, len(list_filter(f.held, lambda h: bit_count(xor(h.hi, n.hi)) + bit_count(xor(h.lo, n.lo)) <= 10)) > 0 AS ok
          FROM fold f JOIN n ON n.camera = f.camera AND n.island = f.island AND n.rn = f.rn + 1) f JOIN n ON n.sha256 = f.ns
)
SELECT sha256, moment_id FROM fold UNION ALL SELECT sha256, sha256 FROM records WHERE date_source IN {NO_TIME_SQL}
""")
def f_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.bursts(records(spark, sf_dir), WIDE.burst_gap_seconds, WIDE.burst_bits)


_COPY = """
pairs AS (SELECT a.moment_id, least(a.sha256, b.sha256) AS a, greatest(a.sha256, b.sha256) AS b FROM g a JOIN g b ON a.moment_id = b.moment_id AND a.sha256 < b.sha256
    WHERE abs(epoch(a.taken_at) - epoch(b.taken_at)) <= 1800 AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 2 AND abs(a.exposure - b.exposure) <= 0.05
    AND CASE WHEN a.width = b.width AND a.height = b.height THEN least(a.sharpness, b.sharpness) >= 0.9 * greatest(a.sharpness, b.sharpness) ELSE abs(a.width::DOUBLE / a.height - b.width::DOUBLE / b.height) < 0.01 END)
"""
_G = f"""{SQL}, g AS (SELECT g.*, CAST('0x' || substr(phash, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(phash, 9, 8) AS BIGINT) AS lo FROM grouped g WHERE date_source NOT IN {NO_TIME_SQL})"""


@query(f"WITH {_G}, {_COPY} SELECT moment_id, a, b FROM pairs")
def i_copy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_pairs(grouped(spark, sf_dir), WIDE)


@query(f"""
WITH RECURSIVE {_G}, {_COPY}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT x AS node, x AS other FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON e.x = r.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
k AS (SELECT r.sha256, first_value(r.sha256) OVER (PARTITION BY component ORDER BY width * height DESC, sharpness DESC, taken_at, r.sha256) AS keeper FROM records r JOIN c ON c.node = r.sha256)
SELECT r.sha256, CASE WHEN keeper != r.sha256 THEN keeper END AS duplicate_of FROM records r LEFT JOIN k ON k.sha256 = r.sha256
""")
def i_mark_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir).drop("duplicate_of").withColumn("size", F.lit(None).cast("long"))
    return copies.mark_copies(g, WIDE)


_SCORED = f"""{SQL}, p AS (SELECT *, CASE WHEN bool_and(duplicate_of IS NOT NULL) OVER m THEN TRUE ELSE duplicate_of IS NULL END AS inn FROM grouped WINDOW m AS (PARTITION BY moment_id)),
q AS (SELECT *, max(CASE WHEN inn THEN sharpness END) OVER m AS ms, max(CASE WHEN inn THEN faces END) OVER m AS mf, max(CASE WHEN inn THEN coalesce(face_sharpness, 0) END) OVER m AS mfs,
    max(CASE WHEN inn THEN width * height END) OVER m AS mp FROM p WINDOW m AS (PARTITION BY moment_id)),
s AS (SELECT *, CASE WHEN inn THEN 0.5::DOUBLE * sharpness / (CASE WHEN ms = 0 THEN 1 ELSE ms END) + 0.2::DOUBLE * exposure + CASE WHEN mf > 0 THEN 0.15::DOUBLE * faces / mf ELSE 0 END
    + CASE WHEN mfs > 0 THEN 0.15::DOUBLE * coalesce(face_sharpness, 0) / mfs ELSE 0 END + 0.1::DOUBLE * (width * height) / mp END AS score FROM q),
aim AS (SELECT s.moment_id, coalesce(s.duplicate_of, s.sha256) AS target, user_best, favorite, taken_at, sha256 FROM s WHERE user_best OR favorite),
tg AS (SELECT moment_id, target, min(CASE WHEN user_best THEN strftime(taken_at, '%Y%m%d%H%M%S') || sha256 END) AS pick, bool_or(favorite) AS fav FROM aim GROUP BY 1, 2),
z AS (SELECT s.*, pick, coalesce(fav, FALSE) AND inn AS fav2 FROM s LEFT JOIN tg ON tg.moment_id = s.moment_id AND tg.target = s.sha256),
y AS (SELECT *, row_number() OVER (PARTITION BY moment_id ORDER BY pick ASC NULLS LAST, fav2 DESC, inn DESC, score DESC NULLS LAST, taken_at, sha256) AS rn,
    row_number() OVER (PARTITION BY moment_id ORDER BY score DESC NULLS LAST) AS rk, bool_or(pick IS NOT NULL OR fav2) OVER (PARTITION BY moment_id) AS settled, max(score) OVER (PARTITION BY moment_id) AS first FROM z),
scored AS (SELECT *, rn = 1 AS is_best, coalesce(NOT settled AND first - max(CASE WHEN rk = 2 THEN score END) OVER (PARTITION BY moment_id) <= 0.05::DOUBLE * first, FALSE) AND duplicate_of IS NULL AS close_call FROM y)"""


@query(f"WITH {_SCORED} SELECT sha256, moment_id, round(score, 9) AS score, is_best, close_call FROM scored")
def f_best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.score_groups(grouped(spark, sf_dir), Curation())
    return out.select("sha256", "moment_id", F.round("score", 9).alias("score"), "is_best", "close_call")


@query(f"""
WITH {SQL}, t AS (SELECT taken_at, epoch(taken_at) - epoch(lag(taken_at) OVER (ORDER BY taken_at)) AS gap FROM records WHERE date_source NOT IN {NO_TIME_SQL}),
i AS (SELECT taken_at, sum(CASE WHEN gap > 900 THEN 1 ELSE 0 END) OVER (ORDER BY taken_at) AS e FROM t)
SELECT strftime(min(taken_at), '%Y%m%d_%H%M%S') AS id, min(taken_at) AS start, max(taken_at) AS "end", count(*) AS records FROM i GROUP BY e
""")
def f_event_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.sessions(records(spark, sf_dir), 0.25)


@query("""
WITH t AS (SELECT user_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events), i AS (SELECT *, sum(CASE WHEN gap > INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM t)
SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM i GROUP BY user_id, s
""")
def f_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bursts.user_sessions(table(spark, sf_dir, "events"), ["user_id"], "ts", "3 hours")


@query(f"""
WITH {SQL}, s AS (SELECT event_id, strftime(taken_at, '%Y%m%d_%H') AS stem, taken_at FROM records), used AS (
    SELECT DISTINCT stem, CASE WHEN event_id % 40 = 0 THEN 0 ELSE 2 END AS slot FROM s WHERE event_id % 40 IN (0, 1)),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY taken_at, event_id) AS rn FROM s WHERE event_id % 40 > 1),
f AS (SELECT n.*, (SELECT list(slot) FROM used u WHERE u.stem = n.stem) AS taken FROM n),
g AS (SELECT *, list_filter(range(0, 400), lambda x: NOT list_contains(coalesce(taken, []), x))[rn] AS slot FROM f)
SELECT event_id, CASE WHEN slot = 0 THEN stem ELSE stem || '_' || CAST(slot AS VARCHAR) END AS name FROM g
""")
def f_unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("event_id", "taken_at", F.date_format("taken_at", "yyyyMMdd_HH").alias("stem"))
    k = F.col("event_id") % 40
    taken = r.where(k <= 1).select(F.when(k == 0, F.col("stem")).otherwise(F.concat("stem", F.lit("_2"))).alias("name")).distinct()
    return naming.assign_names(r.where(k > 1), taken, "stem", ["taken_at", "event_id"]).select("event_id", "name")


@query("""
WITH p AS (SELECT doc_id, source || '/f' || CAST(doc_id % 40 AS VARCHAR) || CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS path, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS ext FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS rn FROM p)
SELECT doc_id, CASE WHEN rn = 1 THEN path ELSE left(path, length(path) - length(ext)) || '_' || CAST(rn AS VARCHAR) || ext END AS target FROM n
""")
def f_numbered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.concat("source", F.lit("/f"), (d % 40).cast("string"), F.when(d % 2 == 0, ".txt").otherwise(""))
    return naming.number_paths(table(spark, sf_dir, "documents").select(d, path.alias("path")), "path", ["doc_id"]).select("doc_id", "target")


def _clashes(suffix: str) -> str:
    """The rows of a family (paths that differ in suffixes only) one after the other, with the list of used names."""
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, doc_id * 7919 % 1009 AS k, source || '/f' || CAST(doc_id % 12 AS VARCHAR) AS stem, CASE WHEN doc_id % 2 = 0 THEN '.txt' ELSE '' END AS ext,
    CASE doc_id % 7 WHEN 0 THEN '{suffix}2' WHEN 1 THEN '{suffix}3{suffix}2' WHEN 2 THEN '{suffix}2{suffix}2' WHEN 3 THEN '{suffix}' || CAST(doc_id % 9 AS VARCHAR) ELSE '' END AS tail FROM documents),
n AS (SELECT *, stem || tail AS base, stem || tail || ext AS path, row_number() OVER (PARTITION BY stem, ext ORDER BY k, doc_id) AS rn FROM d),
walk AS (
    SELECT stem, ext, rn, doc_id, path AS target, [path] AS used FROM n WHERE rn = 1
    UNION ALL
    SELECT stem, ext, rn, doc_id, target, list_append(used, target) FROM (
        SELECT n.stem, n.ext, n.rn, n.doc_id, used, CASE WHEN NOT list_contains(used, path) THEN path ELSE
            list_filter(list_transform(range(2, len(used) + 3), lambda i: base || '{suffix}' || CAST(i AS VARCHAR) || n.ext), lambda c: NOT list_contains(used, c))[1] END AS target
        FROM walk JOIN n ON n.stem = walk.stem AND n.ext = walk.ext AND n.rn = walk.rn + 1)
)
SELECT doc_id, target FROM walk"""


def _clashing(spark: SparkSession, sf_dir: str, suffix: str) -> DataFrame:
    d, kind = F.col("doc_id"), F.col("doc_id") % 7
    s = lambda *x: F.concat(*[F.lit(suffix) if y is None else F.lit(y) if isinstance(y, str) else y for y in x])
    tail = F.when(kind == 0, s(None, "2")).when(kind == 1, s(None, "3", None, "2")).when(kind == 2, s(None, "2", None, "2")).when(kind == 3, s(None, (d % 9).cast("string"))).otherwise("")
    path = F.concat("source", F.lit("/f"), (d % 12).cast("string"), tail, F.when(d % 2 == 0, ".txt").otherwise(""))
    rows = table(spark, sf_dir, "documents").select(d, (d * 7919 % 1009).alias("k"), path.alias("path"))
    return naming.number_paths(rows, "path", ["k", "doc_id"], suffix).select("doc_id", "target")


@query(_clashes("_"))
def f_path_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of which some have by nature the names that others would be numbered to."""
    return _clashing(spark, sf_dir, "_")


@query(_clashes("_live"))
def f_clip_clashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clashing(spark, sf_dir, "_live")


_REJECT = "rej AS (SELECT id, label AS person_id FROM vectors WHERE id % 7 = 3)"


@query(f"""
WITH {SQL}, {_REJECT}, b AS (SELECT v.id, n.person_id, max(list_dot_product(v.embedding::DOUBLE[], n.embedding::DOUBLE[])) AS s FROM vectors v JOIN vectors n ON n.label_source = 'user'
    WHERE v.label_source IS NULL AND NOT v.ignored GROUP BY 1, 2), ok AS (SELECT * FROM b WHERE s >= 0.3 AND NOT EXISTS (SELECT 1 FROM rej WHERE rej.id = b.id AND rej.person_id = b.person_id))
SELECT id, person_id, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, person_id) AS rn FROM ok) WHERE rn = 1
""")
def i_auto_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("v", F.col("embedding").cast("array<double>"))
    rejected = v.where("id % 7 = 3").select("id", F.col("label").cast("long").alias("person_id"))
    out = V.label_from_examples(v.where("label_source is null and not ignored"), v.where("label_source = 'user'"), rejected, 0.3)
    return out.select("id", "person_id", F.round("similarity", 6).alias("similarity"))


_MUTUAL = f"""WITH RECURSIVE {SQL}, u AS (SELECT id, embedding::DOUBLE[] AS v FROM vectors WHERE NOT ignored), s AS (SELECT a.id, b.id AS other, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON TRUE),
near AS (SELECT id, other, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, other) AS rn FROM s) WHERE rn <= 10),
links AS (SELECT id, other FROM near WHERE s >= 0.25 AND id != other), mutual AS (SELECT a.id, a.other FROM links a JOIN links b ON a.id = b.other AND a.other = b.id),
reach AS (SELECT id AS node, id AS other FROM u UNION SELECT r.node, m.other FROM reach r JOIN mutual m ON m.id = r.other)"""


@query(_MUTUAL + " SELECT node AS id, min(other) AS group_id FROM reach GROUP BY node")
def i_mutual_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).where("not ignored").select("id", F.col("embedding").cast("array<double>").alias("v"))
    return V.mutual_groups(v, 10, 0.25)


@query(f"""
WITH {SQL}, u AS (SELECT id, embedding::DOUBLE[] AS v FROM vectors), s AS (SELECT a.id, b.id AS other, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.id % 10 = 0)
SELECT id, other, round(s, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, other) AS rn FROM s) WHERE rn <= 10
""")
def g_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("v"))
    return V.nearest(v.where("id % 10 = 0"), v, 10).select("id", "other", F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH RECURSIVE {SQL}, {_REJECT}, b AS (SELECT v.id, n.person_id, max(list_dot_product(v.embedding::DOUBLE[], n.embedding::DOUBLE[])) AS s FROM vectors v JOIN vectors n ON n.label_source = 'user' WHERE v.label_source IS NULL AND NOT v.ignored GROUP BY 1, 2),
ok AS (SELECT * FROM b WHERE s >= 0.3 AND NOT EXISTS (SELECT 1 FROM rej WHERE rej.id = b.id AND rej.person_id = b.person_id)),
auto AS (SELECT id, person_id AS p, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, person_id) AS rn FROM ok) WHERE rn = 1),
u AS (SELECT id, embedding::DOUBLE[] AS v FROM vectors WHERE NOT ignored AND label_source IS NULL AND id NOT IN (SELECT id FROM auto)), s AS (SELECT a.id, b.id AS other, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON TRUE),
near AS (SELECT id, other, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 12) DESC, other) AS rn FROM s) WHERE rn <= 10),
links AS (SELECT id, other FROM near WHERE s >= 0.25 AND id != other), mutual AS (SELECT a.id, a.other FROM links a JOIN links b ON a.id = b.other AND a.other = b.id),
reach AS (SELECT id AS node, id AS other FROM u UNION SELECT r.node, m.other FROM reach r JOIN mutual m ON m.id = r.other), gr AS (SELECT node, min(other) AS g FROM reach GROUP BY node)
SELECT v.id, coalesce(CASE WHEN v.label_source = 'user' THEN v.person_id ELSE p END, -1) AS person_id, CASE WHEN v.label_source = 'user' THEN 'user' WHEN p IS NOT NULL THEN 'auto' END AS label_source, coalesce(round(auto.s, 6), -2) AS similarity, coalesce(g, -1) AS group_id
FROM vectors v LEFT JOIN auto ON auto.id = v.id LEFT JOIN gr ON gr.node = v.id
""")
def i_label_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    rejected = v.where("id % 7 = 3").select("id", F.col("label").cast("long").alias("person_id"))
    out = V.assign(v, rejected, 0.3, 0.25, 10)
    return out.select("id", F.coalesce("person_id", F.lit(-1)).alias("person_id"), "label_source", F.coalesce(F.round("similarity", 6), F.lit(-2.0)).alias("similarity"), F.coalesce("group_id", F.lit(-1)).alias("group_id"))


_KNOWN = f"""{SQL}, k AS (SELECT path, size, CASE WHEN doc_id % 6 = 0 THEN mtime - 5 ELSE mtime END AS mtime, status, CASE WHEN status = 'junk' THEN NULL ELSE sha256 END AS sha256 FROM sources WHERE doc_id % 4 != 0)"""


@query(f"""
WITH {_KNOWN}, j AS (SELECT s.*, k.size AS ks, k.mtime AS km, k.status AS kst, k.sha256 AS ksha, k.path IS NOT NULL AS known,
    CASE doc_id % 5 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'rich' WHEN 3 THEN 'other' ELSE 'image' END AS kind FROM sources s LEFT JOIN k ON k.path = s.path)
SELECT path, kind, CASE WHEN known AND size = ks AND mtime = km AND (ksha IS NOT NULL OR kst = 'junk') AND kst != 'error' AND NOT (kst = 'other' AND kind IN ('rich', 'image')) THEN 'unchanged'
    WHEN 9000 - mtime < 120 THEN 'arriving' WHEN size = 0 THEN 'empty' WHEN NOT known THEN 'new' ELSE 'changed' END AS action FROM j
""")
def a_ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    mtime = F.when(F.col("doc_id") % 6 == 0, F.col("mtime") - 5).otherwise(F.col("mtime"))
    known = s.where("doc_id % 4 != 0").select("path", "size", mtime.alias("mtime"), "status", F.when(F.col("status") != "junk", F.col("sha256")).alias("sha256"))
    return ingest.ingest_plan(s.select("path", "size", "mtime"), known, 9000.0).select("path", "kind", "action")


@query(f"""
WITH {SQL} SELECT path, sha256, CASE WHEN sha256 IN (SELECT sha256 FROM sources WHERE doc_id % 50 = 1) THEN 'deleted' WHEN sha256 IN (SELECT sha256 FROM sources WHERE doc_id % 9 = 0) THEN 'duplicate'
    WHEN path = min(path) OVER (PARTITION BY sha256) THEN 'new' ELSE 'duplicate' END AS outcome FROM sources
""")
def b_route_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    return ingest.route_content(s.select("path", "sha256"), s.where("doc_id % 9 = 0"), s.where("doc_id % 50 = 1"))


@query(f"""
WITH {SQL} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'changed' ELSE status END AS status FROM sources WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
""")
def b_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, d = sources(spark, sf_dir), F.col("doc_id")
    return ingest.upsert(s.where(d % 2 == 0).select("path", "status"), s.where(d % 3 == 0).select("path", F.lit("changed").alias("status")), "path")


@query(f"""
WITH {SQL}, l AS (SELECT 'd/' || CAST(doc_id // 4 AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.HEIC' WHEN 1 THEN '.jpg' WHEN 2 THEN '.MOV' ELSE '.mp4' END AS path, CASE WHEN doc_id % 5 > 0 THEN doc_id % 9 * 1.0::DOUBLE END AS duration, doc_id FROM sources WHERE doc_id % 7 != 0),
c AS (SELECT path, doc_id // 4 AS s FROM l WHERE doc_id % 4 >= 2 AND (duration IS NULL OR duration <= 5)), p AS (SELECT doc_id // 4 AS s, arg_min(path, doc_id % 4) AS photo_path FROM l WHERE doc_id % 4 < 2 GROUP BY 1)
SELECT path, photo_path FROM c JOIN p USING (s)
""")
def b_live_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    ext = F.when(d % 4 == 0, ".HEIC").when(d % 4 == 1, ".jpg").when(d % 4 == 2, ".MOV").otherwise(".mp4")
    path = F.concat(F.lit("d/"), F.floor(d / 4).cast("string"), ext)
    return ingest.live_clips(sources(spark, sf_dir).where(d % 7 != 0).select(path.alias("path"), F.when(d % 5 > 0, (d % 9).cast("double")).alias("duration")))


@query(f"""
WITH {SQL}, frames AS (SELECT (SELECT min(sha256) FROM sources WHERE doc_id = s.doc_id - 1) AS package_sha, 'f' || CAST(doc_id AS VARCHAR) AS sha256 FROM sources s WHERE doc_id % 10 = 5),
live AS (SELECT sha256 FROM sources WHERE doc_id % 3 != 0), e AS (SELECT DISTINCT sha256 FROM sources UNION SELECT sha256 FROM frames)
SELECT sha256 FROM e WHERE sha256 IN (SELECT sha256 FROM live) OR sha256 IN (SELECT f.sha256 FROM frames f WHERE package_sha IN (SELECT sha256 FROM live))
""")
def b_forget_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).select("doc_id", "sha256")
    before = s.select((F.col("doc_id") + 1).alias("doc_id"), F.col("sha256").alias("package_sha"))
    frames = s.where("doc_id % 10 = 5").select("doc_id").join(before, "doc_id").select("package_sha", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("sha256"))
    entities = s.select("sha256").union(frames.select("sha256")).distinct()
    return ingest.forget_unreferenced(entities, s.where("doc_id % 3 != 0"), frames)


@query(f"""
WITH {SQL} SELECT sha256, min(path) AS path FROM sources WHERE status = 'error' AND doc_id % 5 IN (0, 4) AND sha256 NOT IN (SELECT sha256 FROM sources WHERE doc_id % 4 = 0) GROUP BY sha256
""")
def b_recovery_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    return ingest.recovery_candidates(s, s.where("doc_id % 4 = 0").select("sha256", F.lit("failed").alias("outcome")))


@query(f"""
WITH {SQL} SELECT sha256, CASE WHEN date_source = 'mtime' THEN TIMESTAMP '2019-07-04 12:00:00' ELSE taken_at END AS taken_at, CASE WHEN date_source = 'mtime' THEN 'folder' ELSE date_source END AS date_source,
    CASE WHEN date_source = 'mtime' AND NOT favorite THEN NULL ELSE 'n' END AS name FROM records
""")
def b_redate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("name", F.lit("n"))
    paths = r.select("sha256", F.concat(F.lit("2019-07-04 - picnic/a"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"))
    return ingest.redate(r, paths, r.where("favorite"), 2026).select("sha256", "taken_at", "date_source", "name")




def _digest(c: str) -> str:
    """SQL of ``unordered_digest``."""
    return f"count({c}) || '-' || bit_xor(CAST('0x' || substr({c}, 1, 15) AS BIGINT)) || '-' || CAST(sum(CAST('0x' || substr({c}, 16, 8) AS BIGINT)) AS BIGINT)"


_DAYS = f"""{SQL}, d AS (SELECT strftime(taken_at, '%Y-%m-%d') AS day, moment_id, list(sha256 ORDER BY sha256) AS m FROM grouped GROUP BY 1, 2)"""


@query(f"""
WITH {_DAYS}, g AS (SELECT day, sha256(d) AS h, n FROM (SELECT strftime(taken_at, '%Y-%m-%d') AS day, moment_id, {_digest('sha256')} AS d, count(*) AS n FROM grouped GROUP BY 1, 2)),
m AS (SELECT strftime(taken_at, '%Y-%m-%d') AS day, {_digest('sha256')} AS members_sig FROM grouped GROUP BY 1)
SELECT day, any_value(members_sig) AS members_sig, {_digest('h')} AS groups_sig, sum(n)::BIGINT AS records FROM g JOIN m USING (day) GROUP BY day
""")
def e_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.fingerprints(grouped(spark, sf_dir).withColumn("day", F.date_format("taken_at", "yyyy-MM-dd")))


@query(f"""
WITH {SQL}, d AS (SELECT DISTINCT strftime(taken_at, '%Y-%m-%d') AS day, CAST(strftime(taken_at, '%d') AS INTEGER) AS n FROM records)
SELECT day, CASE n % 5 WHEN 0 THEN 'new' WHEN 1 THEN 'reviewed' WHEN 2 THEN 'pics added' WHEN 3 THEN 'moments updated' ELSE 'reviewed' END AS status FROM d UNION ALL SELECT '2023-12-31', 'moments updated'
""")
def l_day_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = status.fingerprints(grouped(spark, sf_dir).withColumn("day", F.date_format("taken_at", "yyyy-MM-dd")))
    n = F.substring("day", 9, 2).cast("int") % 5
    marks = now.where(n > 0).select(
        "day", F.when(n == 2, "other").when(n != 4, F.col("members_sig")).alias("members_sig"), F.when(n == 3, "other").otherwise(F.col("groups_sig")).alias("groups_sig"),
        F.when(n == 2, 1).otherwise(F.col("records")).cast("long").alias("records"),
    )
    gone = spark.createDataFrame([("2023-12-31", "a", "b", 4)], "day string, members_sig string, groups_sig string, records long")
    return status.day_status(now, marks.unionByName(gone))


@query(f"""
WITH {_SCORED}, two AS (SELECT moment_id FROM scored GROUP BY moment_id ORDER BY min(taken_at), moment_id LIMIT 2)
SELECT sha256, (SELECT arg_min(moment_id, strftime(taken_at, '%Y%m%d%H%M%S') || sha256) FROM scored WHERE moment_id IN (SELECT moment_id FROM two)) AS moment_id FROM scored WHERE moment_id IN (SELECT moment_id FROM two)
""")
def j_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = stored(ranking.score_groups(grouped(spark, sf_dir), Curation()).select("sha256", "moment_id", "taken_at", "is_best"), "scored")  # read several times
    two = scored.groupBy("moment_id").agg(F.min("taken_at").alias("t")).orderBy("t", "moment_id").limit(2)
    return edits.combine(scored, scored.where("is_best").join(F.broadcast(two), "moment_id", "left_semi"))


@query("""
WITH t AS (SELECT o_custkey AS k, o_orderpriority AS tag, o_orderkey FROM orders), new AS (SELECT k, substr(trim(regexp_replace(replace(lower(tag), ',', ' '), '\\s+', ' ', 'g')), 1, 40) AS tag FROM t WHERE o_orderkey % 3 = 0)
SELECT CAST(k AS VARCHAR) AS sha256, tag FROM (SELECT DISTINCT k, tag FROM t WHERE k NOT IN (SELECT k FROM new)) UNION ALL SELECT CAST(k AS VARCHAR), tag FROM (SELECT DISTINCT k, tag FROM new)
""")
def j_set_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("sha256"), F.col("o_orderpriority").alias("tag"), "o_orderkey")
    return edits.set_tags(t.select("sha256", "tag").distinct(), t.where("o_orderkey % 3 = 0").select("sha256", "tag"))


@query(f"""
WITH {SQL} SELECT sha256, CASE WHEN event_id % 10 = 1 THEN TIMESTAMP '2020-02-02 12:00:00' WHEN event_id % 10 = 2 THEN TIMESTAMP '2020-02-02 03:04:05' ELSE taken_at END AS taken_at,
    CASE event_id % 10 WHEN 1 THEN 'user-day' WHEN 2 THEN 'user' ELSE date_source END AS date_source, CASE WHEN event_id % 10 IN (1, 2) AND NOT favorite THEN NULL ELSE 'n' END AS name FROM records
""")
def j_set_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, k = records(spark, sf_dir).withColumn("name", F.lit("n")), F.col("event_id") % 10
    chosen = r.where(k.isin(1, 2)).select("sha256", F.lit("2020-02-02 03:04:05").cast("timestamp_ntz").alias("taken_at"), (k == 1).alias("whole_day"))
    return edits.set_date(r, chosen, r.where("favorite")).select("sha256", "taken_at", "date_source", "name")


@query(f"""
WITH {SQL} SELECT 'record' AS kind, sha256, camera, CASE WHEN event_id % 202 = 0 THEN NULL ELSE sharpness END AS sharpness FROM records WHERE NOT (deleted AND event_id % 202 != 0)
UNION ALL SELECT 'tag', sha256, 'x', NULL FROM records WHERE event_id % 3 = 0 AND NOT deleted
""")
def j_delete_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after a deletion and a part of it taken back, and tags, of which those of deleted records are gone."""
    r = records(spark, sf_dir)
    tags = r.where("event_id % 3 = 0").select("sha256", F.lit("x").alias("camera"))
    left, stones, dependents = edits.delete(r, r.where("deleted"), {"tags": tags})
    back = edits.restore(left, stones, r.where("event_id % 202 = 0"), ["sharpness"]).select(F.lit("record").alias("kind"), "sha256", "camera", "sharpness")
    return back.unionByName(dependents["tags"].withColumn("kind", F.lit("tag")), allowMissingColumns=True)


@query(f"WITH {SQL} SELECT slug, start, \"end\", parent FROM ranges WHERE slug NOT LIKE 'winter-trip%' UNION ALL SELECT 'spring', TIMESTAMP '2024-03-01', TIMESTAMP '2024-03-05', NULL")
def j_name_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.operators.intervals import name_range, unname

    return name_range(unname(ranges(spark), "winter-trip"), "spring", "2024-03-05", "2024-03-01")


_WAS = "was AS (SELECT id, label AS person_id FROM vectors WHERE id % 3 = 0)"


@query(f"""
WITH {SQL}, {_WAS}, r AS (SELECT * FROM was WHERE NOT (id % 11 = 0 AND person_id = 3) UNION SELECT id, person_id FROM vectors WHERE id % 11 = 0 AND person_id IS NOT NULL AND person_id != 3)
SELECT id, coalesce(CASE WHEN id % 11 = 0 THEN 3 ELSE person_id END, -1) AS person_id, CASE WHEN id % 11 = 0 THEN 'user' ELSE label_source END AS label_source, id % 11 != 0 AND ignored AS ignored, FALSE AS rejected FROM vectors
UNION ALL SELECT id, person_id, NULL, NULL, TRUE FROM r
""")
def j_identify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors after every eleventh was named, and the rejections that this leaves."""
    v = vectors(spark, sf_dir)
    before = v.where("id % 3 = 0").select("id", F.col("label").cast("long").alias("person_id"))
    named, rejected = edits.identify(v, before, v.where("id % 11 = 0"), 3)
    rows = named.fillna(-1, ["person_id"]).select("id", "person_id", "label_source", "ignored", F.lit(False).alias("rejected"))
    return rows.unionByName(rejected.withColumn("rejected", F.lit(True)), allowMissingColumns=True)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_orderkey % 8 = 0 AND l_suppkey IS NOT NULL)")
def j_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name")
    carried = table(spark, sf_dir, "lineitem").where("l_quantity > 49 and l_orderkey % 8 = 0").select(F.col("l_suppkey").alias("person_id"))
    return edits.orphans(people, carried).select(F.col("id").alias("s_suppkey"), "s_name")
