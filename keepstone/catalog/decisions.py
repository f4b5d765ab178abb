"""Decisions and what follows from them: groups, picks, pins, trays, drafts, marks of days; scoped and repeated runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.adapters import SQL, grouped, ranges, records, table, vectors
from keepstone.catalog import query
from keepstone.catalog.curation import _COPY, _G, _SCORED, NO_TIME_SQL, WIDE, _digest
from keepstone.config import NO_TIME, Curation
from keepstone.operators import derive, edits, relations, status, views
from keepstone.operators.ranking import score_groups
from keepstone.plans import diffs
from keepstone.sources.shared import shared_folder
from keepstone.streaming import incremental


@query(f"""
WITH {SQL}, f AS (SELECT sha256, 'c' || camera || strftime(taken_at, '%Y%m%d%H') AS now_, CASE WHEN event_id % 7 != 0 THEN 'o' || camera || CAST(extract(hour FROM taken_at) // 2 AS VARCHAR) || strftime(taken_at, '%Y%m%d') END AS was FROM records),
h AS (SELECT sha256, sha256(now_) AS g, CASE WHEN was IS NOT NULL THEN sha256(was) END AS old FROM f), n AS (SELECT g, old, count(*) AS n FROM h WHERE old IS NOT NULL GROUP BY 1, 2),
heir AS (SELECT old, g, n FROM (SELECT *, row_number() OVER (PARTITION BY old ORDER BY n DESC, g) AS r FROM n) WHERE r = 1), taken AS (SELECT g, old FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, old) AS r FROM heir) WHERE r = 1)
SELECT sha256, coalesce(old, g) AS moment_id FROM (SELECT h.sha256, h.g, taken.old FROM h LEFT JOIN taken ON taken.g = h.g)
""")
def m_late_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups by hour after late rows came, under the ids that groups of two hours had without them."""
    r = records(spark, sf_dir)
    day = F.date_format("taken_at", "yyyyMMdd")
    old = F.concat(F.lit("o"), "camera", F.floor(F.hour("taken_at") / 2).cast("string"), day)
    before = r.where("event_id % 7 != 0").select("sha256", F.sha2(old, 256).alias("moment_id"))
    now = r.select("sha256", F.sha2(F.concat(F.lit("c"), "camera", F.date_format("taken_at", "yyyyMMddHH")), 256).alias("moment_id"))
    return derive.keep_ids(before, now)


_CHAIN = f"""WITH RECURSIVE {_G}, {_COPY}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT x AS node, x AS other FROM e UNION SELECT r.node, e.y FROM reach r JOIN e ON e.x = r.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY node), k AS (SELECT r.sha256, first_value(r.sha256) OVER (PARTITION BY component ORDER BY width * height DESC, sharpness DESC, taken_at, r.sha256) AS keeper FROM records r JOIN c ON c.node = r.sha256),
regrouped AS (SELECT g.* EXCLUDE (duplicate_of), CASE WHEN keeper != g.sha256 THEN keeper END AS duplicate_of FROM grouped g LEFT JOIN k ON k.sha256 = g.sha256)"""
_AFTER = _SCORED[len(SQL):].replace("FROM grouped WINDOW", "FROM regrouped WINDOW")


@query(f"""
{_CHAIN}{_AFTER}, touched AS (SELECT DISTINCT moment_id FROM grouped WHERE event_id % 50 = 3)
SELECT sha256, moment_id, duplicate_of, round(score, 9) AS score, is_best, close_call FROM scored WHERE moment_id IN (SELECT moment_id FROM touched)
""")
def m_scoped_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies, scores and best members of the groups that a change touched: the rows of a full run."""
    g = grouped(spark, sf_dir).withColumns({"name": F.concat(F.lit("n"), F.col("event_id").cast("string")), "size": F.lit(None).cast("long")})
    out = derive.refresh(g, ranges(spark), WIDE, g.where("event_id % 50 = 3"))
    return out.select("sha256", "moment_id", "duplicate_of", F.round("score", 9).alias("score"), "is_best", "close_call")


@query(f"""
WITH {SQL}, t AS (SELECT taken_at, epoch(taken_at) - epoch(lag(taken_at) OVER (ORDER BY taken_at)) AS gap FROM records WHERE date_source NOT IN {NO_TIME_SQL}),
i AS (SELECT taken_at, sum(CASE WHEN gap > 900 THEN 1 ELSE 0 END) OVER (ORDER BY taken_at) AS e FROM t), s AS (SELECT min(taken_at) AS start, max(taken_at) AS "end", count(*) AS records FROM i GROUP BY e)
SELECT strftime(start, '%Y%m%d_%H%M%S') AS id, start, "end", records, (SELECT coalesce(arg_min(slug, r.start) FILTER (parent IS NOT NULL), arg_max(slug, r.start) FILTER (parent IS NULL)) FROM ranges r WHERE s.start BETWEEN r.start AND r."end") AS slug FROM s
""")
def f_named_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.suggestions(records(spark, sf_dir), ranges(spark), 0.25, NO_TIME)


@query(f"""
WITH {_SCORED}, one AS (SELECT *, is_best AND moment_id IN (SELECT moment_id FROM grouped WHERE event_id % 19 = 0) AS pin, row_number() OVER (PARTITION BY strftime(taken_at, '%Y-%m'), moment_id ORDER BY favorite DESC, is_best AND moment_id IN (SELECT moment_id FROM grouped WHERE event_id % 19 = 0) DESC, coalesce(score, 0) DESC, sha256) AS o
    FROM scored WHERE duplicate_of IS NULL AND (is_best OR favorite))
SELECT month, moment_id, sha256, CAST(rank AS INTEGER) AS rank FROM (SELECT *, strftime(taken_at, '%Y-%m') AS month, row_number() OVER (PARTITION BY strftime(taken_at, '%Y-%m') ORDER BY favorite DESC, pin DESC, coalesce(score, 0) DESC, sha256) AS rank FROM one WHERE o = 1) WHERE rank <= 6
""")
def f_month_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)
    return derive.month_covers(score_groups(g, Curation()), g.where("event_id % 19 = 0").select("moment_id"))


@query(f"""
WITH {SQL} SELECT day, CAST(place AS INTEGER) AS place, sha256, greatest(n - 12, 0) AS more FROM (SELECT strftime(taken_at, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY strftime(taken_at, '%Y-%m-%d') ORDER BY taken_at, sha256) AS place, sha256, count(*) OVER (PARTITION BY strftime(taken_at, '%Y-%m-%d')) AS n FROM records) WHERE place <= 12
""")
def f_day_thumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).withColumn("day", F.date_format("taken_at", "yyyy-MM-dd"))
    return derive.day_thumbs(r, "day", ["taken_at", "sha256"])


@query(f"""
WITH {SQL}, o AS (SELECT sha256, sha256('g' || CAST(event_id % 3 AS VARCHAR)) AS m FROM records WHERE event_id % 40 = 1), moved AS (SELECT g.sha256, coalesce(o.m, g.moment_id) AS moment_id FROM grouped g LEFT JOIN o USING (sha256))
SELECT 'record' AS kind, sha256 AS a, moment_id AS b FROM moved UNION ALL SELECT DISTINCT 'touched', moment_id, NULL FROM (SELECT g.moment_id FROM grouped g JOIN o USING (sha256) UNION SELECT m FROM o)
UNION ALL SELECT 'pin', p, NULL FROM (SELECT DISTINCT moment_id AS p FROM grouped) WHERE p IN (SELECT moment_id FROM moved)
""")
def j_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir).select("sha256", "moment_id", "event_id")
    overrides = g.where("event_id % 40 = 1").select("sha256", F.sha2(F.concat(F.lit("g"), (F.col("event_id") % 3).cast("string")), 256).alias("moment_id"))
    moved, touched, pins = edits.regroup(g.drop("event_id"), overrides, g.select("moment_id").distinct())
    named = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), b.alias("b"))
    none = F.lit(None).cast("string")
    return named(moved, "record", "sha256", F.col("moment_id")).unionByName(named(touched, "touched", "moment_id", none)).unionByName(named(pins, "pin", "moment_id", none))


@query(f"""
WITH {SQL}, p AS (SELECT DISTINCT moment_id FROM grouped WHERE event_id % 30 = 1 UNION SELECT moment_id FROM grouped WHERE favorite UNION SELECT moment_id FROM grouped WHERE event_id % 71 = 0) SELECT moment_id FROM p WHERE moment_id NOT IN (SELECT moment_id FROM grouped WHERE event_id % 13 = 5)
""")
def j_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins, some of stars, some set by hand (one of a group that isn't there), some taken off."""
    g = grouped(spark, sf_dir)
    pins = edits.pin_starred(g.where("event_id % 30 = 1").select("moment_id").distinct(), g, g.where("favorite"))
    chosen = g.where("event_id % 71 = 0").select("moment_id").unionByName(spark.createDataFrame([("gone",)], "moment_id string"))
    return edits.set_pin(edits.set_pin(pins, g, chosen, True), g, g.where("event_id % 13 = 5"), False)


@query(f"""
WITH {SQL}, f AS (SELECT arg_min(moment_id, strftime(taken_at, '%Y%m%d%H%M%S') || sha256) AS m, min(strftime(taken_at, '%Y%m%d%H%M%S') || sha256) AS k FROM grouped)
SELECT sha256, CASE WHEN moment_id = m THEN sha256 = substr(k, 15) ELSE user_best END AS user_best FROM grouped, f
""")
def j_pick_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir)
    first = g.orderBy("taken_at", "sha256").select("moment_id", "sha256").first()  # what a user picked
    return edits.pick_best(g, first["moment_id"], first["sha256"]).select("sha256", "user_best")


@query(f"""
WITH {SQL}, f AS (SELECT moment_id AS m FROM grouped GROUP BY 1 HAVING count(*) > 2 ORDER BY 1 LIMIT 1), o AS (SELECT sha256 FROM grouped, f WHERE moment_id = m AND sha256 != m),
d AS (SELECT {_digest('sha256')} AS d FROM o) SELECT sha256, CASE WHEN sha256 = m THEN m ELSE sha256('split:' || m || ':' || d) END AS moment_id FROM grouped, f, d WHERE moment_id = m
""")
def j_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members but the first leave a group."""
    g = grouped(spark, sf_dir).select("sha256", "moment_id")
    m = g.groupBy("moment_id").count().where("count > 2").agg(F.min("moment_id")).first()[0]  # what a user picked
    return edits.split(g, m, g.where((F.col("moment_id") == m) & (F.col("sha256") != m)))


@query(f"WITH {SQL} SELECT sha256, moment_id, user_best FROM grouped WHERE event_id % 2 = 0 UNION ALL SELECT sha256, 'other', TRUE FROM grouped WHERE event_id % 2 = 1")
def j_undo(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir).select("sha256", "moment_id", "user_best", "event_id")
    now = g.withColumns({"moment_id": F.lit("other"), "user_best": F.lit(True)}).drop("event_id")
    return edits.undo(now, g.where("event_id % 2 = 0").drop("event_id"))


@query(f"WITH {SQL} SELECT sha256, coalesce(CASE WHEN event_id % 9 = 0 THEN 'o' END, moment_id) AS moment_id FROM grouped")
def j_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.operators.bursts import apply_overrides

    g = grouped(spark, sf_dir)
    return apply_overrides(g.select("sha256", "moment_id"), g.where("event_id % 9 = 0").select("sha256", F.lit("o").alias("moment_id")))


@query("""
WITH t AS (SELECT DISTINCT p_brand AS tag FROM part), b AS (SELECT p_type AS tag, min(p_partkey) AS k FROM part GROUP BY 1), i AS (SELECT tag, row_number() OVER (ORDER BY k) - 1 AS position FROM b),
n AS (SELECT tag, row_number() OVER (ORDER BY tag) AS r FROM t WHERE tag NOT IN (SELECT tag FROM i)) SELECT tag, position FROM i UNION ALL SELECT tag, (SELECT max(position) FROM i) + r FROM n
""")
def j_tag_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New choices at the end of an ordered list."""
    p = table(spark, sf_dir, "part")
    types = p.groupBy(F.col("p_type").alias("tag")).agg(F.min("p_partkey").alias("k")).toPandas().sort_values("k")["tag"]  # a list that a user keeps
    items = spark.createDataFrame([(t, i) for i, t in enumerate(types)], "tag string, position long")
    return edits.append_positions(items, p.select(F.col("p_brand").alias("tag")), "tag")


@query(f"WITH {SQL}, t AS (SELECT sha256 FROM records WHERE event_id % 6 = 0) SELECT sha256 FROM t WHERE sha256 NOT IN (SELECT sha256 FROM records WHERE event_id % 4 = 0) UNION ALL SELECT sha256 FROM records WHERE event_id % 4 = 0 AND event_id % 6 != 0")
def j_tray(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return edits.toggle(r.where("event_id % 6 = 0").select("sha256"), r.where("event_id % 4 = 0").select("sha256"))


@query(f"WITH {SQL} SELECT sha256, event_id % 5 = 0 OR event_id % 2 = 0 AS purged FROM records WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def j_forget_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were removed by hand become purged tombstones beside those that there are."""
    r = records(spark, sf_dir)
    stones = r.where("event_id % 7 = 0 and event_id % 5 != 0").select("sha256", F.lit("{}").alias("data"), (F.col("event_id") % 2 == 0).alias("purged"))
    return edits.forget_missing(r, stones, r.where("event_id % 5 = 0"))[1].select("sha256", "purged")


@query("SELECT count(*) AS purged FROM supplier")
def j_empty_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    stones = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 2 == 0).alias("purged"))
    return edits.empty_trash(stones).agg(F.count_if("purged").alias("purged"))


@query("SELECT 'a' AS name, 'Alpha' AS title, 3 AS pictures UNION ALL SELECT 'b', NULL, NULL")
def j_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    drafts = spark.createDataFrame([("a", '{"title": "old", "gone": 1}')], "name string, body string")
    fields = table(spark, sf_dir, "region").agg(F.lit("Alpha").alias("title"), F.lit(3).alias("pictures"), F.lit(None).cast("string").alias("quote"))
    saved = edits.save_draft(drafts, "a", fields)
    load = lambda n: edits.load_draft(saved, n, "title string, pictures int").select(F.lit(n).alias("name"), "title", "pictures")
    return load("a").unionByName(load("b"))


@query(f"""
WITH {SQL}, n AS (SELECT strftime(taken_at, '%Y-%m-%d') AS day, CAST(strftime(taken_at, '%d') AS INTEGER) AS n, {_digest('sha256')} AS members_sig FROM grouped GROUP BY 1, 2)
SELECT day, CASE WHEN n % 3 = 0 THEN 'reviewed' WHEN n % 3 = 1 THEN 'new' ELSE 'moments updated' END AS status FROM n
""")
def j_keep_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One's own edit merges all groups of a day; every third day was marked as it was, every other third before that."""
    g = grouped(spark, sf_dir).withColumn("day", F.date_format("taken_at", "yyyy-MM-dd"))
    n = F.substring("day", 9, 2).cast("int") % 3
    before, after = status.fingerprints(g), status.fingerprints(g.withColumn("moment_id", F.lit("one")))
    marks = before.where(n == 0).unionByName(before.where(n == 2).withColumn("members_sig", F.lit("other")).withColumn("records", F.col("records") + 1))
    return status.day_status(after, status.keep_reviewed(marks, before, after, before.select("day")))


@query(f"""
WITH {SQL}, n AS (SELECT strftime(taken_at, '%Y-%m-%d') AS day, CAST(strftime(taken_at, '%d') AS INTEGER) AS n, {_digest('sha256')} AS sig FROM grouped GROUP BY 1, 2) SELECT day, CASE WHEN n % 2 = 0 THEN sig ELSE 'kept' END AS members_sig FROM n
""")
def j_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = status.fingerprints(grouped(spark, sf_dir).withColumn("day", F.date_format("taken_at", "yyyy-MM-dd")))
    old = now.withColumn("members_sig", F.when(F.substring("day", 9, 2).cast("int") % 2 == 1, "kept"))
    return status.backfill(old, now).select("day", "members_sig")


@query("SELECT sum(p_size * (p_partkey % 5) / 4.0::DOUBLE) / sum(p_size) AS done FROM part")
def l_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.weighted_progress(table(spark, sf_dir, "part").select(F.col("p_size").alias("weight"), ((F.col("p_partkey") % 5) / 4).alias("fraction")))


@query(f"WITH {SQL} SELECT sha256 FROM records WHERE top AND NOT private")
def l_export_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What may leave: the guard lets a choice without private records through."""
    r = records(spark, sf_dir)
    return diffs.refuse_private(r.where("top and not private").select("sha256"), r)


@query("SELECT user_id, time_bucket(INTERVAL 1 DAY, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def m_day_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a day by user, as a stream that updates its counts."""
    root = f"{shared_folder(spark)}/days-{uuid.uuid4().hex[:12]}"
    stream = incremental.stream_table(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = incremental.windowed_counts(stream, "ts", ["user_id"], "1 day", "1 day", "3650 days")
    incremental.run_latest(counts, ["user_id", "start"], f"{root}/out", f"{root}/log")
    return spark.read.parquet(f"{root}/out").select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH b AS (SELECT path, mtime, size FROM (SELECT 'p' || CAST(doc_id % 100 AS VARCHAR) AS path, CAST(doc_id AS DOUBLE) AS mtime, n_chars AS size, row_number() OVER (PARTITION BY doc_id % 100 ORDER BY doc_id DESC) AS r FROM documents) WHERE r = 1)
SELECT path, mtime, (SELECT max(doc_id) FROM documents) + 1 - mtime >= 50 AS ready FROM b
""")
def m_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed too recently wait; of a path the newest row counts."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 100).cast("string")).alias("path"), F.col("doc_id").cast("double").alias("mtime"), F.col("n_chars").alias("size"))
    now = d.agg(F.max("mtime")).first()[0] + 1
    ready, pending = incremental.settle(d.where("mtime % 2 = 0"), d.where("mtime % 2 = 1"), now, 50.0)
    return ready.withColumn("ready", F.lit(True)).unionByName(pending.withColumn("ready", F.lit(False))).select("path", "mtime", "ready")


@query("""
SELECT p_partkey, '> ' || p_name || '  ' || chr(10) || '  ' || chr(10) || '>  ' || chr(10) || '  ' || chr(10) || '> x  ' || chr(10) || '  ' AS quoted,
    '---' || chr(10) || 'title: "' || p_name || ' \\"q\\""' || chr(10) || 'author: me' || chr(10) || 'categories: ["a b"]' || chr(10) || '---' AS head,
    CASE WHEN p_partkey % 2 = 0 THEN 'https://x.org/a%20b/2024/02/03/' || CAST(p_partkey AS VARCHAR) || '.html' ELSE 'https://x.org/' END AS url FROM part
""")
def k_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, one = table(spark, sf_dir, "part"), F.array(F.lit("a b"))
    key = F.col("p_partkey").cast("string")
    file = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("2024-02-03-"), key, F.lit(".md"))).otherwise(F.lit("notes.txt"))
    return p.select(
        "p_partkey", views.block_quote(F.concat("p_name", F.lit("\n\nx"))).alias("quoted"),
        views.post_head(F.concat("p_name", F.lit(' "q" ')), F.lit("me"), one, F.array().cast("array<string>")).alias("head"), views.post_url(F.lit("https://x.org/"), file, one).alias("url"),
    )


@query("""
WITH l AS (SELECT l_orderkey, 'n' || CAST(l_linenumber AS VARCHAR) AS name, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'before' ELSE '  ' END AS b FROM lineitem),
m AS (SELECT l_orderkey, string_agg(CASE WHEN b = 'before' THEN 'before' || chr(10) || chr(10) ELSE '' END || '![alt](' || '{{ site.pics_url }}' || name || '.jpg)', chr(10) || chr(10) ORDER BY l_linenumber, name) AS body FROM l GROUP BY 1)
SELECT o_orderkey AS post, 'top' || chr(10) || chr(10) || coalesce(body || chr(10) || chr(10), '') || 'end' AS body FROM orders LEFT JOIN m ON l_orderkey = o_orderkey
""")
def k_post_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    pictures = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("post"), n.alias("position"), F.concat(F.lit("n"), n.cast("string")).alias("name"), F.lit(" alt ").alias("alt"), F.when(n % 2 == 0, "before").otherwise("  ").alias("text_before"))
    posts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("post"), F.lit(" top").alias("top_text"), F.lit("end ").alias("bottom_text"))
    return views.post_body(pictures, posts)


@query("""
SELECT e.event_id, e.event_type, a.value AS as_of_value, a.event_id AS as_of_event_id FROM events e ASOF LEFT JOIN (SELECT user_id, ts, s.value AS value, s.event_id AS event_id FROM (SELECT user_id, ts, max(struct_pack(value := value, event_id := event_id)) AS s FROM events WHERE event_id % 3 = 0 GROUP BY user_id, ts)) a ON a.user_id = e.user_id AND a.ts <= e.ts
""")
def d_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return relations.as_of(e, e.where("event_id % 3 = 0"), ["user_id"], "ts", ["value", "event_id"]).select("event_id", "event_type", "as_of_value", "as_of_event_id")


@query("""
SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS below, first_value(o_orderkey) OVER w AS first, nth_value(o_orderkey, 2) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
    round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS kind FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)
""")
def f_window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("_keepstone_orders")
    return spark.sql("""
        SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS below, first_value(o_orderkey) OVER w AS first,
            nth_value(o_orderkey, 2) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,
            round(sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS three,
            dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS kind
        FROM _keepstone_orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)""")


@query("SELECT event_type, count(DISTINCT user_id % 7) AS kinds, count(*) AS n FROM events GROUP BY event_type")
def e_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches are exact at so few values."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.approx_count_distinct(F.col("user_id") % 7, 0.01).alias("kinds"), F.count("*").alias("n"))


@query("""
(SELECT 'except' AS kind, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 = 0 EXCEPT ALL SELECT 'except', l_linenumber FROM lineitem WHERE l_orderkey % 3 = 1)
UNION ALL (SELECT 'intersect', l_linenumber FROM lineitem WHERE l_orderkey % 3 = 0 INTERSECT ALL SELECT 'intersect', l_linenumber FROM lineitem WHERE l_orderkey % 3 = 1)
""")
def h_multisets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"))
    part = lambda k: n.where(F.col("l_orderkey") % 3 == k).select("n")
    named = lambda df, kind: df.select(F.lit(kind).alias("kind"), "n")
    return named(part(0).exceptAll(part(1)), "except").unionByName(named(part(0).intersectAll(part(1)), "intersect"))


@query("""
SELECT 'all' AS scope, count(*) AS n FROM customer UNION ALL SELECT 'none', 0 UNION ALL SELECT 'some', count(*) FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)
UNION ALL SELECT 'filter', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'no filter', count(*) FROM customer
""")
def c_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No scope means all rows, an empty one none; empty filters ask for nothing."""
    c = table(spark, sf_dir, "customer")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    cases = {
        "all": relations.in_scope(c, "c_nationkey", None), "none": relations.in_scope(c, "c_nationkey", nations.where("false")),
        "some": relations.in_scope(c, "c_nationkey", nations.where("n_regionkey = 1")), "filter": relations.matching(c, c_mktsegment="BUILDING"), "no filter": relations.matching(c, c_mktsegment="", c_name=None),
    }
    out = [df.agg(F.lit(name).alias("scope"), F.count("*").alias("n")) for name, df in cases.items()]
    first = out[0]
    for df in out[1:]:
        first = first.unionByName(df)
    return first


@query("SELECT s_suppkey, s_name, (SELECT count(*) > 0 FROM supplier WHERE s_acctbal > 1e12) AS rich FROM supplier")
def c_known_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return relations.known_columns(s, ["s_name", "s_suppkey", "not there"]).withColumn("rich", F.lit(relations.exists(s.where("s_acctbal > 1e12"))))


@query("SELECT 'library' AS label, 'AFRICA' AS path, count(*) > 0 AS there FROM region WHERE r_name = 'AFRICA' UNION ALL SELECT 'cache', 'nowhere', FALSE")
def g_path_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.path_report({"library": "AFRICA", "cache": "nowhere"}, table(spark, sf_dir, "region").select(F.col("r_name").alias("path")))


@query(f"""WITH {SQL} SELECT kind, k, CAST(rank AS INTEGER) AS rank FROM (SELECT 'range' AS kind, slug AS k, row_number() OVER (ORDER BY start) AS rank FROM ranges UNION ALL SELECT 'ignored', CAST(id AS VARCHAR), row_number() OVER (ORDER BY id DESC) FROM vectors WHERE ignored) WHERE rank <= 20""")
def g_ordered_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named ranges by start, and the twenty newest ignored vectors: each scan is cut before it is numbered."""
    r = ranges(spark).orderBy("start").limit(20)
    v = vectors(spark, sf_dir).where("ignored").orderBy(F.desc("id")).limit(20)
    a = r.select(F.lit("range").alias("kind"), F.col("slug").alias("k"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("start")).alias("rank"))
    b = v.select(F.lit("ignored").alias("kind"), F.col("id").cast("string").alias("k"), F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("id"))).alias("rank"))
    return a.unionByName(b)
