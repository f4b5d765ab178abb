"""Relational forms: filters, joins, aggregates, windows, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepstone.adapters import SQL, grouped, ranges, records, sources, table, vectors
from keepstone.catalog import query
from keepstone.operators import ingest, intervals, ranking, rollups

T = table


@query("""
SELECT o_orderkey, coalesce(nullif(o_orderpriority, '1-URGENT'), 'now') AS priority, o_totalprice FROM orders
WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT LIKE '5%' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
    AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
""")
def c_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders").where(
        F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").startswith("5") & F.col("o_orderdate").between("1995-01-01", "1996-12-31")
    )
    large = T(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    building = T(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    out = o.join(large, "o_orderkey", "left_semi").join(building, "o_custkey", "left_anti")
    return out.select("o_orderkey", F.coalesce(F.nullif("o_orderpriority", F.lit("1-URGENT")), F.lit("now")).alias("priority"), "o_totalprice")


@query("""
SELECT c_custkey, n_name, r_name, o_orderkey, l_linenumber, s_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 0
WHERE r_name = 'EUROPE' AND l_quantity > 40
""")
def d_join_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: T(spark, sf_dir, n)
    where = t("nation").join(t("region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = t("customer").join(where, F.col("c_nationkey") == F.col("n_nationkey"))
    lines = t("orders").join(t("lineitem").where("l_quantity > 40"), F.col("o_orderkey") == F.col("l_orderkey"))
    rich = t("supplier").where("s_acctbal > 0")
    out = c.join(lines, F.col("c_custkey") == F.col("o_custkey")).join(rich, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("c_custkey", "n_name", "r_name", "o_orderkey", "l_linenumber", "s_name")


@query(f"""
WITH {SQL}, hit AS (SELECT e.event_id, r.* FROM records e JOIN ranges r ON e.taken_at BETWEEN r.start AND r."end")
SELECT e.event_id, coalesce((SELECT arg_min(slug, start) FROM hit h WHERE h.event_id = e.event_id AND parent IS NOT NULL),
    (SELECT arg_max(slug, start) FROM hit h WHERE h.event_id = e.event_id AND parent IS NULL)) AS slug FROM records e
""")
def d_interval_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir).select("event_id", "taken_at")
    return intervals.most_specific(r, "taken_at", ranges(spark), "event_id").select("event_id", "slug")


@query(f"""
WITH {SQL}, u AS (SELECT CAST(user_id AS VARCHAR) AS slug, min(taken_at) AS start, min(taken_at) + INTERVAL 8 DAY AS "end" FROM records GROUP BY user_id)
SELECT u.slug AS a_slug, r.slug AS b_slug, CASE WHEN r.start <= u.start AND u."end" <= r."end" THEN 'within'
    WHEN u.start <= r.start AND r."end" <= u."end" THEN 'contains' ELSE 'overlaps' END AS kind
FROM u JOIN ranges r ON u.start <= r."end" AND r.start <= u."end"
""")
def d_interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.min("taken_at")
    u = records(spark, sf_dir).groupBy(F.col("user_id").cast("string").alias("slug")).agg(start.alias("start"))
    u = u.withColumn("end", (F.col("start") + F.expr("interval 8 days")).cast("timestamp_ntz"))
    return intervals.overlapping(u, ranges(spark))


@query(f"""
WITH {SQL}, h AS (SELECT date_trunc('hour', taken_at) AS h, min(taken_at) AS start, max(taken_at) AS "end" FROM records GROUP BY 1),
s AS (SELECT *, strftime(start, '%Y%m%d_%H%M%S') AS id, list(struct_pack(id := strftime(start, '%Y%m%d_%H%M%S'), e := "end")) OVER (ORDER BY start ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS l FROM h),
p AS (SELECT s.*, (SELECT arg_min(r."end", r.start) FROM ranges r WHERE r.parent IS NULL AND r.start <= s.start AND s."end" <= r."end") AS until FROM s)
SELECT id, coalesce(array_to_string(list_transform(list_filter(l, lambda x: until IS NULL OR x.e <= until), lambda x: x.id), ','), '') AS later FROM p
""")
def f_later_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours with records as suggestions; those after each one, but none beyond the range that it lies in."""
    h = records(spark, sf_dir).groupBy(F.date_trunc("hour", "taken_at").alias("h")).agg(F.min("taken_at").alias("start"), F.max("taken_at").alias("end"))
    found = h.select(F.date_format("start", "yyyyMMdd_HHmmss").alias("slug"), "start", "end")
    out = intervals.later_within(found, ranges(spark), 15)
    return out.select(F.col("slug").alias("id"), F.array_join("later", ",").alias("later"))


@query(f"""
WITH {SQL}, there AS (SELECT path FROM sources WHERE doc_id % 3 != 0) SELECT sha256, min(path) AS path FROM sources WHERE path IN (SELECT path FROM there) GROUP BY sha256
""")
def d_first_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir)
    return ingest.first_source(s, s.where("doc_id % 3 != 0"))


@query(f"""
WITH {SQL}, expected AS (SELECT 'a' AS root, path, sha256 FROM sources WHERE doc_id % 4 != 0),
listing AS (SELECT 'a' AS root, CASE WHEN doc_id % 5 = 1 THEN 'moved/' || path ELSE path END AS path, sha256 FROM sources WHERE doc_id % 7 != 0),
m AS (SELECT *, row_number() OVER (PARTITION BY root, sha256 ORDER BY path) AS n FROM expected e WHERE NOT EXISTS (SELECT 1 FROM listing l WHERE l.root = e.root AND l.path = e.path)),
u AS (SELECT root, sha256, path AS new_path, row_number() OVER (PARTITION BY root, sha256 ORDER BY path) AS n FROM listing l WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE l.root = e.root AND l.path = e.path))
SELECT root, sha256, path, new_path, CASE WHEN path IS NULL THEN 'unknown' WHEN new_path IS NULL THEN 'missing' ELSE 'moved' END AS kind FROM m FULL JOIN u USING (root, sha256, n)
""")
def d_moved_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sources(spark, sf_dir).withColumn("root", F.lit("a"))
    expected = s.where("doc_id % 4 != 0").select("root", "path", "sha256")
    moved = F.when(F.col("doc_id") % 5 == 1, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    return ingest.moved_files(expected, s.where("doc_id % 7 != 0").select("root", moved.alias("path"), "sha256"))


@query(f"""
WITH {SQL}, packages AS (SELECT 'p' || CAST(event_id AS VARCHAR) AS package_sha, CASE WHEN event_id % 2 = 0 THEN sha256 ELSE 'none' END AS photo_sha FROM records WHERE event_id % 10 < 2 AND event_id % 11 != 5),
frames AS (SELECT 'p' || CAST(event_id - event_id % 10 + k AS VARCHAR) AS package_sha, CASE WHEN event_id % 10 = 4 THEN 'Reference.jpg' ELSE 'f' || CAST(event_id % 10 AS VARCHAR) END AS member, sha256 FROM records, (VALUES (0), (1)) v(k) WHERE event_id % 10 BETWEEN 2 AND 6)
SELECT p.package_sha, CASE WHEN EXISTS (SELECT 1 FROM records r WHERE r.sha256 = p.photo_sha) THEN p.photo_sha ELSE
    (SELECT arg_min(f.sha256, (CAST(lower(f.member) != 'reference.jpg' AS INTEGER), f.member)) FROM frames f WHERE f.package_sha = p.package_sha) END AS sha256 FROM packages p
""")
def d_companion_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, e = records(spark, sf_dir), F.col("event_id")
    name = lambda c: F.concat(F.lit("p"), c.cast("string"))
    packages = r.where((e % 10 < 2) & (e % 11 != 5)).select(name(e).alias("package_sha"), F.when(e % 2 == 0, F.col("sha256")).otherwise("none").alias("photo_sha"))
    member = F.when(e % 10 == 4, "Reference.jpg").otherwise(F.concat(F.lit("f"), (e % 10).cast("string")))
    frames = r.where((e % 10).between(2, 6)).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("k"), e, member.alias("member"), "sha256")
    return ingest.companion_target(packages, frames.select(name(e - e % 10 + F.col("k")).alias("package_sha"), "member", "sha256"), r)


@query(f"""
WITH {SQL} SELECT a.id, b.id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS similarity FROM vectors a JOIN vectors b ON a.id < b.id
WHERE list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4
""")
def d_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs above a threshold, block against block."""
    from keepstone.operators.vectors import similar_pairs

    v = vectors(spark, sf_dir).select("id", F.col("embedding").cast("array<double>").alias("v"))
    return similar_pairs(v, 0.4).withColumn("similarity", F.round("similarity", 6))


@query(f"""
WITH {SQL} SELECT (SELECT count(*) FROM grouped) AS records, (SELECT count(DISTINCT moment_id) FROM grouped) AS moments, (SELECT count(duplicate_of) FROM grouped) AS copies,
    (SELECT count(*) FROM grouped WHERE favorite) AS favorites, (SELECT count(*) FROM grouped WHERE deleted) AS deleted,
    (SELECT count(*) FROM grouped WHERE date_source IN ('mtime', 'folder-month')) AS undated, (SELECT count(*) - count(DISTINCT sha256) FROM sources) AS exact_copies,
    (SELECT count(*) FROM sources WHERE status = 'error') AS unreadable, (SELECT count(*) FROM ranges) AS named_ranges,
    (SELECT count(DISTINCT person_id) FROM vectors) AS people
""")
def e_status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over each relation; single rows are put side by side."""
    g = grouped(spark, sf_dir).agg(
        F.count("*").alias("records"), F.count_distinct("moment_id").alias("moments"), F.count("duplicate_of").alias("copies"),
        F.count_if("favorite").alias("favorites"), F.count_if("deleted").alias("deleted"), F.count_if(F.col("date_source").isin("mtime", "folder-month")).alias("undated"),
    )
    s = sources(spark, sf_dir).agg((F.count("*") - F.count_distinct("sha256")).alias("exact_copies"), F.count_if(F.col("status") == "error").alias("unreadable"))
    r = ranges(spark).agg(F.count("*").alias("named_ranges"))
    v = vectors(spark, sf_dir).agg(F.count_distinct("person_id").alias("people"))
    one = lambda df: df.withColumn("_k", F.lit(1))
    return one(g).join(one(s), "_k").join(one(r), "_k").join(one(v), "_k").drop("_k")


@query(f"""
WITH {SQL} SELECT coalesce(person_id, -1) AS person_id, count(*) AS vectors, sum(CASE WHEN label_source = 'user' THEN 1 ELSE 0 END)::BIGINT AS named, min(id) AS first, max(id) AS last FROM vectors GROUP BY 1
""")
def e_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).fillna(-1, ["person_id"]).groupBy("person_id").agg(
        F.count("*").alias("vectors"), F.count_if(F.col("label_source") == "user").alias("named"), F.min("id").alias("first"), F.max("id").alias("last")
    )


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ', ' ORDER BY o_orderpriority) AS priorities, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses,
    string_agg(DISTINCT CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END, ', ' ORDER BY CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END) AS open FROM orders GROUP BY o_custkey
""")
def e_ordered_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda c: F.nullif(F.array_join(F.array_sort(F.collect_set(c)), ", "), F.lit(""))
    return T(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        joined(F.col("o_orderpriority")).alias("priorities"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"),
        joined(F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority"))).alias("open"),
    )


_FOLDERS = f"""
WITH {SQL}, r AS (SELECT strftime(taken_at, '%Y/%Y-%m-%d') AS folder, strftime(taken_at, '%Y-%m-%d') AS day, moment_id, exposure > 0.9 AS close_call FROM grouped WHERE event_id % 3 != 1),
v AS (SELECT strftime(taken_at, '%Y/%Y-%m-%d') AS folder, strftime(taken_at, '%Y-%m-%d') AS day FROM grouped WHERE event_id % 3 = 1),
a AS (SELECT folder, min(day) AS day, count(*) AS records, count(DISTINCT moment_id) AS moments, count(DISTINCT CASE WHEN close_call THEN moment_id END) AS close_calls FROM r GROUP BY folder),
b AS (SELECT folder, min(day) AS day, count(*) AS videos FROM v GROUP BY folder),
folders AS (SELECT coalesce(a.folder, b.folder) AS folder, coalesce(a.day, b.day) AS day, coalesce(records, 0) AS records, coalesce(moments, 0) AS moments, coalesce(close_calls, 0) AS close_calls,
    coalesce(videos, 0) AS videos, CAST(substr(coalesce(a.day, b.day), 9, 2) AS INTEGER) % 3 = 0 AS reviewed FROM a FULL JOIN b ON a.folder = b.folder)
"""


def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, e = grouped(spark, sf_dir), F.col("event_id")
    both = g.withColumns({"folder": F.date_format("taken_at", "yyyy/yyyy-MM-dd"), "day": F.date_format("taken_at", "yyyy-MM-dd"), "close_call": F.col("exposure") > 0.9})
    status = F.when(F.substring("day", 9, 2).cast("int") % 3 == 0, "reviewed").otherwise("new")
    marks = both.select("day").distinct().withColumn("status", status)
    return rollups.folder_summary(both.where(e % 3 != 1), both.where(e % 3 == 1), marks)


@query(_FOLDERS + "SELECT folder, records, moments, close_calls, videos, reviewed FROM folders")
def e_folder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folders(spark, sf_dir).select("folder", "records", "moments", "close_calls", "videos", "reviewed")


@query(_FOLDERS + """
SELECT substr(day, 1, 4) AS year, substr(day, 1, 7) AS month, sum(records)::BIGINT AS records, count(*) AS days, count(*) FILTER (reviewed) AS done, count(*) FILTER (NOT reviewed) AS todo
FROM folders GROUP BY ROLLUP (substr(day, 1, 4), substr(day, 1, 7))
""")
def e_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.overview(_folders(spark, sf_dir))


@query(_FOLDERS + """
SELECT month, """ + ", ".join(f"coalesce(max(CASE WHEN d = {i} THEN n END), -1) AS d{i:02d}" for i in range(1, 32)) + """
FROM (SELECT strftime(x, '%Y-%m') AS month, day(x) AS d, coalesce((SELECT sum(records)::BIGINT FROM folders f WHERE f.day = strftime(x, '%Y-%m-%d')), 0) AS n
    FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 1 DAY)) AS x)) GROUP BY month
""")
def e_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places beyond a month's end are -1 here."""
    return rollups.calendar(_folders(spark, sf_dir), 2024).fillna(-1)


@query(f"""
WITH {SQL} SELECT strftime(taken_at, '%Y') AS year, strftime(taken_at, '%Y-%m') AS month, count(*) AS n, string_agg(sha256, ',' ORDER BY taken_at, event_id, sha256) AS items FROM records WHERE favorite GROUP BY 1, 2
""")
def e_gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    picks = records(spark, sf_dir).where("favorite").select("taken_at", F.lpad(F.col("event_id").cast("string"), 20, "0").alias("name"), "sha256")
    return rollups.gallery(picks).select("year", "month", "n", F.array_join("items.sha256", ",").alias("items"))


@query(f"""
WITH {SQL}, c AS (SELECT r.slug, e.user_id, count(*) AS count FROM records e JOIN ranges r ON e.taken_at BETWEEN r.start AND r."end" WHERE date_source NOT IN ('mtime', 'folder', 'folder-month', 'user-day') GROUP BY 1, 2)
SELECT slug, user_id, count, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY count DESC, user_id) AS rank FROM c) WHERE rank <= 6
""")
def e_most_common(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.config import NO_TIME

    r = records(spark, sf_dir).where(~F.col("date_source").isin(*NO_TIME)).withColumn("d", F.to_date("taken_at"))
    days = ranges(spark).withColumn("d", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    inside = r.join(days, "d").where(F.col("taken_at").between(F.col("start"), F.col("end")))
    return rollups.common(inside, ["slug"], "user_id", 6).select("slug", "user_id", "count", "rank")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def e_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count_distinct("l_suppkey").alias("suppliers")
    )


@query(f"""
WITH {SQL}, x AS (SELECT label, unnest(embedding::DOUBLE[]) AS v, unnest(range(64)) AS pos FROM vectors), m AS (SELECT label, pos, avg(v) AS m FROM x GROUP BY 1, 2),
c AS (SELECT label, list(m ORDER BY pos) AS c, sqrt(sum(m * m)) AS norm FROM m GROUP BY label),
s AS (SELECT v.id, v.label, list_dot_product(v.embedding::DOUBLE[], c) / norm AS s FROM vectors v JOIN c USING (label))
SELECT id, label, round(s, 6) AS similarity FROM s
""")
def e_centroid_typicality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keepstone.operators.vectors import typicality

    v = vectors(spark, sf_dir).select("id", "label", F.col("embedding").cast("array<double>").alias("v"))
    return typicality(v, ["label"]).select("id", "label", F.round("similarity", 6).alias("similarity"))


@query(f"""
WITH {SQL}, n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY taken_at, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM records)
SELECT user_id, event_id FROM n WHERE n <= 8 OR list_contains([CAST(round_even(k * (n - 1) / 7.0::DOUBLE, 0) AS BIGINT) for k in range(8)], i)
""")
def f_even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.even_sample(records(spark, sf_dir), ["user_id"], ["taken_at", "event_id"], 8).select("user_id", "event_id")


@query(f"""
WITH {SQL}, d AS (SELECT DISTINCT strftime(taken_at, '%Y-%m-%d') AS day FROM records), t AS (SELECT day, CAST(substr(day, 9, 2) AS INTEGER) % 3 != 0 AS todo FROM d)
SELECT day, lag(day) OVER w AS previous, lead(day) OVER w AS next,
    max(CASE WHEN todo THEN day END) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_todo,
    min(CASE WHEN todo THEN day END) OVER (ORDER BY day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_todo FROM t WINDOW w AS (ORDER BY day)
""")
def f_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = records(spark, sf_dir).select(F.date_format("taken_at", "yyyy-MM-dd").alias("day")).distinct()
    return ranking.neighbours(days, ["day"], "day", F.substring("day", 9, 2).cast("int") % 3 != 0)


@query(f"""
WITH {SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY strftime(taken_at, '%Y-%m'), moment_id ORDER BY favorite DESC, sharpness DESC, sha256) AS o FROM grouped WHERE duplicate_of IS NULL)
SELECT strftime(taken_at, '%Y-%m') AS month, moment_id, sha256, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY strftime(taken_at, '%Y-%m') ORDER BY favorite DESC, sharpness DESC, sha256) AS rank FROM one WHERE o = 1) WHERE rank <= 6
""")
def f_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grouped(spark, sf_dir).where("duplicate_of is null").withColumn("month", F.date_format("taken_at", "yyyy-MM"))
    order = [F.desc(F.col("favorite").cast("int")), F.desc("sharpness"), F.asc("sha256")]
    return ranking.top_per_group(g, ["month"], order, 6, "moment_id").select("month", "moment_id", "sha256", "rank")


@query("""
WITH n AS (SELECT n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS p FROM nation)
SELECT n_nationkey, CASE WHEN p = 5 THEN 6 WHEN p = 6 THEN 5 ELSE p END AS position FROM n
""")
def f_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = T(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_nationkey").cast("long").alias("position"))
    return ranking.moved_by_one(items, "n_nationkey", "position", 5, 1).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "position")


@query("""
SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY (o_orderstatus = 'P') DESC, lower(o_orderpriority) != '1-urgent', o_totalprice DESC, o_orderkey LIMIT 100
""")
def g_multi_key_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = T(spark, sf_dir, "orders")
    order = [F.desc(F.col("o_orderstatus") == "P"), F.lower("o_orderpriority") != "1-urgent", F.desc("o_totalprice"), "o_orderkey"]
    return o.orderBy(*order).limit(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("""
SELECT l_suppkey, l_orderkey, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) WHERE rank <= 3
""")
def g_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")]
    return ranking.top_per_group(T(spark, sf_dir, "lineitem"), ["l_suppkey"], order, 3).select("l_suppkey", "l_orderkey", "l_linenumber", "rank")


@query("""
WITH a AS (SELECT DISTINCT c_nationkey AS k, 'customers only' AS w FROM customer WHERE c_acctbal > 9000), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, 'union' AS kind FROM (SELECT k FROM a UNION SELECT k FROM b) UNION ALL SELECT k, 'both' FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'first only' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)
""")
def h_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = T(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")).distinct()
    b = T(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct()
    named = lambda df, n: df.withColumn("kind", F.lit(n))
    return named(a.union(b).distinct(), "union").union(named(a.intersect(b), "both")).union(named(a.subtract(b), "first only"))


@query(f"""
WITH {SQL}, n AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY taken_at, event_id) AS i, user_id FROM records), b AS (SELECT user_id, min(i) AS lo, max(i) AS hi FROM n WHERE event_id % 50 = 7 GROUP BY user_id)
SELECT n.user_id, n.event_id FROM n JOIN b USING (user_id) WHERE i BETWEEN lo AND hi
""")
def c_range_between_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything between the first and the last chosen item of an order."""
    w = Window.partitionBy("user_id").orderBy("taken_at", "event_id")
    chosen, g = F.when(F.col("event_id") % 50 == 7, F.col("i")), Window.partitionBy("user_id")
    n = records(spark, sf_dir).select("user_id", "event_id", F.row_number().over(w).alias("i"))
    return n.where(F.expr("true")).withColumns({"lo": F.min(chosen).over(g), "hi": F.max(chosen).over(g)}).where("i between lo and hi").select("user_id", "event_id")
