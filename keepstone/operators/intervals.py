"""Named, closed time ranges with one level of nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Microseconds of the smallest cell, and levels of cells (each twice as long as those below; the last is some 1,200 years).
_CELL, _LEVELS = 3_600_000_000, 24
#: Points in one cell above which they are dealt to several tasks, and the most tasks of a cell.
_CROWD, _MOST_SHARES = 1 << 20, 1 << 10


def _hour(time: str) -> Column:
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / _CELL).cast("long")


def _wide(level: Column) -> Column:
    """Hours of a cell."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level)


def cells(start: Column, end: Column) -> Column:
    """The dyadic cells (level, cell) that cover the hours ``start`` to ``end``: at most two on each level, whatever the
    length; none if the ends are swapped."""

    def on(level: Column) -> Column:
        wide = _wide(level)
        low, high = F.floor((start + wide - 1) / wide).cast("long"), F.floor((end + 1) / wide).cast("long")
        ends = F.array(F.when(low % 2 != 0, low), F.when(high % 2 != 0, high - 1))
        # The top level has no parent to hand cells to.
        inner = F.when(level < _LEVELS - 1, ends).otherwise(F.sequence(low, high - 1))
        return F.when(low < high, F.transform(F.filter(inner, lambda c: c.isNotNull()), lambda c: F.struct(level.alias("level"), c.alias("cell"))))

    each = F.transform(F.sequence(F.lit(0), F.lit(_LEVELS - 1)), on)
    return F.flatten(F.filter(each, lambda x: x.isNotNull()))


def containing(points: DataFrame, time: str, ranges: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Rows of ``points`` beside each row of ``ranges`` whose closed interval holds their time; no other column may be shared.

    A range is posted in O(log) cells of doubling length and a point asks its cell on each level that any range uses, so
    ranges of seconds and of decades cost alike. Cells with a crowd of points are split, and only their ranges repeated.
    """
    posted = ranges.withColumn("_c", F.explode(cells(_hour(start), _hour(end)))).select(*ranges.columns, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    levels = [r[0] for r in posted.select("_level").distinct().orderBy("_level").collect()]  # _LEVELS at most
    if not levels:
        return points.join(ranges, F.lit(False))
    ask = F.explode(F.transform(F.array(*[F.lit(x) for x in levels]), lambda x: F.struct(x.alias("level"), F.floor(F.col("_h") / _wide(x)).cast("long").alias("cell"))))
    asked = points.withColumn("_h", _hour(time)).withColumn("_c", ask).select(*points.columns, F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell"))
    # Points are counted by hour first; crowds are few, at most one for each _CROWD points and level.
    hours = points.select(_hour(time).alias("_h")).groupBy("_h").count().withColumn("_c", ask)
    crowds = hours.groupBy(F.col("_c.level").alias("_level"), F.col("_c.cell").alias("_cell")).agg(F.sum("count").alias("count")).where(F.col("count") > _CROWD)
    crowds = crowds.select("_level", "_cell", F.least(F.ceil(F.col("count") / _CROWD), F.lit(_MOST_SHARES)).cast("int").alias("_shares"))
    if crowds.isEmpty():
        met = asked.join(posted, ["_level", "_cell"])
    else:
        shares = F.coalesce("_shares", F.lit(1))
        left = asked.join(crowds, ["_level", "_cell"], "left").withColumn("_share", F.pmod(F.xxhash64(*points.columns), shares).cast("int")).drop("_shares")
        right = posted.join(crowds, ["_level", "_cell"], "left").withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("_shares")
        met = left.join(right, ["_level", "_cell", "_share"])
    return met.where(F.col(time).between(F.col(start), F.col(end))).select(*points.columns, *ranges.columns)


def most_specific(instants: DataFrame, time: str, ranges: DataFrame, key: str, out: str = "slug") -> DataFrame:
    """instants plus the slug of the most specific range that contains their time; a child wins over its parent.

    Of several children the first by start wins, of several top-level ranges the last. ``key`` tells instants apart.
    """
    r = ranges.select(F.col("slug").alias("_slug"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("parent").alias("_parent"))
    hits = containing(instants.select(F.col(key).alias("_key"), F.col(time).alias("_time")), "_time", r, "_start", "_end")
    child, order = F.col("_parent").isNotNull(), F.struct("_start", "_slug")
    best = hits.groupBy(F.col("_key").alias(key)).agg(F.coalesce(F.min_by("_slug", F.when(child, order)), F.max_by("_slug", F.when(~child, order))).alias(out))
    return instants.join(best, key, "left")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a_slug, b_slug, kind) of ranges of two relations that overlap: within, contains or overlaps.

    Of two ranges that overlap exactly one begins within the other (of two that begin together the first counts), so pairs
    are found once, by where ranges begin.
    """
    x = a.where("start <= end").select(F.col("slug").alias("a_slug"), F.col("start").alias("s1"), F.col("end").alias("e1"))
    y = b.where("start <= end").select(F.col("slug").alias("b_slug"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    meet = containing(x, "s1", y, "s2", "e2").unionByName(containing(y, "s2", x, "s1", "e1").where("s1 < s2"))
    kind = F.when(F.expr("s2 <= s1 and e1 <= e2"), "within").when(F.expr("s1 <= s2 and e2 <= e1"), "contains").otherwise("overlaps")
    return meet.select("a_slug", "b_slug", kind.alias("kind"))


def range_problems(ranges: DataFrame) -> DataFrame:
    """(slug, problem) of ranges that break the rules: swapped ends, overlap of siblings or of top-level ranges,
    a child outside its parent, a child of a child, a parent that isn't there."""
    swapped = ranges.where("end < start").select("slug", F.lit("swapped").alias("problem"))
    good = ranges.where("start <= end")
    level = lambda c: F.coalesce(F.col(f"{c}.parent"), F.lit(""))
    pairs = overlapping(good, good).where("a_slug < b_slug")
    a, b = ranges.select("slug", "parent").alias("a"), ranges.select("slug", "parent").alias("b")
    same = pairs.join(a, F.col("a_slug") == F.col("a.slug")).join(b, F.col("b_slug") == F.col("b.slug")).where(level("a") == level("b"))
    overlap = same.select(F.explode(F.array("a_slug", "b_slug")).alias("slug"), F.lit("overlap").alias("problem")).distinct()
    c, p = ranges.where("parent is not null").alias("c"), ranges.alias("p")
    placed = c.join(p, F.col("c.parent") == F.col("p.slug"), "left")
    problem = (
        F.when(F.col("p.slug").isNull(), "no parent")
        .when(F.col("p.parent").isNotNull(), "too deep")
        .when((F.col("c.start") < F.col("p.start")) | (F.col("c.end") > F.col("p.end")), "outside parent")
    )
    outside = placed.select(F.col("c.slug").alias("slug"), problem.alias("problem")).where("problem is not null")
    return swapped.unionByName(overlap).unionByName(outside)


def name_range(ranges: DataFrame, slug: str, start: str, end: str, parent: str | None = None) -> DataFrame:
    """ranges with one named or replaced; swapped ends are put in order; a rule broken raises an error."""
    start, end = min(start, end), max(start, end)
    spark = ranges.sparkSession
    row = spark.createDataFrame([(slug, parent)], "slug string, parent string").select(
        "slug", F.lit(start).cast("timestamp_ntz").alias("start"), F.lit(end).cast("timestamp_ntz").alias("end"), "parent"
    )
    made = ranges.where(F.col("slug") != slug).select("slug", "start", "end", "parent").unionByName(row)
    broken = range_problems(made).limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0]['slug']}: {broken[0]['problem']}")
    return made


def name_ranges(ranges: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ranges, refused): many ranges named or replaced at once, and the new ones (slug, problem) that break a rule.

    Swapped ends are put in order, and of new ranges with one name the least counts. A new range that breaks a rule
    beside the others, new ones among them, is refused; a range of its name stays as it was.
    """
    ordered = new.select("slug", F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), "parent")
    one = ordered.groupBy("slug").agg(F.min(F.struct("start", "end", "parent")).alias("x")).select("slug", "x.*")
    made = ranges.select(*one.columns).join(one.select("slug"), "slug", "left_anti").unionByName(one)
    refused = range_problems(made).join(one.select("slug"), "slug", "left_semi")
    good = one.join(refused.select("slug"), "slug", "left_anti")
    return ranges.select(*one.columns).join(good.select("slug"), "slug", "left_anti").unionByName(good), refused


def unname(ranges: DataFrame, slug: str) -> DataFrame:
    """Without a range and the ranges in it."""
    return ranges.where((F.col("slug") != slug) & (F.coalesce("parent", F.lit("")) != slug))


def later_siblings(ranges: DataFrame, most: int) -> DataFrame:
    """ranges plus ``later``: (slug, end) of the next ``most`` by start.

    Rows are ordered within their month; what a month needs of those after it are their first ``most`` rows, so no task
    orders the whole table. A month reaches past months without rows.
    """
    rows = ranges.withColumn("_m", F.date_trunc("month", "start"))
    months = Window.orderBy("_m")
    named = rows.select("_m").distinct().withColumn("_i", F.row_number().over(months))  # one row for each month
    rows = rows.join(F.broadcast(named), "_m").drop("_m")
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_i").orderBy("start", "slug"))).where(F.col("_r") <= most)
    ahead = first.select("slug", "start", "end", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("_k"), "_i").select("slug", "start", "end", (F.col("_i") - F.col("_k")).alias("_i"))
    both = rows.withColumn("_own", F.lit(True)).unionByName(ahead.where("_i > 0").withColumn("_own", F.lit(False)), allowMissingColumns=True)
    w = Window.partitionBy("_i").orderBy("start", "slug").rowsBetween(1, most)
    return both.withColumn("later", F.collect_list(F.struct("slug", "end")).over(w)).where("_own").drop("_i", "_own")


def later_within(found: DataFrame, ranges: DataFrame, most: int) -> DataFrame:
    """found (slug, start, end) plus ``later``: the slugs of the next ``most`` that end before the top-level range ends in
    which a row lies as a whole; without such a range, all of them. The first range by start counts."""
    top = ranges.where("parent is null").select(F.col("start").alias("_s"), F.col("end").alias("_e"))
    inside = containing(found.select("slug", "start", "end"), "start", top, "_s", "_e").where(F.col("end") <= F.col("_e"))
    until = inside.groupBy("slug").agg(F.min_by("_e", "_s").alias("_until"))
    rows = later_siblings(found, most).join(until, "slug", "left")
    kept = F.filter("later", lambda x: F.col("_until").isNull() | (x["end"] <= F.col("_until")))
    return rows.withColumn("later", F.transform(kept, lambda x: x["slug"])).drop("_until")
