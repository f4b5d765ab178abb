"""Read views: cards with everything shown beside a record, previews of ranges, and text for posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepstone.config import NO_TIME
from keepstone.operators.ranking import even_sample


def cards(records: DataFrame, people: DataFrame, tags: DataFrame, notes: DataFrame) -> DataFrame:
    """records plus members of their group, people and tags as text (null without any), and whether notes exist.

    Side tables are aggregated once and joined, one join each. people (sha256, person), tags (sha256, tag), notes (sha256).
    """
    joined = lambda df, c, out: df.groupBy("sha256").agg(F.array_join(F.array_sort(F.collect_set(c)), ", ").alias(out))
    members = records.groupBy("moment_id").agg(F.count("*").alias("members"), F.count_if(F.col("duplicate_of").isNull()).alias("alternates"))
    noted = notes.select("sha256", F.lit(True).alias("_n")).distinct()
    out = records.join(members, "moment_id").join(joined(people, "person", "people"), "sha256", "left")
    out = out.join(joined(tags, "tag", "tags"), "sha256", "left").join(noted, "sha256", "left")
    return out.withColumn("noted", F.coalesce("_n", F.lit(False))).drop("_n")


def card_filter(*kinds: str) -> Column:
    """Cards to show: best members, or those of any of the given kinds (favorite, private, close, person, nobody)."""
    tests = {
        "favorite": F.col("favorite"), "private": F.col("private"), "close": F.col("close_call"),
        "person": F.col("people").isNotNull(), "nobody": F.col("people").isNull(),
    }
    if not kinds:
        return F.col("is_best")
    out = tests[kinds[0]]
    for kind in kinds[1:]:
        out = out | tests[kind]
    return out


def range_preview(best: DataFrame, ranges: DataFrame, size: int = 8) -> tuple[DataFrame, DataFrame]:
    """(sample, counts) of best members inside each range: a sample spread evenly, and moments and days by range."""
    real = best.where(~F.col("date_source").isin(*NO_TIME)).withColumn("_d", F.to_date("taken_at"))
    days = ranges.select("slug", "start", "end", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))).alias("_d"))
    inside = real.join(days, "_d").where(F.col("taken_at").between(F.col("start"), F.col("end")))
    counts = inside.groupBy("slug").agg(F.count("*").alias("moments"), F.count_distinct("_d").alias("days"))
    return even_sample(inside, ["slug"], ["taken_at", "sha256"], size).select("slug", "sha256", "taken_at"), counts


def selected_range(records: DataFrame, chosen: DataFrame) -> DataFrame:
    """(start, end) of the chosen records that have a real time."""
    real = records.join(chosen.select("sha256").distinct(), "sha256", "left_semi").where(~F.col("date_source").isin(*NO_TIME))
    return real.agg(F.min("taken_at").alias("start"), F.max("taken_at").alias("end"))


def yaml_list(values: Column) -> Column:
    """["a", "b"] with quotes and backslashes escaped."""
    quoted = F.transform(values, lambda v: F.concat(F.lit('"'), F.regexp_replace(v, r'(["\\])', r"\\$1"), F.lit('"')))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def url_part(text: Column) -> Column:
    """A path segment of an address; blanks become %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def post_name(day: Column, slug: Column) -> Column:
    return F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), slug, F.lit(".md"))


def block_quote(text: Column) -> Column:
    """Each line as a quotation of its own."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    return F.array_join(F.transform(lines, lambda x: F.concat(F.when(x == "", ">  ").otherwise(F.concat(F.lit("> "), x, F.lit("  "))), F.lit("\n  "))), "\n")


def post_body(pictures: DataFrame, posts: DataFrame) -> DataFrame:
    """(post, body) of posts (post, top_text, bottom_text) with their pictures (post, position, name, alt, text_before)
    in order; what is blank is left out, blank lines stand between the parts."""
    said = lambda c: F.when(F.trim(c) != "", F.trim(c))
    picture = F.concat(F.lit("!["), F.coalesce(F.trim("alt"), F.lit("")), F.lit("]({{ site.pics_url }}"), "name", F.lit(".jpg)"))
    shown = pictures.select("post", F.struct("position", F.concat_ws("\n\n", said(F.col("text_before")), picture).alias("t")).alias("p"))
    middle = shown.groupBy("post").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the pictures of one post
    middle = middle.select("post", F.array_join(F.transform("ps", lambda p: p["t"]), "\n\n").alias("middle"))
    parts = [said(F.col("top_text")), F.col("middle"), said(F.col("bottom_text"))]
    return posts.join(middle, "post", "left").select("post", F.concat_ws("\n\n", *parts).alias("body"))


def post_head(title: Column, author: Column, categories: Column, tags: Column) -> Column:
    """The header of a post; categories and tags are arrays, and empty ones are left out."""
    quoted = F.concat(F.lit('title: "'), F.replace(F.trim(title), F.lit('"'), F.lit('\\"')), F.lit('"'))
    listed = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), yaml_list(c)))
    lines = [F.lit("---"), quoted, F.concat(F.lit("author: "), author), listed("categories", categories), listed("tags", tags), F.lit("---")]
    return F.concat_ws("\n", *lines)


def post_url(site: Column, file: Column, categories: Column) -> Column:
    """Address of a post by its file's name; the site's own for a name that isn't a post's."""
    part = lambda i: F.regexp_extract(file, r"^(\d{4})-(\d{2})-(\d{2})-(.+)\.md$", i)
    base = F.regexp_replace(site, "/+$", "")
    path = F.concat_ws("/", base, F.transform(categories, url_part), part(1), part(2), part(3), F.concat(part(4), F.lit(".html")))
    return F.when(part(4) != "", path).otherwise(site)


def human_size(size: Column) -> Column:
    """Bytes in the largest unit that leaves at least one, to one decimal from KB on."""
    out = F.format_string("%d B", size)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB"), (4, "TB")):
        out = F.when(size >= 1024**power, F.format_string(f"%.1f {unit}", size / 1024**power)).otherwise(out)
    return out


def shown_path(path: Column) -> Column:
    """A mounted drive path as that drive's own."""
    drive = F.regexp_extract(path, "^/mnt/([a-z])/", 1)
    rest = F.translate(F.regexp_replace(path, "^/mnt/[a-z]/", ""), "/", "\\")
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":\\"), rest)).otherwise(path)
