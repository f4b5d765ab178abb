"""File sources: recursive listings of one or more roots with stable keys, content hashes and text front matter."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.config import EMPTY_SHA256
from keepstone.functions.scalars import file_kind, root_key
from keepstone.sources import trees

ROOT_PREFIX = "_inbox_"


def list_root(spark: SparkSession, root: str, with_content_hash: bool = False) -> DataFrame:
    """(path, size, mtime[, sha256]) of all files below a root; contents are only read for the hash.

    Executors list and read the tree; a store that only Spark's readers can open goes through those.
    """
    try:
        trees.file_system(root)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _listed_by_spark(spark, root, with_content_hash)
    found = trees.list_tree(spark, root)
    return trees.with_hashes(found, root).drop("error") if with_content_hash else found


def _listed_by_spark(spark: SparkSession, root: str, with_content_hash: bool) -> DataFrame:
    """The same by Spark's file scan. It leaves empty files out of its rows but knows their paths; they come back with
    size 0 and no time."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"

    def relative(path: Column) -> Column:
        plain = F.regexp_replace(path, "^file:/+", "/")
        return F.when(plain.startswith(base), F.substring(plain, len(base) + 1, 1 << 30)).otherwise(plain)

    out = [relative(F.col("path")).alias("path"), F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000).alias("mtime")]
    if with_content_hash:
        out.append(F.sha2("content", 256).alias("sha256"))
    found = files.select(*out)
    known = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(relative(F.col("path")).alias("path"))
    empty = known.join(found.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("size"), F.lit(None).cast("double").alias("mtime"))
    if with_content_hash:
        empty = empty.withColumn("sha256", F.lit(EMPTY_SHA256))
    return found.unionByName(empty)


def _exists(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def list_roots(spark: SparkSession, roots: list[str], with_content_hash: bool = False) -> DataFrame:
    """Listings of all roots that are there, keyed by root number; a missing root is skipped, numbers stay."""
    found = None
    for i, root in enumerate(roots):
        if not _exists(spark, root):
            continue
        part = list_root(spark, root, with_content_hash).withColumn("key", root_key(F.lit(i), F.col("path"), ROOT_PREFIX)).withColumn("root", F.lit(i))
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise FileNotFoundError("none of the roots is there: " + ", ".join(roots))
    return found


def missing_roots(spark: SparkSession, roots: list[str]) -> list[str]:
    return [r for r in roots if not _exists(spark, r)]


def front_matter(spark: SparkSession, folder: str) -> DataFrame:
    """(field, value, posts) over the front matter of text files: lines ``key: [a, b]`` or ``key: a`` before ``---``."""
    texts = spark.read.text(folder, wholetext=True)
    head = F.regexp_extract("value", r"(?s)^---\n(.*?)\n---", 1)
    lines = texts.select(F.explode(F.split(head, "\n")).alias("line"))
    pairs = lines.select(F.regexp_extract("line", r"^(\w+):", 1).alias("field"), F.regexp_extract("line", r"^\w+:\s*\[?(.*?)\]?\s*$", 1).alias("all"))
    values = pairs.where(F.col("field").isin("author", "categories", "tags")).select("field", F.explode(F.split("all", r"\s*,\s*")).alias("value"))
    return values.where("value != ''").groupBy("field", "value").agg(F.count("*").alias("posts"))


def load_settings(path: str) -> dict:
    import tomllib

    with open(path, "rb") as f:
        return tomllib.load(f)


def library_files(listing: DataFrame, state: str) -> DataFrame:
    """Files of a library's tree without its own state folder and without what systems leave behind."""
    return listing.where(~F.col("path").startswith(f"{state}/") & (file_kind(F.col("path")) != "junk"))
