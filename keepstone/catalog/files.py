"""File sources: a few small files, written from the driver's tables, are listed, read and decoded again."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import table
from keepstone.catalog import query
from keepstone.sources import files, media, trees
from keepstone.sources.shared import shared_folder


def _written(spark: SparkSession, found: dict[str, bytes]) -> str:
    """A new folder in the shared one with the given files, written by executors."""
    root = f"{shared_folder(spark)}/files-{uuid.uuid4().hex[:12]}"
    rows = spark.createDataFrame([(name, bytearray(data)) for name, data in found.items()], "path string, data binary")
    trees.write_files(rows, root)
    return root.removeprefix("file://").removeprefix("file:")


def _nations(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    return [(r["n_name"], r["n_regionkey"]) for r in table(spark, sf_dir, "nation").collect()]  # 25 rows


@query("""
SELECT 0 AS root, 'r' || CAST(n_regionkey AS VARCHAR) || '/' || replace(n_name, ' ', '_') || '.jpg' AS path, 'r' || CAST(n_regionkey AS VARCHAR) || '/' || replace(n_name, ' ', '_') || '.jpg' AS key, length(n_name) AS size, sha256(n_name) AS sha256 FROM nation
UNION ALL SELECT 1, 'x/' || replace(r_name, ' ', '_') || '.txt', '_inbox_1/x/' || replace(r_name, ' ', '_') || '.txt', 0, 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855' FROM region
""")
def a_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two roots with files, of which one has empty files only, and a third that isn't there."""
    a = _written(spark, {f"r{k}/{n.replace(' ', '_')}.jpg": n.encode() for n, k in _nations(spark, sf_dir)})
    b = _written(spark, {f"x/{r['r_name'].replace(' ', '_')}.txt": b"" for r in table(spark, sf_dir, "region").collect()})
    return files.list_roots(spark, [a, b, f"{a}-gone"], with_content_hash=True).select("root", "path", "key", "size", "sha256")


@query("SELECT 'r' || CAST(n_regionkey AS VARCHAR) || '/' || replace(n_name, ' ', '_') || '.jpg' AS path FROM nation WHERE n_regionkey != 2")
def a_library_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = {f"{'.state' if k == 2 else f'r{k}'}/{n.replace(' ', '_')}.jpg": b"x" for n, k in _nations(spark, sf_dir)}
    root = _written(spark, found | {"r0/Thumbs.db": b"x", "desktop.ini": b"x"})
    return files.library_files(files.list_root(spark, root), ".state").select("path")


@query("""
SELECT 'author' AS field, 'me' AS value, count(*) AS posts FROM nation UNION ALL SELECT 'tags', 'r' || CAST(n_regionkey AS VARCHAR), count(*) FROM nation GROUP BY n_regionkey UNION ALL SELECT 'tags', 'all', count(*) FROM nation
""")
def a_front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = {f"{n.replace(' ', '_')}.md": f"---\ntitle: {n}\nauthor: me\ntags: [r{k}, all]\n---\ntags: [none]\n".encode() for n, k in _nations(spark, sf_dir)}
    return files.front_matter(spark, _written(spark, posts))


@query("SELECT 'gap_seconds' AS name, '10' AS value UNION ALL SELECT 'roots', 'a,b'")
def a_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    import os
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".toml", delete=False) as f:  # the driver's own file, as settings are
        f.write('gap_seconds = 10\nroots = ["a", "b"]\n')
    found = files.load_settings(f.name)
    os.unlink(f.name)
    return spark.createDataFrame([(k, ",".join(v) if isinstance(v, list) else str(v)) for k, v in found.items()], "name string, value string")


@query("""
SELECT n_name AS package_sha, 'a.jpg' AS member, 'flash' AS label, sha256(n_name) AS sha256, length(n_name) AS size FROM nation UNION ALL SELECT n_name, 'b.JPG', '', sha256(n_name || n_name), 2 * length(n_name) FROM nation
""")
def a_package_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in packages, and a package that can't be read."""

    def packed(name: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for member, text in (("a.jpg", name), ("b.JPG", name * 2), ("note.txt", "x"), ("content.xml", '<i name="a.jpg" label="flash"/>')):
                z.writestr(member, text)
        return out.getvalue()

    rows = [(n, bytearray(packed(n))) for n, _ in _nations(spark, sf_dir)] + [("broken", bytearray(b"PK no"))]
    return media.explode_packages(spark.createDataFrame(rows, "package_sha string, content binary"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 != 0 THEN 1600000000 + p_partkey * 1000 ELSE -1 END AS seconds FROM part")
def a_container_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Creation times out of movie headers, of 32 bits or, where those don't hold a time, of 64; a file without one has none."""
    made = F.lit(1_600_000_000 + media.EPOCH_1904) + F.col("p_partkey") * 1000
    short = F.concat(F.lit("0000001C6D6F6F76000000146D76686400000000"), F.lpad(F.hex(made), 8, "0"), F.lit("00000000"))
    long = F.concat(F.lit("000000246D6F6F760000001C6D76686401000000"), F.lpad(F.hex(made), 16, "0"), F.lit("0000000000000000"))
    header = F.when(made < 1 << 32, short).otherwise(long)
    content = F.unhex(F.when(F.col("p_partkey") % 4 == 0, F.lit("0000000866726565")).otherwise(header))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(media.container_time(content), F.lit(-1)).alias("seconds"))


def _png(width: int, height: int, gray: int) -> bytes:
    """A picture of one gray value."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = (b"\0" + bytes([gray]) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@query("""
SELECT replace(n_name, ' ', '_') || '.png' AS name, CASE WHEN n_nationkey % 6 != 0 THEN 20 + n_nationkey ELSE -1 END AS width, CASE WHEN n_nationkey % 6 != 0 THEN 16 ELSE -1 END AS height,
    CASE WHEN n_nationkey % 6 != 0 THEN round(1 - abs((50 + n_nationkey) / 255.0::DOUBLE - 0.46::DOUBLE), 9) ELSE -1 END AS exposure, n_nationkey % 6 = 0 AS broken FROM nation
""")
def a_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded pictures; one that can't be decoded is a row with an error."""
    from keepstone.sources.images import image_features

    rows = table(spark, sf_dir, "nation").select("n_name", "n_nationkey").collect()  # 25 rows
    found = {f"{n.replace(' ', '_')}.png": _png(20 + k, 16, 50 + k) if k % 6 else b"not a picture" for n, k in rows}
    out = image_features(spark, _written(spark, found))
    none = lambda c: F.coalesce(F.col(c), F.lit(-1))
    return out.select(
        F.substring_index("path", "/", -1).alias("name"), none("width").alias("width"), none("height").alias("height"), F.coalesce(F.round("exposure", 9), F.lit(-1.0)).alias("exposure"), F.col("error").isNotNull().alias("broken")
    )


@query("""
WITH v AS (SELECT p_partkey, p_size * 5 AS a, 255 - p_size * 5 AS b, p_partkey % 2 = 0 AS flat FROM part),
m AS (SELECT *, (CASE WHEN a <= 4 OR a >= 251 THEN 0.5::DOUBLE ELSE 0 END) + CASE WHEN (CASE WHEN flat THEN a ELSE b END) <= 4 OR (CASE WHEN flat THEN a ELSE b END) >= 251 THEN 0.5::DOUBLE ELSE 0 END AS clipped, (a + CASE WHEN flat THEN a ELSE b END) / 2.0::DOUBLE AS mean FROM v)
SELECT p_partkey, round(greatest(0, least(1, 1 - 2 * clipped - abs(mean / 255 - 0.46::DOUBLE))), 9) AS exposure, CASE WHEN flat THEN 0 ELSE 16.0 * (a - b) * (a - b) END::DOUBLE AS sharpness FROM m
""")
def a_pixel_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of pictures of one gray value, and of chessboards of two."""
    a, b = F.col("p_size") * 5, 255 - F.col("p_size") * 5
    text = lambda c: F.lpad(F.hex(c), 2, "0")
    other = F.when(F.col("p_partkey") % 2 == 0, a).otherwise(b)
    rows = F.concat(F.repeat(F.concat(text(a), text(other)), 4), F.repeat(F.concat(text(other), text(a)), 4))
    # Numbers take little room beside the pictures made of them, so they are dealt out by a stated number of tasks.
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    pictures = parts.select("p_partkey", F.unhex(F.repeat(rows, 4)).alias("pixels"))
    found = pictures.withColumn("f", media.gray_features(F.lit(8), F.lit(8), F.col("pixels")))
    return found.select("p_partkey", F.round("f.exposure", 9).alias("exposure"), F.round("f.sharpness", 6).alias("sharpness"))
