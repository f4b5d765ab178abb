"""Trees of files that executors write from whole tables, list, and read by ranges."""

from __future__ import annotations

import io
import struct
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.adapters import table
from keepstone.catalog import query
from keepstone.session import ship
from keepstone.sources import trees
from keepstone.sources.media import EPOCH_1904
from keepstone.sources.shared import shared_folder


def _tree(files: DataFrame, make: Callable[[int, str], bytes]) -> str:
    """A new folder with a file for each row (path, number, text)."""
    spark = files.sparkSession
    ship(spark)
    root = f"{shared_folder(spark)}/keepstone-tree-{uuid.uuid4().hex[:12]}"
    data = F.udf(lambda number, text: make(number, text or ""), "binary")  # fixtures only: what a camera would have written
    trees.write_files(files.select("path", data("number", "text").alias("data")), root)
    return root


def _documents(spark: SparkSession, sf_dir: str, ext: Column) -> DataFrame:
    path = F.concat("source", F.lit("/d"), (F.col("doc_id") % 13).cast("string"), F.lit("/f"), F.col("doc_id").cast("string"), ext)
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.col("doc_id").alias("number"), "text")


_NAME = "source || '/d' || CAST(doc_id % 13 AS VARCHAR) || '/f' || CAST(doc_id AS VARCHAR)"


@query(f"""
SELECT {_NAME} || '.txt' AS path, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE octet_length(encode(coalesce(text, ''))) END AS size, sha256(CASE WHEN doc_id % 9 = 0 THEN '' ELSE coalesce(text, '') END) AS sha256, true AS recent FROM documents
""")
def a_tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each document in folders of folders, some of them empty, with sizes, times and hashes."""
    root = _tree(_documents(spark, sf_dir, F.lit(".txt")), lambda n, t: b"" if n % 9 == 0 else t.encode())
    found = trees.with_hashes(trees.list_tree(spark, root), root)
    return found.select("path", "size", "sha256", (F.abs(F.unix_timestamp() - F.col("mtime")) < 86_400).alias("recent"))


def _movie(n: int, text: str) -> bytes:
    """A movie with its media data before the header (even ids), behind it, or without a header (every seventh)."""
    media = struct.pack(">I4s", 8 + len(text.encode()), b"mdat") + text.encode()
    if n % 7 == 0:
        return media
    wide = n % 3 == 0
    made = struct.pack(">IQQ" if wide else ">III", int(wide) << 24, 1_600_000_000 + EPOCH_1904 + n, 0)
    head = struct.pack(">I4s", 8 + len(made) + 8, b"mvhd") + made + bytes(8)
    moov = struct.pack(">I4s", 8 + 8 + len(head), b"moov") + struct.pack(">I4s", 8, b"free") + head
    ftyp = struct.pack(">I4s4s", 12, b"ftyp", b"isom")
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + len(text.encode())) + text.encode()
    return ftyp + (large + moov if n % 2 == 0 else moov + media)


@query(f"SELECT {_NAME} || '.mov' AS path, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE 1600000000 + doc_id END AS seconds FROM documents")
def a_movie_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(_documents(spark, sf_dir, F.lit(".mov")), _movie)
    return trees.container_times(trees.list_tree(spark, root), root)


def _package(n: int, text: str) -> bytes:
    if n % 5 == 0:
        return text.encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in (("a.jpg", text), ("b.JPG", text * 2), ("note.txt", text), ("content.xml", '<i name="a.jpg" label="flash"/>')):
            z.writestr(name, data)
    return out.getvalue()


@query(f"""
WITH d AS (SELECT {_NAME} || '.nar' AS path, coalesce(text, '') AS t FROM documents WHERE doc_id % 5 != 0)
SELECT path, 'a.jpg' AS member, 'flash' AS label, sha256(t) AS sha256, octet_length(encode(t)) AS size FROM d UNION ALL SELECT path, 'b.JPG', '', sha256(t || t), 2 * octet_length(encode(t)) FROM d
""")
def a_package_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images in packages, and files that only have a package's name."""
    root = _tree(_documents(spark, sf_dir, F.lit(".nar")), _package)
    return trees.package_index(trees.list_tree(spark, root), root)


def _picture(n: int, text: str) -> bytes:
    """A JPEG's header (little and big endian in turn) and its text as data; a PNG's; or no picture."""
    width, height = 100 + n % 50, 300 + n % 70
    if n % 8 == 0:
        return text.encode()
    if n % 8 == 1:
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", width, height) + text.encode()
    order = "<" if n % 2 else ">"
    model = f"Acme {n % 4}" if n % 3 else f"Mark {n % 4}"
    texts = [(0x010F, "Acme"), (0x0110, model), (0x9003, f"2024:01:{1 + n % 28:02d} 10:20:{n % 60:02d}"), (0x9011, "+02:00")]
    first, second = 8, 8 + 2 + 12 * 4 + 4
    places, blob = {}, b""
    for tag, t in texts:
        places[tag] = second + 2 + 12 * 2 + 4 + len(blob)
        blob += t.encode() + b"\0"
    entry = lambda tag, t: struct.pack(f"{order}HHII", tag, 2, len(t) + 1, places[tag])
    tiff = (b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, first) + struct.pack(f"{order}H", 4)
    tiff += entry(*texts[0]) + entry(*texts[1]) + struct.pack(f"{order}HHIHH", 0x0112, 3, 1, 1 + n % 8, 0) + struct.pack(f"{order}HHII", 0x8769, 4, 1, second)
    tiff += bytes(4) + struct.pack(f"{order}H", 2) + entry(*texts[2]) + entry(*texts[3]) + bytes(4) + blob
    exif = b"Exif\0\0" + tiff
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes(9)
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab\xff\xe1" + struct.pack(">H", 2 + len(exif)) + exif + b"\xff\xc0" + struct.pack(">H", 2 + len(frame)) + frame + text.encode()


@query(f"""
WITH d AS (SELECT {_NAME} || '.jpg' AS path, doc_id AS n, 100 + doc_id % 50 AS w, 300 + doc_id % 70 AS h, doc_id % 8 IN (4, 5, 6, 7) AS turned FROM documents)
SELECT path, CASE WHEN n % 8 > 0 THEN CASE WHEN turned THEN h ELSE w END END::INT AS width, CASE WHEN n % 8 > 0 THEN CASE WHEN turned THEN w ELSE h END END::INT AS height,
    CASE WHEN n % 8 > 1 THEN CASE WHEN n % 3 > 0 THEN 'Acme ' || CAST(n % 4 AS VARCHAR) ELSE 'Acme Mark ' || CAST(n % 4 AS VARCHAR) END END AS camera,
    CASE WHEN n % 8 > 1 THEN TIMESTAMP '2024-01-01 10:20:00' + to_days((n % 28)::INT) + to_seconds(n % 60) END AS taken_at, CASE WHEN n % 8 > 1 THEN '+02:00' END AS utc_offset FROM d
""")
def a_picture_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides, camera and time of pictures from the first bytes of each file."""
    root = _tree(_documents(spark, sf_dir, F.lit(".jpg")), _picture)
    return trees.picture_headers(trees.list_tree(spark, root), root, 2030)
