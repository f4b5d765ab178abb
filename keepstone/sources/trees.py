"""Trees of files, listed and read by executors: no path and no content passes the driver.

Folders are listed level by level, each folder by a task; headers, indexes and members are read by ranges, so a movie of
many GB costs a few reads of a few bytes. A root is a local path or any address that Arrow's file systems open.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import tomllib
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.functions.scalars import camera_name, header_time
from keepstone.session import ship, small_batches
from keepstone.sources.media import EPOCH_1904
from keepstone.sources.shared import stored

#: Bytes of a content that are held at a time, and of a picture in which its header has to begin and end.
PIECE, HEADER = 1 << 20, 1 << 18
#: Orientations of a header that swap width and height.
SWAPPED = (5, 6, 7, 8)


def file_system(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    scheme, found, rest = root.partition(":")
    if not found or scheme == "file":
        return pyarrow.fs.LocalFileSystem(), "/" + (rest if found else root).lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(root)


def _each(df: DataFrame, columns: list[str], read: Callable[[str], list[tuple]], schema: pa.Schema, keep: list[str] = ()) -> DataFrame:
    """Rows of ``read(path)`` for each path, behind the columns ``keep``; many tasks, as opening a file is what takes time."""
    ddl = ", ".join(f"{f.name} {_SQL[f.type]}" for f in schema)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, owner = [], []
                for i, path in enumerate(part.column("path").to_pylist()):
                    found = read(path)
                    rows += found
                    owner += [i] * len(found)
                made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)]
                yield pa.record_batch([*(part.column(c).take(pa.array(owner, pa.int64())) for c in keep), *made], names=[*keep, *schema.names])

    ship(df.sparkSession)
    return df.select(*dict.fromkeys([*columns, *keep])).mapInArrow(run, ", ".join(x for x in (kept, ddl) if x))


_SQL = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary"}


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all files below a root, empty ones as well, with paths relative to it; null if it isn't there.

    A level of folders is listed at a time and written, so a listing goes on where an executor was lost. One folder is
    one task, whatever it holds.
    """
    schema = pa.schema([("path", pa.string()), ("folder", pa.bool_()), ("size", pa.int64()), ("mtime", pa.float64())])

    def read(folder: str) -> list[tuple]:
        fs, top = file_system(root)
        chosen = pyarrow.fs.FileSelector(posixpath.join(top, folder) if folder else top, allow_not_found=True)
        out = []
        for info in fs.get_file_info(chosen):
            is_folder = info.type == pyarrow.fs.FileType.Directory
            when = None if info.mtime is None else info.mtime.timestamp()
            out.append((posixpath.join(folder, info.base_name), is_folder, None if is_folder else info.size, when))
        return out

    level = spark.createDataFrame([("",)], "path string")
    found = None
    while True:
        here = stored(_each(level.repartition("path"), ["path"], read, schema), "level")
        found = here if found is None else found.unionByName(here)
        level = here.where("folder").select("path")
        if level.isEmpty():
            return found.where("not folder").select("path", "size", "mtime")


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Write files (path, data) below a root by executors; (path, size). A file is written beside its place and moved, so
    a task that runs again replaces what it wrote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = file_system(root)
        made: set[str] = set()
        for batch in batches:
            sizes = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data").to_pylist(), strict=True):
                target = posixpath.join(top, path)
                folder = posixpath.dirname(target)
                if folder not in made:
                    fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with fs.open_output_stream(f"{target}.part") as out:
                    out.write(data)
                fs.move(f"{target}.part", target)
                sizes.append(len(data))
            yield pa.record_batch([batch.column("path"), pa.array(sizes, pa.int64())], names=["path", "size"])

    ship(files.sparkSession)
    small_batches(files.sparkSession, 256, 4 << 20)  # rows are whole files; a batch of Spark's own 10,000 rows is held at once
    return stored(files.select("path", "data").mapInArrow(run, "path string, size long"), "written")


def with_hashes(listing: DataFrame, root: str) -> DataFrame:
    """listing plus sha256 and error; contents pass in pieces. A file that can't be read is a row with its error."""

    def read(path: str) -> list[tuple]:
        fs, top = file_system(root)
        digest = hashlib.sha256()
        try:
            with fs.open_input_stream(posixpath.join(top, path)) as f:
                while piece := f.read(PIECE):
                    digest.update(piece)
        except OSError as e:
            return [(None, type(e).__name__)]
        return [(digest.hexdigest(), None)]

    return _each(listing, ["path"], read, pa.schema([("sha256", pa.string()), ("error", pa.string())]), listing.columns)


def _boxes(f, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, stop) of the boxes between two places of a movie, by their heads only."""
    while start + 8 <= stop:
        f.seek(start)
        head = f.read(16)
        if len(head) < 8:
            return
        size, kind = struct.unpack_from(">I4s", head)
        length = 8
        if size == 1 and len(head) == 16:
            size, length = struct.unpack_from(">Q", head, 8)[0], 16
        size = stop - start if size == 0 else size
        if size < length:
            return
        yield kind, start + length, min(start + size, stop)
        start += size


def movie_seconds(f, size: int, last_year: int = 2100) -> int | None:
    """Creation time of an MP4 or MOV in Unix seconds, or None if absent or implausible; media data is passed over."""
    for kind, start, stop in _boxes(f, 0, size):
        if kind != b"moov":
            continue
        for name, begin, end in _boxes(f, start, stop):
            if name == b"mvhd" and end - begin >= 12:
                f.seek(begin)
                body = f.read(12)
                made = struct.unpack_from(">Q" if body[0] == 1 else ">I", body, 4)[0] - EPOCH_1904
                year = 1970 + made / 31_556_952
                return made if 1990 <= year <= last_year + 1 else None
    return None


def _opened(root: str, path: str, use: Callable) -> object:
    """What ``use(file, size)`` says, or None if the file can't be read or understood."""
    fs, top = file_system(root)
    try:
        with fs.open_input_file(posixpath.join(top, path)) as f:
            return use(f, f.size())
    except (OSError, struct.error, ValueError, zipfile.BadZipFile, KeyError):
        return None


def container_times(listing: DataFrame, root: str, last_year: int = 2100) -> DataFrame:
    """(path, seconds): when movies were made, by their headers."""
    read = lambda p: [(_opened(root, p, lambda f, n: movie_seconds(f, n, last_year)),)]
    return _each(listing, ["path"], read, pa.schema([("seconds", pa.int64())]), ["path"])


def package_index(listing: DataFrame, root: str) -> DataFrame:
    """(path, member, label, sha256, size) of the images in ZIP packages, by their directory: a member is read in pieces,
    what else a package holds isn't. Labels come from its ``content.xml``. A file that is no package gives no row."""

    def members(f, _: int) -> list[tuple]:
        out = []
        with zipfile.ZipFile(f) as z:
            names = z.namelist()
            text = z.read("content.xml").decode("utf-8", "replace") if "content.xml" in names else ""
            labels = dict(re.findall(r'name="([^"]+)"[^>]*label="([^"]+)"', text))
            for name in sorted(names):
                if name.lower().endswith((".jpg", ".jpeg")):
                    digest = hashlib.sha256()
                    with z.open(name) as m:
                        while piece := m.read(PIECE):
                            digest.update(piece)
                    out.append((name, labels.get(name, ""), digest.hexdigest(), z.getinfo(name).file_size))
        return out

    schema = pa.schema([("member", pa.string()), ("label", pa.string()), ("sha256", pa.string()), ("size", pa.int64())])
    return _each(listing, ["path"], lambda p: _opened(root, p, members) or [], schema, ["path"])


def settings(listing: DataFrame, root: str) -> DataFrame:
    """(path, section, name, value) of TOML files, values as text; a file that can't be read as TOML gives no row."""

    def entries(f, size: int) -> list[tuple]:
        found = tomllib.loads(f.read(size).decode("utf-8"))
        out = []
        for section, inner in {"": {k: v for k, v in found.items() if not isinstance(v, dict)}, **{k: v for k, v in found.items() if isinstance(v, dict)}}.items():
            out += [(section, k, ",".join(map(str, v)) if isinstance(v, list) else str(v)) for k, v in inner.items()]
        return out

    schema = pa.schema([("section", pa.string()), ("name", pa.string()), ("value", pa.string())])
    return _each(listing, ["path"], lambda p: _opened(root, p, entries) or [], schema, ["path"])


#: Tags of a picture's header: make, model, orientation, time, the place of the second directory, original time, offset.
_MAKE, _MODEL, _ORIENTATION, _TIME, _SECOND, _ORIGINAL, _OFFSET = 0x010F, 0x0110, 0x0112, 0x0132, 0x8769, 0x9003, 0x9011


def _directory(tiff: bytes, order: str, at: int) -> dict[int, object]:
    """Tags of one directory of a TIFF header: texts and whole numbers."""
    found: dict[int, object] = {}
    (count,) = struct.unpack_from(f"{order}H", tiff, at)
    for i in range(count):
        tag, kind, n = struct.unpack_from(f"{order}HHI", tiff, at + 2 + 12 * i)
        value = at + 10 + 12 * i
        if kind == 2:  # text
            start = value if n <= 4 else struct.unpack_from(f"{order}I", tiff, value)[0]
            found[tag] = tiff[start : start + n].split(b"\0")[0].decode("utf-8", "replace").strip()
        elif kind in (3, 4):
            found[tag] = struct.unpack_from(f"{order}{'H' if kind == 3 else 'I'}", tiff, value)[0]
    return found


def picture_header(data: bytes) -> tuple | None:
    """(width, height, orientation, make, model, taken, offset) from the beginning of a JPEG or PNG, or None."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return (*struct.unpack_from(">II", data, 16), None, None, None, None, None)
    if data[:2] != b"\xff\xd8":
        return None
    at, size, tags = 2, None, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind, length = struct.unpack_from(">BH", data, at + 1)
        body = data[at + 4 : at + 2 + length]
        if kind == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
            if order:
                try:
                    tags = _directory(tiff, order, struct.unpack_from(f"{order}I", tiff, 4)[0])
                    if isinstance(tags.get(_SECOND), int):
                        tags = {**tags, **_directory(tiff, order, tags[_SECOND])}
                except struct.error:  # a header that is cut off tells what it has told so far
                    pass
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack_from(">HH", body, 1)
            size = (width, height)
            break
        at += 2 + length
    if size is None:
        return None
    return (*size, tags.get(_ORIENTATION), tags.get(_MAKE), tags.get(_MODEL), tags.get(_ORIGINAL) or tags.get(_TIME), tags.get(_OFFSET))


def picture_headers(listing: DataFrame, root: str, now_year: int) -> DataFrame:
    """(path, width, height, camera, taken_at, utc_offset) from headers, sides as an upright picture has them; a file
    that is no picture, or whose header is broken, has nulls."""
    fields = [("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), *((n, pa.string()) for n in ("make", "model", "taken", "utc_offset"))]
    nothing = (None,) * len(fields)
    read = lambda p: [_opened(root, p, lambda f, n: picture_header(f.read(min(n, HEADER)))) or nothing]
    told = _each(listing, ["path"], read, pa.schema(fields), ["path"])
    turned: Column = F.coalesce(F.col("orientation").isin(*SWAPPED), F.lit(False))
    return told.select(
        "path",
        F.when(turned, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(turned, F.col("width")).otherwise(F.col("height")).alias("height"),
        camera_name(F.col("make"), F.col("model")).alias("camera"),
        header_time(F.col("taken"), now_year).alias("taken_at"),
        "utc_offset",
    )
