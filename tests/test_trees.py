from __future__ import annotations

import io
import os
import struct

from keepstone.sources import media, trees


def test_listing_and_hashes(spark, tmp_path):
    for i in range(40):
        folder = tmp_path / f"a{i % 3}" / "b c" / f"d{i % 5}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"é {i}.txt").write_bytes(b"x" * i)
    (tmp_path / "empty folder").mkdir()
    (tmp_path / "top").write_bytes(b"")
    found = {r["path"]: (r["size"], r["sha256"], r["error"]) for r in trees.with_hashes(trees.list_tree(spark, f"file://{tmp_path}"), str(tmp_path)).collect()}
    assert len(found) == 41 and found["a0/b c/d0/é 0.txt"][0] == 0 and found["top"][1].startswith("e3b0c442")
    assert trees.list_tree(spark, str(tmp_path / "gone")).count() == 0
    listing = spark.createDataFrame([("top",), ("gone",)], "path string")
    assert {r["path"]: r["error"] for r in trees.with_hashes(listing, str(tmp_path)).collect()} == {"top": None, "gone": "FileNotFoundError"}


def test_written_files_replace_themselves(spark, tmp_path):
    files = spark.createDataFrame([(f"x/{i}", bytearray(b"a" * i)) for i in range(9)], "path string, data binary")
    for _ in range(2):
        assert trees.write_files(files, str(tmp_path)).count() == 9
    assert sorted(os.listdir(tmp_path / "x")) == [str(i) for i in range(9)] and (tmp_path / "x/7").read_bytes() == b"a" * 7


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes += len(out)
        return out


def test_a_movie_is_read_by_a_few_bytes():
    made = struct.pack(">III", 0, media.EPOCH_1904 + 1_600_000_000, 0)
    head = struct.pack(">I4s", 8 + len(made), b"mvhd") + made
    moov = struct.pack(">I4s", 8 + len(head), b"moov") + head
    large = struct.pack(">I4sQ", 1, b"mdat", 16 + 5_000_000) + bytes(5_000_000)
    for data in (moov + large, large + moov, struct.pack(">I4s", 12, b"ftyp") + b"isom" + large + moov):
        f = Counted(data)
        assert trees.movie_seconds(f, len(data)) == media.container_seconds(data) == 1_600_000_000 and f.bytes < 200
    for data in (b"", b"abc", large, moov[:20], struct.pack(">I4s", 3, b"moov"), bytes(40), struct.pack(">I4s", 0, b"moov") + head):
        assert trees.movie_seconds(io.BytesIO(data), len(data)) == media.container_seconds(data)


def test_broken_and_short_headers():
    tiff = b"II" + struct.pack("<HI", 42, 8) + struct.pack("<H", 2) + struct.pack("<HHI4s", 0x0110, 2, 3, b"M2\0\0") + struct.pack("<HHIHH", 0x0112, 3, 1, 6, 0)
    frame = b"\xff\xc0" + struct.pack(">HBHHB", 8, 8, 20, 10, 3)
    picture = lambda exif: b"\xff\xd8\xff\xe1" + struct.pack(">H", 8 + len(exif)) + b"Exif\0\0" + exif + frame
    assert trees.picture_header(picture(tiff)) == (10, 20, 6, None, "M2", None, None)
    assert trees.picture_header(picture(tiff[:20]))[:2] == (10, 20) and trees.picture_header(picture(b"XX"))[2] is None
    assert trees.picture_header(b"") is None and trees.picture_header(b"\xff\xd8\xff\xe1") is None and trees.picture_header(picture(tiff)[:30]) is None


def test_a_file_that_is_nothing_has_nulls(spark, tmp_path):
    for name, data in (("a.jpg", b""), ("b.jpg", b"\xff\xd8\xff"), ("c.jpg", b"\x89PNG\r\n\x1a\n")):
        (tmp_path / name).write_bytes(data)
    listing = trees.list_tree(spark, str(tmp_path))
    rows = trees.picture_headers(listing, str(tmp_path), 2030).collect()
    assert len(rows) == 3 and all(r[1:] == (None,) * 5 for r in rows)
    assert [r["seconds"] for r in trees.container_times(listing, str(tmp_path)).collect()] == [None] * 3
    assert trees.package_index(listing, str(tmp_path)).count() == 0


def test_files_are_written_in_small_batches(spark, tmp_path):
    """10,000 whole files were one batch of a task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        trees.write_files(spark.createDataFrame([("a/b", b"x")], "path string, data binary"), str(tmp_path))
        assert 0 < int(spark.conf.get(key)) <= 256
    finally:
        spark.conf.set(key, before)
