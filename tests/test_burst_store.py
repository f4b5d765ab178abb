from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from keepstone.config import Curation
from keepstone.operators import bursts, derive
from keepstone.streaming import burst_store

SCHEMA = "sha256 string, taken_at timestamp_ntz, date_source string, camera string, phash string, name string, ext string, width int, height int, sharpness double, exposure double, faces int, face_sharpness double, user_best boolean, favorite boolean, size long"


def _rows(n, seed):
    import datetime as dt

    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.choice([rng.randrange(3 * 86400), 86400 + rng.randrange(-200, 200), 40_000 + rng.randrange(900)]))
        sha = f"{rng.randrange(16**8):08x}{i:04x}"
        out.append((sha, at, rng.choice(["exif", "exif", "exif", "user", "mtime"]), rng.choice(["a", "b", None]), f"{rng.choice([0, 1, 3, 255 << 40]):016x}",
            f"n{i}", ".jpg", 100 + i % 3, 100, float(i % 7), 0.5, i % 2, 0.1, i % 19 == 0, i % 11 == 0, None))
    return out


def _pairs(df):
    return {r["sha256"]: r["moment_id"] for r in df.select("sha256", "moment_id").collect()}


@pytest.fixture(scope="module")
def applied(spark, tmp_path_factory):
    """A store after three batches with late rows and deletions, all its records, and what the last batch changed."""
    rows = _rows(360, 3)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    part = F.pmod(F.crc32(F.col("sha256").cast("binary")), F.lit(9))
    store = burst_store.BurstStore(spark, str(tmp_path_factory.mktemp("bursts")), 60, 6)
    store.apply(df.where(part < 6))
    store.apply(df.where(part == 6), df.where(part == 0))
    before = _pairs(store.groups())
    changed = store.apply(df.where(part >= 7), df.where(part == 1))
    return store, df.where(part > 1), before, changed


def test_batches_equal_a_full_run(spark, applied):
    store, left, before, changed = applied
    full = _pairs(bursts.bursts(left, 60, 6))
    assert _pairs(store.groups()) == full
    told = {r["sha256"]: (r["before"], r["moment_id"]) for r in changed.collect()}
    for sha in set(before) | set(full):
        if before.get(sha) != full.get(sha):
            assert told[sha] == (before.get(sha), full.get(sha))
    assert all(v == (before.get(k), full.get(k)) for k, v in told.items())


def test_a_batch_reads_what_it_touches(spark, tmp_path):
    import datetime as dt

    rows = [(f"{i:04x}", dt.datetime(2024, 1, 1) + dt.timedelta(days=i), "exif", "a", "0" * 16) for i in range(60)]
    schema = "sha256 string, taken_at timestamp_ntz, date_source string, camera string, phash string"
    store = burst_store.BurstStore(spark, str(tmp_path), 600, 6)
    store.apply(spark.createDataFrame(rows, schema).coalesce(1))
    late = [("ffff", dt.datetime(2024, 1, 11, 0, 5), "exif", "a", "0" * 16), ("fffe", dt.datetime(2024, 1, 11, 0, 12), "exif", "a", "0" * 16)]
    hit = store._hit(store._timed(spark.createDataFrame(late, schema)))
    assert [r["island"] for r in hit.collect()] == ["000a"]
    read = store._table("rows", "cell", hit.select(F.col("home").alias("cell")))
    assert len(read.inputFiles()) == 1 and read.count() == 1
    changed = store.apply(spark.createDataFrame(late, schema)).collect()
    assert {(r["sha256"], r["before"], r["moment_id"]) for r in changed} == {("000a", "000a", "000a"), ("ffff", None, "000a"), ("fffe", None, "000a")}


def test_a_batch_that_stopped_is_not_read(spark, tmp_path):
    rows = _rows(40, 5)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    store = burst_store.BurstStore(spark, str(tmp_path), 60, 6)
    store.apply(df.limit(20))
    real = store._append
    store._append = lambda d, name, folder: real(d, name, folder) if name == "rows" else (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError, match="lost"):
        store.apply(df)
    store._append = real
    store.apply(df)
    assert _pairs(store.groups()) == _pairs(bursts.bursts(df, 60, 6))


def test_scoped_chain_equals_a_full_run(spark, applied):
    """Copies, scores, best members and paths after late rows, deletions and manual groups."""
    store, left, _, changed = applied
    cfg, ranges = Curation(), spark.createDataFrame([("trip", "2024-01-01 05:00:00", "2024-01-02 20:00:00", None)], "slug string, s string, e string, parent string")
    ranges = ranges.select("slug", F.col("s").cast("timestamp_ntz").alias("start"), F.col("e").cast("timestamp_ntz").alias("end"), "parent")
    groups = bursts.bursts(left, 60, 6)
    shas = sorted(_pairs(groups))
    overrides = spark.createDataFrame([(shas[3], shas[90]), (shas[4], "by-hand"), (shas[120], "by-hand"), (shas[50], shas[50])], "sha256 string, moment_id string")
    edited = spark.createDataFrame([(shas[3], None), (shas[50], None)], "sha256 string, before string")
    full = derive.refresh(left.join(bursts.apply_overrides(groups, overrides), "sha256"), ranges, cfg)
    expected = {r["sha256"]: tuple(r) for r in full.collect()}
    rows, touched = burst_store.members(store, changed, overrides, edited)
    scoped = derive.refresh(rows.select(*left.columns, "moment_id"), ranges, cfg, touched)
    got = {r["sha256"]: tuple(r) for r in scoped.collect()}
    ids = {r["moment_id"] for r in touched.collect()}
    assert got == {k: v for k, v in expected.items() if v[1] in ids}
    assert {shas[3], shas[50]} <= set(got) and 0 < len(got) < len(expected)


def test_a_folder_of_many_rows_is_many_tasks(spark, tmp_path):
    """an island lies under its first day, so one task sorted and wrote nearly all rows."""
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "65536")
    try:
        store = burst_store.BurstStore(spark, str(tmp_path), 60, 6)
        df = spark.range(0, 40_000, 1, 4).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"), F.lit("d1").alias("cell"))
        store._append(df, "rows", "cell")
    finally:
        spark.conf.set(key, before)
    read = store._table("rows", "cell", None)
    assert len(read.inputFiles()) > 1 and read.count() == 40_000


def test_only_groups_that_changed_are_touched(spark, tmp_path):
    """F2 (r04): every group of an island that was folded again was derived again, though most stayed as they were."""
    import datetime as dt

    schema = "sha256 string, taken_at timestamp_ntz, date_source string, camera string, phash string, sharpness double"
    row = lambda i, m, bits, sharp=1.0: (f"{i:04x}", dt.datetime(2024, 1, 1, 8, m), "exif", "a", f"{bits:016x}", sharp)
    far = [0, 2**30 - 1, 2**60 - 2**30, 2**62 - 2**15]
    store = burst_store.BurstStore(spark, str(tmp_path), 600, 6)
    store.apply(spark.createDataFrame([row(i, i, far[i // 2 % 4]) for i in range(16)], schema).coalesce(1))
    late = spark.createDataFrame([row(99, 3, far[1]), row(8, 8, far[0], 5.0)], schema).coalesce(1)
    gone = spark.createDataFrame([row(14, 14, far[3])], schema).coalesce(1)
    changed = store.apply(late, gone)
    told = {r["sha256"]: (r["before"], r["moment_id"], r["given"]) for r in changed.collect()}
    assert len(told) == 17 and told["0008"] == ("0008", "0008", True) and told["0000"] == ("0000", "0000", False)
    none = spark.createDataFrame([], "sha256 string, moment_id string")
    rows, touched = burst_store.members(store, changed, none, none.withColumnRenamed("moment_id", "before"))
    # A row came to 0002, 0008 was given with another sharpness, and 000e went from its group, which is now that of 000f.
    assert {r["moment_id"] for r in touched.collect()} == {"0002", "0008", "000e", "000f"}
    got = {(r["sha256"], r["moment_id"], r["sharpness"]) for r in rows.collect()}
    assert got == {("0002", "0002", 1.0), ("0003", "0002", 1.0), ("0063", "0002", 1.0), ("0008", "0008", 5.0), ("0009", "0008", 1.0), ("000f", "000f", 1.0)}


def test_a_row_that_moved_and_came_back_counts_once(spark, tmp_path):
    """Islands that several batches told of, and one that went and came again, in groups and in what is located."""
    rows = _rows(60, 8)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    part = F.pmod(F.crc32(F.col("sha256").cast("binary")), F.lit(3))
    store = burst_store.BurstStore(spark, str(tmp_path), 60, 6)
    store.apply(df)
    store.apply(df.where("false"), df.where(part == 0))
    store.apply(df.where(part == 0))
    store.apply(df.where(part == 1), df.where(part == 2))
    full = _pairs(bursts.bursts(df.where(part != 2), 60, 6))
    assert store.groups().count() == len(full) and _pairs(store.groups()) == full
    found = store.located(df.where(part == 0).select("sha256"))
    assert found.count() == len(_pairs(found)) and _pairs(found).items() <= full.items()
