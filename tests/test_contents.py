from __future__ import annotations

import os

from pyspark.sql import functions as F

from keepstone.streaming import contents
from keepstone.streaming.contents import ContentStore


def test_each_key_once_over_batches_and_growing_digits(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path), ["a", "b"], bucket_rows=10)
    df = spark.range(600).select((F.col("id") * 7 % 211).alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") * 7 % 211 % 3).cast("string")).alias("b"), "id")
    seen: set = set()
    for n in range(4):
        part = df.where(F.col("id") % 4 == n)
        got = [(r["a"], r["b"]) for r in store.add(part, n).collect()]
        expected = {(r["a"], r["b"]) for r in part.collect()} - seen
        assert len(got) == len(expected) and set(got) == expected
        seen |= expected
    assert {r["digits"] for r in spark.read.parquet(f"{tmp_path}/keys").select("digits").distinct().collect()} == {1, 2}
    again = {(r["a"], r["b"]) for r in store.add(df.where(F.col("id") % 4 == 1), 1).collect()}
    assert again and again <= seen and spark.read.parquet(f"{tmp_path}/keys").count() == len(seen)
    assert store.add(df.limit(0), 9).count() == 0


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    store = ContentStore(spark, str(tmp_path), ["sha256"], bucket_rows=16)
    rows = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    store.add(rows, 0)
    reads = []
    real = store._read
    store._read = lambda kind, digits, buckets: reads.append((kind, out := real(kind, digits, buckets))) or out
    new = spark.range(5000, 5005).select(F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
    assert store.seen(new).count() == 0 and store.seen(rows.limit(3)).count() == 3
    files = {kind: [len(df.inputFiles()) for k, df in reads if k == kind and df is not None] for kind in ("maps", "keys")}
    assert max(files["maps"]) <= 5 and max(files["keys"], default=0) <= 3 and len(os.listdir(tmp_path / "keys/digits=2")) >= 200


def test_a_large_batch_lists_once_and_writes_few_files_of_maps(spark, tmp_path, monkeypatch):
    """every bucket was looked up by name, had a file for its map, and one task wrote the files of all."""
    store = ContentStore(spark, str(tmp_path), ["id"], bucket_rows=16)
    rows = spark.range(3000)
    assert store.add(rows.where("id < 2500"), 0).count() == 2500
    looked = []
    real = contents.exists
    monkeypatch.setattr(contents, "exists", lambda s, p: looked.append(p) or real(s, p))
    assert sorted(r["id"] for r in store.add(rows.where("id >= 1000"), 1).collect()) == list(range(2500, 3000))
    assert len(looked) < 20
    maps = [f for _, _, files in os.walk(tmp_path / "maps/digits=2") for f in files if f.endswith(".parquet")]
    assert len(maps) <= 2 * 16
    tasks = {f.split("-")[1] for _, _, files in os.walk(tmp_path / "keys/digits=2") for f in files if f.startswith("part-")}
    assert len(tasks) > 1
