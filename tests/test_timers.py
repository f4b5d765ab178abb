from __future__ import annotations

import datetime as dt
import random

from keepstone.session import ship
from keepstone.streaming import timers

BASE = dt.datetime(2024, 1, 1)


def expected(rows, quiet):
    """Runs of changes by key that are over when the latest change is seen."""
    out, end = [], max(t for _, t, _ in rows)
    for key in {k for k, _, _ in rows}:
        runs = []
        for _, t, v in sorted(r for r in rows if r[0] == key):
            if runs and t - runs[-1][1] <= quiet:
                runs[-1] = (runs[-1][0], t, runs[-1][2] + 1, v)
            else:
                runs.append((t, t, 1, v))
        out += [(key, *r[1:]) for r in runs if r[1] + quiet < end]
    return sorted(out)


def test_batches_and_restarts_give_the_runs_of_all_changes(spark, tmp_path):
    ship(spark)
    rng = random.Random(4)
    rows = sorted({(rng.choice("abc"), rng.randrange(4000), 0) for _ in range(120)}, key=lambda r: r[1])
    rows = [(k, t, i) for i, (k, t, _) in enumerate(rows)]
    schema = "path string, mtime timestamp, size long"
    for a in range(0, len(rows), 45):
        part = [(k, BASE + dt.timedelta(seconds=t), v) for k, t, v in rows[a : a + 45]]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        timers.run_quiet(timers.settled_files(stream, 60), f"{tmp_path}/out", f"{tmp_path}/log")
        seen = rows[: a + 45]
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        assert sorted((r["path"], int((r["mtime"] - BASE).total_seconds()), r["changes"], r["size"]) for r in got) == expected(seen, 60)


def test_rows_out_of_order_wait_for_the_watermark(spark, tmp_path):
    ship(spark)
    schema = "target string, at timestamp, version long"
    for part in ([("m", 100, 1), ("m", 400, 2)], [("m", 150, 3), ("m", 395, 4)], [("m", 5000, 5)]):
        df = spark.createDataFrame([(k, BASE + dt.timedelta(seconds=t), v) for k, t, v in part], schema)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        timers.run_quiet(timers.debounced_writes(stream, "target", "at", "version", 60, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/log")
    got = sorted((int((r["due"] - BASE).total_seconds()), r["version"], r["changes"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(210, 3, 2), (460, 2, 2)]
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "default").endswith(("default", "HDFSBackedStateStoreProvider"))
