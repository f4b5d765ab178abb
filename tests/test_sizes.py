"""Queries on tables whose keys, groups or rows are larger than the given ones."""

from __future__ import annotations

import numpy as np

import __spark_entry__  # noqa: F401  (loads the catalog)
from keepstone import catalog
from keepstone.sources import media
from tests.conftest import DATA, oracle


def _with(duck, tmp_path, name: str, sql: str) -> str:
    """A folder that has one table, made by SQL over the given ones."""
    duck.sql(f"copy ({sql}) to '{tmp_path}/{name}.parquet'")
    return str(tmp_path)


def test_container_times_beyond_32_bits(spark, tmp_path):
    """seconds since 1904 pass 32 bits at part 612,123."""
    c = oracle("sf0.001")
    folder = _with(c, tmp_path, "part", "select p_partkey + 612000 as p_partkey from part limit 200")
    found = {r["p_partkey"]: r["seconds"] for r in catalog.QUERIES["a_container_times"](spark, folder).collect()}
    assert found == {k: 1_600_000_000 + k * 1000 if k % 4 else -1 for k in found} and len(found) == 200


def test_pixel_measures_are_many_tasks(spark):
    """one small file of parts was one task."""
    assert catalog.QUERIES["a_pixel_measures"](spark, f"{DATA}/sf0.001").rdd.getNumPartitions() > 1


def test_picture_hash_is_of_plain_means():
    rng = np.random.default_rng(3)
    basis = np.cos(np.pi * (2 * np.arange(32)[None, :] + 1) * np.arange(32)[:, None] / 64)
    for h, w in ((8, 8), (31, 70), (64, 33)):
        g = rng.integers(0, 256, (h, w), dtype=np.uint8)
        parts = [[g[np.ix_(r, c)] for c in np.array_split(np.arange(w), 32)] for r in np.array_split(np.arange(h), 32)]
        low = (basis @ np.asarray([[x.mean() if x.size else 0 for x in row] for row in parts]) @ basis.T)[:8, :8]
        bits = "".join("1" if x else "0" for x in (low > np.median(low)).ravel())
        assert media.picture_hash(g) == f"{int(bits, 2):016x}"


def _shots(rows: list[tuple], spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "sha256 string, moment_id string, at double, phash string, exposure double, width int, height int, sharpness double")
    return df.withColumns({"taken_at": F.timestamp_seconds(F.col("at") + 1_700_000_000).cast("timestamp_ntz"), "date_source": F.lit("exif"), "size": F.lit(None).cast("long"), "camera": F.lit("c")}).drop("at")


def test_copies_are_linked_by_nodes_not_by_pairs(spark, monkeypatch):
    """400 rows that are all alike but for a little sharpness and time were 79,800 links."""
    from keepstone.config import Curation
    from keepstone.operators import copies

    found = []
    plain = copies.connected_components
    monkeypatch.setattr(copies, "connected_components", lambda links, *a: (found.append(links.count()), plain(links, *a))[1])
    rows = [(f"s{i:03d}", "m", i * 0.1, "00000000000000ff", 0.5 + i % 5 * 0.005, 40, 30, 50.0 + i * 0.01) for i in range(400)]
    out = copies.mark_copies(_shots(rows, spark), Curation(copy_gap_seconds=60)).collect()
    assert found[0] < 100 and len(out) == 400
    assert {r["duplicate_of"] for r in out} == {None, "s399"}


def test_copies_equal_those_of_all_pairs(spark):
    """Random rows around every threshold, with sharpness that can't be compared, against all pairs of a group."""
    from keepstone.config import Curation
    from keepstone.operators import copies
    from keepstone.operators.graph import connected_components

    rng = np.random.default_rng(5)
    hashes = ["0000000000000000", "0000000000000003", "8000000000000001", "f000000000000000", "00000000000000ff"]
    sharp = [None, 0.0, -1.0, float("nan"), float("inf")]
    rows = []
    for i in range(1500):
        size = [(40, 30), (20, 15), (30, 40), (41, 31), (10, 0)][rng.integers(5)]
        value = sharp[rng.integers(5)] if rng.random() < 0.1 else float(np.round(np.exp(rng.normal(0, 1)), 2))
        exposed = None if rng.random() < 0.02 else float(np.round(rng.random(), 2))
        rows.append((f"s{i:04d}", f"m{rng.integers(6)}", float(rng.integers(0, 400)), hashes[rng.integers(5)], exposed, *size, value))
    df, cfg = _shots(rows, spark), Curation(copy_gap_seconds=20)
    safe = df.where("height > 0")  # the test of pairs divides by it
    wide = connected_components(copies.copy_pairs(safe, cfg)).collect()
    together: dict = {}
    for r in wide:
        together.setdefault(r["component"], set()).add(r["node"])
    found: dict = {}
    for r in copies.mark_copies(df, cfg).collect():
        if r["duplicate_of"]:
            found.setdefault(r["duplicate_of"], {r["duplicate_of"]}).add(r["sha256"])
    flat = {frozenset(v) for v in found.values()}
    at = {r[0]: r for r in rows}
    rest = {frozenset(s for s in v if at[s][6] > 0) for v in flat} - {frozenset()}
    assert {v for v in rest if len(v) > 1} == {frozenset(v) for v in together.values()} and len(together) > 20


def test_scores_take_one_wide_sort_for_groups_and_names(spark):
    """F14 to F17: a task held the rows of a group in six sorts."""
    from keepstone.adapters import grouped
    from keepstone.config import Curation
    from keepstone.operators.ranking import score_groups

    plan = score_groups(grouped(spark, f"{DATA}/sf0.001"), Curation())._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    # Two sorts of the join with groups by hour, one by (group, name), one by (group, row).
    assert sum("Sort [" in line for line in plan.splitlines()) <= 4


def test_paths_read_scores_that_are_written(spark, monkeypatch):
    """scores were run again for each reader."""
    from keepstone.plans import paths

    found = []
    plain = paths.stored
    monkeypatch.setattr(paths, "stored", lambda df, name: (found.append(name), plain(df, name))[1])
    catalog.QUERIES["l_desired_paths"](spark, f"{DATA}/sf0.001")
    assert found == ["scored"]


def test_combine_reads_scores_that_are_written(spark):
    """scores were run again for each of six readers."""
    plan = catalog.QUERIES["j_combine"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_refresh_reads_records_and_scores_that_are_written(spark, monkeypatch):
    """records were made anew for each step of finding copies, and scores once for paths and once for their rows."""
    from keepstone.operators import derive

    found = []
    plain = derive.stored
    monkeypatch.setattr(derive, "stored", lambda df, name: (found.append(name), plain(df, name))[1])
    plan = catalog.QUERIES["m_scoped_refresh"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert found == ["own", "scored"] and "Window" not in plan
