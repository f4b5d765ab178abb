"""Semantics that small fixtures show best."""

from __future__ import annotations

import random
import struct
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from keepstone import schema
from keepstone.config import Curation
from keepstone.functions import scalars as S
from keepstone.functions.scalars import unordered_digest
from keepstone.operators import bursts, copies, edits, graph, ingest, intervals, naming, ranking, status
from keepstone.operators import vectors as V
from keepstone.plans import diffs, paths
from keepstone.sources import files, media
from keepstone.streaming import incremental

T0 = datetime(2024, 1, 1, 12)


def _records(spark, rows):
    """rows: (sha256, seconds, camera, phash, source)."""
    made = [(s, T0 + timedelta(seconds=t), c, h, d) for s, t, c, h, d in rows]
    return spark.createDataFrame(made, "sha256 string, taken_at timestamp_ntz, camera string, phash string, date_source string")


def test_bursts_against_a_plain_fold(spark):
    rng = random.Random(3)
    rows = [(f"s{i:03d}", rng.randrange(400), rng.choice([None, "a", "b"]), f"{rng.choice([0, 1, 7, 2**64 - 1, 2**63]):016x}", rng.choice(["exif", "exif", "mtime"])) for i in range(300)]
    expected, current, last = {}, {}, {}
    for s, t, c, h, d in sorted(rows, key=lambda r: (r[2] or "", r[1], r[0])):
        if d == "mtime":
            expected[s] = s
            continue
        group, x = current.get(c or ""), int(h, 16)
        if group and t - last[c or ""] <= 10 and min((x ^ y).bit_count() for y in group[1]) <= 3:
            group[1].append(x)
        else:
            group = current[c or ""] = (s, [x])
        expected[s], last[c or ""] = group[0], t
    found = {r["sha256"]: r["moment_id"] for r in bursts.bursts(_records(spark, rows), 10, 3).collect()}
    assert found == expected


def test_overrides_win(spark):
    groups = spark.createDataFrame([("a", "a"), ("b", "a")], "sha256 string, moment_id string")
    out = bursts.apply_overrides(groups, spark.createDataFrame([("b", "split")], "sha256 string, moment_id string"))
    assert {tuple(r) for r in out.collect()} == {("a", "a"), ("b", "split")}


def test_components_of_a_chain_and_random_links(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(40)]
    parent = {x: x for pair in links for x in pair}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    found = dict(graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {x: find(x) for x in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def _copy_rows(spark, rows):
    made = [(s, "m", T0 + timedelta(seconds=t), "exif", "00" * 8, w, h, sharp, 0.5, size) for s, t, w, h, sharp, size in rows]
    return spark.createDataFrame(
        made, "sha256 string, moment_id string, taken_at timestamp_ntz, date_source string, phash string, width int, height int, sharpness double, exposure double, size long"
    )


def test_copies_keep_the_largest(spark):
    rows = [("full", 0, 4000, 3000, 9.0, 10), ("half", 1, 2000, 1500, 5.0, 4), ("late", 9, 4000, 3000, 9.0, 10), ("blur", 1, 4000, 3000, 2.0, 10)]
    found = {r["sha256"]: r["duplicate_of"] for r in copies.mark_copies(_copy_rows(spark, rows), Curation()).collect()}
    # half joins full and, by shape alone, the blurred frame too: all three are one group.
    assert found == {"full": None, "half": "full", "late": None, "blur": "full"}


def test_scores_picks_and_stale_pointers(spark):
    rows = [
        ("a", "m", 0, 10.0, None, False, False), ("b", "m", 1, 9.9, None, False, False), ("c", "m", 2, 50.0, "a", True, False),
        ("d", "n", 0, 10.0, "elsewhere", True, False), ("e", "n", 1, 20.0, None, False, False), ("f", "o", 0, 3.0, None, False, False), ("g", "o", 1, 2.99, None, False, False),
    ]
    made = [(s, m, T0 + timedelta(seconds=t), sharp, 0.5, 0, None, 100, 100, dup, pick, fav) for s, m, t, sharp, dup, pick, fav in rows]
    df = spark.createDataFrame(
        made, "sha256 string, moment_id string, taken_at timestamp_ntz, sharpness double, exposure double, faces int, face_sharpness double, width int, height int, duplicate_of string, user_best boolean, favorite boolean"
    )
    out = {r["sha256"]: r for r in ranking.score_groups(df, Curation()).collect()}
    assert [s for s in sorted(out) if out[s]["is_best"]] == ["a", "d", "f"]
    assert out["c"]["score"] is None and out["d"]["score"] is None
    assert {s for s in out if out[s]["close_call"]} == {"f", "g"}


def test_even_sample_and_neighbours(spark):
    df = spark.createDataFrame([(i,) for i in range(20)], "i int").withColumn("g", F.lit(1))
    picked = sorted(r["i"] for r in ranking.even_sample(df, ["g"], ["i"], 8).collect())
    assert picked == sorted({round(i * 19 / 7) for i in range(8)})
    rows = ranking.neighbours(df, ["i"], "i", F.col("i") % 5 == 0).where("i = 7").first()
    assert (rows["previous"], rows["next"], rows["previous_todo"], rows["next_todo"]) == (6, 8, 5, 10)


def test_names_fill_free_slots(spark):
    new = spark.createDataFrame([("x", i) for i in range(3)] + [("y", 9)], "stem string, k int")
    taken = spark.createDataFrame([("x",), ("x_2",), ("y_01",)], "name string")
    out = naming.assign_names(new, taken, "stem", ["k"]).orderBy("stem", "k")
    assert [r["name"] for r in out.collect()] == ["x_1", "x_3", "x_4", "y"]


def _ranges(spark, rows):
    return spark.createDataFrame(rows, "slug string, start string, end string, parent string").select("slug", F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), "parent")


def test_interval_rules(spark):
    good = _ranges(spark, [("trip", "2024-01-01", "2024-01-05", None), ("trip/a", "2024-01-02", "2024-01-03", "trip")])
    assert intervals.range_problems(good).count() == 0
    bad = _ranges(spark, [("trip", "2024-01-01", "2024-01-05", None), ("other", "2024-01-05", "2024-01-06", None), ("trip/a", "2024-01-04", "2024-01-07", "trip"), ("z", "2024-02-02", "2024-02-01", None), ("q", "2024-03-01", "2024-03-02", "none")])
    found = {tuple(r) for r in intervals.range_problems(bad).collect()}
    assert found == {("trip", "overlap"), ("other", "overlap"), ("trip/a", "outside parent"), ("z", "swapped"), ("q", "no parent")}
    with pytest.raises(ValueError):
        intervals.name_range(good, "clash", "2024-01-04", "2024-01-09")
    assert intervals.unname(good, "trip").count() == 0


def test_dates(spark):
    names = ["IMG_20260703_145633.jpg", "20151004_06_56_36", "WP_20151004_06_56_36.jpg", "x_2026-07-03 14.56.33", "120260703_145633", "20261303_145633", "a"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(S.name_time(F.col("n"), 2026).alias("t"))
    t = [r["t"] for r in df.collect()]
    assert t == [datetime(2026, 7, 3, 14, 56, 33), datetime(2015, 10, 4, 6, 56, 36), datetime(2015, 10, 4, 6, 56, 36), datetime(2026, 7, 3, 14, 56, 33), None, None, None]
    folders = ["2016-01-03 - run/2016-04/a.jpg", "2016-04 x/b/a.jpg", "2016-13-40/a.jpg", "a.jpg", "1950-01-01/a.jpg"]
    df = spark.createDataFrame([(n,) for n in folders], "n string").select(S.folder_time(F.col("n"), 2026).alias("f"))
    got = [r["f"] and (r["f"]["taken_at"], r["f"]["source"]) for r in df.collect()]
    assert got == [(datetime(2016, 4, 1, 12), "folder-month"), (datetime(2016, 4, 1, 12), "folder-month"), None, None, None]
    df = spark.createDataFrame([("bad", "x/2016-01-03/a.jpg", 0.0), ("2020:01:02 03:04:05", "a", 0.0), (None, "a", 1.5)], "h string, p string, m double")
    got = [tuple(r["c"]) for r in df.select(S.capture_time(F.col("h"), F.col("p"), F.col("m"), 2026).alias("c")).collect()]
    assert got == [(datetime(2016, 1, 3, 12), "folder"), (datetime(2020, 1, 2, 3, 4, 5), "exif"), (datetime(1970, 1, 1, 0, 0, 1), "mtime")]


def test_text_scalars(spark):
    row = spark.range(1).select(
        S.slugify(F.lit("Birthday Party!")).alias("a"), S.slugify(F.lit("!?")).alias("b"), S.pretty_slug(F.lit("a-b/c-d")).alias("c"), S.clean_tag(F.lit("  A,b   C ")).alias("d"),
        S.highlight_path(F.lit("_undated/x.jpg"), F.lit("n")).alias("e"), S.extension(F.lit("a/.hidden")).alias("f"), S.is_screenshot(F.lit("a.PNG"), F.lit(None).cast("string")).alias("g"),
    ).first()
    assert tuple(row) == ("birthday-party", None, "a b › c d", "a b c", "_undated/n.jpg", "", True)


def test_status_by_membership(spark):
    now = status.fingerprints(spark.createDataFrame([("d1", "m", "a"), ("d1", "m", "b"), ("d1", "n", "c")], "day string, moment_id string, sha256 string"))
    renamed = status.fingerprints(spark.createDataFrame([("d1", "q", "b"), ("d1", "q", "a"), ("d1", "n", "c")], "day string, moment_id string, sha256 string"))
    assert now.collect() == renamed.collect()
    marks = status.mark(now.limit(0), now, now)
    assert [r["status"] for r in status.day_status(renamed, marks).collect()] == ["reviewed"]
    assert [r["status"] for r in status.day_status(now.limit(0), marks).collect()] == ["moments updated"]
    old = marks.withColumn("members_sig", F.lit(None).cast("string"))
    assert status.backfill(old, now).collect() == marks.collect()


def test_mutual_groups_and_rejections(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(2, 16))
    rows = []
    for i in range(24):
        v = centres[i % 2] + rng.normal(0, 0.2, 16)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), (i % 2) if i < 4 else None, "user" if i < 4 else None, i == 23))
    df = spark.createDataFrame(rows, "id long, embedding array<double>, person_id long, label_source string, ignored boolean")
    rejected = spark.createDataFrame([(10, 0)], "id long, person_id long")
    out = {r["id"]: r for r in V.assign(df, rejected, 0.6, 0.5, 10).collect()}
    assert all(out[i]["person_id"] == i % 2 and out[i]["label_source"] == "auto" for i in range(4, 23) if i != 10)
    assert out[10]["person_id"] is None and out[10]["group_id"] == 10 and out[23]["group_id"] is None
    groups = dict(V.mutual_groups(df.select("id", F.col("embedding").alias("v")), 12, 0.5).collect())
    assert set(groups.values()) == {0, 1}


def test_scoped_equals_full(spark):
    from keepstone.adapters import grouped
    from tests.conftest import DATA

    g = grouped(spark, f"{DATA}/sf0.001")
    full = ranking.score_groups(g, Curation())
    change = g.where("event_id in (3, 50, 700)")
    part = ranking.score_groups(incremental.touched(g, change, "moment_id"), Curation())
    ids = part.select("sha256")
    assert sorted(map(repr, part.collect())) == sorted(map(repr, full.join(ids, "sha256", "left_semi").select(*part.columns).collect()))


def test_edits(spark):
    df = spark.createDataFrame([("a", "m", True, 0), ("b", "m", False, 1), ("c", "n", True, 2)], "sha256 string, moment_id string, is_best boolean, t int")
    df = df.withColumns({"taken_at": F.col("t"), "user_best": F.lit(False)})
    pick = lambda *shas: spark.createDataFrame([(x,) for x in shas], "sha256 string")
    both = edits.combine(df, pick("a", "c"))
    assert {tuple(r) for r in both.collect()} == {("a", "m"), ("b", "m"), ("c", "m")}
    with pytest.raises(ValueError):
        edits.combine(df, pick("a", "b"))
    parts = {r[0]: r[1] for r in edits.split(df, "m", pick("b")).collect()}
    digest = df.where("sha256 = 'b'").agg(unordered_digest(F.col("sha256"))).first()[0]
    assert parts == {"a": "m", "b": edits.split_id("m", digest)}
    taken = spark.createDataFrame([(parts["b"],)], "moment_id string")
    assert edits.split_id("m", digest, taken) not in {parts["b"], "m"}
    with pytest.raises(ValueError):
        edits.split(df, "m", pick("a", "b"))
    moved = df.drop("moment_id").join(both, "sha256").select(*df.columns)
    back = edits.undo(moved, df.select("sha256", "moment_id", "user_best"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert [r["sha256"] for r in edits.pick_best(df, "m", "b").where("user_best").collect()] == ["b"]
    keys = spark.createDataFrame([("a",), ("z",)], "sha256 string")
    assert {r[0] for r in edits.toggle(df.select("sha256"), keys).collect()} == {"b", "c", "z"}
    items = spark.createDataFrame([("a", 0), ("b", 1)], "k string, position long")
    new = edits.append_positions(items, spark.createDataFrame([("b",), ("c",)], "k string"), "k")
    assert {tuple(r) for r in new.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_private_never_leaves(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "sha256 string, private boolean")
    with pytest.raises(ValueError):
        diffs.refuse_private(df.select("sha256"), df)
    assert diffs.refuse_private(df.where("not private").select("sha256"), df).count() == 1


def test_ingest_of_a_folder(spark, tmp_path):
    import os

    for name, data in (("b1/IMG_1.jpg", b"x"), ("b1/copy.jpg", b"x"), ("b1/empty.jpg", b""), ("Thumbs.db", b"t"), ("b2/clip.mov", b"v")):
        p = tmp_path / "in" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
        os.utime(p, (1_700_000_000, 1_700_000_000))
    listing = files.list_roots(spark, [str(tmp_path / "none"), str(tmp_path / "in")], with_content_hash=True)
    assert {r["key"] for r in listing.collect()} == {f"_inbox_1/{n}" for n in ("b1/IMG_1.jpg", "b1/copy.jpg", "b1/empty.jpg", "Thumbs.db", "b2/clip.mov")}
    known = spark.createDataFrame([("b1/IMG_1.jpg", 1, 1_700_000_000.0, "image", "h")], "path string, size long, mtime double, status string, sha256 string")
    plan = {r["path"]: r["action"] for r in ingest.ingest_plan(listing.select("path", "size", "mtime"), known, 1_700_000_500.0).collect()}
    assert plan == {"b1/IMG_1.jpg": "unchanged", "b1/copy.jpg": "new", "b1/empty.jpg": "empty", "Thumbs.db": "new", "b2/clip.mov": "new"}
    none = spark.createDataFrame([], "sha256 string")
    routed = {r["path"]: r["outcome"] for r in ingest.route_content(listing.select("path", "sha256"), none, none).collect()}
    assert routed["b1/IMG_1.jpg"] == "new" and routed["b1/copy.jpg"] == "duplicate"
    assert files.missing_roots(spark, [str(tmp_path / "none")]) == [str(tmp_path / "none")]


def test_settling_files_are_offered_again(spark):
    rows = "path string, size long, mtime double"
    batch = spark.createDataFrame([("a", 1, 100.0), ("b", 1, 950.0)], rows)
    ready, pending = incremental.settle(batch, batch.limit(0), 1000.0, 120.0)
    assert [r["path"] for r in ready.collect()] == ["a"]
    ready, _ = incremental.settle(batch.limit(0), pending, 1100.0, 120.0)
    assert [r["path"] for r in ready.collect()] == ["b"]


def test_media():
    assert media.exposure(np.full((8, 8), 117, np.uint8)) > media.exposure(np.full((8, 8), 40, np.uint8)) > media.exposure(np.full((8, 8), 255, np.uint8))
    rng = np.random.default_rng(0)
    noisy = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    assert media.sharpness(noisy) > media.sharpness(np.full((64, 64), 9, np.uint8)) == 0
    assert media.picture_hash(noisy) == media.picture_hash(noisy) and len(media.picture_hash(noisy)) == 16
    body = struct.pack(">B3xI", 0, 1_700_000_000 + media.EPOCH_1904) + bytes(8)
    mvhd = struct.pack(">I4s", 8 + len(body), b"mvhd") + body
    assert media.container_seconds(struct.pack(">I4s", 8 + len(mvhd), b"moov") + mvhd) == 1_700_000_000
    assert media.container_seconds(b"garbage") is None


def test_packages_become_rows(spark):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.jpg", b"1")
        z.writestr("b.jpg", b"22")
        z.writestr("content.xml", '<frame name="b.jpg" label="flash"/>')
    df = spark.createDataFrame([("p", bytearray(out.getvalue())), ("q", bytearray(b"no zip"))], "package_sha string, content binary")
    assert {(r["member"], r["label"], r["size"]) for r in media.explode_packages(df).collect()} == {("a.jpg", "", 1), ("b.jpg", "flash", 2)}


def test_schema_evolution(spark):
    old = spark.createDataFrame([("a", "x")], "slug string, gone string")
    out = schema.evolve(old, schema.RANGES, {"parent": "p"}).first()
    assert out["slug"] == "a" and out["parent"] == "p" and out["start"] is None and set(out.asDict()) == {"slug", "start", "end", "parent"}


def test_paths_of_undated_and_alternates(spark):
    rows = [("a", "n1", ".jpg", T0, "exif", "m", True, None), ("b", "n2", ".jpg", T0 + timedelta(days=1), "exif", "m", False, None), ("c", "n3", ".jpg", T0, "exif", "m", False, "a"), ("d", "n4", ".png", T0, "mtime", "d", True, None), ("e", "n5", ".png", T0, "folder-month", "e", True, None)]
    df = spark.createDataFrame(rows, "sha256 string, name string, ext string, taken_at timestamp_ntz, date_source string, moment_id string, is_best boolean, duplicate_of string")
    found = dict(paths.desired_paths(df, _ranges(spark, [("party", "2024-01-01 10:00:00", "2024-01-01 13:00:00", None)])).collect())
    top = "2024/2024-01-01_party"
    assert found == {"a": f"{top}/n1.jpg", "b": f"{top}/_alternates/n1/n2.jpg", "c": f"{top}/_duplicates/n1/n3.jpg", "d": "_undated/n4.png", "e": "2024/2024-01_unknown-day/n5.png"}


def _png(path, gray):
    import zlib

    h, w = gray.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in gray)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_pictures_are_measured_and_bad_ones_reported(spark, tmp_path):
    from keepstone.sources.images import image_features, upright

    gray = np.random.default_rng(0).integers(0, 255, (40, 60)).astype(np.uint8)
    _png(tmp_path / "a.png", gray)
    (tmp_path / "b.png").write_bytes(b"not a picture")
    rows = {r["path"][-5:]: r for r in image_features(spark, str(tmp_path)).collect()}
    assert (rows["a.png"]["width"], rows["a.png"]["height"], rows["a.png"]["error"]) == (60, 40, None)
    assert abs(rows["a.png"]["sharpness"] - media.sharpness(gray)) < 1e-6 and rows["a.png"]["phash"] == media.picture_hash(gray)
    assert rows["b.png"]["error"] and rows["b.png"]["phash"] is None
    assert upright(60, 40, 6) == (40, 60) and upright(60, 40, None) == (60, 40)


def test_front_matter(spark, tmp_path):
    from keepstone.sources.files import front_matter

    (tmp_path / "a.md").write_text("---\nauthor: ann\ntags: [x, y]\n---\ntags: [no]\n")
    (tmp_path / "b.md").write_text("---\nauthor: ann\ntags: [y]\n---\n")
    assert {tuple(r) for r in front_matter(spark, str(tmp_path)).collect()} == {("author", "ann", 2), ("tags", "x", 1), ("tags", "y", 2)}


def test_own_edits_keep_a_day_reviewed(spark):
    rows = "day string, moment_id string, sha256 string"
    before = status.fingerprints(spark.createDataFrame([("d", "m", "a"), ("d", "n", "b"), ("e", "o", "c")], rows))
    after = status.fingerprints(spark.createDataFrame([("d", "m", "a"), ("d", "m", "b"), ("e", "o", "c")], rows))
    marks = before.where("day = 'd'")
    kept = status.keep_reviewed(marks, before, after, before.select("day"))
    assert {tuple(r) for r in status.day_status(after, kept).collect()} == {("d", "reviewed"), ("e", "new")}


def test_removed_by_hand_never_comes_back(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "sha256 string, n int")
    stones = spark.createDataFrame([], "sha256 string, data string, purged boolean")
    left, stones = edits.forget_missing(df, stones, df.where("n = 1"))
    assert [r["sha256"] for r in left.collect()] == ["b"]
    assert edits.restore(left, stones, df, []).count() == 1
    batch = spark.createDataFrame([("x", "a")], "path string, sha256 string")
    assert ingest.route_content(batch, left, stones).first()["outcome"] == "deleted"


def test_streams_go_on_from_a_checkpoint(spark, tmp_path):
    rows = "sha256 string, at timestamp"
    made = lambda names: spark.createDataFrame([(n, T0) for n in names], rows)
    made(["a", "a", "b"]).coalesce(1).write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.run_available(incremental.first_of_content(incremental.stream_table(spark, str(tmp_path / "in"), made([]).schema), "at", "1 hour"), str(tmp_path / "out"), str(tmp_path / "log"))
    run()
    made(["b", "c"]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("sha256").collect()) == ["a", "b", "c"]
