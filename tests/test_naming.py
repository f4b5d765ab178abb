from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from keepstone.operators import naming
from keepstone.operators.ordering import running_sums


def fold(rows, suffix):
    used, out = set(), {}
    for key, path in sorted(rows):
        base, dot, ext = path.rpartition(".") if "." in path.rsplit("/", 1)[-1] else (path, "", "")
        target, n = path, 1
        while target in used:
            n += 1
            target = f"{base}{suffix}{n}{dot}{ext}"
        used.add(target)
        out[key] = target
    return out


def check(spark, rows, suffix="_"):
    df = spark.createDataFrame([(k, p, "x") for k, p in rows], "k long, path string, other string")
    got = naming.number_paths(df, "path", ["k"], suffix).collect()
    assert {r["k"]: r["target"] for r in got} == fold(rows, suffix) and len(got) == len(rows)


@pytest.mark.parametrize("suffix", ["_", "+"])
def test_equals_the_sequential_fold(spark, suffix):
    rng = random.Random(len(suffix))
    tails = ["", "", "", "2", "3", "5", "1", "02", "2,2", "2,3", "3,2", "2,2,2", "12"]
    rows = []
    for k in range(400):
        tail = "".join(suffix + t for t in rng.choice(tails).split(",") if t)
        rows.append((k, f"d{rng.randrange(3)}/a{rng.randrange(2)}{tail}{rng.choice(['.jpg', '', '.tar.gz'])}"))
    rng.shuffle(rows)
    check(spark, rows, suffix)


def test_natural_names_that_clash(spark):
    cases = (["a.jpg", "a.jpg", "a_2.jpg"], ["a_2.jpg", "a.jpg", "a.jpg"], ["a.jpg", "a.jpg", "a_2.jpg", "a_2.jpg", "a_2_2.jpg"], ["a", "a_3", "a", "a", "a_2"],
        [".hidden", ".hidden"], ["d.x/a", "d.x/a"], ["a."] * 3, ["only"], ["a", "a", "a_999999999", "a_9999999999"])
    rows = [f"c{i}/{name}" for i, names in enumerate(cases) for name in names]
    check(spark, list(enumerate(rows)))
    assert naming.number_paths(spark.createDataFrame([], "k long, path string"), "path", ["k"]).count() == 0


def test_a_stem_with_most_rows_is_many_ranges(spark):
    rows = spark.range(40_000).withColumn("path", F.when(F.col("id") % 1000 == 7, F.concat(F.lit("x_"), F.col("id").cast("string"))).otherwise("x"))
    got = naming.number_paths(rows, "path", ["id"]).collect()
    assert {r["id"]: r["target"] for r in got} == fold([(i, f"x_{i}" if i % 1000 == 7 else "x") for i in range(40_000)], "_")
    assert all(re.fullmatch(r"x(_\d+)*", r["target"]) for r in got)


def test_running_sums_over_ranges_and_null_keys(spark):
    rows = [(None if i % 3 == 0 else i % 2, i * 7919 % 501, i) for i in range(501)]
    df = spark.createDataFrame(rows, "k long, o long, v long").repartition(7)
    got = {(r["k"], r["o"]): (r["n"], r["s"]) for r in running_sums(df, ["k"], ["o"], {"n": F.lit(1), "s": F.col("v")}).collect()}
    for key in (None, 0, 1):
        n = s = 0
        for k, o, v in sorted((r for r in rows if r[0] == key), key=lambda r: r[1]):
            n, s = n + 1, s + v
            assert got[k, o] == (n, s)
    assert running_sums(df, [], ["o"], {"n": F.lit(1)}).agg(F.max("n")).first()[0] == 501


def test_free_names_beside_taken_ones(spark):
    rng = random.Random(9)
    taken = {f"s{rng.randrange(4)}{rng.choice(['', '_1', '_2', '_3', '_7', '_10', '_01', '_2_1'])}" for _ in range(40)} | {"big_400000000"}
    rows = [(i, rng.choice(["s0", "s1", "s2", "s3", "s9", "s1_2", "big"])) for i in range(200)]
    frame = spark.createDataFrame(rows, "i long, stem string")
    got = {r["i"]: r["name"] for r in naming.assign_names(frame, spark.createDataFrame([(t,) for t in taken], "name string"), "stem", ["i"]).collect()}
    used = {s: set() for _, s in rows}
    for t in taken:
        if t in used:
            used[t].add(0)
        base, _, n = t.rpartition("_")
        if base in used and n.isdigit() and not n.startswith("0"):
            used[base].add(int(n))
    for i, stem in rows:
        n = 0
        while n in used[stem]:
            n += 1
        used[stem].add(n)
        assert got[i] == (stem if n == 0 else f"{stem}_{n}")
