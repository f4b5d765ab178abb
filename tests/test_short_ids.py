from __future__ import annotations

from keepstone.operators import short_ids


def test_ids_are_told_apart_and_come_back(spark):
    """F2 (r04): whole hashes were most of what a click shuffled and wrote."""
    ids = [f"{i * 2654435761 % 2**32:08x}{'0' * 40}{i:016x}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "sha256 string")
    length = short_ids.least_length(df, "sha256")
    assert length == 8 and len({i[:length] for i in ids}) == 300
    rows = spark.createDataFrame([(i[:length], None if n % 3 else ids[0][:length], "by-hand" if n % 2 else i[:length]) for n, i in enumerate(ids)], "sha256 string, other string, moment string")
    got = {tuple(r) for r in short_ids.lengthened(rows, df, "sha256", length, ["other", "moment", "sha256"]).collect()}
    assert got == {(i, None if n % 3 else ids[0], "by-hand" if n % 2 else i) for n, i in enumerate(ids)}


def test_ids_that_begin_alike_or_stand_twice(spark):
    alike = spark.createDataFrame([("0" * 20 + f"{i:04x}",) for i in range(40)], "sha256 string")
    assert short_ids.least_length(alike, "sha256") == 24
    twice = spark.createDataFrame([(x,) for x in ("ab" * 16, "ab" * 16, "cd" * 16, None)], "sha256 string")
    assert short_ids.least_length(twice, "sha256") == 32
    got = short_ids.lengthened(twice, twice, "sha256", 32, ["sha256"]).collect()
    assert sorted(r[0] or "" for r in got) == ["", "ab" * 16, "ab" * 16, "cd" * 16]
    assert short_ids.least_length(twice.limit(0), "sha256") == 0
