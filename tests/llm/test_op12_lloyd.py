from __future__ import annotations

import hashlib

import numpy as np

from keepstone.llm import op12_delta_lloyd as L
from keepstone.llm import queries
from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA


def brute(rows, rounds=6):
    """{(vec_id, code): (error, label_error)} and the codebooks' digest, by plain rounds."""
    kept = [(i, l, np.clip(np.floor(4096 * np.asarray(v, float)), -L.LARGEST, L.LARGEST).astype(int)) for i, v, l in rows]
    dim = len(kept[0][2])
    x = np.stack([v for _, _, v in kept]).reshape(-1, 8, dim // 8)
    firsts = {}
    for i, _, v in sorted((k for k in kept if k[0] is not None), key=lambda k: (k[0], k[2].tolist())):
        firsts.setdefault(i, v)
    books = np.stack([firsts[i] for i in sorted(firsts)[:16]]).reshape(-1, 8, dim // 8).transpose(1, 0, 2)
    near = lambda: ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
    for _ in range(rounds):
        code = near().argmin(axis=2)
        new = books.copy()
        for p in range(8):
            for e in range(books.shape[1]):
                mine = x[code[:, p] == e, p]
                if len(mine):
                    new[p, e] = [sum(c) // len(mine) for c in mine.T.tolist()]
        books = new
    code, error = near().argmin(axis=2), near().min(axis=2).sum(axis=1)
    total = {}
    for (_, l, _), e in zip(kept, error.tolist(), strict=True):
        total[l] = total.get(l, 0) + e
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(repr((i, "".join(f"{c:02x}" for c in cs), e, total[l], digest)) for (i, l, _), cs, e in zip(kept, code.tolist(), error.tolist(), strict=True))


def found(spark, rows, **kw):
    frame = spark.createDataFrame([(i, v, l, 1, b"") for i, v, l in rows], "vec_id long, embedding array<float>, label int, block int, code binary")
    return sorted(repr(tuple(r)) for r in L.vector_codes(spark, frame, **kw).collect())


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows = [(i, np.float32(rng.normal(i % 3, 1, 16)).tolist(), i % 4) for i in range(300)] + [(5, [0.5] * 16, None), (5, [0.5] * 16, None), (-7, [-1.0] * 16, 0), (None, [2.0] * 16, 1)]
    for rounds in (0, 1, 6):
        assert found(spark, rows, rounds=rounds) == brute(rows, rounds)


def test_blocks_and_salted_labels(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, np.float32(rng.normal(0, 1, 8)).tolist(), None if i % 3 else i) for i in range(200)]
    monkeypatch.setattr(L, "LABELS_SENT", 4)
    assert found(spark, rows) == brute(rows)


def test_blocks_of_many_sizes(spark):
    rows = spark.range(5000).selectExpr("id", "cast(id % 7 as int) as label", "array(cast(id as int), 1) as v")
    packed = L._blocks(rows).collect()
    ids = [i for r in packed for i in r["ids"]]
    assert sorted(ids) == list(range(5000)) and len({r["block"] for r in packed}) == len(packed)
    for r in packed:
        assert len(r["ids"]) <= L.BLOCK_ROWS and np.frombuffer(r["v"], "<i4").reshape(-1, 2)[:, 0].tolist() == r["ids"]
        assert r["labels"] == [i % 7 for i in r["ids"]]


def test_changes_are_what_moved():
    rng = np.random.default_rng(2)
    v, old, new = rng.integers(-9, 9, (50, 8, 3)), rng.integers(0, 4, (50, 8)).astype(np.uint8), rng.integers(0, 4, (50, 8)).astype(np.uint8)
    new[:40] = old[:40]
    delta = L.changes(v, old, new, 4)
    for p in range(8):
        for e in range(4):
            expected = [int((new[:, p] == e).sum() - (old[:, p] == e).sum()), *(v[new[:, p] == e, p].sum(axis=0) - v[old[:, p] == e, p].sum(axis=0))]
            assert delta.get((p, e), np.zeros(4)).tolist() == expected
    assert L.changes(v, old, old, 4) == {}
    assert sum(x[0] for x in L.changes(v, np.full_like(old, L.NONE), new, 4).values()) == 400


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i)] * 8, i % 2) for i in range(3)]
    bad = [(10, None, 0), (11, [nan] + [0.0] * 7, 0), (12, [inf] + [0.0] * 7, 0), (13, [None] + [0.0] * 7, 0), (14, [], 0), (15, [1.0] * 9, 0), (16, [1.0] * 16, 0)]
    huge = [(20, [3e38] * 8, 0), (21, [-3e38] * 8, 0)]
    assert found(spark, good + bad + huge) == brute(good + huge)
    assert found(spark, bad[:5]) == [] and found(spark, [(None, [1.0] * 8, 0)]) == []
    assert found(spark, [(1, [0.25] * 8, None)] * 40) == brute([(1, [0.25] * 8, None)] * 40)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("keepstone_")]


def test_sql(spark, duck):
    assert spark_rows(queries.queries()["op12_delta_lloyd_codes"](spark, f"{DATA}/sf0.001")) == duck_rows(duck, queries.oracle_sql()["op12_delta_lloyd_codes"])
