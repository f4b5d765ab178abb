from __future__ import annotations

import itertools
import re

import pytest

from keepstone.llm import op11_filter_audit as A
from keepstone.llm import queries
from tests.compare import duck_rows, spark_rows
from tests.conftest import DATA

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def fails(text: str) -> str:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return found


def brute(docs, labels):
    docs = [(i, t or "", p or "") for i, t, p in docs]
    good = {i for i, q, _ in labels if q == 1} - {None}
    toxic = {i for i, _, x in labels if x == 1} - {None}
    out = {}
    for part in {p for _, _, p in docs}:
        rows = []
        for i, t, p in docs:
            copy = i is not None and any(j is not None and j < i and t == u for j, u, _ in docs)
            if p == part:
                rows.append((i, fails(t) + "E" * copy))
        gone = {}
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                out_now = [r for r in left if f in r[1]]
                earlier = len([r for r in rows if f in r[1]]) - len(out_now)
                left = [r for r in left if f not in r[1]]
                gone[f] = gone.get(f, 0) + len(out_now)
                out[part, "".join(order), step] = [
                    len(left), len(out_now), earlier, len([r for r in rows if r[1] == f]),
                    len([r for r in out_now if r[0] in good]), len([r for r in out_now if r[0] in toxic]), f,
                ]
        for key in out:
            if key[0] == part:
                out[key][-1] = gone[out[key][-1]]
    return out


def found(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[f] for f in FIELDS] for r in df.collect()}


def test_the_table_of_first_failures():
    table = A.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for k, order in enumerate(itertools.permutations(range(5))):
            assert table[mask, k] == next((s for s, f in enumerate(order) if mask >> f & 1), 5)


@pytest.mark.parametrize("size", [7, 40, 1 << 20])
def test_masks_in_segments(size, monkeypatch):
    texts = ["", " \t\n", "a b a b a", "Word " * 300, " ".join(f"w{i}" for i in range(300)), "x" * 500, "é É b c " * 90, "50% of it", "\x0b\x0ca\rb", "a\u0085b \x1c c"]
    monkeypatch.setattr(A, "SEGMENT", size)
    for words in (16, 1 << 20):
        monkeypatch.setattr(A, "WORD_BYTES", words)
        for t in texts:
            assert {f for k, f in enumerate("ABCD") if A.content_mask(t.encode()) >> k & 1} == set(fails(t)), t


def test_against_brute_force(spark):
    long = " ".join(f"w{i}" for i in range(400))
    docs = [(1, "a b c", "en"), (2, "a b c", "de"), (3, "a b c", "en"), (3, "a b c", "en"), (None, "a b c", "en"), (None, "a b c", None), (4, None, None), (5, "", ""), (6, long, "en"),
        (7, long, "de"), (8, "X Y Z " * 200, "en"), (9, long + " 5%", "en"), (-1, long, "fr"), (-1, long, "fr"), (10, "word " * 90_000, "en"), (7, "other", "de")]
    labels = [(1, 1, 0), (2, 0, 1), (3, None, 1), (3, 1, None), (6, 1, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0)]
    frame = spark.createDataFrame([(*d, 1, "k") for d in docs], "doc_id long, text string, lang string, mask int, key string")
    told = spark.createDataFrame([(*x, "en") for x in labels], "doc_id long, quality int, toxic int, lang string")
    assert found(A.audit(spark, frame, told)) == brute(docs, labels)
    assert A.audit(spark, frame.limit(0), told).count() == 0
    assert found(A.audit(spark, frame, told.limit(0))) == brute(docs, [])


def test_hot_copies_meet_in_few_rows(spark):
    """Copies are counted before they meet: rows that reach a text's window are parts times labels."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "'same text' as text", "concat('p', id % 100) as lang")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = A.audit(spark, docs, labels).where("filter_order = 'EABCD' and step = 1").groupBy("part").agg({"removed": "sum"}).collect()
    assert len(rows) == 100 and sum(r[1] for r in rows) == 29_999


def test_sql(spark, duck):
    assert spark_rows(queries.queries()["op11_filter_audit"](spark, f"{DATA}/sf0.001")) == duck_rows(duck, queries.oracle_sql()["op11_filter_audit"])
