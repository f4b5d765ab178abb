from __future__ import annotations

import random

from keepstone.operators import edit_log


def _play(edits, upto=None):
    out = {}
    for seq, kind, key, after in edits:
        if upto is None or seq <= upto:
            out[kind, key] = after
    return {k: v for k, v in out.items() if v is not None}


def _state(df):
    return {(r["kind"], r["key"]): r["value"] for r in df.select("kind", "key", "value").collect()}


def test_replay_of_a_thousand_edits(spark):
    rng = random.Random(5)
    kinds = ["group", "pick", "favourite", "tag", "row"]
    edits = [(i // 2, rng.choice(kinds), f"k{rng.randrange(30)}", rng.choice([None, "a", "b", "c"])) for i in range(1000)]
    edits = list({e[:3]: e for e in edits}.values())
    none = spark.createDataFrame([], "seq long, kind string, key string, before string, after string")
    df = spark.createDataFrame(edits, "seq long, kind string, key string, after string")
    first = edit_log.entries(none, df.where("seq < 200"))
    log = first.unionByName(edit_log.entries(first, df.where("seq >= 200"))).cache()
    assert all(r["before"] != r["after"] for r in log.collect())
    for upto in (None, 0, 77, 200, 350):
        assert _state(edit_log.state(log, upto)) == _play(edits, upto)
    small = edit_log.compact(log, 300).cache()
    assert small.count() < log.count() and _state(edit_log.state(small, 350)) == _play(edits, 350)
    assert _state(edit_log.refreshed(edit_log.state(log, 350), log, 350)) == _play(edits)

    # Clicks taken back: the last change of a key that isn't one of them decides what can go.
    gone = {s for s in range(0, 500, 3)}
    rows, conflicts = edit_log.undo(log, spark.createDataFrame([(s,) for s in gone], "seq long"), 1000)
    expected, blocked = {}, set()
    for kind, key in {e[1:3] for e in edits}:
        mine = [r for r in sorted(log.where(f"kind = '{kind}' and key = '{key}'").collect(), key=lambda r: r["seq"])] if key in ("k1", "k2", "k3") else None
        if mine is None:
            continue
        while mine and mine[-1]["seq"] in gone:
            mine.pop()
        value = mine[-1]["after"] if mine else None
        if value is not None:
            expected[kind, key] = value
        blocked |= {(r["seq"], kind, key) for r in mine if r["seq"] in gone}
    now = _state(edit_log.state(log.unionByName(rows)))
    assert {k: v for k, v in now.items() if k[1] in ("k1", "k2", "k3")} == expected
    assert {tuple(r) for r in conflicts.where("key in ('k1', 'k2', 'k3')").select("seq", "kind", "key").collect()} == blocked
    back, _ = edit_log.undo(log.unionByName(rows), spark.createDataFrame([(1000,)], "seq long"), 1001)
    assert _state(edit_log.state(log.unionByName(rows).unionByName(back))) == _play(edits)
