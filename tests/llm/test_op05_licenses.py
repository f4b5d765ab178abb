from __future__ import annotations

import random

from keepstone.llm import op5_licenses as L
from keepstone.llm import queries
from tests.conftest import DATA


def brute(text):
    words = [w.decode() for w in L.words_of(text or "")]
    places, labels = [], set()
    for phrase, label in L.BASE_PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), labels


def _tuple(s):
    return s.n_words, s.n_base, s.first_word, s.last_word, s.base_labels


def test_base_phrases_against_plain_search():
    rng, scanner = random.Random(1), L.LicenseScanner()
    words = sorted({w for p in L.BASE_PHRASES for w in p.split()} | {"x", "the", "licensed", "under", "é"})
    for _ in range(4000):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(14)))
        if rng.random() < 0.3:
            text += "-" + rng.choice(list(L.BASE_PHRASES)).upper() + "\n" + rng.choice(L.TEMPLATES)[1][:60]
        assert _tuple(scanner.scan(text.encode())) == brute(text)


def test_segments_of_a_long_text(monkeypatch):
    text = "a mit license b. apache   license; " * 50
    whole = L.LicenseScanner().scan(text.encode())
    monkeypatch.setattr(L, "SEGMENT", 64)
    parts = L.LicenseScanner().scan(text.encode())
    assert _tuple(parts) == _tuple(whole) == brute(text) and parts.spans == whole.spans


def test_automaton_accepts_exactly_the_runs():
    rng, strings = random.Random(2), [[0, 1, 0, 1, 1], [1, 1, 0], [0, 0, 0], [2]]
    a = L.SuffixAutomaton()
    for i, s in enumerate(strings):
        a.add(i, s)
    a.finish()
    runs = {tuple(s[i:j]) for s in strings for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(2000):
        word, v = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 6))), 0
        for c in word:
            v = a.next[v].get(c) if v is not None else None
        assert (v is not None) == (word in runs)
        if v is not None:
            ends = {(i, j) for i, s in enumerate(strings) for j in range(len(word), len(s) + 1) if tuple(s[j - len(word) : j]) == word}
            assert a.ends[v] == ends


def test_templates_add_labels_and_spans():
    scanner = L.LicenseScanner()
    bsd = dict(L.TEMPLATES)["bsd"]
    s = scanner.scan(f"x y {bsd.replace('binary', 'object')} z".encode())
    label, cover, first, end = s.spans[0]
    assert label == "bsd" and 0.9 < cover < 1 and (first, end) == (2, 2 + len(L.words_of(bsd)))
    assert not scanner.scan(b"redistribution and use of this text").spans[0][1] >= L.LEAST_COVER


def test_every_notice_is_a_span():
    scanner = L.LicenseScanner()
    bsd = dict(L.TEMPLATES)["bsd"]
    size = len(L.words_of(bsd))
    text = f"{bsd} one two three {'x ' * 40}{bsd} {'y ' * 40}{bsd[: len(bsd) // 3]}"
    found = [s for s in scanner.scan(text.encode()).spans if s[0] == "bsd"]
    assert [(s[1], s[2], s[3]) for s in found] == [(1.0, 0, size), (1.0, size + 43, 2 * size + 43)]


def test_a_chain_looks_back_past_many_matches():
    # 200 matches that end between the two halves of the template, within the gap
    words = [f"a{i}" for i in range(20)]
    halves = " ".join(words[:10]), " ".join(words[10:])
    noise = " ".join(words[12:15])
    scanner = L.LicenseScanner(templates=[("t", f"{halves[0]} {halves[1]}")] + [("t", noise)] * 90, phrases={})
    text = f"{halves[0]} x {noise} x {noise} x {halves[1]}"
    spans = [s for s in scanner.scan(text.encode()).spans if s[3] - s[2] > 15]
    assert spans and spans[0][1] == 1.0


def test_query_and_edges(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.queries()["op5_license_automaton"](spark, f"{DATA}/sf0.001").collect():
        n, base, first, last, labels = brute(texts[r["doc_id"]])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, base, first, last)
        assert r["base_labels"] == ",".join(sorted(labels)) and set(labels) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    rows = [(None, None, 1), (1, "", 2), (1, "MIT License", 3), (1, "MIT License", 3)]
    out = L.scan_documents(spark.createDataFrame(rows, "doc_id long, text string, labels int")).collect()
    assert [(r["n_words"], r["labels"], r["score"]) for r in out] == [(0, "", 0.0), (0, "", 0.0), (2, "mit", 1.0), (2, "mit", 1.0)]
    assert L.scan_documents(docs.limit(0)).count() == 0
