"""Licence scan with a generalised suffix automaton over licence words.

The automaton accepts every run of words of every template and base phrase. A text is streamed through it word by
word; after each word the state and length give the longest run that ends there and occurs in some template (the
matching statistics). Base phrases are read off the states. Runs that can't be extended and are long enough become
matches; for each template, matches in the same order in text and template are chained into covered spans, and a
template that is covered to a sufficient share adds its label.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepstone.llm.common import released, slices, texts, utf8

#: Base phrases and their labels (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Well-known notices (fixed values), by label.
TEMPLATES = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]

#: Words: runs of digits, lower-case ASCII letters and anything beyond ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Shortest run of words that counts as a match, and the share of a template that must be covered.
LEAST_MATCH, LEAST_COVER = 3, 0.8
#: The most text words between two matches of a chain.
LARGEST_GAP = 32
#: Bytes of a text that are split into words at a time.
SEGMENT = 4 << 20


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode().lower())


class SuffixAutomaton:
    """Generalised suffix automaton; state 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]

    def _state(self, length: int, step: dict[int, int], link: int) -> int:
        self.next.append(step)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # the run is known from another string
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return new

    def add(self, number: int, word_ids: list[int]) -> None:
        last = 0
        for i, c in enumerate(word_ids):
            last = self._extend(last, c)
            self.ends[last].add((number, i + 1))

    def finish(self) -> None:
        """Hand end positions up the suffix links, longest states first."""
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            self.ends[self.link[v]] |= self.ends[v]
        self.ends[0] = set()

    def walk(self, word_ids: list[int]) -> int:
        v = 0
        for c in word_ids:
            v = self.next[v][c]
        return v


@dataclass
class Scan:
    """What one text showed; spans are (label, covered share, first word, word after the last)."""

    n_words: int = 0
    n_base: int = 0
    first_word: int | None = None
    last_word: int | None = None
    base_labels: set[str] = field(default_factory=set)
    spans: list[tuple[str, float, int, int]] = field(default_factory=list)


class LicenseScanner:
    def __init__(self, templates=TEMPLATES, phrases=BASE_PHRASES, least_match=LEAST_MATCH, least_cover=LEAST_COVER):
        self.least_match, self.least_cover = least_match, least_cover
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
        self.labels = [label for label, _ in templates]
        coded, coded_phrases = [number(t) for _, t in templates], [(number(p), label) for p, label in phrases.items()]
        self.sizes = [len(t) for t in coded]
        self.automaton = SuffixAutomaton()
        for i, t in enumerate(coded):
            self.automaton.add(i, t)
        for p, _ in coded_phrases:
            self.automaton.add(-1, p)
        self.automaton.finish()
        # A phrase ends at a state that lies below the phrase's own state; at its own, the run must be long enough.
        a = self.automaton
        own: dict[int, list[tuple[int, str]]] = {}
        for p, label in coded_phrases:
            own.setdefault(a.walk(p), []).append((len(p), label))
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in a.length]
        for v in sorted(range(1, len(a.length)), key=lambda v: a.length[v]):
            self.phrases[v] = own.get(v, []) + self.phrases[a.link[v]]

    def scan(self, text: bytes | None) -> Scan:
        out, text = Scan(), text or b""
        step, link, length, phrases = (getattr(self.automaton, x) for x in ("next", "link", "length", "next"))
        phrases = self.phrases
        matches: list[tuple[int, int, int]] = []  # end, words, state
        v = run = 0
        last = -2  # index of the last known word
        at = 0
        while at < len(text):
            cut = len(text)
            if cut - at > SEGMENT:
                found = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(text, at + SEGMENT)
                cut = found.end() if found else cut
            ids = list(map(self.vocabulary.get, WORD.findall(text[at:cut].lower())))
            base, at = out.n_words, cut
            out.n_words += len(ids)
            for i, c in enumerate(ids, base):
                if c is None:
                    continue
                if last != i - 1:
                    if run >= self.least_match:
                        matches.append((last + 1, run, v))
                    v = run = 0
                last = i
                if c not in step[v]:
                    if run >= self.least_match:
                        matches.append((i, run, v))
                    while v and c not in step[v]:
                        v = link[v]
                        run = length[v]
                v = step[v][c]  # every known word is a step from the root
                run += 1
                if phrases[v]:
                    for size, label in phrases[v]:
                        if run >= size:
                            start = i + 1 - size
                            out.n_base += 1
                            out.base_labels.add(label)
                            out.first_word = start if out.first_word is None else min(out.first_word, start)
                            out.last_word = start if out.last_word is None else max(out.last_word, start)
        if run >= self.least_match:
            matches.append((last + 1, run, v))
        if matches:
            out.spans = self.chain(matches)
        return out

    def chain(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Chains of each template that share no text word, best first: all that reach ``least_cover``, or the best one.

        Text and template order agree in a chain, and overlaps count once. A match looks back as far as ``LARGEST_GAP``
        words before its start; what lies there is bounded by the sizes of templates, however long the text is.
        """
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for end, run, v in matches:
            for template, template_end in self.automaton.ends[v]:
                if template >= 0:
                    by_template.setdefault(template, []).append((end, template_end, run))
        spans = []
        for template, found in by_template.items():
            found.sort()
            chains: list[tuple[int, int, int]] = []  # covered words, first text word, end
            for i, (end, t_end, run) in enumerate(found):
                covered, first = run, end - run
                j = i - 1
                while j >= 0 and found[j][0] >= end - run - LARGEST_GAP:
                    p_end, p_t_end, _ = found[j]
                    if p_end < end and p_t_end < t_end:
                        new = run - max(0, p_end - (end - run), p_t_end - (t_end - run))
                        if new > 0 and chains[j][0] + new > covered:
                            covered, first = chains[j][0] + new, chains[j][1]
                    j -= 1
                chains.append((covered, first, end))
            taken: list[tuple[int, int]] = []  # by place
            for covered, first, end in sorted(chains, key=lambda c: (-c[0], c[1], c[2])):
                cover = min(1.0, covered / self.sizes[template])
                if taken and cover < self.least_cover:
                    break
                at = bisect.bisect(taken, (first, end))
                if (at == 0 or taken[at - 1][1] <= first) and (at == len(taken) or end <= taken[at][0]):
                    taken.insert(at, (first, end))
                    spans.append((self.labels[template], cover, first, end))
        return sorted(spans, key=lambda s: (-s[1], s[0], s[2]))


SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,cover:double,first_word:long,end_word:long>>"
)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scanner: LicenseScanner | None = None) -> DataFrame:
    """One row for each row of docs. labels: base labels and those of templates covered to ``least_cover``.

    score is the largest covered share of a template; a base phrase, found whole, makes it 1. A null text counts as
    empty: no words, no labels (empty strings), score 0. Only id and text are read; equal rows give equal results.
    """
    scanner = scanner or LicenseScanner()
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    span = pa.struct([("label", pa.string()), ("cover", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())])
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def row(doc_id: int | None, text: bytes | None) -> tuple:
        s = scanner.scan(text)
        added = {label for label, cover, _, _ in s.spans if cover >= scanner.least_cover}
        score = 1.0 if s.n_base else max((cover for _, cover, _, _ in s.spans), default=0.0)
        both = (",".join(sorted(x)) for x in (s.base_labels, s.base_labels | added))
        spans = [dict(zip(("label", "cover", "first_word", "end_word"), x, strict=True)) for x in s.spans]
        return (doc_id, s.n_words, s.n_base, s.first_word, s.last_word, *both, score, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            columns = zip(*map(row, ids, texts), strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.list_(span)], strict=True)]
            yield pa.record_batch(arrays, names=names)

    return texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text")).mapInArrow(released(run), SCHEMA)
