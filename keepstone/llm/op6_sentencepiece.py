"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

The model file is of the merge kind. A sequence of its pieces is the encoding of their text exactly if every two
neighbours are the encoding of their own text, so encoding is a search for the best path through a lattice of pieces
in which a step between two pieces weighs 0 if they may be neighbours and minus infinity if not. A giant document is
split into chunks at any place. A boundary state is the piece that crosses or touches the boundary, with the number of
characters that it takes behind it; a chunk yields the max-plus matrix from its first boundary's states to its last
boundary's. Matrices are combined associatively, which fixes the state at every boundary, and each chunk is then
traced back by itself.

No piece goes from another character to a blank mark, so a word with the marks before it is a unit that is encoded by
itself. What lies between a chunk's first and last such place goes through the library, as do ordinary documents as a
whole; the lattice is only walked where a chunk's boundary cuts a unit.
"""

from __future__ import annotations

import functools
import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepstone.llm.common import released, Scratch, slices, texts, utf8

#: Characters of a chunk; longer documents are split.
CHUNK = 32_768
MARK = "▁"
#: Weights of the max-plus semiring that occur: an allowed step, and none.
ALLOWED, NONE = 0.0, float("-inf")

#: A boundary state: characters behind the boundary, and the piece (None where a unit begins).
State = tuple[int, str | None]
Matrix = dict[State, dict[State, float]]


def combine(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for start, row in a.items():
        best: dict[State, float] = {}
        for mid, w in row.items():
            for end, v in b.get(mid, {}).items():
                if w + v > best.get(end, NONE):
                    best[end] = w + v
        if best:
            out[start] = best
    return out


def boundary_states(matrices: list[Matrix], first: State, last: State) -> list[State]:
    """The state at every boundary of the best path, by a tree of associative products."""
    if len(matrices) == 1:
        return [first, last]
    tree = [matrices]
    while len(tree[-1]) > 1:
        row = tree[-1]
        tree.append([combine(row[i], row[i + 1]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)])
    ends = [first, last]
    for row in reversed(tree[:-1]):
        finer = [ends[0]]
        for i in range(0, len(row), 2):
            a, b = ends[i // 2], ends[i // 2 + 1]
            if i + 1 < len(row):
                finer.append(max((w + row[i + 1].get(mid, {}).get(b, NONE), mid) for mid, w in row[i][a].items())[1])
            finer.append(b)
        ends = finer
    return ends


class PieceEncoder:
    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        self.ids = {pieces[i]: i for i in plain}
        self.score = {pieces[i]: m.get_score(i) for i in plain}
        self.bytes = {int(pieces[i][3:5], 16): i for i in range(len(pieces)) if m.is_byte(i)}
        self.longest = max(map(len, self.ids))
        self.text = [p.replace(MARK, " ").encode() for p in pieces]
        for value, i in self.bytes.items():
            self.text[i] = bytes([value])
        for i in range(len(pieces)):
            if m.is_control(i):
                self.text[i] = b""
        self.allowed: dict[tuple[str, str], bool] = {}

    # Units ------------------------------------------------------------------------------------------------------

    def encode_units(self, text: str) -> list[int]:
        """Ids of a normalised text of whole units; it begins with a mark, which the library adds by itself."""
        if len(text) < 2:
            return [self.ids[MARK]] if text else []
        return self.model.encode(text[1:])

    def normalise(self, text: str) -> str:
        return self.model.normalize(text) if text else ""

    # Lattice ----------------------------------------------------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging; the best score first, the leftmost among equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], NONE), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: str, b: str) -> bool:
        key = (a, b)
        if key not in self.allowed:
            if len(self.allowed) > 1_000_000:
                self.allowed.clear()
            self.allowed[key] = self.merge(a + b) == [a, b]
        return self.allowed[key]

    def pieces_at(self, text: str, i: int) -> list[str]:
        """Pieces that may begin at a place; a character without a piece stands for itself."""
        found = [text[i : i + n] for n in range(1, min(self.longest, len(text) - i) + 1) if text[i : i + n] in self.ids]
        return found if text[i] in self.ids else [text[i], *found]

    def unit_starts(self, text: str, i: int) -> Iterator[tuple[int, str | None]]:
        """(end, piece) of the first piece behind or with the last of the marks that begin a unit at i."""
        marks = i
        while marks < len(text) and text[marks] == MARK:
            marks += 1
        run = marks - i
        if marks == len(text):  # blanks at the end of a document
            yield marks, None
        for back in (1, 0):
            lead = MARK * min(run - back, 3)
            if run >= back and marks < len(text):
                for piece in self.pieces_at(text, marks - back):
                    if (not back or len(piece) > 1) and self.merge(lead + piece) == [*self.merge(lead), piece]:
                        yield marks - back + len(piece), piece

    def marks_before(self, unit_text: str, piece_start: int) -> list[int]:
        return self.encode_units(unit_text[:piece_start])

    def walk(self, text: str, start: int, stop: int, first: list[State]) -> dict[State, dict[State, list[State]]]:
        """From boundary states at ``start`` to those at ``stop`` (both places in text): every path's states in between.

        Returns, for each state, the states it can be reached from. States are (end place, piece).
        """
        came: dict[State, set[State]] = {s: set() for s in first}
        at: dict[int, list[State]] = {}
        for s in first:
            at.setdefault(s[0], []).append(s)
        for i in range(start, stop):
            for state in at.get(i, []):
                if state[1] is None:
                    steps = self.unit_starts(text, i)
                else:
                    steps = ((i + len(p), p) for p in self.pieces_at(text, i) if self.may_follow(state[1], p))
                for step in steps:
                    if step not in came:
                        came[step] = set()
                        at.setdefault(step[0], []).append(step)
                    came[step].add(state)
        return came

    def cuts(self, text: str) -> tuple[int, int] | None:
        """First and last place of a chunk (its own characters) where a unit begins behind another character."""
        places = re.compile(f"(?<=[^{MARK}]){MARK}")
        first = places.search(text)
        if not first:
            return None
        last = text.rfind(MARK)
        while last and text[last - 1] == MARK:
            last -= 1
        return first.start(), max(last, first.start())

    def matrix(self, before: str, text: str, size: int, is_last: bool) -> Matrix:
        """Transfer matrix of a chunk: its own ``size`` characters and as many behind it as a piece may take."""
        starts = self.states_across(before, text) if before else [(0, None)]
        found = self.cuts(text[:size])
        out: Matrix = {}
        if found is None:
            for s in starts:
                ends = self._ends(self.walk(text, 0, size, [s]), text, size, is_last)
                if ends:
                    out[s] = dict.fromkeys(ends, ALLOWED)
            return out
        a, b = found
        tail = {(0, None)} if is_last else self._ends(self.walk(text, b, size, [(b, None)]), text, size, is_last)
        for s in starts:
            if s[0] <= a and any(end == a for end, _ in self.walk(text, 0, a, [s])):
                out[s] = dict.fromkeys(tail, ALLOWED)
        return out

    def _ends(self, came: dict, text: str, size: int, is_last: bool) -> set[State]:
        """Reached states at the chunk's end; where a text or a unit ends there, all pieces that end there are one."""
        closed = is_last or text[size : size + 1] == MARK
        ends = {(end - size, piece) for end, piece in came if end >= size}
        return {(0, None) for end, _ in ends if end == 0} if closed else {s for s in ends if s[1] is not None}

    def states_across(self, before: str, text: str) -> list[State]:
        """Boundary states between the characters ``before`` and ``text``: pieces that begin before and end behind."""
        if text[:1] == MARK and before[-1:] != MARK:
            return [(0, None)]
        both, n, out = before + text[: self.longest], len(before), []
        for i in range(max(0, n - self.longest), n):
            for p in self.pieces_at(both, i):
                if i + len(p) >= n:
                    out.append((i + len(p) - n, p))
        return sorted(set(out))

    def trace(self, text: str, size: int, first: State, last: State) -> list[int]:
        """Ids of the pieces that end behind the first state and up to the last one."""
        found = self.cuts(text[:size])
        goal = (size + last[0], last[1])
        if found is None:
            return self._back(text, 0, size, first, goal)
        a, b = found
        head = self._back(text, 0, a, first, (a, None)) if first != (a, None) else []
        ids = head + self.encode_units(text[a:b])
        if last == (0, None):
            return ids + self.encode_units(text[b:size])
        return ids + self._back(text, b, size, (b, None), goal)

    def _back(self, text: str, start: int, stop: int, first: State, goal: State) -> list[int]:
        if first[1] is None and goal[1] is None:
            return self.encode_units(text[first[0] : goal[0]])
        came = self.walk(text, start, stop, [first])
        targets = [s for s in came if s == goal or (goal[1] is None and s[0] == goal[0])]
        # Keep the states from which the goal was reached; the path is unique.
        state, pieces = targets[0], []
        while state != first:
            source = sorted(came[state], key=str)[0]
            pieces.append((state, source))
            state = source
        ids: list[int] = []
        for (end, piece), source in reversed(pieces):
            if source[1] is None:  # marks between a unit's start and its first piece
                ids += self.marks_before(text[source[0] : end - len(piece)], end - len(piece) - source[0])
            ids += [self.ids[piece]] if piece in self.ids else [self.bytes[x] for x in piece.encode()]
        return ids

    # Whole texts ------------------------------------------------------------------------------------------------

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)

    def decode(self, ids: list[int]) -> str:
        """Text of ids; the blank that encoding puts before a text is taken off."""
        data = b"".join(map(self.text.__getitem__, ids))
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def chunks(self, normal: str, chunk: int) -> list[tuple[str, str, int]]:
        """(characters before, own characters and those a piece may take behind them, own size) of each chunk.

        A chunk never ends within or right behind blank marks.
        """
        out, at = [], 0
        while at < len(normal):
            to = min(len(normal), at + chunk)
            while to < len(normal) and normal[to - 1] == MARK:
                to += 1
            out.append((normal[max(0, at - self.longest) : at], normal[at : to + self.longest], to - at))
            at = to
        return out


@functools.cache
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encode_giant(e: PieceEncoder, text: str, chunk: int) -> list[int]:
    """The chunked way in one process, as the Spark jobs do it; for tests."""
    parts = e.chunks(e.normalise(text), chunk)
    matrices = [e.matrix(*p, i == len(parts) - 1) for i, p in enumerate(parts)]
    if not parts:
        return []
    states = boundary_states(matrices, (0, None), (0, None))
    return [x for (_, t, n), a, b in zip(parts, states[:-1], states[1:], strict=True) for x in e.trace(t, n, a, b)]


def _as_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


SCHEMA = "doc_id long, n_chunks int, n_pieces long, ids_crc32 long, round_trip boolean, ids binary"


def _encode_short(rows: DataFrame, model: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in slices(batches, "text", 1 << 20):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = (text or b"").decode("utf-8", "replace")
                ids = e.encode(text)
                data = _as_bytes(ids)
                out.append((doc_id, 1, len(ids), zlib.crc32(data), e.decode(ids) == text.replace(MARK, " "), data))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.record_batch(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")])

    return rows.mapInArrow(released(run), SCHEMA)


def _encode_long(spark: SparkSession, rows: DataFrame, model: str, chunk: int) -> DataFrame:
    scratch = Scratch(spark, "pieces")
    part_schema = "uid long, doc_id long, k int, n int, before string, text string, size int"

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for frame in frames:
            for uid, doc_id, text in zip(frame["uid"], frame["doc_id"], frame["text"], strict=True):
                parts = e.chunks(e.normalise(text), chunk)
                for k, (before, own, size) in enumerate(parts):
                    yield pd.DataFrame([(uid, doc_id, k, len(parts), before, own, size)], columns=[x.split()[0] for x in part_schema.split(", ")])

    numbered = rows.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id"), F.col("text").cast("string"))
    parts = scratch.write(numbered.mapInPandas(split, part_schema), "parts").repartition("uid", "k")

    def matrices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for f in frames:
            made = [pickle.dumps(e.matrix(b, t, s, k == n - 1)) for b, t, s, k, n in zip(f.before, f.text, f["size"], f.k, f.n, strict=True)]
            yield pd.DataFrame({"uid": f.uid, "k": f.k, "matrix": made})

    def scan(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("k")
        states = boundary_states([pickle.loads(m) for m in f.matrix], (0, None), (0, None))
        pairs = [pickle.dumps(x) for x in zip(states, states[1:], strict=False)]
        return pd.DataFrame({"uid": f.uid, "k": f.k, "states": pairs})

    made = parts.mapInPandas(matrices, "uid long, k int, matrix binary")
    states = made.groupBy("uid").applyInPandas(scan, "uid long, k int, states binary")  # matrices of one document

    def trace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(model)
        for f in frames:
            ids, same = [], []
            for own, size, pair in zip(f.text, f["size"], f.states, strict=True):
                a, b = pickle.loads(pair)
                found = e.trace(own, size, a, b)
                ids.append(_as_bytes(found))
                data = b"".join(map(e.text.__getitem__, found))
                same.append(data == own[a[0] : size + b[0]].replace(MARK, " ").encode())
            yield pd.DataFrame({"uid": f.uid, "doc_id": f.doc_id, "k": f.k, "same": same, "ids": ids})

    traced = parts.join(states, ["uid", "k"]).select("uid", "doc_id", "k", "text", "size", "states")
    traced = traced.mapInPandas(trace, "uid long, doc_id long, k int, same boolean, ids binary")

    def whole(f: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(f.sort_values("k").ids)
        return pd.DataFrame(
            {"doc_id": [f.doc_id.iloc[0]], "n_chunks": [len(f)], "n_pieces": [len(data) // 4], "ids_crc32": [zlib.crc32(data)],
             "round_trip": [bool(f.same.all())], "ids": [data]}
        )

    return traced.groupBy("uid").applyInPandas(whole, SCHEMA)


def encode_documents(spark: SparkSession, docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_chunks, n_pieces, ids_crc32, round_trip, ids) for every row: ids as the library encodes the text.

    round_trip tells that decoding the ids gives the text again (a blank mark in a text comes back as a blank). A null
    text counts as empty and has no ids. Rows that repeat, or have no id, are documents of their own. Only id and text
    are read.
    """
    rows = texts(docs).select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"), F.coalesce(F.length(text_col), F.lit(0)).alias("n"))
    short = _encode_short(rows.where(F.col("n") <= chunk).select("doc_id", "text"), model)
    return short.unionByName(_encode_long(spark, rows.where(F.col("n") > chunk).select("doc_id", "text"), model, chunk))


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model)
        for batch in slices(batches, "ids", 1 << 20):
            texts = [None if x is None else e.decode(np.frombuffer(x, "<u4").tolist()) for x in batch.column("ids").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(released(run), "doc_id long, text string")
