"""Toxicity by weak supervision: voters, a generative model of their votes, and a linear classifier.

Voters are lexicon stems (beginnings of words, or whole words) at three densities, and a few fixed word lists and
patterns. Stems are mined from labelled rows. A label model explains all votes, and the labels as one more voter, by a
hidden truth: each voter has an accuracy on either side, and its correlation with one other voter is kept in a tree
(the spanning tree of greatest mutual information given the truth), fitted by expectation maximisation. A linear
classifier over densities of stems then learns the posterior, and scores whole texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepstone.llm.common import Scratch, released, segments, slices, texts, utf8

THRESHOLD = 0.5
#: Letters of the beginnings of words that can be stems; a word of at most ``LONGEST`` letters is one as a whole ("$").
BEGINNINGS = range(3, 9)
LONGEST = 24
#: Least share of the words that a stem takes, for each of its voters.
DENSITIES = (0.0, 0.005, 0.02)
#: Rows of label 1 that a stem needs. Its evidence (twice a log likelihood ratio) must exceed twice the logarithm of the
#: number of candidates, about what the best of so many stems without meaning would have.
LEAST_ROWS = 3
#: Bytes of a text that are read at a time.
SEGMENT = 1 << 18
_WORD = re.compile(r"[^\W\d_]+")

# Words of the lists that vote in any language.
INSULTS = frozenset("idiot idiots moron morons stupid loser losers scum trash pathetic worthless disgusting clown imbecile jerk dumb".split())
THREATS = frozenset("kill die hurt destroy beat hang shoot burn".split())
HATE = frozenset("hate hated hates despise vermin subhuman filth garbage".split())
LISTS = (INSULTS, THREATS, HATE)
_ADDRESS = re.compile(r"\byou(?:'re| are|r)? (?:an? |such |all |so )?")
PATTERNS = len(LISTS) + 4


@dataclass
class Reading:
    """What one text says: its words, how often each known stem begins one, and a share for each pattern."""

    words: int
    stems: np.ndarray
    patterns: np.ndarray


def stems_of(word: str) -> list[str]:
    found = [word[:n] for n in BEGINNINGS if n <= len(word)]
    return [*found, f"{word}$"] if len(word) <= LONGEST else found


class Reader:
    """Counts stems; words seen before are looked up, so a task's memory has a bound."""

    def __init__(self, stems: list[str], held: int = 1 << 17):
        self.place = {s: i for i, s in enumerate(stems)}
        self.known: dict[str, list[int]] = {}
        self.held = held

    def places(self, word: str) -> list[int]:
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= self.held:
                self.known.clear()
            found = self.known[word] = [self.place[s] for s in stems_of(word) if s in self.place]
        return found

    def read(self, data: bytes) -> Reading:
        stems = np.zeros(len(self.place), np.int64)
        marks = np.zeros(PATTERNS)
        words = letters = 0
        for piece in segments(data, SEGMENT):
            text = piece.decode("utf-8", "replace")
            low = text.lower()
            count = Counter(_WORD.findall(low))
            for word, n in count.items():
                words += n
                letters += n * len(word)
                for i in self.places(word):
                    stems[i] += n
                for k, names in enumerate(LISTS):
                    if word in names:
                        marks[k] += n
            at = len(LISTS)
            marks[at] += len(piece) - len(piece.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            marks[at + 1] += low.count("!!")
            marks[at + 2] += sum(1 for _ in _ADDRESS.finditer(low)) if "you" in low else 0
            marks[at + 3] += low.count("?!") + low.count("!?")
        marks /= max(words, 1)
        marks[len(LISTS)] *= max(words, 1) / max(letters, 1)
        return Reading(words, stems, marks)


def mined(data: bytes) -> dict[str, int]:
    """How dense each stem of a text is, as an index of ``DENSITIES``."""
    count: Counter[str] = Counter()
    for piece in segments(data, SEGMENT):
        count.update(_WORD.findall(piece.decode("utf-8", "replace").lower()))
    words = sum(count.values())
    stems: Counter[str] = Counter()
    for word, n in count.items():
        for s in stems_of(word):
            stems[s] += n
    return {s: sum(n >= d * words for d in DENSITIES) - 1 for s, n in stems.items()}


def crop(data: bytes, most: int, pieces: int = 16) -> bytes:
    """A text of over ``most`` bytes as evenly spaced pieces; learning reads no more of it."""
    if len(data) <= most:
        return data
    starts = np.linspace(0, len(data) - most // pieces, pieces).astype(int)
    return b" ".join(data[a : a + most // pieces] for a in starts.tolist())


@dataclass
class LabelModel:
    """P(truth) and, for each voter, P(vote | truth, vote of its parent); voters are numbered parents first."""

    prior: float
    parent: np.ndarray  # m; -1 for a voter without one
    table: np.ndarray  # m x 2 (truth) x 2 (parent's vote): probability of a vote
    annotator: np.ndarray = field(default_factory=lambda: np.asarray([0.02, 0.95]))  # P(label 1 | truth)

    def evidence(self, votes: np.ndarray) -> np.ndarray:
        """Log likelihood of the votes for truth 1 less that for truth 0."""
        total = np.zeros(len(votes))
        for i, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            one = self.table[i][:, given]
            log = np.log(np.where(votes[:, i] == 1, one, 1 - one))
            total += log[1] - log[0]
        return total

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """P(truth 1); a label of -1 isn't known."""
        says = np.stack([1 - self.annotator, self.annotator])  # label x truth
        log = np.log(says[:, 1] / says[:, 0])
        z = self.evidence(votes) + np.log(self.prior / (1 - self.prior)) + np.where(labels >= 0, log[np.maximum(labels, 0)], 0)
        return 0.5 + 0.5 * np.tanh(0.5 * z)


def _tree(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Parent of each voter in the spanning tree of the greatest mutual information given the truth."""
    m = votes.shape[1]
    gain = np.zeros((m, m))
    v = votes.astype(float)
    for w in (1 - q, q):
        total = w.sum() + 1e-9
        both = (v * w[:, None]).T @ v / total
        one = np.diag(both)
        for a in (0, 1):
            for b in (0, 1):
                pa_, pb = (one if a else 1 - one)[:, None], (one if b else 1 - one)[None]
                joint = both if a and b else one[:, None] - both if a else one[None] - both if b else 1 - one[:, None] - one[None] + both
                joint = np.maximum(joint, 1e-12)
                gain += total * joint * np.log(joint / np.maximum(pa_ * pb, 1e-12))
    parent = np.full(m, -1)
    if m < 2:
        return parent
    best, link, inside = gain[0].copy(), np.zeros(m, int), np.zeros(m, bool)
    inside[0] = True
    for _ in range(m - 1):
        i = int(np.where(inside, -np.inf, best).argmax())
        inside[i], parent[i] = True, link[i]
        closer = gain[i] > best
        link[closer & ~inside], best = i, np.maximum(best, gain[i])
    return parent


def fit_label_model(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 8) -> LabelModel:
    """Expectation maximisation from the labels outwards; the labels are the votes of an annotator who may err."""
    known = labels >= 0
    share = float((weight * (labels == 1)).sum() / max((weight * known).sum(), 1e-9))
    prior = min(max(share, 0.005), 0.98)
    q = np.where(known, np.where(labels == 1, 0.98, 0.01), prior)
    model = LabelModel(prior, np.full(votes.shape[1], -1), np.full((votes.shape[1], 2, 2), 0.5))
    for turn in range(rounds):
        if turn < 3:  # the tree settles before its tables do
            model.parent = _tree(votes, q)
        rate = np.stack([(1 - q) * weight, q * weight])
        for i, p in enumerate(model.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), int)
            alone = (rate @ votes[:, i] + 0.5) / (rate.sum(axis=1) + 1)
            for a in (0, 1):
                rows = rate * (given == a)
                # Few rows with this vote of the parent: the voter's own rate counts as two of them.
                model.table[i, :, a] = (rows @ votes[:, i] + 2 * alone) / (rows.sum(axis=1) + 2)
        model.table = model.table.clip(1e-4, 1 - 1e-4)
        seen = rate * known
        model.annotator = ((seen @ (labels == 1) + [0.2, 9.5]) / (seen.sum(axis=1) + 10)).clip(0.001, 0.999)
        q = model.posterior(votes, labels)
    return model


@dataclass
class ToxicityModel:
    stems: list[str]
    voters: list[tuple[int, float]]  # place of the stem, density
    label_model: LabelModel | None
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, readings: list[Reading]) -> np.ndarray:
        z = ((features(readings) - self.mean) / self.scale) @ self.weights + self.bias
        return 0.5 + 0.5 * np.tanh(0.5 * z)


def features(readings: list[Reading]) -> np.ndarray:
    words = np.maximum(np.asarray([r.words for r in readings], float), 1)[:, None]
    share = np.stack([r.stems for r in readings]) / words
    stands = share > 0
    dense = np.minimum(np.sqrt(share / DENSITIES[-1]), 2.0)
    kinds = np.log1p(np.stack([(share >= max(d, 1e-12)).sum(axis=1) for d in DENSITIES], axis=1))
    return np.concatenate([stands, dense, kinds, np.minimum(np.stack([r.patterns for r in readings]) * 20, 2.0)], axis=1)


def votes_of(readings: list[Reading], voters: list[tuple[int, float]]) -> np.ndarray:
    """A 0 or 1 of every voter for every text: stems first, then patterns."""
    if not readings:
        return np.zeros((0, len(voters) + PATTERNS), np.int8)
    words = np.asarray([r.words for r in readings])[:, None]
    stems = np.stack([r.stems for r in readings])
    place, density = np.asarray([p for p, _ in voters], int), np.asarray([d for _, d in voters])
    lexicon = (stems[:, place] > 0) & (stems[:, place] >= density * words)
    marks = np.stack([r.patterns for r in readings])
    least = np.asarray([0.0] * len(LISTS) + [0.5, 0.01, 0.01, 0.01])
    return np.concatenate([lexicon, marks > least], axis=1).astype(np.int8)


def _regress(x: np.ndarray, q: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Logistic regression on probabilities q by Newton steps, halved until the loss falls."""
    one = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    keep = np.full(one.shape[1], ridge)
    keep[-1] = 1e-6
    mean = float(np.clip((q * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    w = np.zeros(one.shape[1])
    w[-1] = np.log(mean / (1 - mean))

    def loss(w: np.ndarray) -> float:
        z = one @ w
        return float((weight * (np.logaddexp(0, z) - q * z)).sum() + 0.5 * (keep * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        p = 0.5 + 0.5 * np.tanh(0.5 * (one @ w))
        h = (one * (weight * p * (1 - p))[:, None]).T @ one
        step = np.linalg.solve(h + np.diag(keep), one.T @ (weight * (q - p)) - keep * w)
        size, then = 1.0, loss(w + step)
        while then > now and size > 1e-4:
            size /= 2
            then = loss(w + size * step)
        if now - then <= 1e-6 * abs(now):
            break
        w, now = w + size * step, then
    return w[:-1], float(w[-1])


def train(stems: list[str], voters: list[tuple[int, float]], readings: list[Reading], labels: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> ToxicityModel:
    """Label model, then classifier. Without labels of both kinds every score is the share of label 1 (none: 0)."""
    known = labels >= 0
    wide = 2 * len(stems) + len(DENSITIES) + PATTERNS
    if len(set(labels[known].tolist())) < 2:
        share = 0.98 if known.any() and labels.max() == 1 else 0.0
        bias = float(np.log(share / (1 - share))) if share else -50.0
        return ToxicityModel(stems, voters, None, np.zeros(wide), np.ones(wide), np.zeros(wide), bias)
    votes = votes_of(readings, voters)
    model = fit_label_model(votes[known], labels[known], weight[known])
    q = model.posterior(votes, np.full(len(votes), -1))  # the classifier learns what the voters tell, for unlabelled rows as well
    x = features(readings)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 0.05
    weights, bias = _regress((x - mean) / scale, q, weight, ridge)
    return ToxicityModel(stems, voters, model, mean, scale, weights, bias)


def pick_stems(rows: list[tuple[str, int, float]], most: int) -> list[tuple[str, int]]:
    """(stem, density) of the best candidates (stem, density, evidence); at each density a stem stands for all that begin
    it or that it begins."""
    picked: list[tuple[str, int]] = []
    taken: list[set[str]] = [set() for _ in DENSITIES]  # stems and their beginnings
    whole: list[set[str]] = [set() for _ in DENSITIES]
    for stem, level, _ in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        starts = {stem.rstrip("$")[:n] for n in range(1, len(stem.rstrip("$")) + 1)}
        if stem.rstrip("$") in taken[level] or starts & whole[level]:
            continue
        taken[level] |= starts
        whole[level].add(stem.rstrip("$"))
        picked.append((stem, level))
        if len(picked) == most:
            break
    return picked


def _candidates(rows: DataFrame, most_bytes: int, most: int, scratch: Scratch) -> list[tuple[str, int, float]]:
    """(stem, density, evidence) of the ``most`` stems that tell label 1 best, over labelled rows (label, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = mined(crop(text or b"", most_bytes))
                columns = [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int8()), pa.array([label] * len(found), pa.int8())]
                yield pa.record_batch(columns, names=["stem", "level", "label"])

    seen = rows.select("label", "text").mapInArrow(released(run), "stem string, level byte, label byte")
    totals = rows.agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n")).first()
    if not totals["p"] or not totals["n"]:
        return []
    sums = [
        F.struct(F.lit(k).alias("level"), F.sum(F.when(F.col("level") >= k, F.col("label")).otherwise(0)).alias("a"), F.sum(F.when(F.col("level") >= k, 1 - F.col("label")).otherwise(0)).alias("b"))
        for k in range(len(DENSITIES))
    ]
    each = seen.groupBy("stem").agg(F.array(*sums).alias("s")).select("stem", F.inline("s")).where(F.col("a") >= LEAST_ROWS)
    p, n = F.lit(float(totals["p"])), F.lit(float(totals["n"]))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    part = lambda x, t, of, whole: F.when(x > 0, x * F.log(x * (p + n) / (of * whole))).otherwise(0.0)
    both = a + b
    evidence = 2 * (part(a, both, both, p) + part(b, both, both, n) + part(p - a, both, p + n - both, p) + part(n - b, both, p + n - both, n))
    each = scratch.write(each, "candidates")
    told = each.where(a * n > b * p).select("stem", "level", evidence.alias("evidence")).where(F.col("evidence") >= 2 * math.log(max(each.count(), 2)))
    return [tuple(r) for r in told.orderBy(F.desc("evidence"), "stem", "level").limit(most).collect()]


def _readings(rows: DataFrame, stems: list[str], most_bytes: int) -> DataFrame:
    """(label, words, stems, patterns) of the rows of a sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(stems)
        for batch in slices(batches, "text", 1 << 20):
            found = [reader.read(crop(t or b"", most_bytes)) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("label"),
                pa.array([r.words for r in found], pa.int64()),
                pa.array([r.stems.astype("<i4").tobytes() for r in found], pa.binary()),
                pa.array([r.patterns.astype("<f8").tobytes() for r in found], pa.binary()),
            ]
            yield pa.record_batch(columns, names=["label", "words", "stems", "patterns"])

    return rows.select("label", "text").mapInArrow(released(run), "label int, words long, stems binary, patterns binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_rows: int = 3000,
    most_bytes: int = 1 << 17,
    most_stems: int = 256,
    ridge: float = 1.0,
) -> ToxicityModel:
    """Learn from a bounded sample where ``learn`` holds on the id column.

    The sample: the first ``most_rows`` ids of each label, and as many of any documents, by a hash of the id. Rows of the
    rarer label are weighed as they stand in the labels. A long text is read in pieces of ``most_bytes`` together. The ids
    are at most three times ``most_rows`` and are sent to all executors; the driver gets that many rows of
    ``most_stems`` counts. A null id or label says nothing, an id with two labels counts for both, and of rows that say
    the same one is learned from.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).dropna().where(learn).where("label in (0, 1)")
    known = known.select(F.col(id_col).alias("_ks_id"), "label")
    order = [F.xxhash64("_ks_id"), "_ks_id"]
    firsts = [known.where(F.col("label") == k).distinct().orderBy(*order).limit(most_rows) for k in (0, 1)]
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    named = docs.where(learn).select(F.col(id_col).alias("_ks_id")).where("_ks_id is not null")
    some = named.distinct().orderBy(*order).limit(most_rows).join(known, "_ks_id", "left")
    some = some.select("_ks_id", F.coalesce("label", F.lit(-1)).alias("label"))
    picked = firsts[0].unionByName(firsts[1]).unionByName(some).distinct()
    rows = texts(docs).select(F.col(id_col).alias("_ks_id"), utf8(text_col).alias("text")).join(F.broadcast(picked), "_ks_id").select("label", "text")
    rows = rows.where("text is not null").dropDuplicates(["label", "text"])
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = scratch.write(rows, "sample")
    found = _candidates(rows.where("label >= 0"), most_bytes, 8 * most_stems, scratch)
    chosen = pick_stems(found, most_stems)
    stems = sorted({s for s, _ in chosen})
    place = {s: i for i, s in enumerate(stems)}
    voters = [(place[s], DENSITIES[level]) for s, level in chosen]
    told = _readings(rows, stems, most_bytes).orderBy(F.xxhash64("stems", "words", "patterns"), "label").limit(3 * most_rows).collect()
    scratch.drop()
    told.sort(key=lambda r: (r["label"], r["words"], bytes(r["stems"]), bytes(r["patterns"])))
    readings = [Reading(r["words"], np.frombuffer(r["stems"], "<i4").astype(np.int64), np.frombuffer(r["patterns"], "<f8")) for r in told]
    said = np.asarray([r["label"] for r in told], int)
    drawn = Counter(said.tolist())
    weight = np.asarray([counts[k] / drawn[k] if k >= 0 else 1.0 for k in said.tolist()])
    if len(weight):
        weight /= weight[said >= 0].mean() if (said >= 0).any() else 1.0
    return train(stems, voters, readings, said, weight, ridge)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every row plus score (0 to 1) over the whole text, and predicted, behind ``prefix``.

    A null text counts as empty: no words. A text of any length is read in segments. An empty table gives no row. If
    labels of one kind only were there to learn from, every score is the same.
    """
    schema = docs.select(*keep).schema
    source = text_col if text_col in keep else "_ks_text"  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.stems)
        for batch in slices(batches, source, 1 << 20):
            p = model.score([reader.read(t or b"") for t in batch.column(source).cast(pa.binary()).to_pylist()])
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch(
                [*columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                names=[*keep, f"{prefix}score", f"{prefix}predicted"],
            )

    out = T.StructType([*schema.fields, T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    return texts(docs).select(*keep, *[utf8(text_col).alias(source)] * (source not in keep)).mapInArrow(released(run), out)
