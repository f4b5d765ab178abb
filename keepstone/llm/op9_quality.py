"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` bytes, cut from end to end. Each passage is described by hashed byte
pairs, how often pairs recur, and shares of byte kinds; a small encoder maps it to a vector; gated attention weighs
the passages; the weighted mean of the vectors gives the document's score. Only document labels are learned from:
the gradient reaches encoder and attention through the weighted mean. Training is numpy on a bounded sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keepstone.llm.common import released, slices, texts, utf8

PASSAGE = 512
BUCKETS = 256
#: Share of positives below which a score means label 0.
THRESHOLD = 0.3


def _pair_buckets() -> np.ndarray:
    """Bucket of each pair of bytes, by multiplicative hashing."""
    pair = np.arange(1 << 16, dtype=np.uint64)
    return ((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _kinds() -> np.ndarray:
    """Kind of each byte: lower case, upper case, digit, blank, line end, stop or comma, other ASCII, beyond ASCII."""
    kind = np.full(256, 6, np.int64)
    kind[128:] = 7
    for i, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,")):
        kind[[ord(c) for c in chars]] = i
    return kind


_BUCKET, _KIND = _pair_buckets(), _kinds()
FEATURES = BUCKETS + 8 + 3


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the number of passages of each text (an empty text has one, of zeros)."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    n = int(counts.sum())
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum(counts) - counts
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    owner = np.repeat(starts, sizes) + inside // PASSAGE
    follow = np.empty_like(data)
    follow[:-1] = data[1:]
    follow[np.cumsum(sizes)[sizes > 0] - 1] = 10  # a text ends as a line does
    pairs = np.bincount(owner * BUCKETS + _BUCKET[data.astype(np.int64) * 256 + follow], minlength=n * BUCKETS)
    pairs = pairs.reshape(n, BUCKETS).astype(np.float32)
    kinds = np.bincount(owner * 8 + _KIND[data], minlength=n * 8).reshape(n, 8).astype(np.float32)
    size = np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    again = (pairs * (pairs - 1)).sum(axis=1, keepdims=True) / np.maximum(size * (size - 1), 1)
    used = (pairs > 0).sum(axis=1, keepdims=True) / np.sqrt(size)
    x = np.concatenate([np.sqrt(pairs / size), kinds / size, np.log(again + 1e-4), used, np.log(size)], axis=1)
    return x.astype(np.float32), counts


@dataclass
class AttentionModel:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray  # F x H encoder
    b: np.ndarray
    v: np.ndarray  # H x A attention
    u: np.ndarray  # H x A its gate
    a: np.ndarray  # A
    c: np.ndarray  # H output
    d: np.ndarray  # 1

    @staticmethod
    def init(x: np.ndarray, hidden: int, attention: int, prior: float, seed: int) -> AttentionModel:
        rng = np.random.default_rng(seed)
        n = lambda *s: rng.normal(0, s[0] ** -0.5, s)
        return AttentionModel(
            x.mean(axis=0), x.std(axis=0) + 1e-3, n(x.shape[1], hidden), np.zeros(hidden), n(hidden, attention),
            n(hidden, attention), n(attention), n(hidden) * 0.1, np.asarray([np.log(prior / (1 - prior))]),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.b, self.v, self.u, self.a, self.c, self.d]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> tuple:
        starts = np.cumsum(counts) - counts
        h = np.tanh(((x - self.mean) / self.scale) @ self.w + self.b)
        t, g = np.tanh(h @ self.v), 0.5 + 0.5 * np.tanh(0.5 * (h @ self.u))
        e = (t * g) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        weight = e / np.repeat(np.add.reduceat(e, starts), counts)
        z = np.add.reduceat(h * weight[:, None], starts, axis=0)
        return 0.5 + 0.5 * np.tanh(0.5 * (z @ self.c + self.d)), h, t, g, weight, z, starts

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        p, h, t, g, weight, z, starts = self.forward(x, counts)
        loss = float(-np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-9)))
        dp = (p - y) / len(y)
        dz = np.repeat(dp[:, None] * self.c, counts, axis=0)
        along = (h * dz).sum(axis=1)
        de = weight * (along - np.repeat(np.add.reduceat(along * weight, starts), counts))
        dt, dg = de[:, None] * self.a * g * (1 - t * t), de[:, None] * self.a * t * g * (1 - g)
        dh = (dz * weight[:, None] + dt @ self.v.T + dg @ self.u.T) * (1 - h * h)
        scaled = (x - self.mean) / self.scale
        return loss, [scaled.T @ dh, dh.sum(axis=0), h.T @ dt, h.T @ dg, (t * g).T @ de, z.T @ dp, np.asarray([dp.sum()])]


def train(
    x: np.ndarray, counts: np.ndarray, y: np.ndarray, hidden: int = 24, attention: int = 12, epochs: int = 16,
    batch: int = 128, rate: float = 0.005, decay: float = 1e-3, seed: int = 3,
) -> AttentionModel:
    """Fit on bags; the prior is the share of label 1, kept off 0 and 1, so scores stay calibrated."""
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.02, 0.98))
    model = AttentionModel.init(x if len(x) else np.zeros((1, FEATURES)), hidden, attention, prior, seed)
    if len(np.unique(y)) < 2:
        model.c[:] = 0
        return model
    rng = np.random.default_rng(seed)
    starts = np.cumsum(counts) - counts
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    step, total = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            bags = order[at : at + batch]
            rows = np.concatenate([np.arange(starts[i], starts[i] + counts[i]) for i in bags])
            _, grads = model.gradients(x[rows], counts[bags], y[bags])
            step += 1
            now = rate * min(1.0, 2 * (1 - step / (total + 1)))
            for p, g, m, s in zip(model.parameters(), grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                p -= now * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8) + decay * p)
    return model


def _bag_rows(docs: DataFrame, most: int) -> DataFrame:
    """(label, n, features): passages of whole texts; of a long text ``most`` of them, evenly spaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            x, counts = passages([t or b"" for t in batch.column("text").to_pylist()])
            at, sizes, out = 0, [], []
            for n in counts.tolist():
                pick = at + np.unique(np.linspace(0, n - 1, min(n, most)).astype(int))
                sizes.append(len(pick))
                out.append(x[pick].astype("<f2").tobytes())
                at += n
            yield pa.record_batch(
                [batch.column("label"), pa.array(sizes, pa.int32()), pa.array(out, pa.binary())],
                names=["label", "n", "features"],
            )

    return texts(docs).select("label", "text").mapInArrow(released(run), "label int, n int, features binary")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    most_rows: int = 4000,
    most_passages: int = 16,
    **training,
) -> AttentionModel:
    """Train on at most ``most_rows`` labelled rows (first by a hash of the id) where ``learn`` holds on the id column.

    A null id or label takes no part; an id with two labels counts for both, as does one that stands for several texts.
    The picked ids are at most ``most_rows``, so they are sent to all executors. Of the rows that carry them, the first
    ``most_rows`` by a hash of their features go on, so the driver gets at most ``most_rows`` x ``most_passages`` passages.
    """
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("label")).dropna().where(learn)
    known = known.where("label in (0, 1)").orderBy(F.xxhash64(F.col(id_col)), "label").limit(most_rows)
    known = known.select(F.col(id_col).alias("_ks_id"), "label")
    rows = docs.select(F.col(id_col).alias("_ks_id"), utf8(text_col).alias("text")).join(F.broadcast(known), "_ks_id")
    bags = _bag_rows(rows, most_passages)
    found = bags.orderBy(F.xxhash64("features", "label"), "features", "label").limit(most_rows).collect()
    found.sort(key=lambda r: (r["label"], bytes(r["features"])))
    if not found:
        return train(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0))
    x = np.frombuffer(b"".join(r["features"] for r in found), "<f2").astype(np.float32).reshape(-1, FEATURES)
    return train(x, np.asarray([r["n"] for r in found]), np.asarray([r["label"] for r in found], float), **training)


def score(docs: DataFrame, model: AttentionModel, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every row plus score (0 to 1) over all passages of the whole text, and predicted, behind ``prefix``.

    A null text counts as empty: one passage of zeros. An empty table gives no row. If labels of one kind only were
    there to learn from, every score is that prior.
    """
    schema = docs.select(*keep).schema
    source = text_col if text_col in keep else "_ks_text"  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source, 1 << 20):
            x, counts = passages([t or b"" for t in batch.column(source).cast(pa.binary()).to_pylist()])
            p = model.forward(x, counts)[0].astype(np.float64)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch(
                [*columns, pa.array(p, pa.float64()), pa.array((p >= THRESHOLD).astype(np.int32), pa.int32())],
                names=[*keep, f"{prefix}score", f"{prefix}predicted"],
            )

    out = T.StructType([*schema.fields, T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    return texts(docs).select(*keep, *[utf8(text_col).alias(source)] * (source not in keep)).mapInArrow(released(run), out)
