"""Language identification by a bidirectional gated recurrent network over UTF-8 bytes.

The network reads windows of ``WINDOW`` bytes: one gated recurrent unit runs forwards and one backwards, and a linear
layer over both states labels every byte position with language probabilities. A document is cut into windows from
end to end, all of them are labelled, and the document's probabilities are the mean over all its positions. Training
is plain numpy: backpropagation through time with Adam, on crops of a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepstone.llm.common import released, slices, texts, utf8

#: Bytes that the states run through before they start anew.
WINDOW = 96
#: Windows that advance together at prediction.
LANES = 1536
#: What a document without a letter, or a null text, is called.
UNDETERMINED = "und"
#: What matches a letter.
LETTER = r"\p{L}"
#: Values of the hash by which texts are drawn.
DRAWS = 1 << 40


@dataclass
class ByteGru:
    """Parameters; axis 0 is the direction (forwards, backwards). Gates lie in the order z, r, n."""

    languages: list[str]
    w: np.ndarray  # 2 x 256 x 3H: input weights, a row for each byte value
    u: np.ndarray  # 2 x H x 3H
    b: np.ndarray  # 2 x 1 x 3H
    c: np.ndarray  # 2 x 1 x H: bias of the recurrent part of n
    v: np.ndarray  # 2 x H x L
    d: np.ndarray  # L

    @property
    def hidden(self) -> int:
        return self.u.shape[1]

    @staticmethod
    def init(languages: list[str], hidden: int, seed: int) -> ByteGru:
        rng = np.random.default_rng(seed)
        f = np.float32
        return ByteGru(
            languages,
            rng.normal(0, 0.3, (2, 256, 3 * hidden)).astype(f),
            rng.normal(0, hidden**-0.5, (2, hidden, 3 * hidden)).astype(f),
            np.zeros((2, 1, 3 * hidden), f),
            np.zeros((2, 1, hidden), f),
            rng.normal(0, 0.3, (2, hidden, len(languages))).astype(f),
            np.zeros(len(languages), f),
        )

    def states(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (2, T, B, H) for bytes x (2, T, B), of which [1] is reversed in time. keep: gets what training needs."""
        _, steps, lanes = x.shape
        n = self.hidden
        h = np.zeros((2, lanes, n), np.float32)
        out = np.empty((2, steps, lanes, n), np.float32)
        # A logistic function is 0.5 + 0.5 tanh(x / 2), so all gates go through tanh; halves are put into the weights.
        half = np.concatenate([np.full(2 * n, 0.5), np.ones(n)]).astype(np.float32)
        w, u = (self.w + self.b) * half, self.u * half
        for t in range(steps):
            a = np.stack([w[0][x[0, t]], w[1][x[1, t]]])
            g = np.matmul(h, u)
            zr = np.tanh(a[..., : 2 * n] + g[..., : 2 * n])
            zr *= 0.5
            zr += 0.5
            m = g[..., 2 * n :] + self.c
            new = np.tanh(a[..., 2 * n :] + zr[..., n:] * m)
            before = h
            h = new + zr[..., :n] * (h - new)
            out[:, t] = h
            if keep is not None:
                keep.append((before, zr, m, new))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """Probabilities (T, B, L) of every position for bytes x (T, B)."""
        h = self.states(np.stack([x, x[::-1]]))
        logits = h[0].reshape(-1, self.hidden) @ self.v[0] + h[1, ::-1].reshape(-1, self.hidden) @ self.v[1] + self.d
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits.reshape(*x.shape, -1)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy over all positions of windows x (T, B) with labels y (B), and its gradients."""
        steps, lanes = x.shape
        n, count = self.hidden, steps * lanes
        both, kept = np.stack([x, x[::-1]]), []
        h = self.states(both, kept)
        forth, back = h[0], h[1, ::-1]
        logits = forth @ self.v[0] + back @ self.v[1] + self.d
        logits -= logits.max(axis=-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=-1, keepdims=True)
        loss = float(-np.log(p[:, np.arange(lanes), y] + 1e-9).mean())
        p[:, np.arange(lanes), y] -= 1
        p /= count
        flat = p.reshape(count, -1)
        gv = np.stack([forth.reshape(count, n).T @ flat, back.reshape(count, n).T @ flat])
        gd = flat.sum(axis=0)
        gh = np.stack([p @ self.v[0].T, (p @ self.v[1].T)[::-1]])
        gw, gu = np.zeros_like(self.w), np.zeros_like(self.u)
        gb, gc = np.zeros_like(self.b), np.zeros_like(self.c)
        carry = np.zeros((2, lanes, n), np.float32)
        ut = self.u.transpose(0, 2, 1)
        for t in range(steps - 1, -1, -1):
            before, zr, m, new = kept[t]
            z, r = zr[..., :n], zr[..., n:]
            dh = gh[:, t] + carry
            dn = dh * (1 - z) * (1 - new * new)
            dz = dh * (before - new) * z * (1 - z)
            dr = dn * m * r * (1 - r)
            dm = dn * r
            da = np.concatenate([dz, dr, dn], axis=2)  # of the input's part
            dg = np.concatenate([dz, dr, dm], axis=2)  # of the state's part
            for k in (0, 1):
                order = np.argsort(both[k, t], kind="stable")
                values, first = np.unique(both[k, t][order], return_index=True)
                gw[k][values] += np.add.reduceat(da[k][order], first, axis=0)
            gu += np.matmul(before.transpose(0, 2, 1), dg)
            gb += da.sum(axis=1, keepdims=True)
            gc += dm.sum(axis=1, keepdims=True)
            carry = dh * z + np.matmul(dg, ut)
        return loss, [gw, gu, gb, gc, gv, gd]

    def parameters(self) -> list[np.ndarray]:
        return [self.w, self.u, self.b, self.c, self.v, self.d]


def train(
    texts: list[bytes], labels: list[str], hidden: int = 8, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 1
) -> ByteGru:
    """Fit on random windows; languages are drawn equally often. One language, or none, needs no training."""
    languages = sorted(set(labels))
    model = ByteGru.init(languages, hidden, seed)
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed)
    arrays = [np.frombuffer(t, np.uint8) for t in texts]
    groups = [[i for i, x in enumerate(labels) if x == name and len(texts[i])] for name in languages]
    groups_at = [k for k, g in enumerate(groups) if g]
    if len(groups_at) < 2:
        return model
    first = [np.zeros_like(p) for p in model.parameters()]
    second = [np.zeros_like(p) for p in model.parameters()]
    for step in range(1, steps + 1):
        y = rng.choice(groups_at, batch)
        x = np.full((WINDOW, batch), 32, np.uint8)
        for i, k in enumerate(y):
            a = arrays[groups[k][rng.integers(len(groups[k]))]]
            at = int(rng.integers(max(1, len(a) - WINDOW + 1)))
            part = a[at : at + WINDOW]
            x[: len(part), i] = part
        _, grads = model.gradients(x, y)
        norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
        now = rate * min(1.0, 10 * step / steps, 2 * (1 - step / (steps + 1)))
        for p, g, m, s in zip(model.parameters(), grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (norm + 1e-12))
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def document_probabilities(model: ByteGru, texts: list[bytes]) -> np.ndarray:
    """Mean over all positions of each whole text (documents x languages); a text without bytes gets zeros."""
    sizes = np.asarray([len(t) for t in texts], np.int64)
    total = np.zeros((len(texts), len(model.languages)))
    count = -(-sizes // WINDOW)
    ends = np.cumsum(count)
    n = int(ends[-1]) if len(ends) else 0
    if not n or not model.languages:
        return total
    padded = np.full(n * WINDOW, 32, np.uint8)
    for i, t in enumerate(texts):
        at = (ends[i] - count[i]) * WINDOW
        padded[at : at + sizes[i]] = np.frombuffer(t, np.uint8)
    windows = padded.reshape(n, WINDOW)
    owner = np.repeat(np.arange(len(texts)), count)
    length = np.full(n, WINDOW)
    has = count > 0
    length[ends[has] - 1] = sizes[has] - (count[has] - 1) * WINDOW
    at_step = np.arange(WINDOW)[:, None]
    for a in range(0, n, LANES):
        p = model.probabilities(np.ascontiguousarray(windows[a : a + LANES].T))
        p *= (at_step < length[a : a + LANES])[..., None]
        sums = p.sum(axis=0)
        for k in range(sums.shape[1]):
            total[:, k] += np.bincount(owner[a : a + LANES], sums[:, k], len(texts))
    return total / np.maximum(sizes, 1)[:, None]


def sample_rows(docs: DataFrame, text: Column, lang: Column, per_language: int, crop: int, languages: int) -> DataFrame:
    """(lang, crop of text): min(``per_language``, distinct texts) texts of each of the ``languages`` most frequent
    languages (ties by name), however often a text stands.

    Languages are counted over all rows; at most ``languages`` of them are kept, so they are broadcast. Texts are drawn in
    the order of their hash, and the crop starts at a hashed place. What is drawn from is how many different texts a
    language has, estimated without a shuffle of texts (HyperLogLog, 5 %): hashes beyond eight times the share that is
    needed go before the shuffle, so what is ranked doesn't grow with the rows or tasks of a frequent language.
    """
    rows = docs.select(text.alias("text"), lang.alias("lang")).where("lang is not null and text is not null").withColumn("h", F.xxhash64("text"))
    counted = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct("h", 0.05).alias("distinct"))
    most = counted.orderBy(F.desc("rows"), "lang").limit(languages)
    early = F.pmod("h", F.lit(DRAWS)) <= F.lit(8.0 * per_language * DRAWS) / F.greatest("distinct", F.lit(1))
    drawn = rows.join(F.broadcast(most), "lang").where(early).select(
        "lang",
        F.pmod("h", F.lit(DRAWS)).alias("draw"),
        "h",
        F.expr(f"substring(text, cast(1 + pmod(h, greatest(1, length(text) - {crop})) as int), {crop})").alias("text"),
    )
    one = drawn.groupBy("lang", "draw", "h").agg(F.min("text").alias("text"))  # copies of a text take one place
    first = one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "h")))
    return first.where(F.col("rank") <= per_language).select("lang", "text")


def fit(
    docs: DataFrame,
    learn: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 400,
    crop: int = 1500,
    languages: int = 64,
    **training,
) -> ByteGru:
    """Train on the rows where ``learn`` holds. The sample is bounded by ``per_language`` x ``languages`` x ``crop``."""
    rows = sample_rows(docs.where(learn), F.col(text_col), F.col(lang_col), per_language, crop, languages).collect()
    rows.sort(key=lambda r: (r["lang"], r["text"]))
    return train([r["text"].encode() for r in rows], [r["lang"] for r in rows], **training)


def predict(docs: DataFrame, model: ByteGru, keep: list[str], text_col: str = "text", prefix: str = "") -> DataFrame:
    """Columns ``keep`` of every row plus lang_pred and score (the pooled probability of lang_pred), both behind ``prefix``.

    Whole texts are read. A null text, or one without any letter, is ``und`` with score 0, as is every text if nothing
    could be learned. Ties go to the first language in alphabetical order. An empty table gives no row.
    """
    schema = docs.select(*keep).schema
    source = text_col if text_col in keep else "_ks_text"  # a text that is kept is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, source, 4 << 20):
            found = [t or b"" for t in batch.column(source).cast(pa.binary()).to_pylist()]
            letters = np.asarray(batch.column("_ks_letter").fill_null(False).to_pylist(), bool)
            p = document_probabilities(model, found)
            best = p.argmax(axis=1) if model.languages else np.zeros(len(found), int)
            letters &= bool(model.languages)
            names = [model.languages[k] if ok else UNDETERMINED for k, ok in zip(best, letters, strict=True)]
            score = np.where(letters, p.max(axis=1, initial=0), 0.0).clip(0, 1)
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.record_batch(
                [*columns, pa.array(names, pa.string()), pa.array(score, pa.float64())],
                names=[*keep, f"{prefix}lang_pred", f"{prefix}score"],
            )

    from pyspark.sql import types as T

    out = T.StructType([*schema.fields, T.StructField(f"{prefix}lang_pred", T.StringType()), T.StructField(f"{prefix}score", T.DoubleType())])
    narrow = texts(docs).select(*keep, *[utf8(text_col).alias(source)] * (source not in keep), F.col(text_col).rlike(LETTER).alias("_ks_letter"))
    return narrow.mapInArrow(released(run), out)
