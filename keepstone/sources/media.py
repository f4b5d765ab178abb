"""Decoders: package members as rows, container times, and pixel measures over decoded gray images."""

from __future__ import annotations

import functools
import io
import re
import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Seconds from the container epoch (1904) to the Unix epoch.
EPOCH_1904 = 2_082_844_800


def package_members(content: bytes) -> list[tuple[str, str, bytes]]:
    """(member, label, data) of the images in a ZIP package; labels come from its ``content.xml``."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            text = z.read("content.xml").decode("utf-8", "replace") if "content.xml" in names else ""
            labels = dict(re.findall(r'name="([^"]+)"[^>]*label="([^"]+)"', text))
            return [(n, labels.get(n, ""), z.read(n)) for n in sorted(names) if n.lower().endswith((".jpg", ".jpeg"))]
    except zipfile.BadZipFile:
        return []


def explode_packages(packages):
    """(package_sha, member, label, sha256, size) of packages (package_sha, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        for frame in frames:
            rows = [
                (sha, member, label, hashlib.sha256(data).hexdigest(), len(data))
                for sha, content in zip(frame["package_sha"], frame["content"], strict=True)
                for member, label, data in package_members(bytes(content))
            ]
            yield pd.DataFrame(rows, columns=["package_sha", "member", "label", "sha256", "size"])

    return packages.select("package_sha", "content").mapInPandas(run, "package_sha string, member string, label string, sha256 string, size long")


def container_seconds(content: bytes, last_year: int = 2100) -> int | None:
    """Creation time of an MP4 or MOV in Unix seconds from moov/mvhd, or None if absent or implausible."""

    def boxes(data: bytes) -> Iterator[tuple[bytes, bytes]]:
        at = 0
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            head = 8
            if size == 1 and at + 16 <= len(data):
                size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
            size = len(data) - at if size == 0 else size
            if size < head:
                return
            yield kind, data[at + head : at + size]
            at += size

    for kind, inner in boxes(content):
        if kind != b"moov":
            continue
        for name, body in boxes(inner):
            if name == b"mvhd" and len(body) >= 12:
                made = struct.unpack_from(">Q" if body[0] == 1 else ">I", body, 4)[0] - EPOCH_1904
                year = 1970 + made / 31_556_952
                return made if 1990 <= year <= last_year + 1 else None
    return None


@F.pandas_udf(T.LongType())
def container_time(content: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else container_seconds(bytes(c)) for c in content], dtype="Int64")


def exposure(gray: np.ndarray) -> float:
    """1 less twice the share of clipped pixels and the distance of the mean from 0.46, within 0 and 1."""
    clipped = float(((gray <= 4) | (gray >= 251)).mean())
    return max(0.0, min(1.0, 1 - 2 * clipped - abs(float(gray.mean()) / 255 - 0.46)))


def sharpness(gray: np.ndarray) -> float:
    """Variance of the four-neighbour Laplacian with mirrored borders."""
    p = np.empty((gray.shape[0] + 2, gray.shape[1] + 2))
    p[1:-1, 1:-1] = gray
    p[0], p[-1] = p[2], p[-3]
    p[:, 0], p[:, -1] = p[:, 2], p[:, -3]
    return float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())


@functools.cache
def _means(length: int) -> tuple[np.ndarray, np.ndarray]:
    """(32 x length zeros and ones, 32 lengths): which rows of an image each of 32 parts holds, and how many."""
    sizes = [len(part) for part in np.array_split(np.arange(length), 32)]
    held = np.repeat(np.eye(32), sizes, axis=1)
    return held, np.asarray(sizes, np.float64)


@functools.cache
def _cosines() -> np.ndarray:
    k = np.arange(32)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)


def picture_hash(gray: np.ndarray) -> str:
    """64-bit hash: 32 x 32 means, cosine transform, the 8 x 8 lowest frequencies against their median."""
    (rows, high), (cols, wide) = _means(gray.shape[0]), _means(gray.shape[1])
    # Sums of whole numbers are exact, so a mean is that of its pixels taken alone; a part without pixels is 0.
    small = (rows @ gray.astype(np.float64) @ cols.T) / np.maximum(np.outer(high, wide), 1)
    basis = _cosines()
    low = (basis @ small @ basis.T)[:8, :8]
    middle = np.partition(low, (31, 32), axis=None)[31:33]
    return np.packbits(low.ravel() > (middle[0] + middle[1]) / 2).tobytes().hex()


_FEATURES = T.StructType([T.StructField("exposure", T.DoubleType()), T.StructField("sharpness", T.DoubleType()), T.StructField("phash", T.StringType())])


@F.pandas_udf(_FEATURES)
def gray_features(width: pd.Series, height: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    """Measures of decoded gray images (bytes, row by row); null pixels or wrong sizes give nulls."""
    out = []
    for w, h, p in zip(width, height, pixels, strict=True):
        if p is None or len(p) != w * h or min(w, h) < 2:
            out.append((None, None, None))
            continue
        g = np.frombuffer(bytes(p), np.uint8).reshape(int(h), int(w))
        out.append((exposure(g), sharpness(g), picture_hash(g)))
    return pd.DataFrame(out, columns=["exposure", "sharpness", "phash"])
