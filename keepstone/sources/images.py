"""Pictures that Spark itself can decode, as gray images and their measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from keepstone.sources.media import exposure, picture_hash, sharpness

#: Orientations of a header that swap width and height.
SWAPPED = (5, 6, 7, 8)


def image_features(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, exposure, sharpness, phash, error) of the pictures below a path.

    A picture that can't be decoded is a row with an error, not a failed run.
    """
    rows = spark.read.format("image").option("dropInvalid", "false").load(path)
    flat = rows.selectExpr("image.origin as path", "image.width as width", "image.height as height", "image.nChannels as channels", "image.data as data")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for p, w, h, c, data in zip(f.path, f.width, f.height, f.channels, f.data, strict=True):
                if w < 2 or h < 2 or c not in (1, 3, 4) or len(data) != w * h * c:
                    out.append((p, None, None, None, None, None, "can't be decoded"))
                    continue
                pixels = np.frombuffer(bytes(data), np.uint8).reshape(h, w, c)
                # Channels come as blue, green, red.
                gray = pixels[..., 0] if c == 1 else np.round(pixels[..., :3] @ np.asarray([0.114, 0.587, 0.299])).astype(np.uint8)
                out.append((p, w, h, exposure(gray), sharpness(gray), picture_hash(gray), None))
            yield pd.DataFrame(out, columns=["path", "width", "height", "exposure", "sharpness", "phash", "error"]).astype({"width": "Int32", "height": "Int32"})

    return flat.mapInPandas(run, "path string, width int, height int, exposure double, sharpness double, phash string, error string")


def upright(width: int, height: int, orientation: int | None) -> tuple[int, int]:
    return (height, width) if orientation in SWAPPED else (width, height)
