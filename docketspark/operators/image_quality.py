"""Sharpness, contrast, brightness and noise of page images."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.confidence import image_quality_score

DPI = 96.0


def gray_of(height: int, width: int, channels: int, data: bytes | pa.Buffer) -> np.ndarray:
    """Gray values of an image as Spark decodes it: rows of blue, green, red (and alpha) bytes."""
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(float)
    if channels == 1:
        return pixels[:, :, 0]
    return np.floor(pixels[:, :, 2] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 0] * 0.114 + 0.5)


def laplacian(gray: np.ndarray) -> np.ndarray:
    """Sum of the four neighbours less four times the pixel; beyond an edge the pixel before it is mirrored."""
    pad = [(1, 1) if n > 1 else (0, 0) for n in gray.shape]
    wide = np.pad(gray, pad, mode="reflect")
    wide = np.pad(wide, [(0, 0) if n > 1 else (1, 1) for n in gray.shape], mode="edge")
    return wide[:-2, 1:-1] + wide[2:, 1:-1] + wide[1:-1, :-2] + wide[1:-1, 2:] - 4 * gray


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of metrics for each picture; a batch holds some 64 MB of pictures, as Spark cuts batches by bytes, and one is worked on at a time."""
    names = ["origin", "sharpness", "contrast", "brightness", "noise", "height_inches", "width_inches"]
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            origin, h, w, channels = (batch.column(c)[k].as_py() for c in ("origin", "height", "width", "nChannels"))
            gray = gray_of(h, w, channels, batch.column("data")[k].as_buffer())
            edges = laplacian(gray)
            rows.append((origin, edges.var(), gray.std(), gray.mean(), np.abs(edges).mean() / 255.0, h / DPI, w / DPI))
        if rows:
            yield pa.record_batch([pa.array(c, pa.string() if n == "origin" else pa.float64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def image_quality_metrics(images: DataFrame) -> DataFrame:
    """Metrics of spark.read.format("image") rows; images that could not be decoded go."""
    pixels = images.select("image.*").where(F.col("height") > 0).select("origin", "height", "width", "nChannels", "data")
    return pixels.mapInArrow(_measure, "origin string, sharpness double, contrast double, brightness double, noise double, height_inches double, width_inches double")


def with_quality_score(metrics: DataFrame) -> DataFrame:
    return metrics.withColumn("quality_score", image_quality_score(*(F.col(c) for c in ("sharpness", "contrast", "brightness", "noise"))))
