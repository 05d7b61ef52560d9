"""Frames to descriptors: dense arrays at the boundary of a pluggable model, one task's frames at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dense_frames(frames: DataFrame, width: int, height: int, background: int, slices: DataFrame) -> DataFrame:
    """(slice, frame): r, g, b planes in row order as bytes. Only active pixels are shuffled; a frame is as large as the sensor."""
    pixels = frames.groupBy("slice").agg(F.collect_list(F.struct("y", "x", "r", "g", "b")).alias("px"))
    src = slices.select("slice").join(pixels, "slice", "left").select("slice", "px.y", "px.x", "px.r", "px.g", "px.b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            cols = [batch.column(i) for i in range(1, 6)]
            for row in range(batch.num_rows):
                frame = np.full((3, height, width), background, np.uint8)
                if cols[0][row].is_valid:
                    y, x, r, g, b = (np.asarray(c[row].values) for c in cols)
                    frame[:, y.astype(int), x.astype(int)] = np.stack([r, g, b]).astype(np.uint8)
                out.append(frame.tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["slice", "frame"])

    return src.mapInArrow(run, "slice long, frame binary")


def cubic_weights(n_in: int, n_out: int, antialias: bool = True) -> np.ndarray:
    """Rows of separable cubic interpolation weights, pixel centres aligned at the edges of the image.

    With antialias the kernel (a = -0.5) widens by the scale when shrinking; without it, a = -0.75 and edge pixels repeat.
    """
    a = -0.5 if antialias else -0.75
    scale = n_in / n_out
    wide = max(scale, 1.0) if antialias else 1.0
    centre = (np.arange(n_out) + 0.5) * scale - 0.5
    at = np.arange(int(np.floor(centre.min() - 2 * wide)), int(np.ceil(centre.max() + 2 * wide)) + 1)
    d = np.abs(at[None, :] - centre[:, None]) / wide
    w = np.where(d <= 1, ((a + 2) * d - (a + 3)) * d * d + 1, np.where(d < 2, ((d - 5) * d + 8) * d * a - 4 * a, 0.0))
    out = np.zeros((n_out, n_in))
    inside = (at >= 0) & (at < n_in)
    if antialias:
        out[:, at[inside]] = w[:, inside]
        return out / out.sum(1, keepdims=True)
    np.add.at(out, (slice(None), np.clip(at, 0, n_in - 1)), w)
    return out


def model_input(frame: bytes, width: int, height: int, mean: list[float], std: list[float], size: tuple[int, int]) -> np.ndarray:
    """float32 [3, H, W]: over 255, normalised, then resized."""
    x = np.frombuffer(frame, np.uint8).reshape(3, height, width).astype(np.float32) / np.float32(255)
    x = (x - np.asarray(mean, np.float32)[:, None, None]) / np.asarray(std, np.float32)[:, None, None]
    rows, cols = cubic_weights(height, size[0]), cubic_weights(width, size[1])
    return np.einsum("oh,chw,pw->cop", rows, x, cols, optimize=True).astype(np.float32)


def extract(frames: DataFrame, model: Callable[[np.ndarray], np.ndarray], width: int, height: int, mean: list[float], std: list[float], size: tuple[int, int], batch_size: int = 16) -> DataFrame:
    """(slice, embedding): unit descriptors of (slice, frame) rows by a picklable model [n, 3, H, W] -> [n, D]."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, batch_size):
                part = batch.slice(a, batch_size)
                x = np.stack([model_input(f, width, height, mean, std, size) for f in part.column(1).to_pylist()])
                d = np.asarray(model(x), np.float32)
                d = d / np.maximum(np.linalg.norm(d, axis=1, keepdims=True), 1e-12)
                yield pa.record_batch([part.column(0), pa.array(list(d), pa.list_(pa.float32()))], names=["slice", "embedding"])

    return frames.select("slice", "frame").mapInArrow(run, "slice long, embedding array<float>")
