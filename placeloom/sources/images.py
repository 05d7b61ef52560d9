"""Image files at the edge: decode to planes, stand in for unreadable ones, write preview strips. PNG needs no library; others use Pillow if it is there."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import draw

try:
    from PIL import Image
except ImportError:  # not installed here
    Image = None

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Fixed values of the format: samples a pixel by colour type.
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """uint8 [3, H, W] of an 8-bit, non-interlaced PNG; grey is repeated, alpha goes. ValueError if it isn't one."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, head, body = 8, None, []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + size]
        if len(chunk) < size:
            raise ValueError("cut short")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None or head[2] != 8 or head[3] not in SAMPLES or head[6]:
        raise ValueError("unsupported PNG")
    width, height, n = head[0], head[1], SAMPLES[head[3]]
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    except zlib.error as e:
        raise ValueError("broken PNG") from e
    if len(raw) != height * (width * n + 1):
        raise ValueError("cut short")
    rows = raw.reshape(height, -1)
    out, above = np.zeros((height, width, n), np.uint8), np.zeros((width, n), np.int64)
    for y in range(height):
        how, line = rows[y, 0], rows[y, 1:].reshape(width, n).astype(np.int64)
        if how == 1:
            line = np.cumsum(line, axis=0)
        elif how == 2:
            line = line + above
        elif how in (3, 4):  # these depend on the pixel to the left after decoding
            left, corner = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for x in range(width):
                up = above[x]
                if how == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x], up
        elif how:
            raise ValueError("unknown row filter")
        above = line & 255
        out[y] = above
    planes = out.transpose(2, 0, 1)
    return np.repeat(planes[:1], 3, axis=0) if n < 3 else planes[:3]


def write_png(planes: np.ndarray) -> bytes:
    height, width = planes.shape[1:]
    rows = np.zeros((height, width * 3 + 1), np.uint8)
    rows[:, 1:] = planes.transpose(1, 2, 0).reshape(height, -1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


#: First bytes of whole formats that only Pillow reads.
OTHER_FORMATS = {b"\xff\xd8\xff": "JPEG", b"GIF8": "GIF", b"BM": "BMP", b"II*\0": "TIFF", b"MM\0*": "TIFF", b"RIFF": "WebP"}


class NoDecoder(RuntimeError):
    """An image of a format for which nothing is installed: not the same as an unreadable one."""


def decode(data: bytes | None) -> np.ndarray | None:
    """uint8 [3, H, W], or None if it can't be read. A format that only Pillow reads is an error where Pillow is absent."""
    if data and Image is None:
        for start, name in OTHER_FORMATS.items():
            if data.startswith(start):
                raise NoDecoder(f"{name} images need Pillow on the executors; without it only PNG is read")
    try:
        if data and data[:8] == SIGNATURE:
            return read_png(data)
        if data and Image is not None:
            return np.asarray(Image.open(io.BytesIO(data)).convert("RGB")).transpose(2, 0, 1)
    except (ValueError, OSError):
        pass
    return None


def read_images(files: DataFrame, content: str = "content") -> DataFrame:
    """path, height, width, frame (planes as bytes); the last three are null where a file can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                part = batch.slice(i, 16)
                got = [decode(x) for x in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array([g is not None and g.shape[1] or None for g in got], pa.int32()), pa.array([g is not None and g.shape[2] or None for g in got], pa.int32()), pa.array([None if g is None else g.tobytes() for g in got], pa.binary())], names=["path", "height", "width", "frame"])

    return files.select("path", content).mapInArrow(run, "path string, height int, width int, frame binary")


def with_substitutes(wanted: DataFrame, images: DataFrame, places: DataFrame, tries: int = 4, seed: int = 0) -> DataFrame:
    """Each wanted (place_id, path) with a readable path: its own, else one of `tries` seeded others of its place, else null.

    images: path, frame (null if unreadable); places: place_id, path. Frames aren't moved by the choice.
    """
    readable = images.where("frame is not null").select("path")
    own = wanted.join(readable.withColumn("ok", F.lit(True)), "path", "left")
    bad = own.where("ok is null").select("place_id", "path")
    order = Window.partitionBy("place_id", "path").orderBy(draw(seed, F.col("path"), F.col("other")), "other")
    others = bad.join(places.select("place_id", F.col("path").alias("other")), "place_id").where("other != path").withColumn("k", F.row_number().over(order)).where(F.col("k") <= tries)
    best = others.join(readable.withColumnRenamed("path", "other"), "other").groupBy("place_id", "path").agg(F.min(F.struct("k", "other")).alias("b")).select("place_id", "path", F.col("b.other").alias("used"))
    return own.where("ok").select("place_id", "path", F.col("path").alias("used")).unionByName(bad.join(best, ["place_id", "path"], "left"))


def preview_strips(ranked: DataFrame, frames: DataFrame, width: int, height: int, cell: tuple[int, int] = (224, 160)) -> DataFrame:
    """(query_id, png): the query window and its matches side by side. ranked is a small, chosen set; frames: id, frame."""
    rows = ranked.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id")).distinct().unionByName(ranked.select("query_id", "rank", F.col("reference_id").alias("id"))).join(frames, "id")
    strips = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "frame"))).alias("s")).select("query_id", "s.frame")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.arange(cell[1]) * height // cell[1], np.arange(cell[0]) * width // cell[0]
        for batch in batches:
            out = [write_png(np.concatenate([np.frombuffer(f, np.uint8).reshape(3, height, width)[:, y][:, :, x] for f in strip], axis=2)) for strip in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["query_id", "png"])

    return strips.mapInArrow(run, "query_id string, png binary")
