"""A Python data source for matrices in .npy files: a partition is a block of rows, found by its offset in the file.

spark.dataSource.register(NpyCells); spark.read.format("npy_cells").load(path)

Cells other than 0 are rows (row, col, value); a driver or task holds one block at most. It opens paths that the executors mount.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCK_BYTES = 16 << 20


@dataclass(frozen=True)
class Header:
    shape: tuple[int, int]
    dtype: np.dtype
    offset: int
    column_major: bool


def header(path: str) -> Header:
    """Shape, type and start of the data of a matrix of numbers; pickled objects are an error."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        shape, column_major, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
        if len(shape) != 2:
            raise ValueError("ground truth must be a matrix")
        if dtype.hasobject or dtype.kind not in "biuf":
            raise ValueError(f"a matrix of {dtype} holds no numbers")
        return Header(shape, dtype, f.tell(), column_major)


class Block(InputPartition):
    def __init__(self, at: int, to: int):
        self.at, self.to = at, to


class NpyCells(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_cells"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> DataSourceReader:
        return NpyReader(self.options["path"])


class NpyReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        h = header(self.path)
        lines, length = h.shape[::-1] if h.column_major else h.shape
        step = max(1, BLOCK_BYTES // max(1, length * h.dtype.itemsize))
        return [Block(a, min(lines, a + step)) for a in range(0, lines, step)]

    def read(self, partition: Block):
        h = header(self.path)
        length = h.shape[0] if h.column_major else h.shape[1]
        n = (partition.to - partition.at) * length
        lines = np.fromfile(self.path, h.dtype, n, offset=h.offset + partition.at * length * h.dtype.itemsize)
        if len(lines) < n:
            raise ValueError(f"{self.path}: cut short")
        at, to = np.nonzero(lines.reshape(-1, length))
        row, col = (to, at + partition.at) if h.column_major else (at + partition.at, to)
        value = lines[at * length + to].astype(np.float64)
        for k in range(0, len(row), 1 << 16):
            yield pa.record_batch([pa.array(x[k : k + (1 << 16)]) for x in (row, col, value)], names=["row", "col", "value"])
