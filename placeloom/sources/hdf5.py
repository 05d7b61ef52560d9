"""A Python data source for HDF5 recordings: a partition is a stretch of rows, so one file is read by many tasks.

spark.dataSource.register(Hdf5Events); spark.read.format("hdf5_events").option("keys", '{"t": "events/ts"}').load(folder)

It needs h5py where tasks run and where the plan is made; without it, that is the error. Datasets x, y, t, p are looked for below `group`
(events), then at the top. It opens paths that the executors mount. Convert once to Parquet (npz.to_parquet with fmt="hdf5_events") for repeated use.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .npz import SCHEMA, event_files
from .options import UNITS

ROWS, STRETCH = 1 << 16, 1 << 24


def library():
    try:
        import h5py
    except ImportError as missing:
        raise RuntimeError("HDF5 recordings need h5py, which isn't installed here; NPZ, CSV and Parquet recordings don't") from missing
    return h5py


class Rows(InputPartition):
    def __init__(self, path: str, at: int, to: int):
        self.path, self.at, self.to = path, at, to


class Hdf5Events(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hdf5_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return Hdf5Reader(dict(self.options))


class Hdf5Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.keys = json.loads(options.get("keys") or "{}")
        self.group = options.get("group") or "events"
        self.per_second = UNITS[options.get("time_unit") or "us"]

    def columns(self, file) -> dict:
        """The dataset of each column."""
        out = {}
        for c in "xytp":
            name = self.keys.get(c, c)
            place = next((p for p in (f"{self.group}/{name}", name) if p in file), None)
            if place is None:
                raise ValueError(f"{file.filename}: no dataset {name}")
            out[c] = file[place]
        if len({len(d) for d in out.values()}) > 1:
            raise ValueError(f"{file.filename}: columns of unequal length")
        return out

    def partitions(self):
        h5 = library()
        out = []
        for path in event_files(self.path):
            with h5.File(path, "r") as f:
                n = len(self.columns(f)["t"])
            out += [Rows(path, a, min(n, a + STRETCH)) for a in range(0, n, STRETCH)]
        return out

    def read(self, partition: Rows):
        with library().File(partition.path, "r") as f:
            columns = self.columns(f)
            for a in range(partition.at, partition.to, ROWS):
                x, y, t, p = (np.asarray(columns[c][a : min(partition.to, a + ROWS)]) for c in "xytp")
                t = t.astype(np.float64) * (1e6 / self.per_second) if t.dtype.kind == "f" else t.astype(np.int64) * 1_000_000 // self.per_second
                yield pa.record_batch(
                    [pa.array([partition.path] * len(x)), pa.array(np.arange(a, a + len(x))), pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32)), pa.array(t.astype(np.int64)), pa.array(p.astype(np.int8))],
                    names=["path", "event_id", "x", "y", "t", "p"],
                )
