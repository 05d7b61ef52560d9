"""A Python data source for NPZ recordings: one partition a file, Arrow batches of events.

spark.dataSource.register(NpzEvents); spark.read.format("npz_events").option("keys", '{"t": "ts"}').load(folder)

It opens paths that the executors mount (the format has no Spark reader). Convert once to Parquet for repeated use.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .options import UNITS

SCHEMA = "path string, event_id long, x int, y int, t long, p tinyint"
ROWS = 1 << 16


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def event_files(path: str) -> list[str]:
    """The file, or the sorted regular files of a folder that aren't hidden."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    found = sorted(str(x) for x in p.iterdir() if x.is_file() and not x.name.startswith(".")) if p.is_dir() else [str(p)]
    if not found:
        raise ValueError(f"no event files in {path}")
    return found


class NpzEvents(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npz_events"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NpzReader(dict(self.options))


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.keys = {k: k for k in "txyp"} | json.loads(options.get("keys") or "{}")
        self.per_second = UNITS[options.get("time_unit") or "us"]

    def partitions(self):
        return [File(p) for p in event_files(self.path)]

    def read(self, partition: File):
        with np.load(partition.path, allow_pickle=False) as f:
            x, y, t, p = (np.asarray(f[self.keys[k]]) for k in "xytp")
        if not len(x) == len(y) == len(t) == len(p):
            raise ValueError(f"{partition.path}: columns of unequal length")
        t = t.astype(np.float64) * (1e6 / self.per_second) if t.dtype.kind == "f" else t.astype(np.int64) * 1_000_000 // self.per_second
        for a in range(0, len(x), ROWS):
            s = slice(a, a + ROWS)
            n = len(x[s])
            yield pa.record_batch(
                [pa.array([partition.path] * n), pa.array(np.arange(a, a + n)), pa.array(x[s].astype(np.int32)), pa.array(y[s].astype(np.int32)), pa.array(t[s].astype(np.int64)), pa.array(p[s].astype(np.int8))],
                names=["path", "event_id", "x", "y", "t", "p"],
            )


def to_parquet(spark, source: str, destination: str, fmt: str = "npz_events", **options) -> None:
    """Convert recordings once; rows sorted by time, so row groups skip. fmt: a registered source of events."""
    spark.dataSource.register(NpzEvents)
    df = spark.read.format(fmt).options(**options).load(source)
    df.repartitionByRange("path", "t").sortWithinPartitions("path", "t", "event_id").write.mode("overwrite").parquet(destination)
