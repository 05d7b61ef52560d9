"""Shared helpers of the training-data operators.

Every operator takes a DataFrame with (at least) the columns it names, selects
those columns first, and returns a fixed schema. Extra input columns, also ones
whose names clash with result columns, are therefore never an error: they are
dropped. A null text is an empty text unless an operator says otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..storage import shared_dir, written  # noqa: F401  (operators take them from here)

#: Text bytes handled at a time inside a Python worker, whatever Arrow's batch size is.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to clash with no column (letter case aside) of df, nor to begin one."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of `column` (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        i = batch.schema.get_field_index(column)
        size = batch.column(i).nbytes
        step = max(1, int(batch.num_rows * limit / max(size, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
