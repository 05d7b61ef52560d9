"""Tabular inputs by path: events, metadata, listings, ground truth, indexes. Explicit schemas, no inference."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.truth import must_be_empty
from .options import UNITS, StreamOptions


def read_events(spark: SparkSession, path: str, options: StreamOptions | None = None, fmt: str = "parquet") -> DataFrame:
    """Canonical events path, event_id, x, y, t (microseconds), p from Parquet, headerless CSV (columns by `order`), NPZ or HDF5 (with h5py)."""
    options = options or StreamOptions()
    keys = {k: k for k in "txyp"} | (options.keys or {})
    if fmt in ("npz", "hdf5"):
        from .hdf5 import Hdf5Events, library
        from .npz import NpzEvents

        if fmt == "hdf5":
            library()
        spark.dataSource.register(NpzEvents if fmt == "npz" else Hdf5Events)
        df = spark.read.format(f"{fmt}_events").option("keys", json.dumps(keys)).option("time_unit", options.time_unit or "us").load(path)
        return df if options.sensor_size is None else _on_sensor(df, options)
    if fmt == "csv":
        df = spark.read.csv(path, schema=", ".join(f"{c} double" for c in options.order)).withColumn("event_id", F.monotonically_increasing_id())
    else:
        df = spark.read.parquet(path)
        df = df if "event_id" in df.columns else df.withColumn("event_id", F.monotonically_increasing_id())
        df = df.withColumnsRenamed({v: k for k, v in keys.items()})
    scale = 1_000_000 / UNITS[options.time_unit or "us"]
    t = F.col("t").cast("long") if scale == 1 else F.floor(F.col("t") * scale).cast("long")
    df = df.select(F.col("_metadata.file_path").alias("path") if fmt == "parquet" else F.input_file_name().alias("path"), "event_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), t.alias("t"), F.col("p").cast("tinyint").alias("p"))
    return df if options.sensor_size is None else _on_sensor(df, options)


def _on_sensor(df: DataFrame, options: StreamOptions) -> DataFrame:
    width, height = options.sensor_size
    return df.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))


def folder_samples(events: DataFrame) -> DataFrame:
    """One sample a file: id, path, slice (null), start_ms, end_ms."""
    return events.groupBy("path").agg((F.min("t") / 1000.0).alias("start_ms"), (F.max("t") / 1000.0).alias("end_ms")).select(names.basename(F.col("path")).alias("id"), "path", F.lit(None).cast("long").alias("slice"), "start_ms", "end_ms")


def csv_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV with header, every column as text, so that written digits survive. Missing columns are an error."""
    df = spark.read.option("header", True).csv(path)
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"{path}: missing columns {sorted(missing)}")
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns])


def listing(spark: SparkSession, root: str, ext: str = ".png") -> DataFrame:
    """Paths below root that end in ext. Only the path column is read: file contents stay where they are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ext}").load(root).select("path")


def flat_images(places: DataFrame) -> DataFrame:
    """Nested (place_id, paths) as rows in a fixed order."""
    return places.select("place_id", F.posexplode("paths").alias("ord", "path")).orderBy("place_id", "ord")


def index_json(spark: SparkSession, path: str, least: int = 1, existing: DataFrame | None = None) -> DataFrame:
    """A custom place index, one JSON array [[place_id, [path, ...]], ...]: (place_id, path), checked.

    Ids are unique, places have `least` paths or more, and paths are in `existing` if that is given.
    """
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", "array<array<string>>")).alias("r")).select(F.col("r")[0].try_cast("long").alias("place_id"), F.from_json(F.col("r")[1], "array<string>").alias("paths"))
    must_be_empty(rows.where("place_id is null or paths is null").select("place_id"), "not a place index")
    must_be_empty(rows.groupBy("place_id").agg(F.count("*").alias("n")).where("n > 1"), "place ids must be unique")
    must_be_empty(rows.where(F.size("paths") < least).select("place_id"), f"a place has fewer than {least} images")
    out = rows.select("place_id", F.explode("paths").alias("path"))
    if existing is not None:
        must_be_empty(out.join(existing.select("path"), "path", "left_anti"), "an image doesn't exist")
    return out


def ground_truth_csv(spark: SparkSession, path: str) -> DataFrame:
    return csv_strings(spark, path, ["query_id", "reference_id"])


def ground_truth_npy(spark: SparkSession, path: str) -> DataFrame:
    """Cells (row, col, value) of a .npy matrix that are not 0, of a matrix read in blocks of rows by the tasks (see sources/npy.py).

    Its number of rows and columns is the shape that `matrix_shape` tells; nothing but the header comes to the driver.
    """
    from .npy import NpyCells

    spark.dataSource.register(NpyCells)
    return spark.read.format("npy_cells").load(path)


def matrix_shape(path: str) -> tuple[int, int]:
    from .npy import header

    return header(path).shape


def coordinates_npz(spark: SparkSession, path: str, conditions: list[str]) -> DataFrame:
    """(cond, slice, x, y, valid) of `{cond}_xy` and `{cond}_valid` arrays."""
    import numpy as np
    import pyarrow as pa

    parts = []
    with np.load(path, allow_pickle=False) as f:
        for c in conditions:
            xy, valid = np.asarray(f[f"{c}_xy"], np.float64), np.asarray(f[f"{c}_valid"], bool)
            if len(xy) != len(valid):
                raise ValueError(f"{c}: coordinates and validity of unequal length")
            parts.append(pa.table({"cond": [c] * len(xy), "slice": np.arange(len(xy)), "x": xy[:, 0], "y": xy[:, 1], "valid": valid}))
    return spark.createDataFrame(pa.concat_tables(parts))


def leading_offsets(raw_counts: DataFrame, coordinate_counts: DataFrame, measured: dict[str, int] | None = None) -> DataFrame:
    """(cond, offset, assumed): measured leading slices, else the difference of counts. A negative offset, or one that
    doesn't bring the lengths together, is an error."""
    spark = raw_counts.sparkSession
    known = spark.createDataFrame(list((measured or {}).items()), "cond string, m long")
    df = raw_counts.select("cond", F.col("n").alias("n_raw")).join(coordinate_counts.select("cond", F.col("n").alias("n_xy")), "cond").join(F.broadcast(known), "cond", "left")
    df = df.withColumn("offset", F.coalesce("m", F.col("n_raw") - F.col("n_xy")))
    must_be_empty(df.where((F.col("offset") < 0) | (F.col("n_raw") - F.col("offset") != F.col("n_xy"))), "slices and coordinates of unequal length")
    return df.select("cond", "offset", F.col("m").isNull().alias("assumed"))
