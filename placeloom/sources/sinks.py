"""Outputs, all through Spark's writers: a job's files appear together or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import param_hash
from ..functions.ordering import draw


def write_retrievals(ranked: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV query_id, reference_id, rank, score in query and rank order."""
    out = ranked.select("query_id", "reference_id", "rank", "score").orderBy("query_id", "rank")
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store the path names, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def write_metrics(spark: SparkSession, metrics: DataFrame | None, path: str) -> None:
    """Write them, or remove those of an earlier run without ground truth now."""
    if metrics is None:
        remove(spark, path)
    else:
        write_json(metrics, path)


def append_scalars(df: DataFrame, path: str) -> None:
    """A log of (step, metric, value) rows."""
    df.select("step", "metric", "value").write.mode("append").json(path)


def write_bank(df: DataFrame, path: str) -> None:
    """Descriptors (id, idx, embedding) sorted by position within files."""
    df.repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def cached_index(spark: SparkSession, root: str, name: str, params: dict, build, listing: DataFrame | None = None, refresh: bool = False, probes: int = 32) -> DataFrame:
    """A place index kept by the hash of its name and parameters; built again if asked, unreadable, or if a seeded sample of its
    paths has one that `listing` lacks."""
    from ..operators.sampling import probe

    path = f"{root.rstrip('/')}/{name}_{param_hash(params)}"
    if not refresh and exists(spark, f"{path}/_SUCCESS"):
        try:
            kept = spark.read.parquet(path)
            if listing is None or probe(kept.select("path").distinct(), listing, probes).isEmpty():
                return kept
        except Exception as e:  # an unreadable cache is built again
            if "AnalysisException" not in type(e).__name__ and "Py4J" not in type(e).__name__:
                raise
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_stats(spark: SparkSession, root: str, key: dict, build) -> dict:
    """One JSON row of statistics by key."""
    path = f"{root.rstrip('/')}/stats_{param_hash(key)}"
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").json(path)
    return json.loads(spark.read.text(path).first()[0])


def budgeted(images: DataFrame, max_images: int, seed: int = 0) -> DataFrame:
    """The images whose pixels are read for statistics: a limit before any pixel is."""
    return images.orderBy(draw(seed, F.col("path")), "path").limit(max_images)
