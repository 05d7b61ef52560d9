"""The retrieval workflow: recordings to ranked windows, metrics and files."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import param_hash
from ..operators import descriptors, frames, metrics, retrieval, sampling, slicing, truth
from ..sources import sinks
from ..sources.options import StreamOptions


@dataclass
class Result:
    """ranked: query_id, reference_id, rank, score; samples of both sides; metrics: one row or None."""

    ranked: DataFrame
    references: DataFrame
    queries: DataFrame
    metrics: DataFrame | None


def mean_model(x: np.ndarray) -> np.ndarray:
    """The smallest descriptor: channel means."""
    return x.mean(axis=(2, 3))


def samples_and_bank(events: DataFrame, options: StreamOptions, representation: str, model, size: tuple[int, int], mean=(0.0, 0.0, 0.0), std=(1.0, 1.0, 1.0)) -> tuple[DataFrame, DataFrame]:
    """(samples, bank (id, embedding)) of one continuous recording."""
    if representation not in ("accumulate", "countmask", "tencode"):
        raise ValueError(f"unsupported representation {representation!r}")
    if options.sensor_size is None:
        raise ValueError("sensor_size is needed to render")
    width, height = options.sensor_size
    samples = slicing.sample_table(events, options.window_us, options.offset_us)
    sliced = frames.in_bounds(slicing.with_slice(events, options.window_us, options.offset_us), width, height)
    if options.hot_pixel_filter:
        sliced = frames.without_hot_pixels(sliced)
    dense = descriptors.dense_frames(frames.render(representation, sliced), width, height, frames.RENDERERS[representation][1], samples)
    bank = descriptors.extract(dense, model, width, height, list(mean), list(std), size)
    return samples, bank.join(samples.select("slice", "id"), "slice").select("id", F.col("slice").alias("idx"), "embedding")


def cached_bank(spark: SparkSession, root: str | None, inputs: dict, build) -> DataFrame:
    """Descriptors kept under a hash of everything they depend on."""
    if root is None:
        return build()
    path = f"{root.rstrip('/')}/bank_{param_hash(inputs)}"
    if not sinks.exists(spark, f"{path}/_SUCCESS"):
        sinks.write_bank(build(), path)
    return spark.read.parquet(path)


def retrieve(reference: DataFrame, query: DataFrame, options: StreamOptions, representation: str = "accumulate", model=mean_model, size: tuple[int, int] = (8, 8), top_k: int = 10, ground_truth: DataFrame | None = None, preview: int = 0, seed: int = 0, output: str | None = None, bank_dir: str | None = None, names: tuple[str, str] = ("reference", "query"), model_name: str = "mean") -> Result:
    """Top-k reference windows of every query window. ground_truth: (query_id, reference_id) ids; preview: only so many seeded query windows.

    names identify the two recordings for the descriptor cache (use their paths).
    """
    spark = reference.sparkSession
    key = {"options": asdict(options), "representation": representation, "model": model_name, "size": list(size)}
    sides = []
    for events, name in ((reference, names[0]), (query, names[1])):
        samples, bank = samples_and_bank(events, options, representation, model, size)
        sides.append((samples, cached_bank(spark, bank_dir, key | {"recording": name}, lambda bank=bank: bank)))
    (ref_samples, ref_bank), (qry_samples, qry_bank) = sides
    if preview:
        chosen = sampling.subset(qry_samples, preview, seed, key="id")
        qry_samples, qry_bank = chosen, qry_bank.join(chosen.select("id"), "id", "left_semi")
    ranked = retrieval.topk(ref_bank, qry_bank, max(top_k, max(metrics.KS)) if ground_truth is not None else top_k)
    measured = None
    if ground_truth is not None:
        wanted = ground_truth.join(qry_samples.select(F.col("id").alias("query_id")), "query_id", "left_semi") if preview else ground_truth
        edges = truth.edges_from_pairs(wanted, ref_samples, qry_samples)
        measured = metrics.recall(metrics.hits(ranked, edges, qry_samples.select(F.col("id").alias("query_id"))))
    ranked = ranked.where(F.col("rank") <= top_k)
    if output:
        sinks.write_retrievals(ranked, f"{output}/retrievals.csv")
        tag = lambda df, side: df.withColumn("side", F.lit(side))
        sinks.write_json(tag(ref_samples, "reference").unionByName(tag(qry_samples, "query")), f"{output}/samples.json")
        run = {k: str(v) for k, v in (key | {"top_k": top_k, "reference": names[0], "query": names[1], "ground_truth": ground_truth is not None}).items()}
        sinks.write_json(spark.createDataFrame([run]), f"{output}/run.json")
        sinks.write_metrics(spark, measured, f"{output}/metrics.json")
    return Result(ranked, ref_samples, qry_samples, measured)


def run_pooled(banks: dict[str, DataFrame], query: str, databases: list[str], radius: float = 25.0, ks: tuple[int, ...] = (1,)) -> DataFrame:
    """One traverse against the union of others. banks: cond -> (slice, embedding, x, y, valid). One row: r_at_k, nq, nr, scorable."""
    parts = [banks[c].where("valid").select(F.concat_ws(":", F.lit(c), F.col("slice")).alias("id"), "embedding", F.col("x").alias("easting"), F.col("y").alias("northing")) for c in [query, *databases]]
    q, db = parts[0], parts[1]
    for p in parts[2:]:
        db = db.unionByName(p)
    edges = truth.radius_edges_float32(db, q, radius)
    per = metrics.hits(retrieval.topk(db, q, max(ks)), edges, q.select(F.col("id").alias("query_id")), ks)
    return metrics.recall_training(per, ks).crossJoin(per.agg(F.count("*").alias("nq"), F.sum("scorable").cast("long").alias("scorable"))).crossJoin(db.agg(F.count("*").alias("nr")))
