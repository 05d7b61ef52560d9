"""Command line: ranks the windows of one recording against another's.

python -m placeloom --reference ref.npz --query qry.npz --sensor 346x260 --top-k 5 --output results/a_b
"""

from __future__ import annotations

import argparse
import importlib
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession

#: Format by ending; folders and anything else are Parquet unless --format says otherwise.
FORMATS = {".npz": "npz", ".csv": "csv", ".h5": "hdf5", ".hdf5": "hdf5"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="placeloom", description="Rank event windows of a query recording against a reference recording.")
    p.add_argument("--reference", required=True)
    p.add_argument("--query", required=True)
    p.add_argument("--format", choices=("parquet", "csv", "npz", "hdf5"), help="of both recordings; by their ending if left out")
    p.add_argument("--sensor", required=True, help="WIDTHxHEIGHT")
    p.add_argument("--window-ms", type=float, default=50.0)
    p.add_argument("--time-unit", choices=("s", "ms", "us", "ns"))
    p.add_argument("--representation", default="accumulate", choices=("accumulate", "countmask", "tencode"))
    p.add_argument("--hot-pixel-filter", action="store_true")
    p.add_argument("--model", help="package.module:callable from float32 frames [n, 3, h, w] to vectors [n, d]; channel means if left out")
    p.add_argument("--descriptor-dir", help="keep descriptors here")
    p.add_argument("--ground-truth", help="CSV query_id,reference_id, or a .npy matrix")
    p.add_argument("--gt-layout", default="reference-query", choices=("reference-query", "query-reference"))
    p.add_argument("--top-k", type=int, default=5)
    p.add_argument("--save-previews", type=int, default=0, help="rank a seeded sample of so many query windows only")
    p.add_argument("--output", help="results/<reference>_<query> if left out")
    return p


def size_of(text: str) -> tuple[int, int]:
    width, _, height = text.lower().partition("x")
    if not (width.isdigit() and height.isdigit()):
        raise SystemExit(f"--sensor takes WIDTHxHEIGHT, not {text!r}")
    return int(width), int(height)


def model_of(name: str | None):
    from .plans.workflow import mean_model

    if name is None:
        return mean_model
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def run(spark: SparkSession, arguments: list[str] | None = None):
    """The workflow's result; files go to the output folder."""
    from .operators import slicing, truth
    from .plans import workflow
    from .sources import tables
    from .sources.options import StreamOptions

    a = parser().parse_args(arguments)
    options = StreamOptions(window_ms=a.window_ms, sensor_size=size_of(a.sensor), time_unit=a.time_unit, hot_pixel_filter=a.hot_pixel_filter)

    def events(path: str) -> DataFrame:
        return tables.read_events(spark, path, options, a.format or FORMATS.get(PurePosixPath(path).suffix.lower(), "parquet"))

    reference, query = events(a.reference), events(a.query)
    gt = None
    if a.ground_truth and a.ground_truth.endswith(".npy"):
        sides = [slicing.sample_table(e, options.window_us, options.offset_us).select("id", "slice").withColumnRenamed("slice", "idx") for e in (reference, query)]
        gt = truth.edges_from_matrix(tables.ground_truth_npy(spark, a.ground_truth), *sides, a.gt_layout, tables.matrix_shape(a.ground_truth))
    elif a.ground_truth:
        gt = tables.ground_truth_csv(spark, a.ground_truth)
    stem = lambda path: PurePosixPath(path).stem
    output = a.output or f"results/{stem(a.reference)}_{stem(a.query)}"
    return workflow.retrieve(reference, query, options, a.representation, model_of(a.model), top_k=a.top_k, ground_truth=gt, preview=a.save_previews, output=output, bank_dir=a.descriptor_dir, names=(a.reference, a.query), model_name=a.model or "mean")


def main() -> None:
    spark = SparkSession.builder.appName("placeloom").getOrCreate()
    result = run(spark)
    if result.metrics is not None:
        print(result.metrics.first().asDict())
    spark.stop()
