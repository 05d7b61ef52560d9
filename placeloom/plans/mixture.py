"""Training mixtures: named streams of places, their checks, statistics and batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import sampling, stats
from ..sources import sinks


@dataclass(frozen=True)
class StreamSpec:
    """name; build(root) -> (place_id, path); subdirs to look for below the data root, and the part `below` them that is training data; groups
    cycle epochs if place_group is built too."""

    name: str
    build: Callable[[str], DataFrame]
    subdirs: tuple[str, ...] = ("",)
    ext: str = ".png"
    cycle_groups: bool = False
    below: str = ""


def resolve_root(spark: SparkSession, base: str, spec: StreamSpec) -> str:
    """The first of subdirs (with jpg/ before the bare folder) that exists."""
    for sub in spec.subdirs:
        for path in ("/".join(p for p in (base.rstrip("/"), sub, tail, spec.below) if p) for tail in ("jpg", "")):
            if sinks.exists(spark, path):
                return path
    raise FileNotFoundError(f"{spec.name}: none of {spec.subdirs} is below {base}")


def extension(spec: StreamSpec, forced: str | None = None, by_stream: dict[str, str] | None = None) -> str:
    """Forced for all, else given for the stream, else the stream's own."""
    return forced or (by_stream or {}).get(spec.name) or spec.ext


def build(spark: SparkSession, base: str, specs: list[StreamSpec], p: int, k: int, seed: int = 0) -> dict[str, DataFrame]:
    """All roots are resolved before any tree is walked. Returns images (stream, place_id, path), ranges, overlaps (a warning, ids are
    unique within a stream), summary and batches (stream, batch, slot, place_id, pick, path)."""
    roots = {s.name: resolve_root(spark, base, s) for s in specs}
    images = batches = None
    for s in specs:
        own = s.build(roots[s.name])
        if own.isEmpty():
            raise ValueError(f"{s.name}: the index is empty")
        tagged = own.select(F.lit(s.name).alias("stream"), "place_id", "path")
        images = tagged if images is None else images.unionByName(tagged)
        drawn = sampling.pk_batches(own, p, k, seed).withColumn("stream", F.lit(s.name))
        batches = drawn if batches is None else batches.unionByName(drawn)
    ranges = stats.id_ranges(images)
    return {"images": images, "ranges": ranges, "overlaps": stats.id_overlaps(ranges), "summary": stats.stream_summary(images, p), "batches": batches}


def resolve_stats(spark: SparkSession, root: str, key: dict, images: DataFrame, pixels: Callable[[DataFrame], DataFrame], max_images: int, streams: int, seed: int = 0) -> dict:
    """Channel statistics over an even, seeded budget of images, kept by key. pixels: images -> (r, g, b) rows, read for the chosen images only."""

    def work():
        chosen = sampling.even_budget(images, max_images, streams, seed)
        return stats.channel_stats(pixels(chosen), ["r", "g", "b"]).groupBy().pivot("channel", ["r", "g", "b"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std"))

    return sinks.cached_stats(spark, root, key, work)
