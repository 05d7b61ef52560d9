"""Training and evaluation transforms as compositions over dense frames in [0, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ordering import uniform
from . import noise
from .frames import flip, swap_polarity


def random_flip(frames: DataFrame, width: int, seed: int = 0, probability: float = 0.5) -> DataFrame:
    """A seeded share of the frames is mirrored."""
    mirror = uniform(f"flip{seed}", F.col("slice")) < probability
    return frames.withColumn("x", F.when(mirror, F.lit(width - 1) - F.col("x")).otherwise(F.col("x")))


def random_crop(frames: DataFrame, width: int, height: int, seed: int = 0, least: float = 0.5) -> DataFrame:
    """A seeded window of at least `least` of each side, scaled back to the frame by nearest pixels: one equi-join on the source pixel."""
    share = F.lit(least) + (1 - least) * uniform(f"size{seed}", F.col("slice"))
    box = frames.select("slice").distinct().select(
        "slice",
        F.greatest(F.floor(share * width), F.lit(1)).alias("w"),
        F.greatest(F.floor(share * height), F.lit(1)).alias("h"),
    )
    box = box.withColumns({"x0": F.floor(uniform(f"left{seed}", F.col("slice")) * (width - F.col("w") + 1)), "y0": F.floor(uniform(f"top{seed}", F.col("slice")) * (height - F.col("h") + 1))})
    grid = frames.sparkSession.range(width * height).select(F.floor(F.col("id") / width).alias("oy"), (F.col("id") % width).alias("ox"))
    to = box.crossJoin(F.broadcast(grid)).select("slice", "oy", "ox", (F.col("x0") + F.floor(F.col("ox") * F.col("w") / width)).cast("int").alias("x"), (F.col("y0") + F.floor(F.col("oy") * F.col("h") / height)).cast("int").alias("y"))
    return to.join(frames, ["slice", "y", "x"]).select("slice", F.col("oy").cast("int").alias("y"), F.col("ox").cast("int").alias("x"), "r", "g", "b")


def normalize(frames: DataFrame, mean: dict[str, float], std: dict[str, float]) -> DataFrame:
    return frames.select("slice", "y", "x", *[((F.col(c) - mean[c]) / std[c]).alias(c) for c in "rgb"])


def transforms(representation: str, mean: dict[str, float], std: dict[str, float], width: int, height: int, train: bool = True, domain_noise: bool = False, mirror: bool = True, seed: int = 0):
    """The list of (name, step) in order; normalisation comes last, since swapping normalised channels isn't swapping polarities."""
    steps = []
    if train:
        if domain_noise:
            f = noise.noise_for(representation)  # an error where noise isn't defined
            steps.append(("noise", lambda df: f(df, seed)))
        steps.append(("swap", lambda df: swap_polarity(df, seed)))
        if mirror:
            steps.append(("flip", lambda df: random_flip(df, width, seed)))
        steps.append(("crop", lambda df: random_crop(df, width, height, seed)))
    steps.append(("normalize", lambda df: normalize(df, mean, std)))
    return steps


def apply(frames: DataFrame, steps) -> DataFrame:
    for _, step in steps:
        frames = step(frames)
    return frames


__all__ = ["apply", "flip", "normalize", "random_crop", "random_flip", "swap_polarity", "transforms"]
