"""Event-noise augmentation of dense frames in [0, 1] (long form), with seeded draws.

gain: count intensity of a frame times a factor in [lo, hi]. dropout: pixels become background at a rate up to
dropout_max. salt: pixels get one event of either polarity at a rate up to salt_prob. One event is worth the frame's
smallest non-zero intensity of the polarity channels (1/255 in an empty frame).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import uniform


def _clamp(v: Column) -> Column:
    return F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))


def _draws(seed: int, gain: tuple[float, float], dropout_max: float, salt_prob: float) -> tuple[Column, Column, Column, Column]:
    s, y, x = F.col("slice"), F.col("y"), F.col("x")
    factor = F.lit(gain[0]) + (gain[1] - gain[0]) * uniform(f"gain{seed}", s) if gain[1] > gain[0] else F.lit(1.0)
    drop = uniform(f"drop{seed}", s, y, x) < uniform(f"rate{seed}", s) * dropout_max
    salt = uniform(f"salt{seed}", s, y, x) < uniform(f"amount{seed}", s) * salt_prob
    return factor, drop, salt, uniform(f"sign{seed}", s, y, x) < 0.5


def _unit(low: Column) -> Column:
    """The frame's least non-zero intensity: a window over one frame's pixels, as many as the sensor has."""
    return F.coalesce(F.min(low).over(Window.partitionBy("slice")), F.lit(1.0 / 255.0))


def _least_positive(*values: Column) -> Column:
    return F.least(*[F.when(v > 0, v) for v in values])


def countmask_noise(frames: DataFrame, seed: int = 0, gain: tuple[float, float] = (0.7, 1.4), dropout_max: float = 0.15, salt_prob: float = 0.005) -> DataFrame:
    """Black background: red and blue counts, green activity."""
    factor, drop, salt, positive = _draws(seed, gain, dropout_max, salt_prob)
    out = frames.select("slice", "y", "x", *[F.when(drop, F.lit(0.0)).otherwise(v).alias(c) for c, v in (("r", F.col("r") * factor), ("g", F.col("g").cast("double")), ("b", F.col("b") * factor))])
    out = out.withColumn("unit", _unit(_least_positive(F.col("r"), F.col("b"))))
    unit = F.col("unit")
    return out.select("slice", "y", "x", _clamp(F.when(salt & positive, unit).otherwise(F.col("r"))).alias("r"), _clamp(F.when(salt, F.lit(1.0)).otherwise(F.col("g"))).alias("g"), _clamp(F.when(salt & ~positive, unit).otherwise(F.col("b"))).alias("b"))


def accumulate_noise(frames: DataFrame, seed: int = 0, gain: tuple[float, float] = (0.7, 1.4), dropout_max: float = 0.15, salt_prob: float = 0.005) -> DataFrame:
    """White background: intensity is 1 - channel; a positive event darkens green and blue, a negative one red and green."""
    factor, drop, salt, positive = _draws(seed, gain, dropout_max, salt_prob)
    out = frames.select("slice", "y", "x", *[F.when(drop, F.lit(1.0)).otherwise(1.0 - factor * (1.0 - F.col(c))).alias(c) for c in "rgb"])
    out = out.withColumn("unit", _unit(_least_positive(1.0 - F.col("r"), 1.0 - F.col("b"))))
    less = lambda hit: F.when(hit, F.col("unit")).otherwise(F.lit(0.0))
    return out.select("slice", "y", "x", _clamp(F.col("r") - less(salt & ~positive)).alias("r"), _clamp(F.col("g") - less(salt)).alias("g"), _clamp(F.col("b") - less(salt & positive)).alias("b"))


NOISE = {"countmask": countmask_noise, "polmask": countmask_noise, "accumulate": accumulate_noise}


def noise_for(representation: str):
    if representation not in NOISE:
        raise ValueError(f"no noise is defined for {representation!r}")
    return NOISE[representation]
