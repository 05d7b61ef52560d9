"""Renderers: one grouped aggregation per pixel and window, then column arithmetic in FLOAT.

Input rows carry slice, x, y, t, p, event_id. Output is long form: slice, y, x, r, g, b (0 to 255). Sparse frames
hold pixels with an event; `dense` adds the background.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PERCENTILE = 0.99


def f32(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("float")


def _frame():
    """A frame's active pixels: at most as many rows as the sensor has. Limits are values over it, so no table of a row a slice is broadcast."""
    return Window.partitionBy("slice")


def in_bounds(events: DataFrame, width: int, height: int) -> DataFrame:
    """Events on the sensor, polarity as 0 or 1 (positive is any p > 0)."""
    return events.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height)).withColumn("p", (F.col("p") > 0).cast("int"))


def pixel_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("slice", "y", "x").agg(F.count_if(F.col("p") > 0).alias("pos"), F.count_if(F.col("p") <= 0).alias("neg"))


def hot_pixels(events: DataFrame, sigmas: float = 3.0) -> DataFrame:
    """Pixels with more events than mean + sigmas * deviation over active pixels."""
    counts = events.groupBy("y", "x").agg(F.count("*").alias("n"))
    limit = counts.agg((F.avg("n") + F.lit(sigmas) * F.stddev_pop("n")).alias("limit"))
    return counts.crossJoin(F.broadcast(limit)).where("n > limit").select("y", "x", "n")


def without_hot_pixels(events: DataFrame, sigmas: float = 3.0) -> DataFrame:
    return events.join(hot_pixels(events, sigmas), ["y", "x"], "left_anti")


def _byte(v: Column) -> Column:
    return F.greatest(F.least(v, f32(255.0)), f32(0.0)).cast("int")


def accumulate(events: DataFrame) -> DataFrame:
    """Winner-takes-all counts on white, each polarity over the percentile of its own active pixels."""
    df = pixel_counts(events).withColumns({f"{c}_limit": F.percentile(F.when(F.col(c) > 0, F.col(c)), F.lit(PERCENTILE)).over(_frame()).cast("float") for c in ("pos", "neg")})
    part = {c: F.when(F.col(f"{c}_limit").isNull(), f32(0.0)).otherwise(F.least(f32(F.col(c)), F.col(f"{c}_limit")) / F.col(f"{c}_limit")).cast("float") for c in ("pos", "neg")}
    df = df.select("slice", "y", "x", part["pos"].alias("a"), part["neg"].alias("b"))
    pos, neg = F.when(F.col("a") >= F.col("b"), F.col("a")).otherwise(f32(0.0)), F.when(F.col("a") >= F.col("b"), f32(0.0)).otherwise(F.col("b"))
    one = f32(1.0)
    return df.select("slice", "y", "x", *[_byte((F.greatest(F.least(v, one), f32(0.0)) * f32(255.0)).cast("float")).alias(c) for c, v in (("r", (one - neg).cast("float")), ("g", ((one - pos).cast("float") - neg).cast("float")), ("b", (one - pos).cast("float")))])


def countmask(events: DataFrame, white_frame: bool = False) -> DataFrame:
    """Counts over one percentile of both polarities; green is where any event fell."""
    counts = pixel_counts(events)
    values = counts.select("slice", "y", "x", "pos", "neg", F.explode(F.array(F.struct(F.lit(1).alias("first"), F.col("pos").alias("v")), F.struct(F.lit(0).alias("first"), F.col("neg").alias("v")))).alias("c"))
    df = values.withColumn("alpha", F.percentile(F.when(F.col("c.v") > 0, F.col("c.v")), F.lit(PERCENTILE)).over(_frame()).cast("float")).where("c.first = 1")
    parts = [(c, (F.least(f32(F.col(v)), F.col("alpha")) / F.col("alpha")).cast("float")) for c, v in (("r", "pos"), ("b", "neg"))]
    r, g, b = parts[0][1], f32(1.0), parts[1][1]
    if white_frame:
        r, g, b = f32(1.0) - r, f32(1.0) - g, f32(1.0) - b
    return df.select("slice", "y", "x", *[_byte((f32(v) * f32(255.0)).cast("float")).alias(c) for c, v in (("r", r), ("g", g), ("b", b))])


def _last(events: DataFrame) -> DataFrame:
    """The last event of each pixel (equal times: the greatest event_id), and the first time of any."""
    last = events.groupBy("slice", "y", "x").agg(F.max(F.struct("t", "event_id", "p")).alias("e"), F.min("t").alias("first"))
    return last.select("slice", "y", "x", F.col("e.t").alias("t"), F.col("e.p").alias("p"), "first")


def tencode(events: DataFrame) -> DataFrame:
    """Last event wins: polarity in red and blue, age within the window in green (new is dark)."""
    df = _last(events).withColumns({"lo": F.min("first").over(_frame()), "hi": F.max("t").over(_frame())})
    age = F.when(F.col("hi") == F.col("lo"), F.lit(0.0)).otherwise((F.col("t") - F.col("lo")).cast("double") / F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(F.col("hi") - F.col("lo")).cast("double"))
    return df.select("slice", "y", "x", (F.col("p") * 255).alias("r"), _byte(F.lit(255.0) * (1.0 - age)).alias("g"), ((1 - F.col("p")) * 255).alias("b"))


def polmask(events: DataFrame) -> DataFrame:
    return _last(events).select("slice", "y", "x", (F.col("p") * 255).alias("r"), F.lit(255).alias("g"), ((1 - F.col("p")) * 255).alias("b"))


def dense(frames: DataFrame, slices: DataFrame, width: int, height: int, background: int) -> DataFrame:
    """Every pixel of every slice in `slices`."""
    grid = slices.select("slice").crossJoin(F.broadcast(frames.sparkSession.range(width * height).select(F.floor(F.col("id") / width).cast("int").alias("y"), (F.col("id") % width).cast("int").alias("x"))))
    out = grid.join(frames.withColumns({"y": F.col("y").cast("int"), "x": F.col("x").cast("int")}), ["slice", "y", "x"], "left")
    return out.select("slice", "y", "x", *[F.coalesce(c, F.lit(background)).cast("int").alias(c) for c in "rgb"])


#: name -> (renderer, background of a dense frame)
RENDERERS = {"accumulate": (accumulate, 255), "countmask": (countmask, 0), "tencode": (tencode, 0), "polmask": (polmask, 0)}


def render(name: str, events: DataFrame, white_frame: bool | None = None) -> DataFrame:
    if name not in RENDERERS:
        raise ValueError(f"no renderer is called {name!r}; there are {', '.join(RENDERERS)}")
    if name == "countmask" and white_frame is not None:
        return countmask(events, white_frame)
    return RENDERERS[name][0](events)


def normalized(frames: DataFrame, mean: dict[str, float], std: dict[str, float]) -> DataFrame:
    """(v / 255 - mean) / std per channel."""
    return frames.select("slice", "y", "x", *[((F.col(c) / 255.0 - F.lit(mean[c])) / F.lit(std[c])).alias(c) for c in "rgb"])


def swap_polarity(frames: DataFrame, seed: int = 0, probability: float = 0.5) -> DataFrame:
    """Red and blue change places in a seeded share of the frames."""
    from ..functions.ordering import uniform

    swap = uniform(f"swap{seed}", F.col("slice")) < probability
    return frames.select("slice", "y", "x", F.when(swap, F.col("b")).otherwise(F.col("r")).alias("r"), "g", F.when(swap, F.col("r")).otherwise(F.col("b")).alias("b"))


def flip(frames: DataFrame, width: int) -> DataFrame:
    return frames.withColumn("x", F.lit(width - 1) - F.col("x"))
