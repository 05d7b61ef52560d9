"""Moments, id ranges and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def channel_stats(df: DataFrame, channels: list[str]) -> DataFrame:
    """Mean and deviation of each channel from sums and sums of squares; the variance is clamped at 1e-8. One row a channel."""
    sums = df.agg(*[x for c in channels for x in (F.sum(F.col(c).cast("double")).alias(f"s_{c}"), F.sum(F.col(c).cast("double") * F.col(c)).alias(f"q_{c}"), F.count(c).alias(f"n_{c}"))])
    rows = sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"s_{c}").alias("s"), F.col(f"q_{c}").alias("q"), F.col(f"n_{c}").alias("n")) for c in channels])).alias("r")).select("r.*")
    mean = F.expr("try_divide(s, cast(n as double))")
    return rows.select("channel", "n", mean.alias("mean"), F.sqrt(F.greatest(F.expr("try_divide(q, cast(n as double))") - mean * mean, F.lit(1e-8))).alias("std"))


def id_ranges(places: DataFrame) -> DataFrame:
    return places.groupBy("stream").agg(F.min("place_id").alias("lo"), F.max("place_id").alias("hi"), F.count_distinct("place_id").alias("places"))


def id_overlaps(ranges: DataFrame) -> DataFrame:
    """Unordered pairs of streams whose ranges meet; touching counts. One row a stream on either side."""
    a, b = (ranges.select(F.col("stream").alias(f"stream_{s}"), F.col("lo").alias(f"lo_{s}"), F.col("hi").alias(f"hi_{s}")) for s in "ab")
    return a.join(b, (F.col("stream_a") < F.col("stream_b")) & (F.col("lo_a") <= F.col("hi_b")) & (F.col("lo_b") <= F.col("hi_a"))).select("stream_a", "stream_b")


def stream_summary(images: DataFrame, p: int) -> DataFrame:
    """Per stream: places, images, batches an epoch, epochs in 1,000 steps (2 digits; null without a batch)."""
    out = images.groupBy("stream").agg(F.count_distinct("place_id").alias("places"), F.count("*").alias("images"))
    batches = F.floor(F.col("places") / p)
    return out.select("stream", "places", "images", batches.alias("batches_per_epoch"), F.round(F.expr(f"try_divide(1000D, floor(places / {p}))"), 2).alias("epochs_per_1k_steps"))


def run_summary(runs: DataFrame, n_available: DataFrame) -> DataFrame:
    """Over scans with runs: least, upper median and most runs a scan, and the share of images used. runs: place_id, scan."""
    per = runs.groupBy("scan").agg(F.count_distinct("place_id").alias("k"))
    n = per.agg(F.count("*").alias("scans"), F.min("k").alias("least"), F.max("k").alias("most"))
    ranks = per.groupBy("k").agg(F.count("*").alias("c"))  # one row for each number of runs
    from pyspark.sql.window import Window

    upto = ranks.withColumn("upto", F.sum("c").over(Window.orderBy("k")))
    middle = upto.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("scans") / 2)).agg(F.min("k").alias("upper_median"))
    used = runs.agg(F.count("*").alias("used"), F.count_distinct("place_id").alias("places"))
    return n.crossJoin(middle).crossJoin(used).crossJoin(n_available.agg(F.count("*").alias("available"))).select("scans", "places", "least", "upper_median", "most", F.round(100.0 * F.col("used") / F.greatest("available", F.lit(1)), 6).alias("percent_used"))


def clip_share(history: DataFrame, clip: float) -> DataFrame:
    return history.agg(F.avg((F.col("gnorm") > clip).cast("double")).alias("clip_share"))
