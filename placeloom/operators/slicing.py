"""Fixed event-time windows over recordings. Events: event_id, x, y, t (microseconds), p."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_slice(events: DataFrame, window_us: int, offset_us: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds `origin` and `slice`; events before the origin go.

    origin = the first event's time, or the offset if that is later: one row in all, or one a recording with `by`. The single row is
    broadcast; rows a recording are joined as their size commands.
    """
    if window_us <= 0:
        raise ValueError("window must be positive")
    by = by or []
    origin = F.min("t") if offset_us is None else F.greatest(F.min("t"), F.lit(offset_us))
    bounds = events.groupBy(*by).agg(origin.alias("origin"))
    joined = events.join(bounds, by) if by else events.crossJoin(F.broadcast(bounds))
    return joined.where("t >= origin").withColumn("slice", F.floor((F.col("t") - F.col("origin")) / window_us).cast("long"))


def between(events: DataFrame, window_us: int, first: int, end: int, offset_us: int | None = None) -> DataFrame:
    """with_slice for the slices first .. end - 1 alone.

    The time bounds become constants: one small job finds the first time (a column of one type, which row-group statistics shorten), and the
    scan then skips every row group that lies outside.
    """
    if window_us <= 0 or end < first:
        raise ValueError("window must be positive, and end not before first")
    lo = events.agg(F.min("t")).first()[0]
    if lo is None:
        return events.where("false").withColumns({"origin": F.lit(None).cast("long"), "slice": F.lit(None).cast("long")})
    origin = lo if offset_us is None else max(lo, offset_us)
    inside = (F.col("t") >= origin + max(first, 0) * window_us) & (F.col("t") < origin + end * window_us)
    return events.where(inside).withColumns({"origin": F.lit(origin).cast("long"), "slice": F.floor((F.col("t") - origin) / window_us).cast("long")})


def sample_table(events: DataFrame, window_us: int, offset_us: int | None = None) -> DataFrame:
    """id, slice, start_ms, end_ms of every window, empty ones too; the last end is the last event's time.

    floor((hi - origin) / w) + 1 windows, so the last event always has one.
    """
    lo, hi = F.min("t"), F.max("t")
    origin = lo if offset_us is None else F.greatest(lo, F.lit(offset_us))
    bounds = events.agg(origin.alias("origin"), hi.alias("hi")).where("hi >= origin")
    n = F.floor((F.col("hi") - F.col("origin")) / window_us)
    rows = bounds.select("origin", "hi", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("slice"))
    start = F.col("origin") + F.col("slice") * window_us
    return rows.select(F.lpad(F.col("slice").cast("string"), 8, "0").alias("id"), "slice", (start / 1000.0).alias("start_ms"), (F.least(start + window_us, F.col("hi")) / 1000.0).alias("end_ms"))


def slice_counts(events: DataFrame, window_us: int, offset_us: int | None = None) -> DataFrame:
    """Events in each window, 0 for empty ones."""
    counts = with_slice(events, window_us, offset_us).groupBy("slice").agg(F.count("*").alias("n"))
    return sample_table(events, window_us, offset_us).join(counts, "slice", "left").select("slice", F.coalesce("n", F.lit(0)).alias("n_events"))


def strided(df: DataFrame, stride: int, start: int = 0, count: int | None = None) -> DataFrame:
    """Every stride-th slice from start, of the first count."""
    keep = (F.col("slice") >= start) & (F.pmod(F.col("slice") - start, F.lit(stride)) == 0)
    return df.where(keep if count is None else keep & (F.col("slice") < start + count))
