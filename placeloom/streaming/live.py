"""Live windows, bursts and the last-event surface. Events have a `ts` timestamp besides x, y, p."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def live_counts(events: DataFrame, window: str, late: str = "10 seconds") -> DataFrame:
    """Events by polarity in each tumbling window; a window closes when the watermark passes it. State: one row a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window)).agg(F.count("*").alias("n_events"), F.count_if(F.col("p") > 0).alias("n_positive")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "n_events", "n_positive")


def live_pixels(events: DataFrame, window: str, late: str = "10 seconds") -> DataFrame:
    """Pixel counts a window, the input of the count renderers. State: one row a window and active pixel."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "y", "x").agg(F.count_if(F.col("p") > 0).alias("pos"), F.count_if(F.col("p") <= 0).alias("neg")).select(F.col("window.start").alias("start"), "y", "x", "pos", "neg")


def bursts(events: DataFrame, gap: str, by: str, late: str = "10 seconds") -> DataFrame:
    """Sessions of events closer than gap, by recording, row or another key (streaming sessions need one)."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col(by)).agg(F.count("*").alias("n_events"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n_events")


def last_surface(events: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """The last event of each pixel so far, in update mode: (y, x, ts, p) whenever it changes. State: one row a pixel."""
    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = tuple(state.get) if state.exists else None
        for f in frames:
            top = f.sort_values(["us", "p"]).iloc[-1]
            now = (int(top.us), int(top.p))
            best = now if best is None or now > best else best
        if best is not None:
            state.update(best)
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
            yield pd.DataFrame({"y": [key[0]], "x": [key[1]], "us": [best[0]], "p": [best[1]]})

    src = events.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.unix_micros("ts").alias("us"), F.col("p").cast("int").alias("p"))
    return src.groupBy("y", "x").applyInPandasWithState(step, "y int, x int, us long, p int", "us long, p int", "update", timeout)
