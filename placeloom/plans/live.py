"""The streaming counterpart of slicing, run to the end of a finite stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..storage import shared_dir
from ..streaming import live
from .base import query, table


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type IN ('click', 'view') AS p, (SELECT max(ts) FROM events) AS last FROM events)
SELECT strftime(start, '%Y-%m-%d') AS day, count(*) AS n_events, count(*) FILTER (WHERE p) AS n_positive FROM e WHERE start + INTERVAL 1 DAY <= last - INTERVAL 10 SECOND GROUP BY start""")
def live_window_counts(spark, sf_dir):
    """Events a day from a stream; days that the watermark has passed. The result holds one row a window."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    events = stream.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("click", "view").cast("int").alias("p"))
    base = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    counts = live.live_counts(events, "1 day")
    running = counts.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start()
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return spark.read.schema(counts.schema).parquet(f"{base}/out").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n_events", "n_positive")
