import pytest
from pyspark.sql import functions as F

from placeloom.operators import frames
from placeloom.streaming import live


@pytest.fixture
def source(spark, tmp_path):
    rows = [(0, 1, 1, "2024-01-01 00:00:00", 1), (1, 1, 1, "2024-01-01 00:00:01", 0), (2, 2, 3, "2024-01-01 00:00:12", 1), (3, 2, 3, "2024-01-01 00:05:00", 1)]
    df = spark.createDataFrame(rows, "event_id long, x int, y int, ts string, p int").withColumn("ts", F.to_timestamp("ts"))
    for i in range(4):
        df.where(F.col("event_id") == i).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def run(df, mode, name, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.sql(f"select * from {name}").collect()


def test_live_counts_close_with_the_watermark(source, tmp_path):
    got = run(live.live_counts(source[1], "10 seconds"), "append", "counts", tmp_path)
    assert sorted((r.n_events, r.n_positive) for r in got) == [(1, 1), (2, 1)]


def test_live_pixels_equal_batch_counts(source, tmp_path):
    got = run(live.live_pixels(source[1], "10 seconds"), "append", "pixels", tmp_path)
    batch = frames.pixel_counts(source[0].where("event_id < 3").withColumn("slice", F.floor(F.unix_seconds("ts") / 10)))
    assert sorted((r.y, r.x, r.pos, r.neg) for r in got) == sorted((r.y, r.x, r.pos, r.neg) for r in batch.collect())


def test_bursts(source, tmp_path):
    assert sorted(r.n_events for r in run(live.bursts(source[1], "5 seconds", "x"), "append", "bursts", tmp_path)) == [1, 2]


def test_last_surface(source, tmp_path):
    got = run(live.last_surface(source[1]), "update", "surface", tmp_path)
    last = {}
    for r in sorted(got, key=lambda r: r.us):
        last[r.y, r.x] = (r.us, r.p)
    want = {(r.y, r.x): (r.us, r.p) for r in source[0].groupBy("y", "x").agg(F.max(F.struct(F.unix_micros("ts").alias("us"), "p")).alias("e")).select("y", "x", "e.us", "e.p").collect()}
    assert last == want
