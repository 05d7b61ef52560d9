"""Seeded samples and batches. Order is MD5 of seed and key, so samples don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ordering import draw, rank_within, with_ordinal


def k_per_place(images: DataFrame, k: int, seed: int = 0, place: str = "place_id", key: str = "path") -> DataFrame:
    order = Window.partitionBy(place).orderBy(draw(seed, F.col(place), F.col(key)), key)
    return images.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def place_batches(places: DataFrame, p: int, seed: int = 0, drop_last: bool = True, by: list[str] | None = None) -> DataFrame:
    """Distinct places in seeded order, p a batch: adds batch and slot. Batch numbers need one order of places (not images); see with_ordinal."""
    order = [draw(seed, *[F.col(c) for c in by or []], F.col("place_id")), "place_id"]
    out = rank_within(places, by, order, "_i") if by else with_ordinal(places, order, "_i")
    out = out.withColumn("batch", F.floor(F.col("_i") / p)).withColumn("slot", F.col("_i") % p)
    if drop_last:
        sizes = places.groupBy(*(by or [])).agg(F.floor(F.count("*") / p).alias("_full"))
        out = (out.join(sizes, by) if by else out.crossJoin(sizes)).where(F.col("batch") < F.col("_full")).drop("_full")
    return out.drop("_i")


def pk_batches(images: DataFrame, p: int, k: int, seed: int = 0) -> DataFrame:
    """(batch, slot, place_id, pick, path): p places a batch, k images a place; places with fewer images aren't used."""
    sized = images.groupBy("place_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("place_id")
    return place_batches(sized, p, seed).join(k_per_place(images, k, seed), "place_id").select("batch", "slot", "place_id", "pick", "path")


def group_cycle(places: DataFrame, p: int, epochs: int, seed: int = 0) -> DataFrame:
    """One group an epoch, in turn over groups with p places or more; (epoch, place_group, batch, slot, place_id)."""
    eligible = places.groupBy("place_group").agg(F.count("*").alias("n")).where(F.col("n") >= p)
    turn = eligible.withColumn("turn", F.row_number().over(Window.orderBy("place_group")) - 1).crossJoin(eligible.agg(F.count("*").alias("n_groups")))
    if turn.isEmpty():
        raise ValueError(f"no group has {p} places")
    plan = turn.join(places.sparkSession.range(epochs).withColumnRenamed("id", "epoch"), F.pmod(F.col("epoch"), F.col("n_groups")) == F.col("turn")).select("epoch", "place_group")
    chosen = places.select("place_group", "place_id").join(plan, "place_group")
    return place_batches(chosen, p, seed, by=["epoch", "place_group"]).select("epoch", "place_group", "batch", "slot", "place_id")


def subset(places: DataFrame, n: int, seed: int = 0, key: str = "place_id") -> DataFrame:
    """n rows by seeded order; all if there are fewer. A sort with limit: each task sends n rows at most."""
    return places.orderBy(draw(seed, F.col(key)), key).limit(n)


def even_budget(images: DataFrame, total: int, streams: int, seed: int = 0) -> DataFrame:
    """The first floor(total / streams) images of each stream in seeded order."""
    order = Window.partitionBy("stream").orderBy(draw(seed, F.col("stream"), F.col("path")), "path")
    return images.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= total // streams)


def gallery_and_queries(rows: DataFrame, max_db: int, max_q: int, radius: float, n_cities: int, seed: int = 0) -> DataFrame:
    """Per city: the gallery first, then queries that it can answer. rows: city, split, key, easting, northing. Adds idx per (city, split) in key order."""
    from .truth import radius_edges

    per_db, per_q = max(1, max_db // n_cities), max(1, max_q // n_cities)
    pick = lambda df, n: df.withColumn("_r", F.row_number().over(Window.partitionBy("city").orderBy(draw(seed, F.col("city"), F.col("key")), "key"))).where(F.col("_r") <= n).drop("_r")
    gallery = pick(rows.where("split = 'database'"), per_db)
    queries = rows.where("split = 'query'")
    edges = radius_edges(gallery, queries, radius, on=["city"], id_col="key")
    can = queries.join(edges.select("city", F.col("query_id").alias("key")).distinct(), ["city", "key"], "left_semi")
    both = gallery.unionByName(pick(can, per_q))
    return both.withColumn("idx", F.row_number().over(Window.partitionBy("city", "split").orderBy("key")) - 1)


def probe(places: DataFrame, listing: DataFrame, n: int = 32, seed: int = 0) -> DataFrame:
    """Paths of a seeded sample of at most n that aren't in the listing: a non-empty result means a stale index."""
    return subset(places, n, seed, key="path").join(listing.select("path"), "path", "left_anti")


def batch_of_step(steps: DataFrame, counts: DataFrame) -> DataFrame:
    """Exhausted streams start again: (step, stream, epoch, batch)."""
    return steps.crossJoin(counts).select("step", "stream", F.floor(F.col("step") / F.col("n_batches")).alias("epoch"), F.pmod(F.col("step"), F.col("n_batches")).alias("batch"))
