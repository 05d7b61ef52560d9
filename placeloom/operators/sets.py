"""Guards and set operations over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .truth import must_be_empty

#: The evaluation's test cities, which never train.
TEST_CITIES = ("miami", "athens", "buenosaires", "stockholm", "bengaluru", "kampala")


def unknown_keys(given: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return given.select(key).distinct().join(known.select(key), key, "left_anti")


def excluded(cities: DataFrame, drop: list[str], test_cities: tuple[str, ...] = TEST_CITIES) -> DataFrame:
    """Cities less `drop` (any letter case). Unknown names and test cities that remain are errors."""
    wanted = sorted({d.strip().lower() for d in drop if d.strip()})
    spark = cities.sparkSession
    names = spark.createDataFrame([(d,) for d in wanted], "low string")
    low = cities.withColumn("low", F.lower("city"))
    must_be_empty(names.join(low.select("low"), "low", "left_anti"), "cannot exclude a city that isn't there")
    left = low.join(F.broadcast(names), "low", "left_anti")
    must_be_empty(left.where(F.col("low").isin(*test_cities)).select("city"), "a test city is among the training cities")
    return left.drop("low")


def union_distinct(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.distinct()


def spans(counts: DataFrame, key: str, n: str) -> DataFrame:
    """Prefix offsets [start, stop) in key order; one row a key."""
    from pyspark.sql.window import Window

    stop = F.sum(n).over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(key, (stop - F.col(n)).alias("start"), stop.alias("stop"))
