"""City metadata from files: <root>/<city>/<split>/postprocessed.csv beside an image tree <root>/<city>/<split>/images/<key><ext>."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places, sets
from .tables import csv_strings, listing

SPLITS = ("database", "query")
FILE = "postprocessed.csv"
NEEDED = ("key", "easting", "northing")


def with_retry(read: Callable[[], DataFrame], what: str, attempts: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A file's first read (its header), again after failures of the store; what can't be understood isn't tried twice. Errors name `what`.

    Later reads are tasks, which Spark repeats by itself (spark.task.maxFailures).
    """
    for attempt in range(1, attempts + 1):
        try:
            return read()
        except (ValueError, AnalysisException) as fault:
            raise ValueError(f"{what}: not a table of the expected form: {fault}") from fault
        except Exception as fault:  # the store's, through whatever client it has
            if attempt == attempts:
                raise RuntimeError(f"{what}: the store did not give the file's contents in {attempts} attempts: {fault}") from fault
            sleep(wait)
    raise AssertionError("not reached")


def city_splits(spark: SparkSession, meta_root: str) -> list[tuple[str, str, str]]:
    """(city, split, file) of all metadata files, by city and split."""
    root = spark._jvm.org.apache.hadoop.fs.Path(meta_root)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        raise FileNotFoundError(f"no city metadata at {meta_root}")
    found = [s.getPath().toString() for s in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{meta_root.rstrip('/')}/*/*/{FILE}")) or ()]
    return sorted((*path.rsplit("/", 3)[1:3], path) for path in found)


def split_metadata(spark: SparkSession, city: str, split: str, path: str) -> DataFrame:
    """city, split, key, easting, northing, cluster, view_direction, night of one file; what it lacks is null but for the needed columns."""

    def read() -> DataFrame:
        df = spark.read.option("header", True).csv(path)
        if missing := set(NEEDED) - set(df.columns):
            raise ValueError(f"no columns {sorted(missing)}")
        return df

    df = with_retry(read, f"{city}/{split} ({path})")
    get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c)
    number = lambda c: get(c).try_cast("double")
    return df.select(F.lit(city).alias("city"), F.lit(split).alias("split"), "key", number("easting").alias("easting"), number("northing").alias("northing"), number("unique_cluster").cast("long").alias("cluster"), get("view_direction").alias("view_direction"), get("night").alias("night"))


def city_metadata(spark: SparkSession, meta_root: str, splits: tuple[str, ...] = SPLITS, drop: tuple[str, ...] = (), night: bool = True) -> DataFrame:
    """Rows of all cities but those dropped (an unknown name, or a test city that stays, is an error); without night images if asked."""
    files = [f for f in city_splits(spark, meta_root) if f[1] in splits]
    names = sorted({f[0] for f in files if any(g[:2] == (f[0], splits[0]) for g in files)})
    if not names:
        raise ValueError(f"no city below {meta_root} has the split {splits[0]}")
    kept = {r.city for r in sets.excluded(spark.createDataFrame([(c,) for c in names], "city string"), list(drop)).collect()}
    out = None
    for city, split, path in files:
        if city in kept:
            own = split_metadata(spark, city, split, path)
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no city is left")
    return out if night else out.where(~F.lower(F.coalesce("night", F.lit(""))).isin("true", "1"))


def with_views(rows: DataFrame, bins: int) -> DataFrame:
    """Adds `view`: the sector of a heading, or the quoted word, as most of a city and split's directions are numbers or words."""
    if bins <= 1:
        return rows.withColumn("view", F.lit("0"))
    number = F.col("view_direction").try_cast("double")
    kinds = rows.groupBy("city", "split").agg((F.avg(number.isNotNull().cast("double")) > 0.5).alias("numeric"))
    sector = F.floor(F.pmod(F.coalesce(number, F.lit(0.0)), F.lit(360.0)) / (360.0 / bins)).cast("string")
    word = F.concat(F.lit("'"), F.coalesce("view_direction", F.lit("nan")), F.lit("'"))
    return rows.join(kinds, ["city", "split"]).withColumn("view", F.when(F.col("numeric"), sector).otherwise(word)).drop("numeric")


def image_keys(spark: SparkSession, images_root: str, ext: str) -> DataFrame:
    """city, split, key, path of the image tree; only paths are read."""
    parts = F.split("path", "/")
    at = lambda k: F.try_element_at(parts, F.lit(k))
    return listing(spark, images_root, ext).where(at(-2) == "images").select(at(-4).alias("city"), at(-3).alias("split"), F.expr(f"substring(element_at(split(path, '/'), -1), 1, length(element_at(split(path, '/'), -1)) - {len(ext)})").alias("key"), "path")


def split_table(spark: SparkSession, images_root: str, meta_root: str, city: str, split: str, ext: str = ".jpg") -> DataFrame:
    """path, easting, northing of a split's keys that have an image."""
    files = {f[:2]: f[2] for f in city_splits(spark, meta_root)}
    if (city, split) not in files:
        raise FileNotFoundError(f"{meta_root}/{city}/{split}/{FILE}")
    rows = split_metadata(spark, city, split, files[city, split])
    return rows.join(image_keys(spark, f"{images_root.rstrip('/')}/{city}/{split}", ext), ["city", "split", "key"]).select("path", "easting", "northing")


def city_places(spark: SparkSession, images_root: str, meta_root: str, ext: str = ".jpg", bins: int = 4, min_images: int = 4, max_images: int | None = None, offset: int = 0, drop: tuple[str, ...] = (), night: bool = True) -> DataFrame:
    """(place_id, city, path): the place index of a metadata tree and its image tree. An empty index is an error."""
    rows = with_views(city_metadata(spark, meta_root, drop=drop, night=night), bins)
    there = rows.join(image_keys(spark, images_root, ext), ["city", "split", "key"])
    out = places.by_clusters(there, bins, min_images, max_images, offset, places.merge_decision(rows), rows)
    if out.isEmpty():
        raise ValueError(f"no place has {min_images} images: does {images_root} hold <city>/<split>/images/<key>{ext}?")
    return out


__all__ = ["city_metadata", "city_places", "city_splits", "csv_strings", "image_keys", "split_metadata", "split_table", "with_retry", "with_views"]
