"""Place indexes: (place_id, path) rows from names, metadata and geometry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geo, names
from ..functions.ordering import rank_within, with_ordinal


def numbered(df: DataFrame, key: str | list[str], out: str = "ordinal") -> DataFrame:
    """Ordinal of each group in key order, ids of groups that later go stay unused. One row a group is ordered, not one a member."""
    keys = [key] if isinstance(key, str) else key
    return df.join(with_ordinal(df.select(*keys).distinct(), keys, out), keys)


def at_least(df: DataFrame, place: str | list[str], n: int) -> DataFrame:
    """Rows of places with n rows or more."""
    keys = [place] if isinstance(place, str) else place
    return df.join(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= n).drop("_n"), keys, "left_semi")


def capped(df: DataFrame, place: str | list[str], n: int, order: str | list[str] = "path") -> DataFrame:
    """The first n rows of each place; partial group limits keep hot places small before the shuffle."""
    keys, order = ([c] if isinstance(c, str) else c for c in (place, order))
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def by_directory(images: DataFrame, min_images: int, max_images: int | None = None, offset: int = 0, stride: int = 1) -> DataFrame:
    """Class = directory: ordinal over all directories, then small ones go, then the cap. (place_id, path)."""
    df = images.select(F.regexp_replace("path", "/[^/]*$", "").alias("dir"), "path")
    classes = with_ordinal(df.groupBy("dir").agg(F.count("*").alias("n")), ["dir"], "ordinal").where(F.col("n") >= min_images)
    df = df.join(classes.select("dir", "ordinal"), "dir")
    if max_images:
        df = capped(df, "dir", max_images)
    return df.select((F.lit(offset) + F.col("ordinal") * stride).cast("long").alias("place_id"), "path")


def by_city_tree(images: DataFrame, min_images: int, offset: int = 0, per_city: int = 10_000_000) -> DataFrame:
    """Class = number in the second field of `<city>/<city>_<number>_...` below a root; cities take ordinals by name. (place_id, path)

    Names without a number there are left out; a city counts for the ordinals even if all of its names are.
    """
    parts = F.split("path", "/")
    df = images.select(F.element_at(parts, -2).alias("city"), F.element_at(parts, -1).alias("name"), "path")
    df = numbered(df, "city", "_c").withColumn("pid", names.place_of_name(F.col("name"))).where("pid is not null")
    return at_least(df, ["city", "pid"], min_images).select((F.lit(offset) + F.col("_c") * per_city + F.col("pid")).cast("long").alias("place_id"), "path")


def runs(images: DataFrame, scan: str, order: list[str], chunk: int, gap: int, min_images: int, offset: int = 0, per_scan: int = 1000, carry: tuple[str, ...] = (), coarse: Column | None = None) -> DataFrame:
    """Capture-ordered runs of `chunk` with `gap` dropped between; short runs go; at most per_scan surviving runs a scan.

    (place_id, scan, run, position, carry...). coarse: see rank_within; it keeps a hot scan out of one task.
    """
    if chunk < min_images:
        raise ValueError("a run must be able to hold min_images")
    stride = chunk + gap
    df = rank_within(images, [scan], order, "_p", coarse)
    df = df.withColumn("_run", F.floor(F.col("_p") / stride)).withColumn("position", F.col("_p") % stride).where(F.col("position") < chunk)
    kept = df.groupBy(scan, "_run").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_images)
    kept = kept.withColumn("run", F.row_number().over(Window.partitionBy(scan).orderBy("_run")) - 1).where(F.col("run") < per_scan)
    scans = with_ordinal(images.select(scan).distinct(), [scan], "_s")
    out = df.join(kept.select(scan, "_run", "run"), [scan, "_run"]).join(scans, scan)
    return out.select((F.lit(offset) + F.col("_s") * 1000 + F.col("run")).cast("long").alias("place_id"), scan, F.col("run").cast("long").alias("run"), F.col("position").cast("long").alias("position"), *carry)


def cells(views: DataFrame, size: int, n: int, groups: tuple[int, ...] = (0,)) -> DataFrame:
    """Views (east, north, ...) with cell edges ce, cn, of the wanted residue groups."""
    df = views.withColumns({"ce": geo.cell(F.col("east"), size), "cn": geo.cell(F.col("north"), size)})
    df = df.withColumn("cell_group", geo.group_id(F.col("ce"), F.col("cn"), size, n).cast("long"))
    return df.where(F.col("cell_group").isin(*groups))


def focal_points(df: DataFrame, distance: float, angle: float, min_images: int = 0) -> DataFrame:
    """Per cell: centre of mass and focal point; cells of fewer than min_images go."""
    stats = df.groupBy("ce", "cn").agg(F.count("*").alias("n_images"), F.avg("east").alias("mu_e"), F.avg("north").alias("mu_n"), F.var_pop("east").alias("ve"), F.var_pop("north").alias("vn"), F.covar_pop("east", "north").alias("cov")).where(F.col("n_images") >= min_images)
    de, dn = geo.focal_step(F.col("ve"), F.col("vn"), F.col("cov"), distance, angle)
    return stats.select("ce", "cn", "n_images", "mu_e", "mu_n", (F.col("mu_e") + de).alias("focal_e"), (F.col("mu_n") + dn).alias("focal_n"))


def best_views(df: DataFrame, focal: DataFrame, max_angle: float = 45.0) -> DataFrame:
    """Per cell and panorama the view aimed best at the focal point, within max_angle; ties: the first path."""
    out = df.join(focal.select("ce", "cn", "focal_e", "focal_n"), ["ce", "cn"])
    out = out.withColumn("diff", geo.angular_difference(F.col("heading"), geo.bearing(F.col("focal_e") - F.col("east"), F.col("focal_n") - F.col("north")))).where(F.col("diff") <= max_angle)
    best = out.groupBy("ce", "cn", "pano").agg(F.min(F.struct("diff", "path")).alias("best"))
    return best.select("ce", "cn", "pano", F.col("best.path").alias("path"), F.col("best.diff").alias("diff"))


def by_cells(views: DataFrame, size: int, n: int, distance: float, angle: float, groups: tuple[int, ...] = (0,), min_class: int = 10, min_place: int = 4, max_angle: float = 45.0, offset: int = 0) -> DataFrame:
    """The whole geometric builder: (place_id, pano, path)."""
    in_cells = cells(views, size, n, groups)
    chosen = at_least(best_views(in_cells, focal_points(in_cells, distance, angle, min_class), max_angle), ["ce", "cn"], min_place)
    return chosen.select(geo.cell_place_id(F.col("ce"), F.col("cn"), size, offset).cast("long").alias("place_id"), "pano", "path")


def merge_decision(rows: DataFrame, tolerance: float = 25.0, least: int = 5) -> DataFrame:
    """Per city: do database and query share one cluster id space? rows: city, split, cluster, easting, northing."""
    c = rows.groupBy("city", "split", "cluster").agg(F.avg("easting").alias("e"), F.avg("northing").alias("n"))
    a, b = (c.where(F.col("split") == s).select("city", "cluster", F.col("e").alias(f"e_{s}"), F.col("n").alias(f"n_{s}")) for s in ("database", "query"))
    shared = a.join(b, ["city", "cluster"]).withColumn("d", F.hypot(F.col("e_database") - F.col("e_query"), F.col("n_database") - F.col("n_query")))
    found = shared.groupBy("city").agg(F.count("*").alias("shared_clusters"), F.percentile("d", 0.5).alias("median_distance"))
    out = rows.select("city").distinct().join(found, "city", "left")
    return out.select("city", F.coalesce("shared_clusters", F.lit(0)).alias("shared_clusters"), "median_distance", F.coalesce((F.col("shared_clusters") >= least) & (F.col("median_distance") <= tolerance), F.lit(False)).alias("merged"))


def by_clusters(rows: DataFrame, bins: int, min_images: int, max_images: int | None = None, offset: int = 0, merge: DataFrame | None = None, cities: DataFrame | None = None) -> DataFrame:
    """City metadata to places: class = (cluster, view bin), with the split where its id spaces differ; ordinals by the key's text.

    rows: city, split, cluster, heading, easting, northing, path, or a ready `view` (text of the bin) in place of heading.
    cities: all cities that take an ordinal, if some have no row here. (place_id, city, path)
    """
    merge = merge_decision(rows) if merge is None else merge
    view = F.col("view") if "view" in rows.columns else geo.view_bin(F.col("heading"), bins).cast("string")
    df = rows.join(merge.select("city", "merged"), "city").withColumn("bin", view)
    key = F.when(F.col("merged"), F.format_string("(%d, %s)", "cluster", "bin")).otherwise(F.format_string("('%s', %d, %s)", "split", "cluster", "bin"))
    df = df.withColumn("key", key)
    cities = with_ordinal((rows if cities is None else cities).select("city").distinct(), ["city"], "_c")
    groups = df.select("city", "key").distinct().withColumn("_g", F.row_number().over(Window.partitionBy("city").orderBy("key")) - 1)
    df = at_least(df, ["city", "key"], min_images)
    if max_images:
        df = capped(df, ["city", "key"], max_images)
    return df.join(groups, ["city", "key"]).join(cities, "city").select((F.lit(offset) + F.col("_c") * 1_000_000 + F.col("_g")).cast("long").alias("place_id"), "city", "path")


def nested(places: DataFrame) -> DataFrame:
    """(place_id, paths sorted). A place's paths become one value here; keep the long form for large places."""
    return places.groupBy("place_id").agg(F.array_sort(F.collect_list("path")).alias("paths"))


def circular_stats(df: DataFrame, group: str, degrees: Column, least: float = 0.0) -> DataFrame:
    """Per group: circular mean, and mean angular difference to it; null where directions cancel out to a mean vector of `least` length or less."""
    length = F.hypot(F.avg(F.sin(F.radians(degrees))), F.avg(F.cos(F.radians(degrees))))
    means = df.groupBy(group).agg(F.when(length > least, geo.circular_mean(degrees)).alias("mean_deg"))
    return df.join(means, group).groupBy(group).agg(F.first("mean_deg").alias("mean_deg"), F.avg(geo.angular_difference(degrees, F.col("mean_deg"))).alias("spread_deg"), F.count("*").alias("n"))


def separation(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean and median angular separation of two streams' places. Both: place_id, mean_deg. One row."""
    d = first.join(second.withColumnRenamed("mean_deg", "other"), "place_id").select(geo.angular_difference(F.col("mean_deg"), F.col("other")).alias("d"))
    return d.agg(F.count("*").alias("shared_places"), F.avg("d").alias("mean_separation"), F.percentile("d", 0.5).alias("median_separation"))


def by_city_rows(meta: DataFrame, listing: DataFrame, min_images: int, ext: str = ".jpg", stride: int = 100_000) -> DataFrame:
    """City metadata as text (city_id, place_id, year, month, northdeg, lat, lon, panoid) to places: names are built, files that
    don't exist go, places of few images go, ids are minted by city ordinal. (place_id, path)"""
    from ..functions.names import city_view_name

    name = city_view_name(*[F.col(c) for c in ("city_id", "place_id", "year", "month", "northdeg", "lat", "lon", "panoid")], ext)
    df = with_ordinals_of_cities(meta.withColumn("path", name)).join(listing.select("path"), "path", "left_semi")
    df = at_least(df, ["city_id", "place_id"], min_images)
    return df.select((F.col("ci") * stride + F.col("place_id").cast("long")).cast("long").alias("place_id"), "path")


def with_ordinals_of_cities(meta: DataFrame) -> DataFrame:
    return numbered(meta, "city_id", "ci")
