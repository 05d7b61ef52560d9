"""The named streams of the training mixture: where each lies below the data root, and how its places are built."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import places
from ..sources import cities, tables
from .mixture import StreamSpec

#: Names, folders and first place ids, 100 million apart.
GSV, FRONTAL, LATERAL, MSLS, MEGASCENES, SCANNET = "gsv_cities", "sf_xl_frontal", "sf_xl_lateral", "msls", "megascenes", "scannet"
FIRST_ID = {GSV: 0, FRONTAL: 100_000_000, LATERAL: 200_000_000, MSLS: 300_000_000, MEGASCENES: 400_000_000, SCANNET: 500_000_000}
FOLDERS = {GSV: ("gsvcities", "gsv-cities"), FRONTAL: ("sf_xl", "sf-xl", "sfxl"), LATERAL: ("sf_xl", "sf-xl", "sfxl"), MSLS: ("mapillary", "msls"), MEGASCENES: ("megascenes",), SCANNET: ("scannet",)}
BELOW = {FRONTAL: "train", LATERAL: "train"}
EXTENSION = {GSV: ".jpg", FRONTAL: ".jpg", LATERAL: ".jpg", MSLS: ".jpg", MEGASCENES: ".png", SCANNET: ".png"}


@dataclass(frozen=True)
class Choices:
    """What the builders ask for. force_ext: one extension for all streams. chunk 0: a scan is one place."""

    min_images: int = 4
    max_images: int | None = 64
    cell: int = 20
    groups_a_side: int = 5
    focal_distance: float = 10.0
    groups: tuple[int, ...] | None = None
    min_class: int = 10
    view_bins: int = 4
    chunk: int = 0
    gap: int = 4
    meta_root: str | None = None
    drop_cities: tuple[str, ...] = ()
    force_ext: str | None = None


def views_of_tree(spark: SparkSession, root: str, ext: str) -> DataFrame:
    """path, east, north, heading, pano of view names; names that lack a field are left out."""
    images = tables.listing(spark, root, ext)
    return images.select("path", *[v.alias(k) for k, v in names.at_fields(names.basename(F.col("path"))).items()]).where("east is not null")


def registry(spark: SparkSession, choices: Choices | None = None) -> dict[str, StreamSpec]:
    """Stream name -> spec, whose build(root) gives (place_id, path)."""
    c = choices or Choices()

    def ext(name: str) -> str:
        return c.force_ext or EXTENSION[name]

    def gsv(root: str) -> DataFrame:
        return places.by_city_tree(tables.listing(spark, root, ext(GSV)), c.min_images, FIRST_ID[GSV])

    def cells(name: str, angle: float):
        groups = c.groups if c.groups is not None else tuple(range(c.groups_a_side**2))

        def build(root: str) -> DataFrame:
            views = views_of_tree(spark, root, ext(name))
            return places.by_cells(views, c.cell, c.groups_a_side, c.focal_distance, angle, groups, c.min_class, c.min_images, offset=FIRST_ID[name]).select("place_id", "path")

        return build

    def msls(root: str) -> DataFrame:
        if c.meta_root is None:
            raise ValueError(f"{MSLS}: meta_root must name the metadata tree")
        return cities.city_places(spark, root, c.meta_root, ext(MSLS), c.view_bins, c.min_images, c.max_images, FIRST_ID[MSLS], c.drop_cities).select("place_id", "path")

    def scenes(root: str) -> DataFrame:
        return places.by_directory(tables.listing(spark, root, ext(MEGASCENES)), c.min_images, c.max_images, FIRST_ID[MEGASCENES])

    def scans(root: str) -> DataFrame:
        images = tables.listing(spark, root, ext(SCANNET))
        if not c.chunk:
            return places.by_directory(images, c.min_images, c.max_images, FIRST_ID[SCANNET])
        scan = images.withColumn("scan", names.dirname(F.col("path")))
        return places.runs(scan, "scan", ["path"], c.chunk, c.gap, c.min_images, FIRST_ID[SCANNET], carry=("path",)).select("place_id", "path")

    builders = {GSV: gsv, FRONTAL: cells(FRONTAL, 0.0), LATERAL: cells(LATERAL, 90.0), MSLS: msls, MEGASCENES: scenes, SCANNET: scans}
    return {n: StreamSpec(n, build, FOLDERS[n], ext(n), n in (FRONTAL, LATERAL), BELOW.get(n, "")) for n, build in builders.items()}
