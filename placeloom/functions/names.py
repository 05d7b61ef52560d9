"""File names as structured keys."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def at_fields(name: Column) -> dict[str, Column]:
    """East, north, heading (numbers) and panorama (text) of an @-separated view name; null where a field is missing or no number."""
    parts = F.split(name, "@")
    get = lambda i: F.try_element_at(parts, F.lit(i + 1))
    east, north, heading, pano = get(1).try_cast("double"), get(2).try_cast("double"), get(9).try_cast("double"), get(7)
    ok = east.isNotNull() & north.isNotNull() & heading.isNotNull() & pano.isNotNull()
    return {k: F.when(ok, v) for k, v in (("east", east), ("north", north), ("heading", heading), ("pano", pano))}


def padded(value: Column, width: int) -> Column:
    """Zero-padded, longer values kept whole."""
    text = value.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def city_view_name(city: Column, place: Column, year: Column, month: Column, heading: Column, lat: Column, lon: Column, pano: Column, ext: str) -> Column:
    return F.concat(F.concat_ws("_", city, padded(place, 7), padded(year, 4), padded(month, 2), padded(heading, 3), lat, lon, pano), F.lit(ext))


def place_of_name(name: Column) -> Column:
    """The number in the second _-separated field, else null."""
    return F.try_element_at(F.split(name, "_"), F.lit(2)).try_cast("long")


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def window_id(slice_no: Column) -> Column:
    return padded(slice_no, 8)


def param_hash(params: dict) -> str:
    """First 12 hex digits of the SHA-1 of the parameters as JSON with sorted keys."""
    return hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest()[:12]
