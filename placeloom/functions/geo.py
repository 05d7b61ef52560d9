"""Plane geometry in metres and degrees, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEGREES = F.lit


def cell(v: Column, size: float) -> Column:
    """Lower edge of the grid cell, also for negative coordinates."""
    return (F.floor(v / F.lit(float(size))) * F.lit(int(size))).cast("long")


def cell_number(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def group_id(ce: Column, cn: Column, size: int, n: int) -> Column:
    """Residue class of a cell, 0 .. n*n-1; ce and cn are cell edges."""
    return F.floor(F.pmod(ce, F.lit(size * n)) / size) * n + F.floor(F.pmod(cn, F.lit(size * n)) / size)


def cell_place_id(ce: Column, cn: Column, size: int, offset: int = 0) -> Column:
    return F.lit(offset) + F.floor(ce / size) * 1_000_000 + F.floor(cn / size)


def group_of_place(place_id: Column, n: int, offset: int = 0) -> Column:
    """The residue class again, from the place id alone. Cells lie within 500,000 rows of the origin, to either side."""
    shifted = place_id - F.lit(offset) + F.lit(500_000)
    row = F.pmod(shifted, F.lit(1_000_000)) - 500_000
    return F.pmod(F.floor(shifted / 1_000_000), F.lit(n)) * n + F.pmod(row, F.lit(n))


def bearing(de: Column, dn: Column) -> Column:
    """Clockwise from north, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(de, dn)), F.lit(360.0))


def angular_difference(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def circular_mean(deg: Column) -> Column:
    """An aggregate: mean direction, [0, 360)."""
    return F.pmod(F.degrees(F.atan2(F.avg(F.sin(F.radians(deg))), F.avg(F.cos(F.radians(deg))))), F.lit(360.0))


def view_bin(degrees: Column, bins: int) -> Column:
    """Sector of a heading; null counts as 0; one sector if bins <= 1."""
    if bins <= 1:
        return F.lit(0).cast("long")
    return F.floor(F.pmod(F.coalesce(degrees, F.lit(0.0)), F.lit(360.0)) / (360.0 / bins)).cast("long")


def focal_step(var_e: Column, var_n: Column, cov: Column, distance: float, angle: float) -> tuple[Column, Column]:
    """Offset of a focal point from the centre of mass.

    The direction is row 1 of the matrix of left singular vectors of the centred coordinates, that is, the
    northing component of both principal axes, larger spread first. Axes come from the closed form for a 2x2
    covariance, each signed so that its component of largest magnitude is positive (equal: the first).
    """
    half = (var_e - var_n) / 2.0
    root = F.sqrt(half * half + cov * cov)
    # angle of the first axis; without spread the axes are the coordinate axes
    theta = F.when(root > 0, F.atan2(cov, half + root)).otherwise(F.lit(0.0))
    theta = F.when((F.abs(cov) == 0) & (half < 0), F.lit(3.141592653589793 / 2)).otherwise(theta)
    c, s = F.cos(theta), F.sin(theta)
    # first axis (c, s), second (-s, c)
    first = F.when(F.abs(c) >= F.abs(s), F.when(c >= 0, s).otherwise(-s)).otherwise(F.abs(s))
    second = F.when(F.abs(s) >= F.abs(c), F.when(-s >= 0, c).otherwise(-c)).otherwise(F.abs(c))
    import math

    ca, sa = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return (first * ca - second * sa) * distance, (first * sa + second * ca) * distance
