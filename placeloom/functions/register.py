"""SQL names for the functions that queries share. They are SQL functions, so Catalyst inlines them."""

from __future__ import annotations

from pyspark.sql import SparkSession

FUNCTIONS = {
    "bearing": ("de DOUBLE, dn DOUBLE", "DOUBLE", "pmod(degrees(atan2(de, dn)), 360D)"),
    "angular_difference": ("a DOUBLE, b DOUBLE", "DOUBLE", "abs(pmod(a - b + 180D, 360D) - 180D)"),
    "dot_product": ("a ARRAY<FLOAT>, b ARRAY<FLOAT>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"),
    "grid_cell": ("v DOUBLE, size BIGINT", "BIGINT", "cast(floor(v / size) as bigint) * size"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    return sorted(FUNCTIONS)
