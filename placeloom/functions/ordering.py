"""Seeded random order (by MD5 of seed and key, the same in every engine and for every partitioning) and gapless ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows that one task may put in order; more are ordered by range over many tasks.
ONE_TASK_ROWS = 200_000


def draw(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def uniform(seed: int | str, *keys: Column) -> Column:
    """[0, 1) from the first 8 hex digits of the draw."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def with_ordinal(df: DataFrame, order: list[Column | str], out: str) -> DataFrame:
    """Adds the gapless position from 0 in the order of all rows, which must be total.

    The rows (one a group, not one a member) are written to the shared folder first, so they are computed once. Up to
    ONE_TASK_ROWS (checked) it is a plain window. Beyond that, rows are range-partitioned and sorted; a row's position is
    its place in its part plus the sizes of earlier parts (one small row a part).
    """
    from ..storage import written

    df = written(df, "groups")
    if df.count() <= ONE_TASK_ROWS:
        return df.withColumn(out, (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id())
    placed = written(placed, "ordinal")
    part = F.shiftrightunsigned("_m", 33)
    sizes = sorted((r.part, r.n) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before, rows = 0, []
    for p, n in sizes:
        rows.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(rows, "_part long, _start long")
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_start")


def rank_within(df: DataFrame, by: list[str], order: list[Column | str], out: str, coarse: Column | None = None) -> DataFrame:
    """Adds the gapless rank from 0 within `by`.

    `coarse`, a column that never falls as the order goes on (such as the day of a time), splits a hot group: ranks are taken
    within (by, coarse), and the sizes of earlier coarse groups are added.
    """
    if coarse is None:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    df = df.withColumn("_c", coarse)
    sizes = df.groupBy(*by, "_c").agg(F.count("*").alias("_n"))
    before = sizes.select(*by, "_c", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_c")) - F.col("_n")).alias("_before"))
    local = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_c").orderBy(*order)) - 1)
    return local.join(before, [*by, "_c"]).withColumn(out, (F.col("_before") + F.col("_r")).cast("long")).drop("_c", "_r", "_before")
