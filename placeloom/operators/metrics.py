"""Recall@k of rankings (query_id, reference_id, rank) against edges (query_id, reference_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KS = (1, 5, 10, 20)


def hits(ranked: DataFrame, edges: DataFrame, queries: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Per query (all columns of `queries`, keyed by query_id): scorable, and hit_k for each k."""
    first = ranked.join(edges, ["query_id", "reference_id"]).groupBy("query_id").agg(F.min("rank").alias("first_hit"))
    scorable = edges.select("query_id").distinct().withColumn("scorable", F.lit(1))
    out = queries.join(scorable, "query_id", "left").join(first, "query_id", "left")
    return out.select(*queries.columns, F.coalesce("scorable", F.lit(0)).alias("scorable"), *[F.coalesce((F.col("first_hit") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks])


def _recall(k: int, zero: bool) -> Column:
    share = F.sum(F.col("scorable") * F.col(f"hit_{k}")).cast("double")
    n = F.sum("scorable")
    return (F.coalesce(share, F.lit(0.0)) / F.greatest(F.coalesce(n, F.lit(0)), F.lit(1))) if zero else F.try_divide(share, n.cast("double"))


def recall(per_query: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """Over scorable queries; null if there is none."""
    return per_query.agg(*[_recall(k, False).alias(f"r_at_{k}") for k in ks], F.count("*").alias("queries"), F.coalesce(F.sum("scorable"), F.lit(0)).cast("long").alias("scorable_queries"))


def recall_training(per_query: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """As `recall`, but 0 if no query is scorable."""
    return per_query.agg(*[_recall(k, True).alias(f"r_at_{k}") for k in ks])


def recall_by(per_query: DataFrame, group: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """One row a group and one for all (null group): grouping sets in one pass."""
    rolled = per_query.groupingSets([[F.col(group)], []], F.col(group)).agg(*[_recall(k, True).alias(f"r_at_{k}") for k in ks], F.count("*").alias("queries"), F.sum("scorable").cast("long").alias("scorable_queries"))
    return rolled


def top1_summary(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").agg(F.count("*").alias("queries"), F.avg("score").alias("mean_top1"), F.min("score").alias("min_top1"))
