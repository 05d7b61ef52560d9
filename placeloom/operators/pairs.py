"""Pairs within batches: mining, memory and the multi-similarity loss (formula of the published loss)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot


def batch_pairs(batch: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """All ordered pairs of a batch (batch_id, item, label): (batch_id, a, b, positive). A batch's size is the recipe's, not the data's."""
    a, b = (batch.select("batch_id", F.col("item").alias(s), F.col("label").alias(f"label_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in carry]) for s in "ab")
    return a.join(b, "batch_id").where("a != b").select("batch_id", "a", "b", (F.col("label_a") == F.col("label_b")).cast("int").alias("positive"), *[f"{c}_{s}" for c in carry for s in "ab"])


def multi_similarity(batch: DataFrame, alpha: float = 2.0, beta: float = 50.0, base: float = 0.5, epsilon: float = 0.1) -> DataFrame:
    """Per anchor the mined pair counts and loss. batch: batch_id, item, label, embedding (unit length)."""
    pairs = batch_pairs(batch, ("embedding",)).withColumn("s", dot(F.col("embedding_a"), F.col("embedding_b"))).drop("embedding_a", "embedding_b")
    anchor = Window.partitionBy("batch_id", "a")
    pairs = pairs.withColumns({"hard_pos": F.min(F.when(F.col("positive") == 1, F.col("s"))).over(anchor), "hard_neg": F.max(F.when(F.col("positive") == 0, F.col("s"))).over(anchor)})
    mined = pairs.where(((F.col("positive") == 1) & (F.col("s") - epsilon < F.col("hard_neg"))) | ((F.col("positive") == 0) & (F.col("s") + epsilon > F.col("hard_pos"))))
    pos, neg = F.col("positive") == 1, F.col("positive") == 0
    out = mined.groupBy("batch_id", "a").agg(
        F.count_if(pos).alias("positives"),
        F.count_if(neg).alias("negatives"),
        (F.log1p(F.coalesce(F.sum(F.when(pos, F.exp(-alpha * (F.col("s") - base)))), F.lit(0.0))) / alpha + F.log1p(F.coalesce(F.sum(F.when(neg, F.exp(beta * (F.col("s") - base)))), F.lit(0.0))) / beta).alias("loss"),
    )
    return out.withColumnRenamed("a", "anchor")


def memory_pairs(stream: DataFrame, size: int, block: int = 1024) -> DataFrame:
    """Each item against the `size` items before it (seq order): (seq, earlier, positive). stream: seq, label.

    A range join made equi: an item meets the blocks of sequence numbers its window touches.
    """
    at = F.floor(F.col("seq") / block)
    live = stream.select("seq", "label", F.explode(F.sequence(F.floor((F.col("seq") - size) / block), at)).alias("blk"))
    old = stream.select(F.col("seq").alias("earlier"), F.col("label").alias("old"), at.alias("blk"))
    return live.join(old, "blk").where((F.col("earlier") < F.col("seq")) & (F.col("earlier") >= F.col("seq") - size)).select("seq", "earlier", (F.col("label") == F.col("old")).cast("int").alias("positive"))


def step_labels(labels: DataFrame, streams: int) -> DataFrame:
    """Labels that differ between streams and steps: label * streams + stream number."""
    return labels.withColumn("label", F.col("label") * streams + F.col("stream_no"))
