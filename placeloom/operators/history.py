"""Training-history summaries over (head, step, value), and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def best_heads(history: DataFrame, head: str = "head", floor: float = -1.0) -> DataFrame:
    """Adds best_before (running maximum of earlier steps, from `floor`) and improved (strictly above it)."""
    before = Window.partitionBy(head).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    out = history.withColumn("best_before", F.coalesce(F.max("value").over(before), F.lit(floor)))
    out = out.withColumn("best_before", F.greatest("best_before", F.lit(floor)))
    return out.withColumn("improved", (F.col("value") > F.col("best_before")).cast("int"))


#: The selection that asks for both real recordings and held-out cities.
COMBINED = "combined"


def head_scores(evals: DataFrame, select: str, real: list[str], held_out: str = "indomain") -> DataFrame:
    """(head, step, value) of the selection heads; evals: (step, condition, value), value null where a condition did not score.

    real: mean over the real conditions that scored. i2e: the held-out condition. main: the selected condition, or COMBINED, the mean of
    the real mean and the held-out one, which needs every real condition. A head without a value at a step has no row there.
    """
    per = evals.groupBy("step").agg(
        F.avg(F.when(F.col("condition").isin(real), F.col("value"))).alias("real"),
        F.count(F.when(F.col("condition").isin(real), F.col("value"))).alias("n"),
        F.max(F.when(F.col("condition") == held_out, F.col("value"))).alias("i2e"),
        F.max(F.when(F.col("condition") == select, F.col("value"))).alias("one"),
    )
    main = F.when(F.col("n") == len(set(real)), (F.col("real") + F.col("i2e")) / 2) if select == COMBINED else F.col("one")
    heads = F.array(*[F.struct(F.lit(h).alias("head"), v.alias("value")) for h, v in (("main", main), ("real", F.col("real")), ("i2e", F.col("i2e")))])
    return per.select("step", F.explode(heads).alias("h")).select("h.head", "step", "h.value").where("value is not null")


def best_of_heads(scores: DataFrame) -> DataFrame:
    """(head, step, value): the first step at which each head reached its best."""
    best = scores.groupBy("head").agg(F.max(F.struct(F.col("value"), (-F.col("step")).alias("s"))).alias("b"))
    return best.select("head", (-F.col("b.s")).alias("step"), F.col("b.value").alias("value"))


def evals_since_best(history: DataFrame, head: str = "head") -> DataFrame:
    """Adds since_best: evaluations since the last improvement (0 at one)."""
    upto = Window.partitionBy(head).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    out = best_heads(history, head).withColumn("_g", F.sum("improved").over(upto))
    within = Window.partitionBy(head, "_g").orderBy("step")
    return out.withColumn("since_best", (F.row_number().over(within) - F.when(F.col("_g") > 0, 1).otherwise(0)).cast("long")).drop("_g")


def lr_schedule(step: Column, warmup: int, lr: float, decay_steps: int, min_lr: float) -> Column:
    """Linear warm-up from step + 1, cosine to min_lr, then min_lr."""
    ratio = (step - warmup) / float(max(decay_steps - warmup, 1))
    cosine = F.lit(min_lr) + 0.5 * (1.0 + F.cos(F.lit(math.pi) * ratio)) * (lr - min_lr)
    return F.when(step < warmup, F.lit(lr) * (step + 1) / float(max(1, warmup))).when(step > decay_steps, F.lit(min_lr)).otherwise(cosine)


def layer_id(name: Column, layers: int, prefix: str = "encoder") -> Column:
    """Depth of a parameter by its name: 0 for embeddings, block + 1, layers + 1 for the rest."""
    block = F.regexp_extract(name, rf"^{prefix}\.blocks\.(\d+)", 1)
    low = name.startswith(f"{prefix}.patch_embed") | name.isin(*[f"{prefix}.{t}" for t in ("cls_token", "pos_embed", "mask_token", "register_tokens")])
    return F.when(block != "", block.try_cast("int") + 1).when(low, 0).otherwise(layers + 1)


def layer_rate(name: Column, layers: int, decay: float, prefix: str = "encoder") -> Column:
    return F.pow(F.lit(decay), F.lit(layers + 1) - layer_id(name, layers, prefix))


def parameter_group(name: Column, rank: Column) -> Column:
    """encoder, transformer, head with weight decay, head without."""
    return F.when(F.contains(name, F.lit("encoder")), "encoder").when(F.contains(name, F.lit("transformer")), "transformer").when((rank < 2) | name.endswith(".bias"), "head_plain").otherwise("head_decay")


def token_grid(height: int, width: int, patch: int) -> tuple[int, int]:
    if height % patch or width % patch:
        raise ValueError("image size must be a multiple of the patch size")
    return height // patch, width // patch


def descriptor_width(clusters: int, dim: int, token: int) -> int:
    return clusters * dim + token
