"""Descriptor pooling over long-form features, as grouped aggregations.

Features: (id, n, d, v), position n and channel d. Scores: (id, m, n, s), cluster m. All groups are one image's, so no group grows with
the data; what takes several groupings of an image is partitioned by image once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TINY = 1e-12
#: Tasks that share the inputs of one block of weights.
SPREAD = 32


def gem(features: DataFrame, p: float = 3.0, eps: float = 1e-6) -> DataFrame:
    """Generalised mean per image and channel."""
    return features.groupBy("id", "d").agg(F.pow(F.avg(F.pow(F.greatest(F.col("v").cast("double"), F.lit(eps)), F.lit(p))), F.lit(1.0 / p)).alias("v"))


#: Weights up to this many rows go through expressions as a table; larger ones as blocks of a matrix.
TABLE_WEIGHTS = 1 << 20
#: Bytes of the blocks of a weight matrix, and of the inputs multiplied at a time.
BLOCK_BYTES = 32 << 20


def project(features: DataFrame, weights: DataFrame, bias: DataFrame) -> DataFrame:
    """normalize(W x + b). features: id, d, v; weights: o, d, w; bias: o, b.

    Up to TABLE_WEIGHTS weights (counted) are joined on d and summed by output. Larger matrices, whose join would make a row for each
    input and output, go through `project_blocks`.
    """
    n = weights.count()
    if n > TABLE_WEIGHTS:
        y = project_blocks(features, weights)
    else:
        y = features.join(F.broadcast(weights), "d").groupBy("id", "o").agg(F.sum(F.col("v") * F.col("w")).alias("y"))
    return normalized(y.join(bias, "o").select("id", "o", (F.col("y") + F.col("b")).alias("y")), ["id"], "y")


def project_blocks(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, o, y = sum of w * v): inputs as vectors, the matrix in blocks of outputs that meet them by a shuffle on the block.

    A block holds BLOCK_BYTES of weights; inputs are sent once a block, and a task holds one block and a batch of inputs at a time.
    """
    width = (features.agg(F.max("d")).first()[0] or 0) + 1
    step = max(1, BLOCK_BYTES // (8 * width))
    blocks = weights.withColumn("block", F.floor(F.col("o") / step).cast("long"))
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    vectors = features.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("d", F.col("v").cast("double")))).alias("m"))
    vectors = vectors.select("id", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(F.col("m")[d.cast(features.schema["d"].dataType)], F.lit(0.0))).alias("x"))
    # a block's rows of weights come before its inputs; inputs of a block are spread over `spread` tasks, each with the block
    spread = F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")
    inputs = vectors.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), spread.alias("salt"), F.lit(1).alias("kind"), F.col("id").cast("string").alias("id"), F.lit(None).cast("long").alias("o"), "x")
    rows = blocks.groupBy("block", "o").agg(F.map_from_entries(F.collect_list(F.struct("d", F.col("w").cast("double")))).alias("m"))
    rows = rows.select("block", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("id"), F.col("o").cast("long").alias("o"), F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda d: F.coalesce(F.col("m")[d.cast(weights.schema["d"].dataType)], F.lit(0.0))).alias("x"))
    both = rows.unionByName(inputs).repartition("block", "salt").sortWithinPartitions("block", "salt", "kind", "o")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, outputs, matrix, stacked = None, [], [], None
        for batch in batches:
            step = max(1, BLOCK_BYTES // (8 * width))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                block, salt, kind = (part.column(i).to_numpy() for i in range(3))
                x = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                cut = [0, *(np.flatnonzero((block[1:] != block[:-1]) | (salt[1:] != salt[:-1])) + 1).tolist(), len(block)]
                for a, b in zip(cut, cut[1:], strict=False):
                    if key != (block[a], salt[a]):
                        key, outputs, matrix, stacked = (block[a], salt[a]), [], [], None
                    mine = kind[a:b] == 0
                    outputs += [o for o in part.column(4).slice(a, b - a).to_pylist() if o is not None]
                    matrix += list(x[a:b][mine])
                    if mine.all():
                        continue
                    stacked = np.stack(matrix) if stacked is None or mine.any() else stacked
                    ids = [i for i in part.column(3).slice(a, b - a).to_pylist() if i is not None]
                    y = x[a:b][~mine] @ stacked.T
                    yield pa.record_batch([pa.array(np.repeat(np.array(ids, object), len(outputs)).tolist(), pa.string()), pa.array(np.tile(outputs, len(ids)), pa.int64()), pa.array(y.ravel())], names=["id", "o", "y"])

    out = both.select("block", "salt", "kind", "id", "o", "x").mapInArrow(run, "id string, o long, y double")
    return out.select(F.col("id").cast(features.schema["id"].dataType).alias("id"), "o", "y")


def normalized(df: DataFrame, by: list[str], value: str) -> DataFrame:
    length = F.sqrt(F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(*by)))
    return df.withColumn(value, F.col(value) / F.greatest(length, F.lit(TINY)))


def log_sum_exp(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    df = df.withColumn("_top", F.max(value).over(w))
    return df.withColumn(out, F.col("_top") + F.log(F.sum(F.exp(F.col(value) - F.col("_top"))).over(w))).drop("_top")


def sinkhorn(scores: DataFrame, m: int, n: int | None = None, dustbin: float = 1.0, iterations: int = 3) -> DataFrame:
    """Log-domain optimal transport with a dustbin row m; adds `lp`, rows m of the dustbin included.

    n: positions of every image, or None to count each image's own. An image with no more positions than clusters has no transport: its lp is null.
    """
    if n is not None and n <= m:
        raise ValueError("needs more positions than clusters")
    scores = scores.select("id", "m", "n", "s").repartition("id")  # serves every window below
    bins = scores.select("id", "n").distinct().repartition("id").select("id", F.lit(m).cast("int").alias("m"), F.col("n").cast("int").alias("n"), F.lit(float(dustbin)).alias("s"))
    df = scores.select("id", F.col("m").cast("int").alias("m"), F.col("n").cast("int").alias("n"), F.col("s").cast("double").alias("s")).unionByName(bins)
    size = F.count_if(F.col("m") == m).over(Window.partitionBy("id")) if n is None else F.lit(n)
    df = df.withColumn("size", size.cast("double")).withColumn("base", F.when(F.col("size") > m, -F.log(F.col("size") + m)))
    base = F.col("base")
    df = df.withColumn("log_a", F.when(F.col("m") == m, base + F.log(F.col("size") - m)).otherwise(base)).withColumn("v", F.lit(0.0))
    for _ in range(iterations):
        df = log_sum_exp(df.withColumn("z", F.col("s") + F.col("v")), ["id", "m"], "z", "lse").withColumn("u", F.col("log_a") - F.col("lse"))
        df = log_sum_exp(df.withColumn("z", F.col("s") + F.col("u")), ["id", "n"], "z", "lse").withColumn("v", base - F.col("lse"))
    return df.select("id", "m", "n", (F.col("s") + F.col("u") + F.col("v") - base).alias("lp"))


def salad(features: DataFrame, scores: DataFrame, tokens: DataFrame, m: int, n: int | None, dim: int, dustbin: float = 1.0) -> DataFrame:
    """(id, pos, v): the unit token, then unit cluster sums in channel-major order, unit as a whole. tokens: id, k, v."""
    p = sinkhorn(scores, m, n, dustbin).where(F.col("m") < m).select("id", "m", "n", F.exp("lp").alias("p"))
    sums = features.join(p, ["id", "n"]).groupBy("id", "m", "d").agg(F.sum(F.col("v") * F.col("p")).alias("v"))
    sums = normalized(sums, ["id", "m"], "v")
    size = tokens.select("id", "k", "v")
    token = normalized(size, ["id"], "v")
    width = token.groupBy("id").agg(F.count("*").alias("width"))
    flat = sums.join(width, "id").select("id", (F.col("width") + F.col("d") * m + F.col("m")).cast("long").alias("pos"), "v")
    both = token.select("id", F.col("k").cast("long").alias("pos"), "v").unionByName(flat)
    return normalized(both, ["id"], "v")
