"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two grouped minima and two equi-joins; a node's neighbours never meet in one task except
through a partial minimum, and a hot node's join is one that adaptive execution may split. Rounds are
written to the shared folder, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1] or 0


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v) longs, each pair in either direction, u != v. Returns (node, root), root = least node reachable, for nodes with root < node."""
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        # large star: every larger neighbour of u is tied to the least of u's neighbours and u
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: u and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = written(small.where("u != v").distinct(), "edges")
        if (after := _state(now)) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
    if state[0]:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
