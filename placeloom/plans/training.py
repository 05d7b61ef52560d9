"""Statistics, history and pooling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import history, pooling, stats
from .base import query, rounded, table

_CH = {"quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS channel, count({c}) AS n, round(sum({c}) / count({c}), 6) AS mean, round(sqrt(greatest(sum({c} * {c}) / count({c}) - pow(sum({c}) / count({c}), 2), 1e-8)), 6) AS std FROM lineitem" for k, c in _CH.items()))
def channel_stats(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(*[F.col(c).alias(k) for k, c in _CH.items()])
    return rounded(stats.channel_stats(li, list(_CH)), "mean", "std")


_STREAMS = "i AS (SELECT 's' || (l_suppkey % 5) AS stream, (l_suppkey % 5) * 900 + l_partkey AS place_id FROM lineitem)"


def _images(spark, sf_dir):
    s = F.col("l_suppkey") % 5
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), s).alias("stream"), (s * 900 + F.col("l_partkey")).alias("place_id"))


@query(f"WITH {_STREAMS} SELECT stream, min(place_id) AS lo, max(place_id) AS hi, count(DISTINCT place_id) AS places FROM i GROUP BY stream")
def id_ranges(spark, sf_dir):
    return stats.id_ranges(_images(spark, sf_dir))


@query(f"WITH {_STREAMS}, r AS (SELECT stream, min(place_id) AS lo, max(place_id) AS hi FROM i GROUP BY 1) SELECT a.stream AS stream_a, b.stream AS stream_b FROM r a JOIN r b ON a.stream < b.stream AND a.lo <= b.hi AND b.lo <= a.hi")
def id_overlap(spark, sf_dir):
    return stats.id_overlaps(stats.id_ranges(_images(spark, sf_dir)))


@query(f"WITH {_STREAMS}, r AS (SELECT stream, count(DISTINCT place_id) AS places, count(*) AS images FROM i GROUP BY 1) SELECT stream, places, images, places // 64 AS batches_per_epoch, round(1000.0::DOUBLE / nullif(places // 64, 0), 2) AS epochs_per_1k_steps FROM r")
def stream_summary(spark, sf_dir):
    return stats.stream_summary(_images(spark, sf_dir), 64)


_HIST = """h AS (SELECT o_orderpriority AS head, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS step, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2),
b AS (SELECT *, greatest(coalesce(max(value) OVER (PARTITION BY head ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0), -1.0) AS best_before FROM h),
im AS (SELECT *, CAST(value > best_before AS INT) AS improved FROM b)"""


def _history(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    step = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("long")
    return o.groupBy(F.col("o_orderpriority").alias("head"), step.alias("step")).agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


@query(f"WITH {_HIST} SELECT head, step, value, best_before, improved FROM im")
def best_heads(spark, sf_dir):
    return history.best_heads(_history(spark, sf_dir))


@query(f"WITH {_HIST}, g AS (SELECT *, sum(improved) OVER (PARTITION BY head ORDER BY step) AS g FROM im) SELECT head, step, CAST(row_number() OVER (PARTITION BY head, g ORDER BY step) - CASE WHEN g > 0 THEN 1 ELSE 0 END AS BIGINT) AS since_best FROM g")
def evals_since_best(spark, sf_dir):
    return history.evals_since_best(_history(spark, sf_dir)).select("head", "step", "since_best")


@query(f"WITH {_HIST} SELECT round(avg(CAST(value > 150000 AS INT)), 6) AS clip_share FROM h")
def clip_share(spark, sf_dir):
    return rounded(stats.clip_share(_history(spark, sf_dir).withColumnRenamed("value", "gnorm"), 150000), "clip_share")


@query("""SELECT o_orderkey, round(CASE WHEN o_orderkey % 12000 < 500 THEN 5e-5 * (o_orderkey % 12000 + 1) / 500.0 WHEN o_orderkey % 12000 > 10000 THEN 1e-6
  ELSE 1e-6 + 0.5 * (1.0 + cos(pi() * (o_orderkey % 12000 - 500) / 9500.0)) * (5e-5 - 1e-6) END, 10) AS lr FROM orders""")
def lr_schedule(spark, sf_dir):
    step = F.col("o_orderkey") % 12000
    return rounded(table(spark, sf_dir, "orders").select("o_orderkey", history.lr_schedule(step, 500, 5e-5, 10000, 1e-6).alias("lr")), "lr", digits=10)


_EVALS = """ev AS (SELECT CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS step, o_orderpriority AS condition, CASE WHEN count(*) % 7 <> 0 THEN round(avg(o_totalprice), 2) END AS value FROM orders GROUP BY 1, 2),
per AS (SELECT step, avg(value) FILTER (WHERE condition IN ('1-URGENT', '2-HIGH')) AS real, count(value) FILTER (WHERE condition IN ('1-URGENT', '2-HIGH')) AS n, max(value) FILTER (WHERE condition = '5-LOW') AS i2e FROM ev GROUP BY step),
heads AS (SELECT 'main' AS head, step, (real + i2e) / 2 AS value FROM per WHERE n = 2 UNION ALL SELECT 'real', step, real FROM per UNION ALL SELECT 'i2e', step, i2e FROM per),
ranked AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY value DESC, step) AS k FROM heads WHERE value IS NOT NULL)"""


@query(f"WITH {_EVALS} SELECT head, step, round(value, 4) AS value FROM ranked WHERE k = 1")
def selection_heads(spark, sf_dir):
    """The best step of each selection head, from evaluations by month and priority; each seventh count is an evaluation without a score."""
    o = table(spark, sf_dir, "orders")
    step = ((F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")).cast("long")
    evals = o.groupBy(step.alias("step"), F.col("o_orderpriority").alias("condition")).agg(F.when(F.count("*") % 7 != 0, F.round(F.avg("o_totalprice"), 2)).alias("value"))
    return rounded(history.best_of_heads(history.head_scores(evals, history.COMBINED, ["1-URGENT", "2-HIGH"], "5-LOW")), "value", digits=4)


_NAMES = """nm AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'encoder.blocks.' || (p_partkey % 12) || '.attn.weight' WHEN 1 THEN 'encoder.patch_embed.proj.weight' WHEN 2 THEN 'encoder.cls_token' WHEN 3 THEN 'encoder.norm.bias' WHEN 4 THEN 'aggregator.score.' || (p_partkey % 3) || '.weight' ELSE 'transformer.layer.bias' END AS name, p_partkey % 3 AS rank FROM part)"""


def _parameters(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.expr("case p_partkey % 6 when 0 then concat('encoder.blocks.', p_partkey % 12, '.attn.weight') when 1 then 'encoder.patch_embed.proj.weight' when 2 then 'encoder.cls_token' when 3 then 'encoder.norm.bias' when 4 then concat('aggregator.score.', p_partkey % 3, '.weight') else 'transformer.layer.bias' end")
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), (k % 3).alias("rank"))


@query(f"""WITH {_NAMES}, l AS (SELECT *, CASE WHEN name LIKE 'encoder.blocks.%' THEN CAST(regexp_extract(name, '^encoder\\.blocks\\.([0-9]+)', 1) AS INT) + 1 WHEN name LIKE 'encoder.patch_embed%' OR name IN ('encoder.cls_token', 'encoder.pos_embed') THEN 0 ELSE 13 END AS lid FROM nm)
SELECT p_partkey, name, lid AS layer, round(pow(0.9, 13 - lid), 8) AS lr_mult, CASE WHEN name LIKE '%encoder%' THEN 'encoder' WHEN name LIKE '%transformer%' THEN 'transformer' WHEN rank < 2 OR name LIKE '%.bias' THEN 'head_plain' ELSE 'head_decay' END AS grp FROM l""")
def parameter_routing(spark, sf_dir):
    n = F.col("name")
    out = _parameters(spark, sf_dir).select("p_partkey", "name", history.layer_id(n, 12).alias("layer"), history.layer_rate(n, 12, 0.9).alias("lr_mult"), history.parameter_group(n, F.col("rank")).alias("grp"))
    return rounded(out, "lr_mult", digits=8)


# Pooling: an image = 8 consecutive vectors, n = vector, d = component 1..4 (0-based); 3 clusters scored by components 11..13.
_FEATS = "f AS (SELECT vec_id // 8 AS id, CAST(vec_id % 8 AS INT) AS n, d, CAST(embedding[d + 1] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(4)) AS d))"


def _features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 8).alias("id"), (F.col("vec_id") % 8).cast("int").alias("n"), F.posexplode(F.slice("embedding", 1, 4)).alias("d", "v")).withColumns({"v": F.col("v").cast("double"), "d": F.col("d").cast("long")})


@query(f"WITH {_FEATS} SELECT id, d, round(pow(avg(pow(greatest(v, 1e-6), 3.0)), 1 / 3.0), 6) AS v FROM f GROUP BY id, d")
def gem_pool(spark, sf_dir):
    return rounded(pooling.gem(_features(spark, sf_dir)), "v")


@query(f"""WITH {_FEATS}, g AS (SELECT id, d, avg(v) AS v FROM f GROUP BY id, d), y AS (SELECT id, o, sum(v * ((o * 4 + d) % 5 - 2)) + o * 0.1 AS y FROM g, (SELECT unnest(range(3)) AS o) GROUP BY id, o)
SELECT id, o, round(y / greatest(sqrt(sum(y * y) OVER (PARTITION BY id)), 1e-12), 6) AS y FROM y""")
def linear_project(spark, sf_dir):
    pooled = _features(spark, sf_dir).groupBy("id", "d").agg(F.avg("v").alias("v"))
    weights = spark.range(12).select(F.floor(F.col("id") / 4).alias("o"), (F.col("id") % 4).alias("d"), ((F.col("id") % 5) - 2).cast("double").alias("w"))
    bias = spark.range(3).select(F.col("id").alias("o"), (F.col("id") * 0.1).alias("b"))
    return rounded(pooling.project(pooled, weights, bias), "y")


@query("SELECT vec_id, " + ", ".join(f"round({b} + " + " + ".join(f"{w} * CAST(embedding[{i + 1}] AS DOUBLE)" for i, w in enumerate(row)) + f", 6) AS y{k}" for k, (row, b) in enumerate((((1.0, -2.0, 0.5), 0.25), ((0.0, 3.0, 1.0), -1.0)))) + " FROM embeddings")
def linear_expression(spark, sf_dir):
    y = vectors.linear(F.slice("embedding", 1, 3), [[1.0, -2.0, 0.5], [0.0, 3.0, 1.0]], [0.25, -1.0])
    return rounded(table(spark, sf_dir, "embeddings").select("vec_id", y[0].alias("y0"), y[1].alias("y1")), "y0", "y1")


def _sinkhorn_sql(m: int) -> str:
    s = f"""sized AS (SELECT vec_id // 8 AS id, CASE WHEN count(*) > {m} THEN count(*) END AS size FROM embeddings GROUP BY 1),
sc AS (SELECT vec_id // 8 AS id, m, CAST(vec_id % 8 AS INT) AS n, CAST(embedding[m + 11] AS DOUBLE) AS s FROM embeddings, (SELECT unnest(range({m})) AS m)
  UNION ALL SELECT vec_id // 8, {m}, CAST(vec_id % 8 AS INT), 1.0 FROM embeddings),
z0 AS (SELECT sc.*, -ln(size + {m}) AS base, CASE WHEN m = {m} THEN -ln(size + {m}) + ln(size - {m}) ELSE -ln(size + {m}) END AS la, CAST(0 AS DOUBLE) AS v FROM sc JOIN sized ON sc.id = sized.id)"""
    for k in range(3):
        s += f""", u{k} AS (SELECT id, m, n, s, base, la, v, la - ln(sum(exp(s + v)) OVER (PARTITION BY id, m)) AS u FROM z{k}),
z{k + 1} AS (SELECT id, m, n, s, base, la, u, base - ln(sum(exp(s + u)) OVER (PARTITION BY id, n)) AS v FROM u{k})"""
    return s + f", p AS (SELECT id, m, n, s + u + v - base AS lp FROM z3)"


def _scores(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("id"), (F.col("vec_id") % 8).cast("int").alias("n"), "embedding")
    return e.select("id", "n", F.posexplode(F.slice("embedding", 11, 3)).alias("m", "s"))


@query(f"WITH {_sinkhorn_sql(3)} SELECT id, CAST(m AS INT) AS m, n, round(lp, 6) AS lp FROM p")
def sinkhorn(spark, sf_dir):
    return rounded(pooling.sinkhorn(_scores(spark, sf_dir), 3), "lp")


@query(f"""WITH {_FEATS}, {_sinkhorn_sql(3)}, c AS (SELECT f.id, m, d, sum(v * exp(lp)) AS v FROM f JOIN p ON f.id = p.id AND f.n = p.n WHERE m < 3 GROUP BY ALL),
cn AS (SELECT id, 2 + d * 3 + m AS pos, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id, m)), 1e-12) AS v FROM c),
t AS (SELECT vec_id // 8 AS id, k, CAST(embedding[k + 21] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(2)) AS k) WHERE vec_id % 8 = 0),
tn AS (SELECT id, k AS pos, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12) AS v FROM t), a AS (SELECT * FROM tn UNION ALL SELECT * FROM cn)
SELECT id, CAST(pos AS BIGINT) AS pos, round(v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12), 6) AS v FROM a""")
def salad_pool(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    tokens = table(spark, sf_dir, "embeddings").where("vec_id % 8 = 0").select(F.floor(F.col("vec_id") / 8).alias("id"), F.posexplode(F.slice("embedding", 21, 2)).alias("k", "v"))
    tokens = tokens.withColumn("v", F.col("v").cast("double"))
    return rounded(pooling.salad(_features(spark, sf_dir), scores, tokens, 3, None, 4), "v")
