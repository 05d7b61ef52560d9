"""Retrieval, ground truth and metrics over the descriptor bank and the point tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import metrics, pairs, retrieval, truth
from .base import BOUNDED_SQL, DAY, GEO_SQL, HEIGHT, RANKED_SQL, WIDTH, bank, geo_points, label_edges, query, rounded, table

K = 20


def _ranked(spark, sf_dir, k=K):
    references, queries = bank(spark, sf_dir)
    return retrieval.topk(references, queries, k), references, queries


@query(f"WITH {RANKED_SQL} SELECT query_id, reference_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= {K}")
def topk_cosine(spark, sf_dir):
    return rounded(_ranked(spark, sf_dir)[0], "score")


@query(f"WITH {RANKED_SQL} SELECT query_id, reference_id, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def topk_expression(spark, sf_dir):
    references, queries = bank(spark, sf_dir)
    return rounded(retrieval.topk_expression(references, queries, 5), "score")


def _per_query(spark, sf_dir):
    ranked, references, queries = _ranked(spark, sf_dir)
    return metrics.hits(ranked, label_edges(references, queries), queries.select(F.col("id").alias("query_id"), "traverse"))


HITS_SQL = RANKED_SQL + """, per AS (SELECT q.id AS query_id, q.traverse, CASE WHEN q.id IN (SELECT query_id FROM edges) THEN 1 ELSE 0 END AS scorable,
  (SELECT min(rank) FROM ranked k JOIN edges g ON k.query_id = g.query_id AND k.reference_id = g.reference_id WHERE k.query_id = q.id AND rank <= 20) AS first_hit FROM q),
hit AS (SELECT *, """ + ", ".join(f"coalesce(CAST(first_hit <= {k} AS INT), 0) AS hit_{k}" for k in metrics.KS) + " FROM per)"
_SHARE = ", ".join(f"round(CAST(sum(scorable * hit_{k}) AS DOUBLE) / nullif(sum(scorable), 0), 6) AS r_at_{k}" for k in metrics.KS)
_SHARE0 = ", ".join(f"round(coalesce(CAST(sum(scorable * hit_{k}) AS DOUBLE), 0) / greatest(coalesce(sum(scorable), 0), 1), 6) AS r_at_{k}" for k in metrics.KS)
_RS = [f"r_at_{k}" for k in metrics.KS]


@query(f"WITH {HITS_SQL} SELECT {_SHARE}, count(*) AS queries, CAST(coalesce(sum(scorable), 0) AS BIGINT) AS scorable_queries FROM hit")
def recall_at_k(spark, sf_dir):
    return rounded(metrics.recall(_per_query(spark, sf_dir)), *_RS)


@query(f"WITH {HITS_SQL} SELECT {_SHARE0} FROM hit")
def recall_train(spark, sf_dir):
    return rounded(metrics.recall_training(_per_query(spark, sf_dir)), *_RS)


@query(f"WITH {HITS_SQL} SELECT traverse, {_SHARE0}, count(*) AS queries, CAST(sum(scorable) AS BIGINT) AS scorable_queries FROM hit GROUP BY GROUPING SETS ((traverse), ())")
def recall_per_city(spark, sf_dir):
    return rounded(metrics.recall_by(_per_query(spark, sf_dir), "traverse"), *_RS)


@query(f"WITH {HITS_SQL} SELECT query_id, scorable, hit_1, hit_5, hit_10, hit_20 FROM hit")
def hit_lookup(spark, sf_dir):
    return _per_query(spark, sf_dir).drop("traverse")


@query(f"WITH {RANKED_SQL} SELECT count(*) AS queries, round(avg(score), 6) AS mean_top1, round(min(score), 6) AS min_top1 FROM ranked WHERE rank = 1")
def top1_summary(spark, sf_dir):
    return rounded(metrics.top1_summary(_ranked(spark, sf_dir, 1)[0]), "mean_top1", "min_top1")


@query("""WITH db AS (SELECT vec_id AS id, embedding AS e, vec_id % 5 AS cond FROM embeddings WHERE vec_id % 5 <> 0),
q AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE vec_id % 10 = 0),
scored AS (SELECT q.id AS query_id, db.id AS reference_id, cond, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: CAST(q.e[i] AS DOUBLE) * CAST(db.e[i] AS DOUBLE))) AS score FROM q, db),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference_id) AS rank FROM scored)
SELECT query_id, reference_id, cond, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM ranked WHERE rank <= 10""")
def pooled_retrieval(spark, sf_dir):
    """Every traverse but the queries' own, pooled by union into one database."""
    references, queries = bank(spark, sf_dir)
    parts = [references.where(F.col("traverse") == cond).withColumn("cond", F.lit(cond).cast("long")) for cond in (1, 2, 3, 4)]
    pool = reduce(DataFrame.unionByName, parts)
    return rounded(retrieval.topk(pool, queries, 10).join(pool.select(F.col("id").alias("reference_id"), "cond"), "reference_id").select("query_id", "reference_id", "cond", "rank", "score"), "score")


@query("SELECT CAST(d.doc_id AS VARCHAR) AS query_id, CAST(l.quality AS VARCHAR) AS reference_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL")
def gt_edges_csv(spark, sf_dir):
    """Labels as (query_id, reference_id) pairs, resolved against both sample tables."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("query_id"), F.col("quality").cast("string").alias("reference_id"))
    known = labels.join(docs, labels.query_id == docs.id, "left_semi")
    return truth.edges_from_pairs(known, known.select(F.col("reference_id").alias("id")).distinct(), docs)


@query("""WITH r AS (SELECT n_nationkey AS id, n_regionkey AS g FROM nation), q AS (SELECT r_regionkey AS id FROM region)
SELECT q.id AS query_id, r.id AS reference_id FROM q JOIN r ON r.g = q.id""")
def gt_matrix(spark, sf_dir):
    """A 0/1 matrix of nations by regions, rows and columns by position, as edges."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    cells = nation.crossJoin(region).select(F.col("n_nationkey").alias("row"), F.col("r_regionkey").alias("col"), (F.col("n_regionkey") == F.col("r_regionkey")).cast("int").alias("value"))
    return truth.edges_from_matrix(cells, nation.select(F.col("n_nationkey").alias("idx"), F.col("n_nationkey").alias("id")), region.select(F.col("r_regionkey").alias("idx"), F.col("r_regionkey").alias("id")))


RADIUS = 250.0


@query(f"WITH {GEO_SQL} SELECT c.id AS query_id, s.id AS reference_id FROM c JOIN s ON (c.e - s.e) * (c.e - s.e) + (c.n - s.n) * (c.n - s.n) <= 62500.0")
def gt_radius(spark, sf_dir):
    return truth.radius_edges(*geo_points(spark, sf_dir), RADIUS)


@query(f"""WITH {GEO_SQL} SELECT c.id AS query_id, s.id AS reference_id FROM c JOIN s ON CAST(sqrt(pow(CAST(CAST(c.e AS FLOAT) AS DOUBLE) - CAST(CAST(s.e AS FLOAT) AS DOUBLE), 2)
  + pow(CAST(CAST(c.n AS FLOAT) AS DOUBLE) - CAST(CAST(s.n AS FLOAT) AS DOUBLE), 2)) AS FLOAT) <= CAST(250 AS FLOAT)""")
def gt_radius_float32(spark, sf_dir):
    return truth.radius_edges_float32(*geo_points(spark, sf_dir), RADIUS)


@query(f"WITH {GEO_SQL} SELECT c.id AS query_id, s.id AS reference_id, c.city AS city FROM c JOIN s ON c.city = s.city AND (c.e - s.e) * (c.e - s.e) + (c.n - s.n) * (c.n - s.n) <= 62500.0")
def gt_block_city(spark, sf_dir):
    return truth.radius_edges(*geo_points(spark, sf_dir), RADIUS, on=["city"])


@query(f"WITH {GEO_SQL} SELECT id, city FROM c WHERE EXISTS (SELECT 1 FROM s WHERE (c.e - s.e) * (c.e - s.e) + (c.n - s.n) * (c.n - s.n) <= 62500.0)")
def answerable_queries(spark, sf_dir):
    references, queries = geo_points(spark, sf_dir)
    return truth.answerable(queries, truth.radius_edges(references, queries, RADIUS)).select("id", "city")


@query(f"""WITH {GEO_SQL}, g AS (SELECT c.id AS q, s.id AS r FROM c JOIN s ON (c.e - s.e) * (c.e - s.e) + (c.n - s.n) * (c.n - s.n) <= 62500.0)
SELECT (SELECT count(*) FROM c) AS queries, (SELECT count(*) FROM s) AS "references", count(*) AS edges, count(DISTINCT q) AS scorable,
  round(CAST(count(*) AS DOUBLE) / ((SELECT count(*) FROM c) * (SELECT count(*) FROM s)), 6) AS density FROM g""")
def gt_density(spark, sf_dir):
    references, queries = geo_points(spark, sf_dir)
    return rounded(truth.density(truth.radius_edges(references, queries, RADIUS), queries, references), "density")


@query("""SELECT a.vec_id // 5 AS slice, a.vec_id AS id, b.vec_id AS other FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 WHERE a.vec_id % 5 = 0 AND b.vec_id % 5 = 1""")
def positional_zip(spark, sf_dir):
    # the last slice may lack its second id: like the SQL, the query takes the slices that have both
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 5).alias("slice"), "vec_id")
    return truth.zipped([e.where("vec_id % 5 = 0").select("slice", F.col("vec_id").alias("id")), e.where("vec_id % 5 = 1").select("slice", F.col("vec_id").alias("other"))], equal=False)


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 6) AS length,
  round(embedding[1] / greatest(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * v))), 1e-12), 6) AS first FROM embeddings""")
def l2_normalize(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return rounded(e.select("vec_id", vectors.norm(F.col("embedding")).alias("length"), F.element_at(vectors.l2_normalize(F.col("embedding")), 1).alias("first")), "length", "first")


BATCH_SQL = """batch AS (SELECT vec_id // 16 AS batch_id, vec_id AS item, label, embedding AS e FROM embeddings),
pr AS (SELECT a.batch_id, a.item AS a, b.item AS b, a.label = b.label AS positive,
  list_sum(list_transform(range(1, len(a.e) + 1), lambda i: CAST(a.e[i] AS DOUBLE) * CAST(b.e[i] AS DOUBLE))) AS s FROM batch a JOIN batch b ON a.batch_id = b.batch_id AND a.item <> b.item)"""


def _batch(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 16).alias("batch_id"), F.col("vec_id").alias("item"), "label", "embedding")


@query(f"WITH {BATCH_SQL} SELECT batch_id, a, b, CAST(positive AS INT) AS positive FROM pr")
def batch_pairs(spark, sf_dir):
    return pairs.batch_pairs(_batch(spark, sf_dir))


@query(f"""WITH {BATCH_SQL}, h AS (SELECT *, min(CASE WHEN positive THEN s END) OVER w AS hard_pos, max(CASE WHEN NOT positive THEN s END) OVER w AS hard_neg FROM pr WINDOW w AS (PARTITION BY batch_id, a)),
m AS (SELECT * FROM h WHERE (positive AND s - 0.1 < hard_neg) OR (NOT positive AND s + 0.1 > hard_pos))
SELECT batch_id, a AS anchor, count(*) FILTER (WHERE positive) AS positives, count(*) FILTER (WHERE NOT positive) AS negatives,
  round(ln(1 + coalesce(sum(exp(-2.0 * (s - 0.5))) FILTER (WHERE positive), 0)) / 2.0 + ln(1 + coalesce(sum(exp(50.0 * (s - 0.5))) FILTER (WHERE NOT positive), 0)) / 50.0, 6) AS loss FROM m GROUP BY ALL""")
def ms_pairs(spark, sf_dir):
    return rounded(pairs.multi_similarity(_batch(spark, sf_dir)), "loss")


@query("""SELECT a.event_id AS seq, b.event_id AS earlier, CAST(a.event_type = b.event_type AS INT) AS positive FROM events a JOIN events b ON b.event_id < a.event_id AND b.event_id >= a.event_id - 8""")
def memory_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("label"))
    return pairs.memory_pairs(e, 8)


@query("SELECT vec_id, label * 6 + vec_id % 6 AS label FROM embeddings")
def step_labels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), (F.col("vec_id") % 6).alias("stream_no"))
    return pairs.step_labels(e, 6).select("vec_id", "label")


@query(f"""WITH {BOUNDED_SQL}, px AS (SELECT slice, y, x, count(*) FILTER (WHERE p > 0) AS pos, count(*) FILTER (WHERE p <= 0) AS neg FROM sliced GROUP BY ALL),
lim AS (SELECT slice, CAST(quantile_cont(CASE WHEN pos > 0 THEN pos END, 0.99) AS FLOAT) AS pl, CAST(quantile_cont(CASE WHEN neg > 0 THEN neg END, 0.99) AS FLOAT) AS nl FROM px GROUP BY slice),
ab AS (SELECT px.slice, CASE WHEN pl IS NULL THEN CAST(0 AS FLOAT) ELSE least(CAST(pos AS FLOAT), pl) / pl END AS a, CASE WHEN nl IS NULL THEN CAST(0 AS FLOAT) ELSE least(CAST(neg AS FLOAT), nl) / nl END AS c FROM px JOIN lim ON px.slice = lim.slice),
win AS (SELECT slice, CASE WHEN a >= c THEN a ELSE CAST(0 AS FLOAT) END AS ip, CASE WHEN a >= c THEN CAST(0 AS FLOAT) ELSE c END AS im FROM ab),
f AS (SELECT slice, 255 - trunc((CAST(1 AS FLOAT) - im) * CAST(255 AS FLOAT)) AS r, 255 - trunc(greatest((CAST(1 AS FLOAT) - ip) - im, CAST(0 AS FLOAT)) * CAST(255 AS FLOAT)) AS g, 255 - trunc((CAST(1 AS FLOAT) - ip) * CAST(255 AS FLOAT)) AS b FROM win),
m AS (SELECT s.slice, 1.0::DOUBLE - coalesce(sum(r), 0) / (255.0::DOUBLE * 192) AS r, 1.0::DOUBLE - coalesce(sum(g), 0) / (255.0::DOUBLE * 192) AS g, 1.0::DOUBLE - coalesce(sum(b), 0) / (255.0::DOUBLE * 192) AS b
  FROM (SELECT unnest(range(CAST(floor((hi - lo) / {DAY}.0) AS BIGINT) + 1)) AS slice FROM bounds) s LEFT JOIN f ON f.slice = s.slice GROUP BY s.slice),
u AS (SELECT slice, r / sqrt(r * r + g * g + b * b) AS r, g / sqrt(r * r + g * g + b * b) AS g, b / sqrt(r * r + g * g + b * b) AS b FROM m)
SELECT q.slice AS query_slice, count(*) AS compared, round(max(q.r * d.r + q.g * d.g + q.b * d.b), 3) AS best FROM u q, u d WHERE q.slice % 2 = 1 AND d.slice % 2 = 0 GROUP BY q.slice""")
def event_retrieval(spark, sf_dir):
    """Event windows end to end: frames, mean descriptors, odd days against even days."""
    from ..sources.options import StreamOptions
    from . import workflow
    from .base import events

    samples, found = workflow.samples_and_bank(events(spark, sf_dir), StreamOptions(window_ms=DAY / 1000, sensor_size=(WIDTH, HEIGHT)), "accumulate", workflow.mean_model, (HEIGHT, WIDTH))
    days = found.where("idx % 2 = 0")
    ranked = retrieval.topk(days, found.where("idx % 2 = 1"), max(1, days.count()))
    ranked = ranked.join(samples.select(F.col("id").alias("query_id"), F.col("slice").alias("query_slice")), "query_id")
    return rounded(ranked.groupBy("query_slice").agg(F.count("*").alias("compared"), F.max("score").alias("best")), "best", digits=3)
