"""Registry of queries and their SQL, and the bindings that several share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY, SIX_HOURS = 86_400_000_000, 21_600_000_000
WIDTH, HEIGHT = 16, 12


def query(sql: str | None = None):
    """Register a query under its function's name; sql is the same result for DuckDB."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream: x, y from user and payload, t in microseconds, p from the type."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        (F.col("user_id") % 18).cast("int").alias("x"),
        (F.get_json_object("props", "$.k").cast("int") % 14).alias("y"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("t"),
        F.col("event_type").isin("click", "view").cast("int").alias("p"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id, CAST(user_id % 18 AS INT) AS x, CAST(json_extract_string(props, '$.k') AS INT) % 14 AS y, epoch_us(ts) AS t,
         CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS p
  FROM events)"""
#: Events on the sensor, with their day.
BOUNDED_SQL = EVENTS_SQL + f""", bounds AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
sliced AS (SELECT ev.*, CAST(floor((t - lo) / {DAY}.0) AS BIGINT) AS slice FROM ev, bounds WHERE x >= 0 AND x < {WIDTH} AND y >= 0 AND y < {HEIGHT})"""


def bank(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, queries): id, embedding, label, traverse."""
    df = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", (F.col("vec_id") % 5).alias("traverse"))
    return df.where("id % 10 != 0"), df.where("id % 10 = 0")


def label_edges(references: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.select(F.col("id").alias("query_id"), "label").join(references.select(F.col("id").alias("reference_id"), "label"), "label").select("query_id", "reference_id")


#: All (query, reference, score) of the bank and their rank, and the label edges.
RANKED_SQL = """q AS (SELECT vec_id AS id, embedding AS e, label, vec_id % 5 AS traverse FROM embeddings WHERE vec_id % 10 = 0),
r AS (SELECT vec_id AS id, embedding AS e, label FROM embeddings WHERE vec_id % 10 <> 0),
scored AS (SELECT q.id AS query_id, r.id AS reference_id,
  list_sum(list_transform(range(1, len(q.e) + 1), lambda i: CAST(q.e[i] AS DOUBLE) * CAST(r.e[i] AS DOUBLE))) AS score FROM q, r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, reference_id) AS rank FROM scored),
edges AS (SELECT q.id AS query_id, r.id AS reference_id FROM q JOIN r ON q.label = r.label)"""


def geo_points(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(references, queries): suppliers and customers as points; id, city, easting, northing."""
    east = lambda k: F.pmod(F.col(k) * 7919, F.lit(5000)).cast("double").alias("easting")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("city"), east("s_suppkey"), F.col("s_acctbal").alias("northing"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("city"), east("c_custkey"), F.col("c_acctbal").alias("northing"))
    return s, c


GEO_SQL = """s AS (SELECT s_suppkey AS id, s_nationkey AS city, CAST((s_suppkey * 7919) % 5000 AS DOUBLE) AS e, s_acctbal AS n FROM supplier),
c AS (SELECT c_custkey AS id, c_nationkey AS city, CAST((c_custkey * 7919) % 5000 AS DOUBLE) AS e, c_acctbal AS n FROM customer)"""


def part_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of places: place_id, path (unique within a place)."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("place_id"), F.concat_ws("/", F.lpad(F.col("l_partkey").cast("string"), 8, "0"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", F.date_format("l_shipdate", "yyyyMMddHHmmss"))).alias("path"))


IMAGES_SQL = """img AS (SELECT l_partkey AS place_id, lpad(CAST(l_partkey AS VARCHAR), 8, '0') || '/' || concat_ws('-', l_orderkey, l_linenumber, l_suppkey, strftime(l_shipdate, '%Y%m%d%H%M%S')) AS path FROM lineitem)"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-cut views: path, east, north, heading, pano."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", F.pmod(F.col("c_custkey") * 7919, F.lit(5000)).cast("double").alias("east"), F.col("c_acctbal").alias("north"))
    df = o.join(c, o.o_custkey == c.c_custkey)
    return df.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("path"), "east", "north", F.pmod(F.col("o_orderkey") * 37, F.lit(360)).cast("double").alias("heading"), F.col("o_custkey").alias("pano"))


VIEWS_SQL = """v AS (SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS path, CAST((c_custkey * 7919) % 5000 AS DOUBLE) AS east, c_acctbal AS north,
  CAST((o_orderkey * 37) % 360 AS DOUBLE) AS heading, o_custkey AS pano FROM orders JOIN customer ON o_custkey = c_custkey),
cells AS (SELECT *, CAST(floor(east / 500.0) AS BIGINT) * 500 AS ce, CAST(floor(north / 500.0) AS BIGINT) * 500 AS cn FROM v),
grouped AS (SELECT *, CAST(floor((((ce % 1000) + 1000) % 1000) / 500) AS BIGINT) * 2 + CAST(floor((((cn % 1000) + 1000) % 1000) / 500) AS BIGINT) AS cell_group FROM cells)"""


def city_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City metadata: city, split, key, cluster, heading, easting, northing, path. Even nations' splits agree on cluster places."""
    c = table(spark, sf_dir, "customer")
    k, even = F.col("c_custkey"), F.col("c_nationkey") % 2 == 0
    return c.select(
        F.col("c_nationkey").alias("city"),
        F.when(k % 5 == 0, "query").otherwise("database").alias("split"),
        F.lpad(k.cast("string"), 8, "0").alias("key"),
        (k % 6).alias("cluster"),
        F.pmod(k * 53, F.lit(360)).cast("double").alias("heading"),
        F.when(even, (k % 6 * 200 + k % 5).cast("double")).otherwise(F.pmod(k * 7919, F.lit(5000)).cast("double")).alias("easting"),
        F.when(even, F.lit(0.0)).otherwise(F.col("c_acctbal")).alias("northing"),
        F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit(".png")).alias("path"),
    )


CITY_SQL = """rows_ AS (SELECT c_nationkey AS city, CASE WHEN c_custkey % 5 = 0 THEN 'query' ELSE 'database' END AS split, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS key,
  c_custkey % 6 AS cluster, CAST((c_custkey * 53) % 360 AS DOUBLE) AS heading,
  CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey % 6 * 200 + c_custkey % 5 AS DOUBLE) ELSE CAST((c_custkey * 7919) % 5000 AS DOUBLE) END AS e,
  CASE WHEN c_nationkey % 2 = 0 THEN 0.0 ELSE c_acctbal END AS n, lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '.png' AS path FROM customer),
cent AS (SELECT city, split, cluster, avg(e) AS e, avg(n) AS n FROM rows_ GROUP BY ALL),
shared AS (SELECT a.city, sqrt((a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n)) AS d FROM cent a JOIN cent b ON a.city = b.city AND a.cluster = b.cluster AND a.split = 'database' AND b.split = 'query'),
merging AS (SELECT u.city, coalesce(k, 0) AS shared_clusters, m AS median_distance, coalesce(k >= 5 AND m <= 25, false) AS merged
  FROM (SELECT DISTINCT city FROM rows_) u LEFT JOIN (SELECT city, count(*) AS k, quantile_cont(d, 0.5) AS m FROM shared GROUP BY city) g ON u.city = g.city)"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})
