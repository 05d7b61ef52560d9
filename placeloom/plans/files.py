"""Operators of the file layer over the test tables: fixtures are written to the shared folder where a format asks for it."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import places, slicing
from ..sources import cities, tables
from ..storage import shared_dir
from .base import EVENTS_SQL, SIX_HOURS, events, query, table


@query("""SELECT event_type || '.npz' AS id, 'rec/' || event_type || '.npz' AS path, round(min(epoch_us(ts)) / 1000.0, 3) AS start_ms, round(max(epoch_us(ts)) / 1000.0, 3) AS end_ms FROM events GROUP BY event_type""")
def folder_samples(spark, sf_dir):
    """One sample a recording of a folder, recordings by the event's type."""
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("rec/"), "event_type", F.lit(".npz")).alias("path"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return tables.folder_samples(e).select("id", "path", F.round("start_ms", 3).alias("start_ms"), F.round("end_ms", 3).alias("end_ms"))


@query("SELECT CAST(c_nationkey AS BIGINT) AS place_id, c_name AS path FROM customer")
def place_index_json(spark, sf_dir):
    """A place index in its file format, written and read back with its checks."""
    c = table(spark, sf_dir, "customer")
    nested = places.nested(c.select(F.col("c_nationkey").cast("long").alias("place_id"), F.col("c_name").alias("path")))
    one = nested.withColumn("paths", F.to_json("paths")).select(F.format_string("[%d, %s]", "place_id", "paths").alias("row")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("row")), ", "), F.lit("]")).alias("value"))
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    one.coalesce(1).write.text(path)
    return tables.index_json(spark, path, 1, c.select(F.col("c_name").alias("path")))


@query("""SELECT o_orderpriority AS cond, count(*) - count(*) FILTER (WHERE o_orderkey % 7 <> 0) AS "offset", o_orderpriority NOT LIKE '1%' AS assumed FROM orders GROUP BY o_orderpriority""")
def slice_leading_offsets(spark, sf_dir):
    """Leading slices of a recording that its coordinates lack; measured for one condition, from the counts for the others."""
    o = table(spark, sf_dir, "orders")
    raw = o.groupBy(F.col("o_orderpriority").alias("cond")).agg(F.count("*").alias("n"))
    known = o.where("o_orderkey % 7 <> 0").groupBy(F.col("o_orderpriority").alias("cond")).agg(F.count("*").alias("n"))
    first = o.where("o_orderpriority like '1%'")
    measured = {r.cond: r.n for r in first.where("o_orderkey % 7 = 0").groupBy(F.col("o_orderpriority").alias("cond")).agg(F.count("*").alias("n")).collect()}
    return tables.leading_offsets(raw, known, measured)


@query("""WITH i AS (SELECT CAST(c_nationkey AS VARCHAR) AS city, c_custkey % 9 AS pid, c_custkey FROM customer),
c AS (SELECT city, dense_rank() OVER (ORDER BY city) - 1 AS ci FROM (SELECT DISTINCT city FROM i)), n AS (SELECT city, pid FROM i WHERE pid <> 8 GROUP BY ALL HAVING count(*) >= 2)
SELECT CAST(900 + ci * 10000000 + i.pid AS BIGINT) AS place_id, '/data/' || i.city || '/City_' || lpad(CAST(i.pid AS VARCHAR), 7, '0') || '_' || c_custkey || '.jpg' AS path
FROM i JOIN n ON i.city = n.city AND i.pid = n.pid JOIN c ON c.city = i.city""")
def city_tree(spark, sf_dir):
    """Places from a city/name tree; names without a number (each ninth) are left out."""
    c = table(spark, sf_dir, "customer")
    number = F.when(F.col("c_custkey") % 9 == 8, F.lit("none")).otherwise(F.lpad((F.col("c_custkey") % 9).cast("string"), 7, "0"))
    path = F.concat(F.lit("/data/"), F.col("c_nationkey").cast("string"), F.lit("/City_"), number, F.lit("_"), F.col("c_custkey").cast("string"), F.lit(".jpg"))
    return places.by_city_tree(c.select(path.alias("path")), 2, 900)


@query("""WITH r AS (SELECT c_nationkey AS city, CASE WHEN c_custkey % 5 = 0 THEN 'query' ELSE 'database' END AS split, c_custkey,
  CASE WHEN c_nationkey % 3 = 0 AND c_custkey % 4 <> 0 THEN c_mktsegment WHEN c_custkey % 11 = 0 THEN NULL ELSE CAST(c_custkey * 53 % 720 AS VARCHAR) END AS d FROM customer),
k AS (SELECT city, split, avg(CAST(TRY_CAST(d AS DOUBLE) IS NOT NULL AS DOUBLE)) > 0.5 AS numeric FROM r GROUP BY ALL)
SELECT c_custkey, CASE WHEN numeric THEN CAST(CAST(floor((coalesce(TRY_CAST(d AS DOUBLE), 0.0) % 360.0) / 90.0) AS BIGINT) AS VARCHAR) ELSE '''' || coalesce(d, 'nan') || '''' END AS view FROM r JOIN k ON r.city = k.city AND r.split = k.split""")
def view_words(spark, sf_dir):
    """View bins from headings, or from words where a city's split has mostly those."""
    k = F.col("c_custkey")
    d = F.when((F.col("c_nationkey") % 3 == 0) & (k % 4 != 0), F.col("c_mktsegment")).when(k % 11 == 0, F.lit(None).cast("string")).otherwise((k * 53 % 720).cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("city"), F.when(k % 5 == 0, "query").otherwise("database").alias("split"), "c_custkey", d.alias("view_direction"))
    return cities.with_views(rows, 4).select("c_custkey", "view")


@query(f"WITH {EVENTS_SQL}, b AS (SELECT min(t) AS lo FROM ev) SELECT event_id, CAST(floor((t - lo) / {SIX_HOURS}.0) AS BIGINT) AS slice FROM ev, b WHERE t >= lo + 5 * {SIX_HOURS} AND t < lo + 9 * {SIX_HOURS}")
def slices_between(spark, sf_dir):
    """Some slices of a recording, with their time bounds as constants of the scan."""
    return slicing.between(events(spark, sf_dir), SIX_HOURS, 5, 9).select("event_id", "slice")
