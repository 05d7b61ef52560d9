"""Place-index builders, geometry, names, sampling and guards over the relational tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo, names
from ..operators import places, sampling, sets, stats
from .base import CITY_SQL, GEO_SQL, IMAGES_SQL, VIEWS_SQL, city_rows, geo_points, part_images, query, rounded, table, views


@query(f"""WITH {IMAGES_SQL}, o AS (SELECT place_id, dense_rank() OVER (ORDER BY lpad(CAST(place_id AS VARCHAR), 8, '0')) - 1 AS g, path, count(*) OVER (PARTITION BY place_id) AS n, row_number() OVER (PARTITION BY place_id ORDER BY path) AS k FROM img)
SELECT CAST(1000000 + g AS BIGINT) AS place_id, path FROM o WHERE n >= 4 AND k <= 20""")
def place_dir_class(spark, sf_dir):
    return places.by_directory(part_images(spark, sf_dir), 4, 20, offset=1_000_000)


@query(f"WITH {IMAGES_SQL} SELECT place_id, path FROM (SELECT *, count(*) OVER (PARTITION BY place_id) AS n FROM img) WHERE n >= 30")
def min_group(spark, sf_dir):
    return places.at_least(part_images(spark, sf_dir), "place_id", 30).select("place_id", "path")


@query(f"WITH {IMAGES_SQL} SELECT place_id, path FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY path) AS k FROM img) WHERE k <= 3")
def cap_per_place(spark, sf_dir):
    return places.capped(part_images(spark, sf_dir), "place_id", 3)


@query(f"WITH {IMAGES_SQL} SELECT place_id, len(p) AS n, md5(array_to_string(list_sort(p), ',')) AS digest FROM (SELECT place_id, list(path) AS p FROM img GROUP BY place_id)")
def nested_places(spark, sf_dir):
    return places.nested(part_images(spark, sf_dir)).select("place_id", F.size("paths").cast("long").alias("n"), F.md5(F.array_join("paths", ",").cast("binary")).alias("digest"))


@query("""WITH u AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS city, regexp_extract(url, '/([0-9]+)', 1) AS num FROM pages),
nm AS (SELECT page_id, city || '_' || num || '_2020' AS name, city, TRY_CAST(nullif(num, '') AS BIGINT) AS pid FROM u),
k AS (SELECT city, dense_rank() OVER (ORDER BY city) - 1 AS ci, pid, page_id FROM nm WHERE pid IS NOT NULL),
g AS (SELECT *, count(*) OVER (PARTITION BY city, pid) AS n FROM k)
SELECT CAST(ci * 10000000 + pid AS BIGINT) AS place_id, page_id FROM g WHERE n >= 1""")
def place_from_name(spark, sf_dir):
    """City = host, name = host_number_year: parse, number the cities, mint global ids."""
    p = table(spark, sf_dir, "pages")
    city = F.split(F.split("url", "://")[1], "/")[0]
    number = F.regexp_extract("url", "/([0-9]+)", 1)
    df = p.select("page_id", city.alias("city"), F.concat_ws("_", city, number, F.lit("2020")).alias("name"))
    df = df.withColumn("pid", names.place_of_name(F.regexp_replace("name", r"^[^_]*_", "x_"))).where("pid is not null")
    df = places.at_least(places.numbered(df, "city", "ci"), ["city", "pid"], 1)
    return df.select((F.col("ci") * 10_000_000 + F.col("pid")).cast("long").alias("place_id"), "page_id")


_RUNS = """e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p FROM events),
k AS (SELECT user_id, event_id, p // 12 AS r0, p % 12 AS position FROM e WHERE p % 12 < 8),
ok AS (SELECT user_id, r0, row_number() OVER (PARTITION BY user_id ORDER BY r0) - 1 AS run FROM (SELECT user_id, r0, count(*) AS n FROM k GROUP BY ALL) WHERE n >= 4),
s AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS si FROM (SELECT DISTINCT user_id FROM events)),
runs AS (SELECT CAST(500000000 + si * 1000 + run AS BIGINT) AS place_id, k.user_id, CAST(run AS BIGINT) AS run, CAST(position AS BIGINT) AS position, event_id
  FROM k JOIN ok ON k.user_id = ok.user_id AND k.r0 = ok.r0 JOIN s ON s.user_id = k.user_id WHERE run < 1000)"""


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return places.runs(e, "user_id", ["ts", "event_id"], 8, 4, 4, offset=500_000_000, carry=("event_id",), coarse=F.to_date("ts"))


@query(f"WITH {_RUNS} SELECT * FROM runs")
def place_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


@query(f"""WITH {_RUNS}, per AS (SELECT user_id, count(DISTINCT place_id) AS k FROM runs GROUP BY user_id), o AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM per)
SELECT (SELECT count(*) FROM per) AS scans, (SELECT count(DISTINCT place_id) FROM runs) AS places, (SELECT min(k) FROM per) AS least, (SELECT k FROM o WHERE i = n // 2) AS upper_median, (SELECT max(k) FROM per) AS most,
  round(100.0::DOUBLE * (SELECT count(*) FROM runs) / (SELECT count(*) FROM events), 6) AS percent_used""")
def run_summary(spark, sf_dir):
    runs = _runs(spark, sf_dir).select("place_id", F.col("user_id").alias("scan"))
    return stats.run_summary(runs, table(spark, sf_dir, "events"))


@query("SELECT DISTINCT user_id AS scan, 500000000 + user_id * 1000 + 7 AS place_id, user_id AS recovered FROM events")
def scan_of_place(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("scan")).distinct().withColumn("place_id", F.lit(500_000_000) + F.col("scan") * 1000 + 7)
    return e.select("scan", "place_id", F.floor((F.col("place_id") - 500_000_000) / 1000).alias("recovered"))


@query(f"WITH {VIEWS_SQL} SELECT path, ce, cn, cell_group FROM grouped WHERE cell_group IN (0, 3)")
def place_cells(spark, sf_dir):
    return places.cells(views(spark, sf_dir), 500, 2, (0, 3)).select("path", "ce", "cn", "cell_group")


@query(f"WITH {VIEWS_SQL} SELECT DISTINCT ce // 500 * 1000000 + CAST(floor(cn / 500.0) AS BIGINT) AS place_id, cell_group, cell_group AS recovered FROM grouped")
def cell_group_of_place(spark, sf_dir):
    c = places.cells(views(spark, sf_dir), 500, 2, (0, 1, 2, 3))
    pid = geo.cell_place_id(F.col("ce"), F.col("cn"), 500)
    return c.select(pid.cast("long").alias("place_id"), "cell_group").distinct().withColumn("recovered", geo.group_of_place(F.col("place_id"), 2).cast("long"))


def _focal_sql(angle: float) -> str:
    ca, sa = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    return f"""st AS (SELECT ce, cn, count(*) AS n_images, avg(east) AS mu_e, avg(north) AS mu_n, var_pop(east) AS ve, var_pop(north) AS vn, covar_pop(east, north) AS cov FROM grouped WHERE cell_group = 0 GROUP BY ALL HAVING count(*) >= 10),
th AS (SELECT *, CASE WHEN cov = 0 AND ve < vn THEN pi() / 2 WHEN sqrt((ve - vn) / 2 * (ve - vn) / 2 + cov * cov) > 0 THEN atan2(cov, (ve - vn) / 2 + sqrt((ve - vn) / 2 * (ve - vn) / 2 + cov * cov)) ELSE 0 END AS th FROM st),
ax AS (SELECT *, CASE WHEN abs(cos(th)) >= abs(sin(th)) THEN CASE WHEN cos(th) >= 0 THEN sin(th) ELSE -sin(th) END ELSE abs(sin(th)) END AS d1,
  CASE WHEN abs(sin(th)) >= abs(cos(th)) THEN CASE WHEN -sin(th) >= 0 THEN cos(th) ELSE -cos(th) END ELSE abs(cos(th)) END AS d2 FROM th),
focal AS (SELECT ce, cn, n_images, mu_e, mu_n, mu_e + 10 * (d1 * {ca!r} - d2 * {sa!r}) AS fe, mu_n + 10 * (d1 * {sa!r} + d2 * {ca!r}) AS fn FROM ax)"""


def _best_sql(angle: float) -> str:
    return f"""{VIEWS_SQL}, {_focal_sql(angle)},
aim AS (SELECT g.ce, g.cn, pano, path, (degrees(atan2(fe - east, fn - north)) + 360.0) AS brg, heading FROM grouped g JOIN focal f ON g.ce = f.ce AND g.cn = f.cn WHERE cell_group = 0),
df AS (SELECT *, abs(((heading - brg + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) AS diff FROM aim),
best AS (SELECT ce, cn, pano, path, diff FROM (SELECT *, row_number() OVER (PARTITION BY ce, cn, pano ORDER BY diff, path) AS k FROM df WHERE diff <= 45.0) WHERE k = 1)"""


@query(f"WITH {VIEWS_SQL}, {_focal_sql(0)} SELECT ce, cn, n_images, round(mu_e, 4) AS mu_e, round(mu_n, 4) AS mu_n, round(fe, 4) AS focal_e, round(fn, 4) AS focal_n FROM focal")
def focal_point(spark, sf_dir):
    return rounded(places.focal_points(places.cells(views(spark, sf_dir), 500, 2), 10, 0, 10), "mu_e", "mu_n", "focal_e", "focal_n", digits=4)


@query(f"WITH {_best_sql(90)} SELECT ce, cn, pano, path, round(diff, 4) AS diff FROM best")
def place_best_view(spark, sf_dir):
    c = places.cells(views(spark, sf_dir), 500, 2)
    return rounded(places.best_views(c, places.focal_points(c, 10, 90, 10)), "diff", digits=4)


@query(f"WITH {_best_sql(0)}, n AS (SELECT *, count(*) OVER (PARTITION BY ce, cn) AS n FROM best) SELECT CAST(7000000000 + ce // 500 * 1000000 + CAST(floor(cn / 500.0) AS BIGINT) AS BIGINT) AS place_id, pano, path FROM n WHERE n >= 4")
def place_geometry(spark, sf_dir):
    return places.by_cells(views(spark, sf_dir), 500, 2, 10, 0, offset=7_000_000_000)


@query(f"WITH {VIEWS_SQL} SELECT path, round((degrees(atan2(east - 2500, north - 4500)) + 360.0) % 360.0, 6) AS bearing, round(abs(((heading - (degrees(atan2(east - 2500, north - 4500)) + 360.0) + 180.0) % 360.0 + 360.0) % 360.0 - 180.0), 6) AS diff FROM v")
def bearing(spark, sf_dir):
    b = geo.bearing(F.col("east") - 2500, F.col("north") - 4500)
    return rounded(views(spark, sf_dir).select("path", b.alias("bearing"), geo.angular_difference(F.col("heading"), b).alias("diff")), "bearing", "diff")


_CIRC = """m AS (SELECT pano, (degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360.0) % 360.0 AS mean_deg, count(*) AS n,
  sqrt(pow(avg(sin(radians(heading))), 2) + pow(avg(cos(radians(heading))), 2)) AS strength FROM v GROUP BY pano)"""


@query(f"WITH {VIEWS_SQL}, {_CIRC}, d AS (SELECT pano, CASE WHEN strength > 1e-6 THEN mean_deg END AS mean_deg FROM m) SELECT v.pano, round(mean_deg, 4) AS mean_deg, round(avg(abs(((heading - mean_deg + 180.0) % 360.0 + 360.0) % 360.0 - 180.0)), 4) AS spread_deg, count(*) AS n FROM v JOIN d ON v.pano = d.pano GROUP BY ALL")
def circular_stats(spark, sf_dir):
    return rounded(places.circular_stats(views(spark, sf_dir), "pano", F.col("heading"), 1e-6), "mean_deg", "spread_deg", digits=4)


def _stream_means_sql(angle: float, name: str) -> str:
    return f"(SELECT ce // 500 * 1000000 + CAST(floor(cn / 500.0) AS BIGINT) AS place_id, (degrees(atan2(avg(sin(radians(heading))), avg(cos(radians(heading))))) + 360.0) % 360.0 AS mean_deg FROM (WITH {_best_sql(angle)} SELECT best.ce, best.cn, v.heading, best.path FROM best JOIN v ON v.path = best.path) GROUP BY ALL) {name}"


@query(f"""WITH d AS (SELECT abs(((f.mean_deg - l.mean_deg + 180.0) % 360.0 + 360.0) % 360.0 - 180.0) AS d FROM {_stream_means_sql(0, 'f')} JOIN {_stream_means_sql(90, 'l')} ON f.place_id = l.place_id)
SELECT count(*) AS shared_places, round(avg(d), 4) AS mean_separation, round(quantile_cont(d, 0.5), 4) AS median_separation FROM d""")
def stream_separation(spark, sf_dir):
    """Mean viewing direction of a place in the frontal and in the lateral stream, over shared places."""
    v = views(spark, sf_dir)
    c = places.cells(v, 500, 2)

    def means(angle):
        best = places.best_views(c, places.focal_points(c, 10, angle, 10)).join(v.select("path", "heading"), "path")
        return best.groupBy(geo.cell_place_id(F.col("ce"), F.col("cn"), 500).alias("place_id")).agg(geo.circular_mean(F.col("heading")).alias("mean_deg"))

    return rounded(places.separation(means(0), means(90)), "mean_separation", "median_separation", digits=4)


@query(f"WITH {CITY_SQL} SELECT city, shared_clusters, round(median_distance, 6) AS median_distance, merged FROM merging")
def merge_decision(spark, sf_dir):
    return rounded(places.merge_decision(city_rows(spark, sf_dir)), "median_distance")


@query(f"""WITH {CITY_SQL}, b AS (SELECT r.city, split, path, CASE WHEN merged THEN printf('(%d, %d)', cluster, CAST(floor(heading / 180.0) AS BIGINT)) ELSE printf('(''%s'', %d, %d)', split, cluster, CAST(floor(heading / 180.0) AS BIGINT)) END AS key FROM rows_ r JOIN merging m ON r.city = m.city),
k AS (SELECT *, dense_rank() OVER (ORDER BY city) - 1 AS ci, dense_rank() OVER (PARTITION BY city ORDER BY key) - 1 AS gi, count(*) OVER (PARTITION BY city, key) AS n, row_number() OVER (PARTITION BY city, key ORDER BY path) AS r FROM b)
SELECT CAST(100000000 + ci * 1000000 + gi AS BIGINT) AS place_id, city, path FROM k WHERE n >= 4 AND r <= 30""")
def place_clusters(spark, sf_dir):
    return places.by_clusters(city_rows(spark, sf_dir), 2, 4, 30, offset=100_000_000)


@query(f"WITH {CITY_SQL} SELECT key, heading, CAST(floor(heading / 72.0) AS BIGINT) AS bin FROM rows_")
def view_bins(spark, sf_dir):
    return city_rows(spark, sf_dir).select("key", "heading", geo.view_bin(F.col("heading"), 5).alias("bin"))


@query("""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'broken@' || o_orderkey ELSE concat_ws('@', '', CAST(o_totalprice AS VARCHAR), CAST(o_custkey AS VARCHAR), '10', 'S', '37.7', '-122.4', 'p' || o_custkey, '', CAST(o_orderkey * 37 % 360 AS VARCHAR), '', '', '2020', '', '.jpg') END AS name, o_totalprice, o_custkey FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS east, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS north, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderkey * 37 % 360 AS DOUBLE) END AS heading, CASE WHEN o_orderkey % 7 <> 0 THEN 'p' || o_custkey END AS pano FROM n""")
def parse_view_names(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    good = F.concat_ws("@", F.lit(""), F.col("o_totalprice").cast("string"), F.col("o_custkey").cast("string"), F.lit("10"), F.lit("S"), F.lit("37.7"), F.lit("-122.4"), F.concat(F.lit("p"), F.col("o_custkey")), F.lit(""), (F.col("o_orderkey") * 37 % 360).cast("string"), *[F.lit(x) for x in ("", "", "2020", "", ".jpg")])
    name = F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("broken@"), F.col("o_orderkey"))).otherwise(good)
    fields = names.at_fields(name)
    return o.select("o_orderkey", *[v.alias(k) for k, v in fields.items()])


@query("""SELECT c_custkey, 'City' || c_nationkey || '_' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) >= 7 THEN CAST(c_custkey AS VARCHAR) ELSE lpad(CAST(c_custkey AS VARCHAR), 7, '0') END || '_2020_' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '_' || lpad(CAST(c_custkey * 53 % 360 AS VARCHAR), 3, '0') || '_37.5_-122.25_p' || c_custkey || '.jpg' AS name, c_nationkey * 100000 + c_custkey AS place_id FROM customer""")
def build_view_names(spark, sf_dir):
    k = F.col("c_custkey")
    name = names.city_view_name(F.concat(F.lit("City"), F.col("c_nationkey")), k, F.lit("2020"), k % 12 + 1, k * 53 % 360, F.lit("37.5"), F.lit("-122.25"), F.concat(F.lit("p"), k), ".jpg")
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"), (F.col("c_nationkey").cast("long") * 100_000 + k).alias("place_id"))


@query("SELECT regexp_replace(url, '/[^/]*$', '') AS dir, count(*) AS n, min(list_last(string_split(url, '/'))) AS first_name FROM pages GROUP BY 1")
def directories(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.groupBy(names.dirname(F.col("url")).alias("dir")).agg(F.count("*").alias("n"), F.min(names.basename(F.col("url"))).alias("first_name"))


@query("SELECT count(*) AS named, count(*) FILTER (WHERE regexp_matches(url, '/[a-z]{2}/[0-9]+')) AS parsed, count(*) FILTER (WHERE NOT regexp_matches(url, '/[a-z]{2}/[0-9]+')) AS skipped FROM pages")
def drop_counters(spark, sf_dir):
    ok = F.col("url").rlike("/[a-z]{2}/[0-9]+")
    return table(spark, sf_dir, "pages").agg(F.count("*").alias("named"), F.count_if(ok).alias("parsed"), F.count_if(~ok).alias("skipped"))


@query("SELECT c_custkey, (TRY_CAST(c_mktsegment AS BOOLEAN) IS TRUE) AS night FROM customer WHERE lower(c_mktsegment) NOT IN ('true', '1') AND c_custkey % 3 <> 0")
def night_filter(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("night", F.when(F.col("c_custkey") % 3 == 0, "True").otherwise(F.col("c_mktsegment")))
    return c.where(~F.lower("night").isin("true", "1")).select("c_custkey", F.lit(False).alias("night"))


@query(f"WITH {CITY_SQL} SELECT key, city FROM rows_ WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = CAST(key AS BIGINT))")
def listed_images(spark, sf_dir):
    """Metadata rows whose image is in the listing."""
    listing = table(spark, sf_dir, "orders").select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit(".png")).alias("path"))
    return city_rows(spark, sf_dir).join(listing, "path", "left_semi").select("key", "city")


@query(f"WITH {CITY_SQL} SELECT city, count(*) AS images, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = CAST(key AS BIGINT))) AS missing FROM rows_ GROUP BY city")
def missing_images(spark, sf_dir):
    """Metadata joined to an image tree, misses counted."""
    tree = table(spark, sf_dir, "orders").select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 8, "0"), F.lit(".png")).alias("found")).distinct()
    joined = city_rows(spark, sf_dir).join(tree, F.col("path") == F.col("found"), "left")
    return joined.groupBy("city").agg(F.count("*").alias("images"), F.count_if(F.col("found").isNull()).alias("missing"))


_MD5 = "md5(concat_ws(':', {0}))"


@query(f"""WITH {IMAGES_SQL}, pl AS (SELECT place_id FROM img GROUP BY 1 HAVING count(*) >= 4), n AS (SELECT count(*) AS n FROM pl),
ord AS (SELECT place_id, row_number() OVER (ORDER BY {_MD5.format("'0', place_id")}, place_id) - 1 AS i FROM pl),
pk AS (SELECT place_id, path, row_number() OVER (PARTITION BY place_id ORDER BY {_MD5.format("'0', place_id, path")}, path) AS pick FROM img)
SELECT CAST(i // 8 AS BIGINT) AS batch, CAST(i % 8 AS BIGINT) AS slot, ord.place_id, CAST(pick AS BIGINT) AS pick, path FROM ord JOIN pk ON ord.place_id = pk.place_id, n WHERE pick <= 4 AND i // 8 < n // 8""")
def pk_batches(spark, sf_dir):
    out = sampling.pk_batches(part_images(spark, sf_dir), 8, 4)
    return out.withColumns({c: F.col(c).cast("long") for c in ("batch", "slot", "pick")})


@query(f"""WITH g AS (SELECT c_custkey AS place_id, c_nationkey % 7 AS place_group FROM customer), el AS (SELECT place_group, row_number() OVER (ORDER BY place_group) - 1 AS turn, count(*) OVER () AS k FROM (SELECT place_group FROM g GROUP BY 1 HAVING count(*) >= 16)),
plan AS (SELECT epoch, place_group FROM el, (SELECT unnest(range(10)) AS epoch) e WHERE epoch % k = turn),
c AS (SELECT epoch, g.place_group, place_id, row_number() OVER (PARTITION BY epoch, g.place_group ORDER BY {_MD5.format("'0', epoch, g.place_group, place_id")}, place_id) - 1 AS i, count(*) OVER (PARTITION BY epoch, g.place_group) AS n FROM g JOIN plan ON g.place_group = plan.place_group)
SELECT CAST(epoch AS BIGINT) AS epoch, CAST(place_group AS BIGINT) AS place_group, CAST(i // 16 AS BIGINT) AS batch, CAST(i % 16 AS BIGINT) AS slot, place_id FROM c WHERE i // 16 < n // 16""")
def group_cycle(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("place_id"), (F.col("c_nationkey").cast("long") % 7).alias("place_group"))
    return sampling.group_cycle(c, 16, 10).withColumns({c: F.col(c).cast("long") for c in ("batch", "slot")})


@query(f"SELECT p_partkey AS place_id FROM part ORDER BY {_MD5.format(chr(39) + '0' + chr(39) + ', p_partkey')}, p_partkey LIMIT 50")
def subset_places(spark, sf_dir):
    return sampling.subset(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place_id")), 50)


@query(f"""WITH i AS (SELECT l_returnflag AS stream, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey, strftime(l_shipdate, '%Y%m%d%H%M%S')) AS path FROM lineitem)
SELECT stream, path, CAST(pick AS BIGINT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY {_MD5.format("'0', stream, path")}, path) AS pick FROM i) WHERE pick <= 100 // 3""")
def even_budget(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("stream"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.date_format("l_shipdate", "yyyyMMddHHmmss")).alias("path"))
    return sampling.even_budget(li, 100, 3).withColumn("pick", F.col("pick").cast("long"))


@query(f"""WITH {CITY_SQL}, db AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {_MD5.format("'0', city, key")}, key) AS r FROM rows_ WHERE split = 'database') WHERE r <= 20),
can AS (SELECT q.* FROM rows_ q WHERE split = 'query' AND EXISTS (SELECT 1 FROM db WHERE db.city = q.city AND (q.e - db.e) * (q.e - db.e) + (q.n - db.n) * (q.n - db.n) <= 62500.0)),
qs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY {_MD5.format("'0', city, key")}, key) AS r FROM can) WHERE r <= 4), u AS (SELECT city, split, key FROM db UNION ALL SELECT city, split, key FROM qs)
SELECT city, split, key, CAST(row_number() OVER (PARTITION BY city, split ORDER BY key) - 1 AS BIGINT) AS idx FROM u""")
def gallery_query_split(spark, sf_dir):
    out = sampling.gallery_and_queries(city_rows(spark, sf_dir), 500, 100, 250.0, 25)
    return out.select("city", "split", "key", F.col("idx").cast("long").alias("idx"))


@query(f"""WITH {IMAGES_SQL}, s AS (SELECT path FROM img ORDER BY {_MD5.format("'0', path")}, path LIMIT 32) SELECT path FROM s WHERE path NOT IN (SELECT path FROM img WHERE place_id % 2 = 0)""")
def stale_probe(spark, sf_dir):
    img = part_images(spark, sf_dir)
    return sampling.probe(img.select("path"), img.where("place_id % 2 = 0"))


@query("""WITH s AS (SELECT unnest(range(60)) AS step), c AS (SELECT n_name AS stream, n_nationkey % 7 + 2 AS k FROM nation) SELECT step, stream, step // k AS epoch, CAST(step % k AS BIGINT) AS batch FROM s, c""")
def batch_of_step(spark, sf_dir):
    counts = table(spark, sf_dir, "nation").select(F.col("n_name").alias("stream"), (F.col("n_nationkey") % 7 + 2).cast("long").alias("n_batches"))
    return sampling.batch_of_step(spark.range(60).withColumnRenamed("id", "step"), counts)


@query("SELECT n_regionkey AS place_id FROM nation WHERE n_nationkey < 12 INTERSECT SELECT r_regionkey FROM region WHERE r_regionkey <> 1")
def id_intersect(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey < 12").select(F.col("n_regionkey").alias("place_id"))
    return n.intersect(table(spark, sf_dir, "region").where("r_regionkey != 1").select("r_regionkey"))


@query("SELECT DISTINCT o_custkey % 400 AS key FROM orders WHERE o_custkey % 400 NOT IN (SELECT s_suppkey FROM supplier)")
def unknown_keys(spark, sf_dir):
    given = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 400).alias("key"))
    return sets.unknown_keys(given, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key")), "key")


@query("SELECT n_name AS city FROM nation WHERE lower(n_name) NOT IN (SELECT lower(n_name) FROM nation WHERE n_nationkey IN (1, 4))")
def exclude_cities(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    drop = [r.n_name.upper() + " " for r in nation.where("n_nationkey in (1, 4)").collect()]
    return sets.excluded(nation.select(F.col("n_name").alias("city")), drop).select("city")


@query("SELECT c_nationkey AS city FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def union_excludes(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("city"))
    return sets.union_distinct(c, table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_nationkey").alias("city")))


@query("WITH k AS (SELECT c_nationkey AS city, count(*) AS n FROM customer GROUP BY 1) SELECT city, CAST(sum(n) OVER (ORDER BY city) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY city) AS BIGINT) AS stop FROM k")
def city_spans(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("city")).agg(F.count("*").alias("n"))
    return sets.spans(counts, "city", "n")


@query(f"WITH {GEO_SQL} SELECT 'database' AS split, id, city FROM s UNION ALL SELECT 'query', id, city FROM c")
def pooled_cities(spark, sf_dir):
    references, queries = geo_points(spark, sf_dir)
    tag = lambda df, name: df.select(F.lit(name).alias("split"), "id", "city")
    return tag(references, "database").unionByName(tag(queries, "query"))


@query("""WITH m AS (SELECT 'C' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS city, c_custkey % 50 AS pid, c_custkey AS k FROM customer),
nm AS (SELECT *, city || '_' || lpad(CAST(pid AS VARCHAR), 7, '0') || '_2021_' || lpad(CAST(k % 12 + 1 AS VARCHAR), 2, '0') || '_' || lpad(CAST(k * 53 % 360 AS VARCHAR), 3, '0') || '_1.50_2.25_p' || k || '.jpg' AS path, dense_rank() OVER (ORDER BY city) - 1 AS ci FROM m),
ok AS (SELECT *, count(*) OVER (PARTITION BY city, pid) AS n FROM nm WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = k))
SELECT CAST(ci * 100000 + pid AS BIGINT) AS place_id, path FROM ok WHERE n >= 2""")
def place_from_csv(spark, sf_dir):
    """City metadata in text columns against a listing of existing names."""
    k = F.col("c_custkey")
    text = {"city_id": F.concat(F.lit("C"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0")), "place_id": k % 50, "year": F.lit("2021"), "month": k % 12 + 1, "northdeg": k * 53 % 360, "lat": F.lit("1.50"), "lon": F.lit("2.25"), "panoid": F.concat(F.lit("p"), k)}
    meta = table(spark, sf_dir, "customer").select("c_custkey", *[v.cast("string").alias(c) for c, v in text.items()])
    name = names.city_view_name(*[F.col(c) for c in text], ".jpg")
    listing = meta.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select(name.alias("path"))
    return places.by_city_rows(meta.drop("c_custkey"), listing, 2)


@query("SELECT n_nationkey, round((degrees(atan2(CAST(n_nationkey - 12 AS DOUBLE), CAST(n_regionkey - 2 AS DOUBLE))) + 360.0) % 360.0, 6) AS b, CAST(floor((n_nationkey - 12) / 5.0) AS BIGINT) * 5 AS cell FROM nation")
def sql_functions(spark, sf_dir):
    """Registered SQL functions."""
    from ..functions.register import register

    register(spark)
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey", "round(bearing(double(n_nationkey - 12), double(n_regionkey - 2)), 6) as b", "grid_cell(double(n_nationkey - 12), 5L) as cell")
