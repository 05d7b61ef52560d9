"""Slicing and rendering over the event stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames, noise, slicing
from .base import BOUNDED_SQL, DAY, EVENTS_SQL, HEIGHT, SIX_HOURS, WIDTH, events, query, rounded

_SLICES = f"""WITH {EVENTS_SQL}, b AS (SELECT min(t) AS lo, max(t) AS hi FROM ev),
w AS (SELECT lo, hi, unnest(range(CAST(floor((hi - lo) / {SIX_HOURS}.0) AS BIGINT) + 1)) AS slice FROM b)"""


@query(f"{_SLICES} SELECT lpad(CAST(slice AS VARCHAR), 8, '0') AS id, slice, (lo + slice * {SIX_HOURS}) / 1000.0 AS start_ms, least(lo + (slice + 1) * {SIX_HOURS}, hi) / 1000.0 AS end_ms FROM w")
def sample_table(spark, sf_dir):
    return slicing.sample_table(events(spark, sf_dir), SIX_HOURS)


@query(f"{_SLICES} SELECT event_id, CAST(floor((t - lo) / {SIX_HOURS}.0) AS BIGINT) AS slice FROM ev, b")
def slice_windows(spark, sf_dir):
    return slicing.with_slice(events(spark, sf_dir), SIX_HOURS).select("event_id", "slice")


@query(f"{_SLICES} SELECT w.slice, count(event_id) AS n_events FROM w LEFT JOIN ev ON t >= lo + w.slice * {SIX_HOURS} AND t < lo + (w.slice + 1) * {SIX_HOURS} GROUP BY w.slice")
def slice_counts_dense(spark, sf_dir):
    return slicing.slice_counts(events(spark, sf_dir), SIX_HOURS)


_OFFSET = 1_704_500_000_000_000


@query(f"""WITH {EVENTS_SQL}, b AS (SELECT greatest(min(t), {_OFFSET}) AS o FROM ev)
SELECT CAST(floor((t - o) / {DAY}.0) AS BIGINT) AS slice, count(*) AS n, min(event_id) AS first_event FROM ev, b WHERE t >= o GROUP BY 1""")
def slice_offset(spark, sf_dir):
    return slicing.with_slice(events(spark, sf_dir), DAY, _OFFSET).groupBy("slice").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query(f"{_SLICES} SELECT slice, (lo + slice * {SIX_HOURS}) / 1000.0 AS start_ms FROM w WHERE slice >= 3 AND (slice - 3) % 4 = 0 AND slice < 103")
def slice_stride(spark, sf_dir):
    return slicing.strided(slicing.sample_table(events(spark, sf_dir), SIX_HOURS), 4, 3, 100).select("slice", "start_ms")


@query(f"WITH {EVENTS_SQL} SELECT event_id, CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, p FROM ev WHERE x >= 0 AND x < {WIDTH} AND y >= 0 AND y < {HEIGHT}")
def bounds_filter(spark, sf_dir):
    return frames.in_bounds(events(spark, sf_dir), WIDTH, HEIGHT).select("event_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "p")


def _sliced(spark, sf_dir):
    return frames.in_bounds(slicing.with_slice(events(spark, sf_dir), DAY), WIDTH, HEIGHT)


def _dense(spark, sf_dir, name, white=None):
    df = events(spark, sf_dir)
    background = 255 if white else frames.RENDERERS[name][1]
    return frames.dense(frames.render(name, _sliced(spark, sf_dir), white), slicing.sample_table(df, DAY), WIDTH, HEIGHT, background)


_COUNTS = BOUNDED_SQL + """, px AS (SELECT slice, y, x, count(*) FILTER (WHERE p > 0) AS pos, count(*) FILTER (WHERE p <= 0) AS neg FROM sliced GROUP BY ALL)"""
_GRID = f""", grid AS (SELECT s.slice, gy.y, gx.x FROM (SELECT unnest(range(CAST(floor((hi - lo) / {DAY}.0) AS BIGINT) + 1)) AS slice FROM bounds) s, (SELECT unnest(range({HEIGHT})) AS y) gy, (SELECT unnest(range({WIDTH})) AS x) gx)"""
_DENSE = "SELECT grid.slice, CAST(grid.y AS INT) AS y, CAST(grid.x AS INT) AS x, CAST(coalesce(r, {0}) AS INT) AS r, CAST(coalesce(g, {0}) AS INT) AS g, CAST(coalesce(b, {0}) AS INT) AS b FROM grid LEFT JOIN f ON grid.slice = f.slice AND grid.y = f.y AND grid.x = f.x"


@query(f"WITH {_COUNTS} SELECT slice, CAST(y AS INT) AS y, x, pos, neg FROM px")
def pixel_histogram(spark, sf_dir):
    return frames.pixel_counts(_sliced(spark, sf_dir)).select("slice", "y", "x", "pos", "neg")


_ACC = _COUNTS + """, lim AS (SELECT slice, CAST(quantile_cont(CASE WHEN pos > 0 THEN pos END, 0.99) AS FLOAT) AS pl, CAST(quantile_cont(CASE WHEN neg > 0 THEN neg END, 0.99) AS FLOAT) AS nl FROM px GROUP BY slice),
ab AS (SELECT px.slice, y, x, CASE WHEN pl IS NULL THEN CAST(0 AS FLOAT) ELSE least(CAST(pos AS FLOAT), pl) / pl END AS a, CASE WHEN nl IS NULL THEN CAST(0 AS FLOAT) ELSE least(CAST(neg AS FLOAT), nl) / nl END AS c FROM px JOIN lim ON px.slice = lim.slice),
win AS (SELECT slice, y, x, CASE WHEN a >= c THEN a ELSE CAST(0 AS FLOAT) END AS ip, CASE WHEN a >= c THEN CAST(0 AS FLOAT) ELSE c END AS im FROM ab),
f AS (SELECT slice, y, x, trunc((CAST(1 AS FLOAT) - im) * CAST(255 AS FLOAT)) AS r, trunc(greatest((CAST(1 AS FLOAT) - ip) - im, CAST(0 AS FLOAT)) * CAST(255 AS FLOAT)) AS g, trunc((CAST(1 AS FLOAT) - ip) * CAST(255 AS FLOAT)) AS b FROM win)""" + _GRID


@query(f"WITH {_ACC} {_DENSE.format(255)}")
def frame_accumulate(spark, sf_dir):
    return _dense(spark, sf_dir, "accumulate")


_CM = _COUNTS + """, al AS (SELECT slice, CAST(quantile_cont(v, 0.99) AS FLOAT) AS a FROM (SELECT slice, pos AS v FROM px UNION ALL SELECT slice, neg FROM px) WHERE v > 0 GROUP BY slice),
f AS (SELECT px.slice, y, x, trunc(least(CAST(pos AS FLOAT), a) / a * CAST(255 AS FLOAT)) AS r, 255 AS g, trunc(least(CAST(neg AS FLOAT), a) / a * CAST(255 AS FLOAT)) AS b FROM px JOIN al ON px.slice = al.slice)""" + _GRID


@query(f"WITH {_CM} {_DENSE.format(0)}")
def frame_countmask(spark, sf_dir):
    return _dense(spark, sf_dir, "countmask")


_CMW = _COUNTS + """, al AS (SELECT slice, CAST(quantile_cont(v, 0.99) AS FLOAT) AS a FROM (SELECT slice, pos AS v FROM px UNION ALL SELECT slice, neg FROM px) WHERE v > 0 GROUP BY slice),
f AS (SELECT px.slice, y, x, trunc((CAST(1 AS FLOAT) - least(CAST(pos AS FLOAT), a) / a) * CAST(255 AS FLOAT)) AS r, 0 AS g, trunc((CAST(1 AS FLOAT) - least(CAST(neg AS FLOAT), a) / a) * CAST(255 AS FLOAT)) AS b FROM px JOIN al ON px.slice = al.slice)""" + _GRID


@query(f"WITH {_CMW} {_DENSE.format(255)}")
def frame_countmask_white(spark, sf_dir):
    return _dense(spark, sf_dir, "countmask", True)


_LAST = BOUNDED_SQL + """, last AS (SELECT * FROM (SELECT slice, y, x, t, p, row_number() OVER (PARTITION BY slice, y, x ORDER BY t DESC, event_id DESC) AS k FROM sliced) WHERE k = 1),
span AS (SELECT slice, min(t) AS lo, max(t) AS hi FROM sliced GROUP BY slice)"""


@query(f"""WITH {_LAST}, f AS (SELECT last.slice, y, x, 255 * p AS r, trunc(255.0::DOUBLE * (1.0::DOUBLE - CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE CAST(t - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE) END)) AS g, 255 * (1 - p) AS b
FROM last JOIN span ON last.slice = span.slice) {_GRID} {_DENSE.format(0)}""")
def frame_tencode(spark, sf_dir):
    return _dense(spark, sf_dir, "tencode")


@query(f"WITH {_LAST}, f AS (SELECT slice, y, x, 255 * p AS r, 255 AS g, 255 * (1 - p) AS b FROM last) {_GRID} {_DENSE.format(0)}")
def frame_polmask(spark, sf_dir):
    return _dense(spark, sf_dir, "polmask")


_HOT = BOUNDED_SQL + ", n AS (SELECT y, x, count(*) AS n FROM sliced GROUP BY ALL), hot AS (SELECT * FROM n WHERE n.n > (SELECT avg(n) + {0} * stddev_pop(n) FROM n))"


@query(f"WITH {_HOT.format('1.0')} SELECT CAST(y AS INT) AS y, x, n FROM hot")
def hot_pixels(spark, sf_dir):
    return frames.hot_pixels(_sliced(spark, sf_dir), 1.0)


@query(f"WITH {_HOT.format('1.0')} SELECT event_id FROM sliced s WHERE NOT EXISTS (SELECT 1 FROM hot WHERE hot.x = s.x AND hot.y = s.y)")
def hot_pixel_filter(spark, sf_dir):
    return frames.without_hot_pixels(_sliced(spark, sf_dir), 1.0).select("event_id")


_MEAN, _STD = {"r": 0.9, "g": 0.8, "b": 0.95}, {"r": 0.2, "g": 0.25, "b": 0.1}


@query(f"WITH {_ACC} SELECT slice, CAST(y AS INT) AS y, x, " + ", ".join(f"round((CAST({c} AS DOUBLE) / 255.0::DOUBLE - {_MEAN[c]}::DOUBLE) / {_STD[c]}::DOUBLE, 6) AS {c}" for c in "rgb") + " FROM f")
def normalized_frames(spark, sf_dir):
    return rounded(frames.normalized(frames.accumulate(_sliced(spark, sf_dir)), _MEAN, _STD), "r", "g", "b")


_U = "CAST(CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT) AS DOUBLE) / 4294967296.0"


@query(f"""WITH {_CM}, s AS (SELECT *, {_U.format("concat_ws(':', 'swap0', slice)")} < 0.5 AS swap FROM f)
SELECT slice, CAST(y AS INT) AS y, CAST({WIDTH - 1} - x AS INT) AS x, CAST(CASE WHEN swap THEN b ELSE r END AS INT) AS r, g, CAST(CASE WHEN swap THEN r ELSE b END AS INT) AS b FROM s""")
def swap_and_flip(spark, sf_dir):
    out = frames.flip(frames.swap_polarity(frames.countmask(_sliced(spark, sf_dir))), WIDTH)
    return out.select("slice", "y", "x", "r", "g", "b")


def _unit_frames(spark, sf_dir, name):
    return _dense(spark, sf_dir, name).select("slice", "y", "x", *[(F.col(c) / 255.0).alias(c) for c in "rgb"])


_DRAWS = f""", draws AS (SELECT *, 0.7 + 0.7 * {_U.format("concat_ws(':', 'gain0', slice)")} AS gain, {_U.format("concat_ws(':', 'drop0', slice, y, x)")} < {_U.format("concat_ws(':', 'rate0', slice)")} * 0.15 AS dropped,
  {_U.format("concat_ws(':', 'salt0', slice, y, x)")} < {_U.format("concat_ws(':', 'amount0', slice)")} * 0.05 AS salt, {_U.format("concat_ws(':', 'sign0', slice, y, x)")} < 0.5 AS positive
  FROM (SELECT slice, y, x, r / 255.0 AS r, g / 255.0 AS g, b / 255.0 AS b FROM d))"""
_CLAMP = "round(greatest(least({0}, 1.0), 0.0), 6)"


@query(f"""WITH {_ACC}, d AS ({_DENSE.format(255)}) {_DRAWS},
k AS (SELECT *, CASE WHEN dropped THEN 1.0 ELSE 1.0 - gain * (1.0 - r) END AS r1, CASE WHEN dropped THEN 1.0 ELSE 1.0 - gain * (1.0 - g) END AS g1, CASE WHEN dropped THEN 1.0 ELSE 1.0 - gain * (1.0 - b) END AS b1 FROM draws),
u AS (SELECT *, coalesce(min(least(CASE WHEN 1.0 - r1 > 0 THEN 1.0 - r1 END, CASE WHEN 1.0 - b1 > 0 THEN 1.0 - b1 END)) OVER (PARTITION BY slice), 1.0 / 255.0) AS unit FROM k)
SELECT slice, y, x, {_CLAMP.format("r1 - CASE WHEN salt AND NOT positive THEN unit ELSE 0.0 END")} AS r, {_CLAMP.format("g1 - CASE WHEN salt THEN unit ELSE 0.0 END")} AS g, {_CLAMP.format("b1 - CASE WHEN salt AND positive THEN unit ELSE 0.0 END")} AS b FROM u""")
def noise_accumulate(spark, sf_dir):
    return rounded(noise.accumulate_noise(_unit_frames(spark, sf_dir, "accumulate"), salt_prob=0.05), "r", "g", "b")


@query(f"""WITH {_CM}, d AS ({_DENSE.format(0)}) {_DRAWS},
k AS (SELECT *, CASE WHEN dropped THEN 0.0 ELSE r * gain END AS r1, CASE WHEN dropped THEN 0.0 ELSE g END AS g1, CASE WHEN dropped THEN 0.0 ELSE b * gain END AS b1 FROM draws),
u AS (SELECT *, coalesce(min(least(CASE WHEN r1 > 0 THEN r1 END, CASE WHEN b1 > 0 THEN b1 END)) OVER (PARTITION BY slice), 1.0 / 255.0) AS unit FROM k)
SELECT slice, y, x, {_CLAMP.format("CASE WHEN salt AND positive THEN unit ELSE r1 END")} AS r, {_CLAMP.format("CASE WHEN salt THEN 1.0 ELSE g1 END")} AS g, {_CLAMP.format("CASE WHEN salt AND NOT positive THEN unit ELSE b1 END")} AS b FROM u""")
def noise_countmask(spark, sf_dir):
    return rounded(noise.countmask_noise(_unit_frames(spark, sf_dir, "countmask"), salt_prob=0.05), "r", "g", "b")
