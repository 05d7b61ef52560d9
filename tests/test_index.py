import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo, names
from placeloom.operators import history, pairs, places, pooling, sampling, sets, stats


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names(spark):
    df = spark.createDataFrame([("@551000.5@4180000@10@S@37@-122@pano@@60@@@@2020@@.jpg",), ("@x@2@3@4@5@6@7@8@9",), ("short",), (None,)], "n string")
    rows = df.select(*[v.alias(k) for k, v in names.at_fields(F.col("n")).items()]).collect()
    assert tuple(rows[0]) == (551000.5, 4180000.0, 60.0, "pano") and all(tuple(r) == (None,) * 4 for r in rows[1:])
    r = one(spark, names.padded(F.lit(123456789), 7), names.padded(F.lit(42), 7), names.place_of_name(F.lit("City01_0000042_2020_05.jpg")), names.place_of_name(F.lit("nothing")), names.basename(F.lit("a/b/c.png")), names.dirname(F.lit("a/b/c.png")))
    assert tuple(r) == ("123456789", "0000042", 42, None, "c.png", "a/b")
    assert names.param_hash({"b": 1, "a": [2]}) == names.param_hash({"a": [2], "b": 1}) != names.param_hash({"a": [2], "b": 2})


def test_cells_and_ids(spark):
    ce, cn = geo.cell(F.lit(-1.0), 20), geo.cell(F.lit(39.9), 20)
    assert tuple(one(spark, ce, cn)) == (-20, 20)
    rng = np.random.default_rng(0)
    pts = [(float(e), float(n)) for e, n in rng.uniform(0, 10**6, (200, 2))]
    df = spark.createDataFrame(pts, "e double, n double").select(geo.cell(F.col("e"), 20).alias("ce"), geo.cell(F.col("n"), 20).alias("cn"))
    df = df.select(geo.group_id(F.col("ce"), F.col("cn"), 20, 5).alias("g"), geo.cell_place_id(F.col("ce"), F.col("cn"), 20, 7).alias("p"))
    for (e, n), r in zip(pts, df.withColumn("back", geo.group_of_place(F.col("p"), 5, 7)).collect(), strict=True):
        a, b = int(e // 20), int(n // 20)
        assert (r.g, r.p, r.back) == ((a % 5) * 5 + b % 5, 7 + a * 1_000_000 + b, r.g)
    frontal = geo.cell_place_id(F.lit(551000), F.lit(4180000), 20, 0)
    lateral = geo.cell_place_id(F.lit(551000), F.lit(4180000 - 100_000_00), 20, 500_000)
    assert one(spark, (frontal == lateral).alias("same")).same  # ids are only unique within a stream


def test_angles(spark):
    r = one(spark, *[geo.bearing(F.lit(e), F.lit(n)) for e, n in ((0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0))], geo.angular_difference(F.lit(350.0), F.lit(10.0)))
    assert list(r) == pytest.approx([0, 90, 180, 270, 20])
    assert [r.b for r in spark.createDataFrame([(0.0,), (359.0,), (None,), (-1.0,)], "h double").select(geo.view_bin(F.col("h"), 4).alias("b")).collect()] == [0, 3, 0, 3]
    assert one(spark, geo.view_bin(F.lit(200.0), 1)).asDict().popitem()[1] == 0


def test_focal_point_is_the_singular_vector_rule(spark):
    rng = np.random.default_rng(5)
    for _ in range(12):
        xy = rng.normal(size=(30, 2)) @ rng.normal(size=(2, 2)) + 100
        for angle in (0.0, 90.0):
            df = spark.createDataFrame([(0, 0, float(e), float(n)) for e, n in xy], "ce long, cn long, east double, north double")
            r = places.focal_points(df, 10.0, angle).first()
            u, _, _ = np.linalg.svd((xy - xy.mean(0)).T, full_matrices=False)
            u = u * np.where(np.abs(u).argmax(0) == 0, np.sign(u[0]), np.sign(u[1]))  # our signs: the largest component positive
            t = math.radians(angle)
            want = xy.mean(0) + 10 * np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) @ u[1]
            assert [r.focal_e, r.focal_n] == pytest.approx(want.tolist(), abs=1e-6)


def test_runs(spark):
    img = spark.createDataFrame([("s1", i, f"p{i:03d}") for i in range(31)] + [("s0", i, f"p{i}") for i in range(3)], "scan string, n long, path string")
    got = places.runs(img, "scan", ["n"], 8, 4, 4, offset=10, carry=("path",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.place_id, []).append(r.path)
    # 31 = 8 + gap 4 + 8 + gap 4 + 7; the short scan has no run but keeps its number
    assert {k: len(v) for k, v in by.items()} == {1010: 8, 1011: 8, 1012: 7}
    assert places.runs(img, "scan", ["n"], 8, 4, 4, per_scan=2).select("place_id").distinct().count() == 2
    with pytest.raises(ValueError):
        places.runs(img, "scan", ["n"], 3, 4, 4)


def test_directories_and_nesting(spark):
    img = spark.createDataFrame([(f"r/{d}/{i}.png",) for d, n in (("b", 5), ("a", 1), ("c", 4)) for i in range(n)], "path string")
    got = places.by_directory(img, 4, 4, offset=100)
    assert {r.place_id: r.paths for r in places.nested(got).collect()} == {101: [f"r/b/{i}.png" for i in range(4)], 102: [f"r/c/{i}.png" for i in range(4)]}


def test_samples(spark):
    img = spark.createDataFrame([(p, f"{p}-{i}") for p in range(30) for i in range(p % 6)], "place_id long, path string")
    a, b = sampling.pk_batches(img, 4, 3), sampling.pk_batches(img.repartition(7), 4, 3)
    assert sorted(a.collect()) == sorted(b.collect())
    for r in a.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("place_id").alias("p")).collect():
        assert (r.n, r.p) == (12, 4)
    assert sampling.subset(img.select("place_id").distinct(), 100).count() == 25
    groups = spark.createDataFrame([(g, g * 100 + i) for g in range(4) for i in range(g * 3)], "place_group long, place_id long")
    cyc = sampling.group_cycle(groups, 4, 5).collect()
    assert {r.epoch: r.place_group for r in cyc} == {0: 2, 1: 3, 2: 2, 3: 3, 4: 2}
    with pytest.raises(ValueError):
        sampling.group_cycle(groups, 50, 2)
    listing = img.where("place_id != 5")
    assert not sampling.probe(img.select("path"), listing, 200).isEmpty()
    assert sampling.probe(listing.select("path"), listing, 200).isEmpty()


def test_id_ranges(spark):
    df = spark.createDataFrame([("a", 0), ("a", 150), ("b", 100), ("b", 200), ("c", 10000), ("d", 200)], "stream string, place_id long")
    assert sorted(map(tuple, stats.id_overlaps(stats.id_ranges(df)).collect())) == [("a", "b"), ("b", "d")]


def test_guards(spark):
    cities = spark.createDataFrame([("Zurich",), ("cph",), ("Tokyo",)], "city string")
    assert sorted(r.city for r in sets.excluded(cities, ["CPH ", ""]).collect()) == ["Tokyo", "Zurich"]
    with pytest.raises(ValueError, match="cannot exclude"):
        sets.excluded(cities, ["cpg"])
    with pytest.raises(ValueError, match="Miami"):
        sets.excluded(cities.union(spark.createDataFrame([("Miami",)], "city string")), ["cph"])


def test_schedule_and_layers(spark):
    lr = lambda s: one(spark, history.lr_schedule(F.lit(s), 500, 5e-5, 10000, 1e-6).alias("v")).v
    assert lr(0) == pytest.approx(5e-5 / 500) and lr(499) == lr(500) == pytest.approx(5e-5)
    assert lr(10000) == pytest.approx(1e-6) and lr(20000) == 1e-6 and lr(5000) < lr(4000)
    df = spark.createDataFrame([("encoder.blocks.3.x",), ("encoder.patch_embed.w",), ("encoder.cls_token",), ("encoder.norm.w",), ("head.w",)], "n string")
    assert [r.v for r in df.select(history.layer_id(F.col("n"), 12).alias("v")).collect()] == [4, 0, 0, 13, 13]
    assert history.token_grid(322, 322, 14) == (23, 23) and history.descriptor_width(64, 256, 256) == 16640
    with pytest.raises(ValueError):
        history.token_grid(320, 322, 14)


def test_heads(spark):
    h = spark.createDataFrame([("m", s, v) for s, v in enumerate((0.1, 0.3, 0.3, 0.2, 0.5))], "head string, step long, value double")
    got = history.evals_since_best(h).orderBy("step").collect()
    assert [r.improved for r in got] == [1, 1, 0, 0, 1] and [r.since_best for r in got] == [0, 0, 1, 2, 0]


def test_sinkhorn_and_salad_against_numpy(spark):
    rng = np.random.default_rng(9)
    m, n, dim, width = 3, 7, 4, 2
    s, f, t = rng.normal(size=(m, n)), rng.normal(size=(dim, n)), rng.normal(size=width)
    lse = lambda z, ax: np.log(np.exp(z).sum(ax, keepdims=True))
    full, base = np.vstack([s, np.ones((1, n))]), -math.log(n + m)
    la = np.full((m + 1, 1), base)
    la[m] += math.log(n - m)
    u, v = np.zeros((m + 1, 1)), np.zeros((1, n))
    for _ in range(3):
        u = la - lse(full + v, 1)
        v = base - lse(full + u, 0)
    want = full + u + v - base
    scores = spark.createDataFrame([(0, a, b, float(s[a, b])) for a in range(m) for b in range(n)], "id long, m int, n int, s double")
    got = np.zeros((m + 1, n))
    for r in pooling.sinkhorn(scores, m, n).collect():
        got[r.m, r.n] = r.lp
    assert np.allclose(got, want)
    unit = lambda x, ax=None: x / np.linalg.norm(x, axis=ax, keepdims=True) if ax is not None else x / np.linalg.norm(x)
    sums = unit(f @ np.exp(want[:m]).T, 0)
    whole = unit(np.concatenate([unit(t), sums.ravel()]))
    features = spark.createDataFrame([(0, b, d, float(f[d, b])) for d in range(dim) for b in range(n)], "id long, n int, d long, v double")
    tokens = spark.createDataFrame([(0, k, float(t[k])) for k in range(width)], "id long, k int, v double")
    rows = pooling.salad(features, scores, tokens, m, n, dim).orderBy("pos").collect()
    assert np.allclose([r.v for r in rows], whole)
    with pytest.raises(ValueError):
        pooling.sinkhorn(scores, 7, 7)


def test_memory_pairs(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(40)], "seq long, label long")
    got = {(r.seq, r.earlier): r.positive for r in pairs.memory_pairs(df, 5, block=4).collect()}
    assert got == {(i, j): int(i % 3 == j % 3) for i in range(40) for j in range(max(0, i - 5), i)}
