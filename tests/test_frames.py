import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import descriptors, frames, noise, slicing

SCHEMA = "event_id long, x int, y int, t long, p tinyint"


def make(spark, rows):
    return spark.createDataFrame([(i, *map(int, r)) for i, r in enumerate(rows)], SCHEMA)


def chw(df, width, height, background):
    out = np.full((3, height, width), background, np.uint8)
    for r in df.collect():
        out[:, r.y, r.x] = (r.r, r.g, r.b)
    return out


@pytest.fixture(scope="module")
def golden(spark):
    rng = np.random.default_rng(0)
    n = 5000
    cols = rng.integers(0, 40, n), rng.integers(0, 30, n), rng.integers(0, 50000, n), rng.choice([-1, 1], n)
    return make(spark, zip(*cols, strict=True)).withColumn("slice", F.lit(0).cast("long")).cache()


def test_golden_accumulate(golden):
    """A published digest of this renderer over seeded events."""
    frame = chw(frames.accumulate(frames.in_bounds(golden, 40, 30)), 40, 30, 255)
    assert hashlib.sha256(frame.tobytes()).hexdigest() == "f7c8e6558486634e34d470d405ee427b80b4976202cf6122ad8f63147f24f80d"


@pytest.mark.parametrize("parts", [1, 3, 17])
@pytest.mark.parametrize("name", list(frames.RENDERERS))
def test_partitioning_and_polarity_encoding_do_not_matter(golden, name, parts):
    a = frames.render(name, frames.in_bounds(golden, 40, 30))
    zero_one = golden.withColumn("p", (F.col("p") > 0).cast("tinyint")).repartition(parts)
    b = frames.render(name, frames.in_bounds(zero_one, 40, 30))
    assert sorted(a.collect()) == sorted(b.collect())


def plain(name, rows, width, height, white=None):
    """Renderers by loops over explicit planes."""
    pos, neg, last = np.zeros((height, width)), np.zeros((height, width)), {}
    for i, (x, y, t, p) in enumerate(rows):
        if 0 <= x < width and 0 <= y < height:
            (pos if p > 0 else neg)[y, x] += 1
            last[y, x] = max(last.get((y, x), (-1, -1, 0)), (t, i, int(p > 0)))
    f = np.float32
    if name in ("tencode", "polmask"):
        out = np.zeros((3, height, width), np.uint8)
        if last:
            times = [t for x, y, t, p in rows if 0 <= x < width and 0 <= y < height]
            lo, hi = min(times), max(times)
            for (y, x), (t, _, p) in last.items():
                age = (t - lo) / (hi - lo) if hi > lo else 0.0
                out[:, y, x] = 255 * p, 255 if name == "polmask" else int(255 * (1 - age)), 255 * (1 - p)
        return out
    if name == "countmask":
        values = np.concatenate([pos.ravel(), neg.ravel()])
        alpha = f(np.percentile(values[values > 0], 99)) if (values > 0).any() else f(1)
        planes = [np.minimum(pos, alpha).astype(f) / alpha, (pos + neg > 0).astype(f), np.minimum(neg, alpha).astype(f) / alpha]
        planes = [f(1) - v for v in planes] if white else planes
        return (np.stack(planes) * f(255)).astype(np.uint8)
    part = []
    for a in (pos, neg):
        limit = f(np.percentile(a[a > 0], 99)) if (a > 0).any() else f(1)
        part.append(np.minimum(a.astype(f), limit) / limit)
    win = part[0] >= part[1]
    ip, im = np.where(win, part[0], f(0)), np.where(win, f(0), part[1])
    one = f(1)
    return (np.clip(np.stack([one - im, one - ip - im, one - ip]), 0, 1) * f(255)).astype(np.uint8)


@pytest.mark.parametrize("name", list(frames.RENDERERS))
def test_renderers_against_loops(spark, name):
    rng = np.random.default_rng(7)
    n = 700
    rows = list(zip(rng.integers(-1, 9, n).tolist(), rng.integers(-1, 8, n).tolist(), rng.integers(0, 300, n).tolist(), rng.choice([0, 1], n).tolist(), strict=True))
    df = make(spark, rows).withColumn("slice", F.lit(0).cast("long"))
    for white in (None, True) if name == "countmask" else (None,):
        background = 255 if white else frames.RENDERERS[name][1]
        got = chw(frames.render(name, frames.in_bounds(df, 8, 7), white), 8, 7, background)
        assert (got == plain(name, rows, 8, 7, white)).all()


def test_empty_frame_and_dispatch(spark):
    none = make(spark, []).withColumn("slice", F.lit(0).cast("long"))
    slices = spark.createDataFrame([(0,)], "slice long")
    for name, background in (("accumulate", 255), ("countmask", 0)):
        rows = frames.dense(frames.render(name, frames.in_bounds(none, 10, 8)), slices, 10, 8, background).collect()
        assert len(rows) == 80 and {(r.r, r.g, r.b) for r in rows} == {(background,) * 3}
    with pytest.raises(ValueError, match="no renderer"):
        frames.render("other", none)


TINY = [(1, 1, 0, 1), (2, 2, 1000, 0), (3, 3, 11000, 1), (1, 2, 31000, 0)]


def test_windows_of_a_tiny_stream(spark):
    df = make(spark, TINY)
    rows = slicing.sample_table(df, 10_000).orderBy("slice").collect()
    assert [r.id for r in rows] == ["00000000", "00000001", "00000002", "00000003"]
    assert rows[3].start_ms == 30 and rows[3].end_ms == 31
    assert [r.n_events for r in slicing.slice_counts(df, 10_000).orderBy("slice").collect()] == [2, 1, 0, 1]
    rows = slicing.sample_table(df, 10_000, 10_000).orderBy("slice").collect()
    assert len(rows) == 3 and rows[0].start_ms == 10
    assert slicing.with_slice(df, 10_000, 10_000).count() == 2
    assert slicing.sample_table(df, 10_000, 10**9).count() == 0
    assert [r.slice for r in slicing.strided(slicing.sample_table(df, 1000), 10, 5, 20).orderBy("slice").collect()] == [5, 15]
    with pytest.raises(ValueError):
        slicing.with_slice(df, 0)


def test_window_on_an_exact_multiple_keeps_the_last_event(spark):
    df = make(spark, [(0, 0, 0, 1), (0, 0, 20_000, 1)])
    assert slicing.sample_table(df, 10_000).count() == 3
    assert [r.n_events for r in slicing.slice_counts(df, 10_000).orderBy("slice").collect()] == [1, 0, 1]


def test_slices_by_recording(spark):
    df = make(spark, TINY).withColumn("path", F.when(F.col("t") < 5000, "a").otherwise("b"))
    got = slicing.with_slice(df, 10_000, by=["path"]).groupBy("path").agg(F.max("slice").alias("m"))
    assert {r.path: r.m for r in got.collect()} == {"a": 0, "b": 2}


def test_hot_pixels(spark):
    df = make(spark, [(0, 0, i, 1) for i in range(100)] + [(x, y, 5, 1) for x in range(6) for y in range(6)])
    assert [(r.y, r.x) for r in frames.hot_pixels(df, 3.0).collect()] == [(0, 0)]
    assert frames.without_hot_pixels(df, 3.0).count() == 35


def unit_frames(spark, white):
    rng = np.random.default_rng(3)
    rows = []
    for s in range(3):
        for y in range(12):
            for x in range(12):
                if rng.random() < 0.5 and s < 2:
                    a, b = (float(v) for v in rng.random(2) * 0.8)
                    rows.append((s, y, x, 1 - b, 1 - max(a, b), 1 - a) if white else (s, y, x, a, 1.0, b))
                else:
                    rows.append((s, y, x, *([1.0] * 3 if white else [0.0] * 3)))
    return spark.createDataFrame(rows, "slice long, y int, x int, r double, g double, b double")


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_noise_respects_the_background(spark, seed):
    for white, f in ((True, noise.accumulate_noise), (False, noise.countmask_noise)):
        src = unit_frames(spark, white)
        background = 1.0 if white else 0.0
        before = {(r.slice, r.y, r.x): (r.r, r.g, r.b) for r in src.collect()}
        gained = {(r.slice, r.y, r.x): (r.r, r.g, r.b) for r in f(src, seed, dropout_max=0, salt_prob=0).collect()}
        assert all(gained[k] == (background,) * 3 for k, v in before.items() if v == (background,) * 3)
        dropped = {(r.slice, r.y, r.x): (r.r, r.g, r.b) for r in f(src, seed, gain=(1, 1), dropout_max=0.9, salt_prob=0).collect()}
        assert all(v == (background,) * 3 or np.allclose(v, before[k]) for k, v in dropped.items())
        salted = {(r.slice, r.y, r.x): (r.r, r.g, r.b) for r in f(src, seed, gain=(1, 1), dropout_max=0, salt_prob=0.9).collect()}
        changed = [k for k, v in salted.items() if not np.allclose(v, before[k])]
        assert changed and all(0 <= c <= 1 for v in salted.values() for c in v)
        if not white:
            assert all(v[1] in (0.0, 1.0) for v in salted.values())
        again = {(r.slice, r.y, r.x): (r.r, r.g, r.b) for r in f(src.repartition(7), seed, gain=(1, 1), dropout_max=0, salt_prob=0.9).collect()}
        assert again == salted
    with pytest.raises(ValueError):
        noise.noise_for("tencode")


def test_dense_frames_resize_and_extract(spark, golden):
    sparse = frames.accumulate(frames.in_bounds(golden, 40, 30))
    slices = spark.createDataFrame([(0,), (1,)], "slice long")
    dense = descriptors.dense_frames(sparse, 40, 30, 255, slices)
    rows = {r.slice: bytes(r.frame) for r in dense.collect()}
    assert hashlib.sha256(rows[0]).hexdigest().startswith("f7c8e6558486") and set(rows[1]) == {255}
    for antialias in (True, False):
        for n_in, n_out in ((30, 30), (30, 64), (64, 30), (1, 5), (5, 1)):
            w = descriptors.cubic_weights(n_in, n_out, antialias)
            assert np.allclose(w.sum(1), 1)
            if n_in == n_out:
                assert np.allclose(w, np.eye(n_in))
    bank = descriptors.extract(dense, lambda x: x.mean(axis=(2, 3)), 40, 30, [0.0] * 3, [1.0] * 3, (16, 16)).collect()
    assert all(abs(np.linalg.norm(r.embedding) - 1) < 1e-6 for r in bank)
