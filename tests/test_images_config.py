import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom import config
from placeloom.functions import ordering
from placeloom.functions.register import register
from placeloom.operators import augment, places
from placeloom.plans import mixture
from placeloom.sources import images

rng = np.random.default_rng(8)


def png(pixels, colour, filters):
    """A writer with chosen row filters."""
    height, width, n = pixels.shape
    raw, above = bytearray(), np.zeros((width, n), int)
    for y in range(height):
        line, how = pixels[y].astype(int), filters[y % len(filters)]
        left = np.vstack([np.zeros((1, n), int), line[:-1]])
        corner = np.vstack([np.zeros((1, n), int), above[:-1]])
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        guess = [0 * line, left, above, (left + above) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))][how]
        raw += bytes([how]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return images.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(raw))) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(colour, n):
    pixels = rng.integers(0, 256, (11, 7, n))
    want = np.repeat(pixels[:, :, :1], 3, 2) if n < 3 else pixels[:, :, :3]
    for filters in ([0], [1], [2], [3], [4], [4, 3, 2, 1, 0]):
        assert (images.read_png(png(pixels, colour, filters)).transpose(1, 2, 0) == want).all()
    planes = want.transpose(2, 0, 1).astype(np.uint8)
    assert (images.read_png(images.write_png(planes)) == planes).all()
    for bad in (b"", b"x", png(pixels, colour, [0])[:-30], None):
        assert images.decode(bad) is None


def test_substitutes_and_previews(spark):
    good = images.write_png(rng.integers(0, 256, (3, 4, 5)).astype(np.uint8))
    files = spark.createDataFrame([("a", good), ("b", b"broken"), ("c", good), ("d", b"broken")], "path string, content binary")
    got = images.read_images(files)
    assert {r.path: r.height for r in got.collect()} == {"a": 4, "b": None, "c": 4, "d": None}
    pl = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "d")], "place_id long, path string")
    used = {r.path: r.used for r in images.with_substitutes(pl, got, pl).collect()}
    assert used["a"] == "a" and used["b"] in ("a", "c") and used["d"] is None
    ranked = spark.createDataFrame([("q", "r1", 1), ("q", "r2", 2)], "query_id string, reference_id string, rank int")
    frames = spark.createDataFrame([(i, bytes(range(60))) for i in ("q", "r1", "r2")], "id string, frame binary")
    strip = images.preview_strips(ranked, frames, 5, 4, (10, 8)).first()
    assert images.read_png(bytes(strip.png)).shape == (3, 8, 30)


def test_recipes(tmp_path):
    r = config.recipe({"streams": ["a"], "exclude_cities": ["Cph"]})
    assert r.exclude_cities == ("Cph", "sf") and r.descriptor_width == 16640
    assert config.recipe({"projection": 8448}).descriptor_width == 8448
    for bad in ({"colour": 1}, {"image_height": 225}, {"representation": "x"}):
        with pytest.raises(ValueError):
            config.recipe(bad)
    (tmp_path / "r.json").write_text('{"top_k": 3}')
    assert config.read_recipe(str(tmp_path / "r.json")).top_k == 3
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        config.read_recipe(str(tmp_path / "l.json"))


def test_transforms(spark):
    df = spark.createDataFrame([(s, y, x, (x + 1) / 10, 1.0, (y + 1) / 10) for s in range(6) for y in range(6) for x in range(8)], "slice long, y int, x int, r double, g double, b double")
    mean, std = dict.fromkeys("rgb", 0.5), dict.fromkeys("rgb", 0.25)
    names = [n for n, _ in augment.transforms("countmask", mean, std, 8, 6, domain_noise=True)]
    assert names == ["noise", "swap", "flip", "crop", "normalize"]
    assert [n for n, _ in augment.transforms("tencode", mean, std, 8, 6, train=False)] == ["normalize"]
    with pytest.raises(ValueError):
        augment.transforms("tencode", mean, std, 8, 6, domain_noise=True)
    out = augment.apply(df, augment.transforms("countmask", mean, std, 8, 6, domain_noise=True)).collect()
    assert len({(r.slice, r.y, r.x) for r in out}) == 6 * 48
    swapped = {(r.slice, r.y, r.x): (r.r, r.b) for r in augment.swap_polarity(df).collect()}
    src = {(r.slice, r.y, r.x): (r.r, r.b) for r in df.collect()}
    kinds = {s: {swapped[k] == src[k] for k in src if k[0] == s and src[k][0] != src[k][1]} for s in range(6)}
    assert all(len(v) == 1 for v in kinds.values()) and {next(iter(v)) for v in kinds.values()} == {True, False}


def test_ordinals_of_many_rows_equal_the_window(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{(i * 7919) % 1000:04d}", i) for i in range(1000)], "k string, i long").repartition(9)
    small = sorted(ordering.with_ordinal(df, ["k"], "o").collect())
    monkeypatch.setattr(ordering, "ONE_TASK_ROWS", 10)
    large = sorted(ordering.with_ordinal(df, ["k"], "o").collect())
    assert small == large and [r.o for r in small] == list(range(1000))
    a = ordering.rank_within(df.withColumn("g", F.col("i") % 3), ["g"], ["i"], "r").select("i", "r")
    b = ordering.rank_within(df.withColumn("g", F.col("i") % 3), ["g"], ["i"], "r", coarse=F.floor(F.col("i") / 50)).select("i", "r")
    assert sorted(a.collect()) == sorted(b.collect())


def test_sql_functions(spark):
    assert register(spark) == sorted(register(spark))
    assert spark.sql("select round(dot_product(array(1.0f, 2.0f), array(3.0f, 4.0f)), 3) v").first().v == 11.0


def test_mixture(spark, tmp_path):
    (tmp_path / "x" / "jpg").mkdir(parents=True)
    (tmp_path / "y").mkdir()

    def builder(first):
        return lambda root: spark.createDataFrame([(first + p, f"{root}/{p}-{i}.png") for p in range(8) for i in range(5)], "place_id long, path string")

    specs = [mixture.StreamSpec("a", builder(0), ("none", "x")), mixture.StreamSpec("b", builder(7), ("y",))]
    assert mixture.resolve_root(spark, str(tmp_path), specs[0]).endswith("x/jpg")
    got = mixture.build(spark, str(tmp_path), specs, 4, 2)
    assert [tuple(r) for r in got["overlaps"].collect()] == [("a", "b")]
    assert {r.stream: (r.places, r.images, r.batches_per_epoch, r.epochs_per_1k_steps) for r in got["summary"].collect()} == {"a": (8, 40, 2, 500.0), "b": (8, 40, 2, 500.0)}
    assert got["batches"].count() == 2 * 2 * 4 * 2
    with pytest.raises(FileNotFoundError):
        mixture.build(spark, str(tmp_path), [mixture.StreamSpec("c", builder(0), ("zz",))], 4, 2)
    with pytest.raises(ValueError, match="empty"):
        mixture.build(spark, str(tmp_path), [mixture.StreamSpec("c", lambda root: builder(0)(root).limit(0), ("y",))], 4, 2)
    pixels = lambda chosen: chosen.selectExpr("place_id / 10D as r", "1D as g", "0D as b")
    s = mixture.resolve_stats(spark, str(tmp_path / "s"), {"k": 1}, got["images"], pixels, 20, 2)
    assert s["g_mean"] == 1.0 and s["g_std"] == pytest.approx(1e-4)
    assert mixture.extension(specs[0], None, {"a": ".jpg"}) == ".jpg" and mixture.extension(specs[0], ".webp", {"a": ".jpg"}) == ".webp"


def test_city_rows_need_their_files(spark):
    meta = spark.createDataFrame([("B", "1", "2020", "5", "90", "1.10", "2.20", "x"), ("B", "1", "2020", "6", "90", "1.10", "2.20", "y"), ("A", "2", "2020", "5", "90", "1.10", "2.20", "z")], "city_id string, place_id string, year string, month string, northdeg string, lat string, lon string, panoid string")
    paths = ["B_0000001_2020_05_090_1.10_2.20_x.jpg", "B_0000001_2020_06_090_1.10_2.20_y.jpg"]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    assert sorted(map(tuple, places.by_city_rows(meta, listing, 2).collect())) == [(100_001, paths[0]), (100_001, paths[1])]


def test_sizes_and_backbones():
    from placeloom.config import BACKBONES, Recipe

    assert Recipe().tokens == 256 and Recipe().at_size(322).tokens == 529
    with pytest.raises(ValueError, match="patch"):
        Recipe().at_size(225)
    assert BACKBONES["base"].width % BACKBONES["base"].heads == 0
