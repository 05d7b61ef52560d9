import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import truth
from placeloom.sources import npy, npz, sinks, tables
from placeloom.sources.options import StreamOptions

X, Y, T, P = np.array([1, 2, 3, 1], np.uint16), np.array([1, 2, 3, 2], np.uint16), np.array([0, 1000, 11000, 31000]), np.array([1, 0, 1, 0], np.uint8)


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "rec"
    d.mkdir()
    np.savez(d / "b.npz", x=X, y=Y, t=T, p=P)
    np.savez(d / "a.npz", x=X[:2], y=Y[:2], t=T[:2], p=P[:2])
    (d / ".hidden").write_text("no")
    return d


def test_npz_and_parquet_and_csv_agree(spark, folder, tmp_path):
    want = sorted((int(x), int(y), int(t), int(p)) for x, y, t, p in zip(X, Y, T, P, strict=True))
    take = lambda df: sorted((r.x, r.y, r.t, r.p) for r in df.collect())
    assert take(tables.read_events(spark, str(folder / "b.npz"), fmt="npz")) == want
    npz.to_parquet(spark, str(folder / "b.npz"), str(tmp_path / "pq"))
    assert take(tables.read_events(spark, str(tmp_path / "pq"))) == want
    (tmp_path / "e.csv").write_text("".join(f"{t / 1000},{x},{y},{p}\n" for x, y, t, p in want))
    assert take(tables.read_events(spark, str(tmp_path / "e.csv"), StreamOptions(time_unit="ms"), fmt="csv")) == want
    small = tables.read_events(spark, str(folder / "b.npz"), StreamOptions(sensor_size=(3, 3)), fmt="npz")
    assert small.count() == 3


def test_folder_samples(spark, folder):
    df = tables.read_events(spark, str(folder), fmt="npz")
    rows = tables.folder_samples(df).orderBy("id").collect()
    assert [(r.id, r.slice, r.start_ms, r.end_ms) for r in rows] == [("a.npz", None, 0.0, 1.0), ("b.npz", None, 0.0, 31.0)]
    with pytest.raises(FileNotFoundError):
        npz.event_files(str(folder / "none"))
    (folder / "empty").mkdir()
    with pytest.raises(ValueError, match="no event files"):
        npz.event_files(str(folder / "empty"))


def test_index_json(spark, tmp_path):
    def write(rows):
        (tmp_path / "i.json").write_text(json.dumps(rows))
        return str(tmp_path / "i.json")

    ok = tables.index_json(spark, write([[1, ["a", "b"]], [2, ["c", "d"]]]), 2)
    assert sorted(map(tuple, ok.collect())) == [(1, "a"), (1, "b"), (2, "c"), (2, "d")]
    with pytest.raises(ValueError, match="unique"):
        tables.index_json(spark, write([[1, ["a"]], [1, ["b"]]]))
    with pytest.raises(ValueError, match="fewer"):
        tables.index_json(spark, write([[1, ["a"]]]), 2)
    with pytest.raises(ValueError, match="exist"):
        tables.index_json(spark, write([[1, ["a"]]]), 1, spark.createDataFrame([("b",)], "path string"))


def test_csv_listing_ground_truth(spark, tmp_path, monkeypatch):
    (tmp_path / "gt.csv").write_text("query_id,reference_id,x\n007,a,1\n")
    assert tables.ground_truth_csv(spark, str(tmp_path / "gt.csv")).first().query_id == "007"
    (tmp_path / "bad.csv").write_text("query,reference\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        tables.ground_truth_csv(spark, str(tmp_path / "bad.csv"))
    np.save(tmp_path / "gt.npy", np.eye(2, dtype=np.uint8))
    assert tables.ground_truth_npy(spark, str(tmp_path / "gt.npy")).where("value = 1").count() == 2
    matrix = np.random.default_rng(0).integers(0, 2, (37, 11))
    sides = [spark.range(n).selectExpr("id as idx", "id") for n in matrix.shape]
    for k, m in enumerate((matrix.astype(np.uint8), np.asfortranarray(matrix).astype(bool, order="F"), matrix.astype(np.float32))):
        np.save(tmp_path / f"m{k}.npy", m)
        path = str(tmp_path / f"m{k}.npy")
        monkeypatch.setattr(npy, "BLOCK_BYTES", 100)
        cells = tables.ground_truth_npy(spark, path)
        assert {(r.row, r.col) for r in cells.collect()} == set(zip(*map(list, np.nonzero(matrix)), strict=True))
        edges = truth.edges_from_matrix(cells, *sides, shape=tables.matrix_shape(path))
        assert {(r.reference_id, r.query_id) for r in edges.collect()} == set(zip(*map(list, np.nonzero(matrix)), strict=True))
    with pytest.raises(ValueError, match="expected"):
        truth.edges_from_matrix(cells, sides[1], sides[0], shape=tables.matrix_shape(path))
    for bad in (np.zeros(3), np.array([["a"]])):
        np.save(tmp_path / "b.npy", bad)
        with pytest.raises(ValueError):
            tables.matrix_shape(str(tmp_path / "b.npy"))
    (tmp_path / "img" / "x").mkdir(parents=True)
    for n in ("x/b.png", "a.png", "c.jpg"):
        (tmp_path / "img" / n).write_bytes(b"1")
    assert sorted(r.path.rsplit("/", 1)[1] for r in tables.listing(spark, str(tmp_path / "img")).collect()) == ["a.png", "b.png"]


def test_coordinates_and_offsets(spark, tmp_path):
    np.savez(tmp_path / "c.npz", a_xy=np.zeros((3, 2)), a_valid=np.array([1, 0, 1], bool))
    c = tables.coordinates_npz(spark, str(tmp_path / "c.npz"), ["a"])
    assert c.where("valid").count() == 2
    counts = lambda n: spark.createDataFrame([("a", n)], "cond string, n long")
    assert tuple(tables.leading_offsets(counts(5), counts(3)).first()) == ("a", 2, True)
    assert tuple(tables.leading_offsets(counts(5), counts(3), {"a": 2}).first()) == ("a", 2, False)
    for raw, measured in ((2, None), (5, {"a": 1})):
        with pytest.raises(ValueError, match="unequal"):
            tables.leading_offsets(counts(raw), counts(3), measured)


def test_sinks(spark, tmp_path):
    root = str(tmp_path)
    log = spark.createDataFrame([(1, "loss", 0.5)], "step long, metric string, value double")
    for _ in range(2):
        sinks.append_scalars(log, f"{root}/log")
    assert spark.read.json(f"{root}/log").count() == 2
    sinks.write_metrics(spark, log, f"{root}/m")
    assert sinks.exists(spark, f"{root}/m")
    sinks.write_metrics(spark, None, f"{root}/m")
    assert not sinks.exists(spark, f"{root}/m")
    calls = []

    def build():
        calls.append(1)
        return spark.createDataFrame([(1, "a"), (1, "b")], "place_id long, path string")

    listing = spark.createDataFrame([("a",), ("b",)], "path string")
    for kwargs in ({}, {}, {"listing": listing}, {"listing": listing.limit(1)}, {"refresh": True}):
        assert sinks.cached_index(spark, root, "x", {"k": 1}, build, **kwargs).count() == 2
    assert len(calls) == 3
    sinks.cached_index(spark, root, "x", {"k": 2}, build)
    assert len(calls) == 4
    stats = [sinks.cached_stats(spark, root, {"s": 1}, lambda: log) for _ in range(2)]
    assert stats[0] == stats[1] and stats[0]["value"] == 0.5
    assert sinks.budgeted(spark.range(50).select(F.col("id").cast("string").alias("path")), 7).count() == 7
