import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom import cli
from placeloom.operators import places
from placeloom.plans import mixture, streams
from placeloom.sources import cities, images, tables


def write(path, text="1"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def tree(tmp_path):
    """Two cities; in a, clusters of both splits agree, in b they don't. Image q9 of a is missing."""
    for city, shift in (("a", 0), ("b", 900)):
        for split, letter in (("database", "d"), ("query", "q")):
            rows = ["x,key,easting,northing,unique_cluster,night,view_direction"]
            for i in range(10):
                rows.append(f"{i},{letter}{i},{i % 5 * 100 + (shift if letter == 'q' else 0)}.5,7,{i % 5},{'True' if i == 3 else 'False'},{i * 30}")
                if (city, letter, i) != ("a", "q", 9):
                    write(tmp_path / "img" / city / split / "images" / f"{letter}{i}.jpg")
            write(tmp_path / "meta" / city / split / "postprocessed.csv", "\n".join(rows) + "\n")
    return str(tmp_path / "img"), str(tmp_path / "meta")


def test_city_places_from_files(spark, tree):
    got = cities.city_places(spark, *tree, bins=1, min_images=2, offset=300)
    want = set()
    for ci, city in enumerate("ab"):
        groups = {}
        for letter in "dq":
            for i in range(10):
                if (city, letter, i) != ("a", "q", 9):
                    split = "database" if letter == "d" else "query"
                    groups.setdefault((i % 5, 0) if city == "a" else (split, i % 5, 0), []).append(f"{letter}{i}.jpg")
        for gi, (_, names) in enumerate(sorted(groups.items(), key=lambda kv: str(kv[0]))):
            want |= {(300 + ci * 1_000_000 + gi, n) for n in names}
    assert {(r.place_id, r.path.rsplit("/", 1)[1]) for r in got.collect()} == want
    assert cities.city_metadata(spark, tree[1], night=False).count() == 36
    assert {r.city for r in cities.city_metadata(spark, tree[1], drop=(" B",)).collect()} == {"a"}
    with pytest.raises(ValueError, match="isn't there"):
        cities.city_metadata(spark, tree[1], drop=("zz",))
    with pytest.raises(ValueError, match="no place has 50"):
        cities.city_places(spark, *tree, min_images=50)


def test_split_table(spark, tree):
    rows = cities.split_table(spark, *tree, "a", "query").collect()
    assert len(rows) == 9 and {r.northing for r in rows} == {7.0}
    with pytest.raises(FileNotFoundError):
        cities.split_table(spark, *tree, "a", "train")
    with pytest.raises(FileNotFoundError):
        cities.city_splits(spark, tree[1] + "x")


def test_test_cities_never_train(spark, tree, tmp_path):
    write(tmp_path / "meta" / "Miami" / "database" / "postprocessed.csv", "key,easting,northing\nk,1,2\n")
    with pytest.raises(ValueError, match="test city"):
        cities.city_metadata(spark, tree[1])
    assert cities.city_metadata(spark, tree[1], drop=("miami",)).count() == 40
    write(tmp_path / "meta" / "Miami" / "database" / "postprocessed.csv", "key,easting\nk,1\n")
    with pytest.raises(ValueError, match="Miami/database.*northing"):
        cities.split_metadata(spark, "Miami", "database", f"{tree[1]}/Miami/database/postprocessed.csv")


def test_views_by_number_or_word(spark):
    rows = [("a", "d", "10"), ("a", "d", "350"), ("a", "d", None), ("a", "q", "Forward"), ("a", "q", "Sideways"), ("a", "q", "90")]
    df = spark.createDataFrame(rows, "city string, split string, view_direction string")
    assert sorted(r.view for r in cities.with_views(df, 4).collect()) == sorted(["0", "3", "0", "'Forward'", "'Sideways'", "'90'"])
    assert {r.view for r in cities.with_views(df, 1).collect()} == {"0"}


def test_retry_tells_storage_from_form():
    calls, waits = [], []

    def flaky(kind, fails):
        def read():
            calls.append(1)
            if len(calls) <= fails:
                raise kind("no data")
            return "table"

        return read

    assert cities.with_retry(flaky(OSError, 2), "x/y", sleep=waits.append) == "table" and waits == [2.0, 2.0]
    calls.clear()
    with pytest.raises(RuntimeError, match="x/y.*3 attempts"):
        cities.with_retry(flaky(OSError, 9), "x/y", sleep=waits.append)
    calls.clear()
    with pytest.raises(ValueError, match="x/y"):
        cities.with_retry(flaky(ValueError, 9), "x/y", sleep=waits.append)
    assert len(calls) == 1


def test_named_streams(spark, tree, tmp_path):
    data = tmp_path / "data"
    for city in ("Bern", "Aarau"):
        for place, n in ((7, 4), (12, 3)):
            for k in range(n):
                write(data / "gsv-cities" / "jpg" / city / f"{city}_{place:07d}_2020_{k:02d}.jpg")
        write(data / "gsv-cities" / "jpg" / city / "note.jpg")
    for i in range(40):
        write(data / "sf_xl" / "jpg" / "train" / f"@{551000 + i % 7}.0@{4180000 + i % 5}.0@10@S@37@-122@pano{i}@@{i * 9 % 360}@@@@2020@@.jpg")
    write(data / "sf_xl" / "jpg" / "test" / "@1@2@@@@@@@@.jpg")
    for scan, n in (("s1", 13), ("s2", 3)):
        for k in range(n):
            write(data / "scannet" / scan / "dslr" / f"DSC{k:05d}.png")
    specs = streams.registry(spark, streams.Choices(chunk=5, gap=1, meta_root=tree[1], cell=20, groups_a_side=2, min_class=2, min_images=3, view_bins=1))
    assert list(specs) == ["gsv_cities", "sf_xl_frontal", "sf_xl_lateral", "msls", "megascenes", "scannet"]
    root = lambda n: mixture.resolve_root(spark, str(data), specs[n])
    assert root("gsv_cities").endswith("gsv-cities/jpg") and root("sf_xl_frontal").endswith("sf_xl/jpg/train") and root("scannet").endswith("data/scannet")
    count = lambda df: {r.place_id: r["count"] for r in df.groupBy("place_id").count().collect()}
    assert count(specs["gsv_cities"].build(root("gsv_cities"))) == {7: 4, 12: 3, 10_000_007: 4, 10_000_012: 3}
    assert count(specs["scannet"].build(root("scannet"))) == {500_000_000: 5, 500_000_001: 5, 500_001_000: 3}
    frontal, lateral = (specs[f"sf_xl_{k}"].build(root(f"sf_xl_{k}")) for k in ("frontal", "lateral"))
    assert frontal.where("place_id >= 100000000").count() == frontal.count() > 0 and lateral.where("place_id < 200000000").count() == 0
    assert specs["msls"].build(tree[0]).where("place_id >= 300000000").count() > 0
    with pytest.raises(FileNotFoundError):
        root("megascenes")
    with pytest.raises(ValueError, match="meta_root"):
        streams.registry(spark)["msls"].build(tree[0])
    assert places.by_city_tree(spark.createDataFrame([("x/C/C_1.jpg",)], "path string"), 1).count() == 0


def test_command_line(spark, tmp_path):
    rng = np.random.default_rng(0)
    t = np.sort(rng.integers(0, 200_000, 3000))
    for name in ("ref", "qry"):
        np.savez(tmp_path / f"{name}.npz", x=rng.integers(0, 16, 3000), y=rng.integers(0, 12, 3000), t=t, p=rng.integers(0, 2, 3000))
    np.save(tmp_path / "gt.npy", np.eye(4, dtype=np.uint8))
    base = ["--reference", str(tmp_path / "ref.npz"), "--query", str(tmp_path / "qry.npz"), "--sensor", "16x12", "--output", str(tmp_path / "out")]
    result = cli.run(spark, [*base, "--ground-truth", str(tmp_path / "gt.npy"), "--top-k", "3"])
    assert result.ranked.count() == 12 and result.metrics.first().queries == 4
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "retrievals.csv")).count() == 12
    with pytest.raises(SystemExit):
        cli.run(spark, [*base[:4], "--sensor", "wide"])


def test_absent_libraries_are_errors_not_empty_results(spark, tmp_path):
    write(tmp_path / "a.h5")
    try:
        import h5py  # noqa: F401
    except ImportError:
        with pytest.raises(RuntimeError, match="h5py"):
            tables.read_events(spark, str(tmp_path / "a.h5"), fmt="hdf5")
    if images.Image is None:
        with pytest.raises(images.NoDecoder, match="JPEG"):
            images.decode(b"\xff\xd8\xff\xe0 and more")
        assert images.decode(b"no image") is None


def test_hdf5_reader_by_way_of_a_stand_in(monkeypatch, tmp_path):
    from placeloom.sources import hdf5

    write(tmp_path / "a.h5")
    data = {"events/x": np.arange(5), "events/y": np.arange(5), "events/ts": np.arange(5) * 10, "p": np.ones(5)}

    class File(dict):
        def __init__(self, path, mode):
            super().__init__(data)
            self.filename = path

        __enter__, __exit__ = lambda self: self, lambda self, *_: None

    monkeypatch.setattr(hdf5, "library", lambda: type("h5py", (), {"File": File}))
    monkeypatch.setattr(hdf5, "STRETCH", 3)
    reader = hdf5.Hdf5Reader({"path": str(tmp_path), "keys": '{"t": "ts"}', "time_unit": "ms"})
    parts = reader.partitions()
    assert [(p.at, p.to) for p in parts] == [(0, 3), (3, 5)]
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["event_id"], r["t"], r["p"]) for r in rows] == [(i, i * 10_000, 1) for i in range(5)]
    data["p"] = np.ones(4)
    with pytest.raises(ValueError, match="unequal"):
        reader.partitions()
