import pytest

import __spark_entry__ as entry
from placeloom.plans import ORACLES, QUERIES
from tests.oracle import compare, connect


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1


def test_plans_push_down_and_stay_jvm_side(spark, sf_small, capsys):
    QUERIES["bounds_filter"](spark, sf_small).explain("formatted")
    plan = capsys.readouterr().out
    assert "value" not in plan.split("ReadSchema")[1].split("\n")[0]
    for name in ("gt_radius", "gt_block_city", "answerable_queries"):
        QUERIES[name](spark, sf_small).explain("formatted")
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    for name in ("frame_accumulate", "frame_tencode", "place_geometry", "sinkhorn", "channel_stats"):
        QUERIES[name](spark, sf_small).explain("formatted")
        plan = capsys.readouterr().out
        assert "Python" not in plan and "MapInArrow" not in plan


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_the_rest_passes_without_the_training_data_operators(tmp_path, gone):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", *gone, "__pycache__"))
    rest = ["tests/test_images_config.py", "tests/test_streaming.py", "tests/test_entry.py::test_contract"]
    run = subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *rest], cwd=tmp_path / "repo", capture_output=True, text=True)
    assert run.returncode == 0, run.stdout[-2000:]
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q)); assert 'recall_at_k' in q and not any(k.startswith('op1') for k in q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True).returncode == 0


def test_a_broken_operator_is_not_taken_for_an_absent_one(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    registry = tmp_path / "repo" / "placeloom" / "llm" / "registry.py"
    if registry.exists():
        registry.write_text("import no_such_module\n")
        run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path / "repo", capture_output=True, text=True)
        assert run.returncode != 0 and "no_such_module" in run.stderr


def test_sinkhorn_shuffles_once_and_time_bounds_reach_the_scan(spark, tmp_path, capsys):
    from placeloom.operators import pooling, slicing

    scores = spark.range(100).selectExpr("id div 20 as id", "cast(id % 20 div 5 as int) as n", "cast(id % 3 as int) as m", "cast(id as double) as s").distinct()
    pooling.sinkhorn(scores, 3, 4).explain("formatted")
    plan = capsys.readouterr().out
    loops = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
    assert loops.count("Exchange\n") <= 5 and loops.count("Window") > 6
    spark.range(0, 1_000_000, 1000).selectExpr("id as event_id", "id as t").write.parquet(str(tmp_path / "e"))
    slicing.between(spark.read.parquet(str(tmp_path / "e")), 50_000, 3, 5).explain("formatted")
    assert "GreaterThanOrEqual(t,150000)" in capsys.readouterr().out
    got = slicing.between(spark.read.parquet(str(tmp_path / "e")), 50_000, 3, 5)
    want = slicing.with_slice(spark.read.parquet(str(tmp_path / "e")), 50_000).where("slice between 3 and 4")
    assert sorted(map(tuple, got.select("event_id", "slice").collect())) == sorted(map(tuple, want.select("event_id", "slice").collect()))


def test_weights_in_blocks_equal_weights_as_a_table(spark, monkeypatch):
    from placeloom.operators import pooling

    features = spark.range(60).selectExpr("id div 6 as id", "id % 6 as d", "double(id * 7 % 11 - 5) as v")
    weights = spark.range(42).selectExpr("id div 6 as o", "id % 6 as d", "double(id * 5 % 13 - 6) as w")
    bias = spark.range(7).selectExpr("id as o", "id * 0.1 as b")
    want = {(r.id, r.o): r.y for r in pooling.project(features, weights, bias).collect()}
    monkeypatch.setattr(pooling, "TABLE_WEIGHTS", 10)
    monkeypatch.setattr(pooling, "BLOCK_BYTES", 8 * 6 * 2)
    monkeypatch.setattr(pooling, "SPREAD", 3)
    got = {(r.id, r.o): r.y for r in pooling.project(features, weights, bias).collect()}
    assert got.keys() == want.keys() and len(got) == 70 and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_temporary_tables_go_and_clusters_need_a_shared_folder(spark):
    import os

    from placeloom import storage

    with storage.temporary_tables(spark):
        before = set(os.listdir(storage.shared_dir(spark)))
        assert storage.written(spark.range(3).toDF("a"), "x").count() == 3
        assert len(set(os.listdir(storage.shared_dir(spark))) - before) == 1
    assert set(os.listdir(storage.shared_dir(spark))) == before

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"getCheckpointDir": staticmethod(lambda: None), "master": "local-cluster[3,2,3000]"})

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Cluster)
