import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from placeloom.operators import metrics, retrieval, truth
from placeloom.plans import ORACLES, QUERIES, workflow
from placeloom.sources.options import StreamOptions
from tests.oracle import compare


def bank(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(m)], "id long, embedding array<float>")


def unit(m):
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(np.float32)


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_topk_against_brute_force(spark, parts):
    rng = np.random.default_rng(12)
    refs, queries = unit(rng.normal(size=(27, 10))), unit(rng.normal(size=(7, 10)))
    refs[18] = refs[1]
    for k in (1, 5, 30):
        got = retrieval.topk(bank(spark, refs).repartition(parts), bank(spark, queries), k).orderBy("query_id", "rank").collect()
        assert len(got) == 7 * min(k, 27)
        for q in range(7):
            s = [float(sum(float(a) * float(b) for a, b in zip(queries[q], r, strict=True))) for r in refs]
            want = sorted(range(27), key=lambda i: (-s[i], i))[: min(k, 27)]
            mine = [r for r in got if r.query_id == q]
            assert [r.reference_id for r in mine] == want
            assert all(abs(r.score - s[r.reference_id]) < 1e-12 for r in mine)
        assert got == retrieval.topk_expression(bank(spark, refs), bank(spark, queries), k).orderBy("query_id", "rank").collect()


def test_ties_blocks_and_errors(spark, monkeypatch):
    got = retrieval.topk(bank(spark, np.ones((15, 2))).repartition(4), bank(spark, np.ones((2, 2))), 5).orderBy("query_id", "rank").collect()
    assert [r.reference_id for r in got] == [0, 1, 2, 3, 4] * 2
    rng = np.random.default_rng(1)
    refs, queries = bank(spark, unit(rng.normal(size=(40, 6)))), bank(spark, unit(rng.normal(size=(9, 6))))
    whole = sorted(retrieval.topk(refs, queries, 4).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK_BYTES", 100)
    assert sorted(retrieval.topk(refs, queries, 4).collect()) == whole
    assert retrieval.topk(refs, queries.limit(0), 4).count() == 0 == retrieval.topk(refs.limit(0), queries, 4).count()
    with pytest.raises(ValueError):
        retrieval.topk(refs, queries, 0)
    with pytest.raises(Exception, match="equal dimensions"):
        retrieval.topk(refs, bank(spark, np.ones((1, 3))), 1).collect()


def test_expression_of_many_pairs_goes_in_blocks(spark, sf_small, tmp_path, monkeypatch):
    """A row a pair only up to EXPRESSION_PAIRS; the rows are the SQL's on either side of it, with common vectors and with null ones."""
    e = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    e = e.withColumn("embedding", F.expr("case when vec_id in (7, 20) then null when vec_id % 3 = 0 then first(embedding) over (order by vec_id) else embedding end"))
    e.write.parquet(f"{tmp_path}/embeddings.parquet")
    pairs = []
    scored = retrieval._scored
    monkeypatch.setattr(retrieval, "_scored", lambda b, q, *a: pairs.append(b.count() * q.count()) or scored(b, q, *a))
    assert plan_against_sql(spark, tmp_path, "topk_expression") == "" and pairs == [450 * 50]
    pairs.clear()
    monkeypatch.setattr(retrieval, "EXPRESSION_PAIRS", 1000)
    assert plan_against_sql(spark, tmp_path, "topk_expression") == "" and pairs == [50, 449]


def test_expression_of_odd_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(unit(rng.normal(size=(30, 4))))]
    rows[3], rows[4], rows[5] = (3, None), (4, [float("nan")] * 4), (5, [0.5, float("inf"), 0.5, 0.5])
    refs, queries = (spark.createDataFrame(r, "id long, embedding array<float>") for r in (rows, rows[2:12]))
    whole = retrieval.topk_expression(refs, queries, 6).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(retrieval, "EXPRESSION_PAIRS", 10)
    assert str(retrieval.topk_expression(refs, queries, 6).orderBy("query_id", "rank").collect()) == str(whole) and len(whole) == 60
    assert retrieval.topk_expression(refs.limit(0), queries, 6).count() == 0 == retrieval.topk_expression(refs, queries.limit(0), 6).count()


def samples(spark, ids):
    return spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "idx long, id string")


def test_ground_truth_forms_agree(spark):
    refs, qs = samples(spark, ["a", "b"]), samples(spark, ["q", "none", "r"])
    pairs = spark.createDataFrame([("q", "a"), ("r", "b"), ("q", "a")], "query_id string, reference_id string")
    from_csv = sorted(truth.edges_from_pairs(pairs, refs, qs).collect())
    m = np.array([[1, 0, 0], [0, 0, 1]])
    for layout, a in (("reference-query", m), ("query-reference", m.T)):
        cells = spark.createDataFrame([(r, c, int(a[r, c])) for r in range(a.shape[0]) for c in range(a.shape[1])], "row long, col long, value long")
        assert sorted(truth.edges_from_matrix(cells, refs, qs, layout).collect()) == from_csv
        with pytest.raises(ValueError, match="shape"):
            truth.edges_from_matrix(cells.where("row = 0"), refs, qs, layout)
    with pytest.raises(ValueError, match="0 or 1"):
        truth.edges_from_matrix(cells.selectExpr("row", "col", "value * 2 as value"), refs, qs)
    with pytest.raises(ValueError, match="layout"):
        truth.edges_from_matrix(cells, refs, qs, "rows")
    with pytest.raises(ValueError, match="unknown query_id"):
        truth.edges_from_pairs(spark.createDataFrame([("zz", "a")], "query_id string, reference_id string"), refs, qs)
    with pytest.raises(ValueError, match="columns"):
        truth.edges_from_pairs(pairs.drop("query_id"), refs, qs)
    ranked = spark.createDataFrame([(q, r, k) for q in ("q", "none", "r") for k, r in ((1, "a"), (2, "b"))], "query_id string, reference_id string, rank int")
    edges = truth.edges_from_pairs(pairs, refs, qs)
    per = metrics.hits(ranked, edges, qs.selectExpr("id as query_id"))
    r = metrics.recall(per).first()
    assert (r.r_at_1, r.r_at_5, r.queries, r.scorable_queries) == (0.5, 1.0, 3, 2)
    none = metrics.hits(ranked, edges.limit(0), qs.selectExpr("id as query_id"))
    assert metrics.recall(none).first().r_at_1 is None and metrics.recall_training(none).first().r_at_1 == 0.0


def points(spark, rows):
    return spark.createDataFrame([(i, float(x), float(y), c) for i, (x, y, c) in enumerate(rows)], "id long, easting double, northing double, city string")


def test_radius(spark):
    db, q = points(spark, [(0, 0, "a"), (30, 0, "a"), (0, 24, "a")]), points(spark, [(0, 0, "a"), (100, 100, "a")])
    for f in (truth.radius_edges, truth.radius_edges_float32):
        assert sorted(map(tuple, f(db, q, 25.0).collect())) == [(0, 0), (0, 2)]
    assert sorted(map(tuple, truth.radius_edges(db, q, 24.0).collect())) == [(0, 0), (0, 2)]
    rng = np.random.default_rng(4)
    a, b = rng.uniform(-300, 300, (80, 2)), rng.uniform(-300, 300, (90, 2))
    got = {tuple(r) for r in truth.radius_edges(points(spark, [(*p, "a") for p in a]), points(spark, [(*p, "a") for p in b]), 40.0).collect()}
    assert got == {(i, j) for i in range(90) for j in range(80) if ((b[i] - a[j]) ** 2).sum() <= 1600}
    d = truth.density(truth.radius_edges(db, q, 25.0), q, db).first()
    assert (d.queries, d.edges, d.scorable) == (2, 2, 1)
    assert [r.id for r in truth.answerable(q, truth.radius_edges(db, q, 25.0)).collect()] == [0]


def test_cities_never_match_each_other(spark):
    rows = [(x, 0, c) for c in "ab" for x in (0, 50)]
    got = truth.radius_edges(points(spark, rows), points(spark, rows), 25.0, on=["city"])
    assert sorted((r.query_id, r.reference_id) for r in got.collect()) == [(i, i) for i in range(4)]


def test_training_recall(spark):
    refs, qs = bank(spark, np.eye(3)), bank(spark, np.eye(3)[[1, 0]])
    edges = spark.createDataFrame([(0, 1)], "query_id long, reference_id long")
    per = metrics.hits(retrieval.topk(refs, qs, 20), edges, qs.selectExpr("id as query_id"))
    assert list(metrics.recall_training(per).first()) == [1.0] * 4


def test_unequal_lengths_are_an_error(spark):
    a = spark.range(3).withColumnRenamed("id", "slice")
    with pytest.raises(ValueError, match="unequal"):
        truth.zipped([a, a.limit(2)])
    assert sorted(r.slice for r in truth.zipped([a, a.where("slice != 1")], equal=False).collect()) == [0, 2]


def plan_against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet/*.parquet')")
    return compare(spark, con, str(folder), QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("rows", [1, 6, 11, 498])
def test_positional_zip_of_any_number_of_rows(spark, sf_small, tmp_path, rows):
    """Where the last slice has its first id only, the slices that have both ids are the result, as in the SQL."""
    spark.read.parquet(f"{sf_small}/embeddings.parquet").where(f"vec_id < {rows}").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert plan_against_sql(spark, tmp_path, "positional_zip") == ("no rows" if rows == 1 else "")


TINY = [(0, 1, 1, 0, 1), (1, 2, 2, 1000, 0), (2, 3, 3, 11000, 1), (3, 1, 2, 31000, 0)]


def test_workflow(spark, tmp_path):
    events = spark.createDataFrame(TINY, "event_id long, x int, y int, t long, p int")
    options = StreamOptions(window_ms=10, sensor_size=(8, 8))
    ids = [f"{i:08d}" for i in range(4)]
    gt = spark.createDataFrame([(i, i) for i in ids], "query_id string, reference_id string")
    out = str(tmp_path / "out")
    for _ in range(2):
        r = workflow.retrieve(events, events, options, top_k=1, ground_truth=gt, output=out, bank_dir=str(tmp_path / "banks"))
        assert len(spark.read.option("header", True).csv(f"{out}/retrievals.csv").collect()) == 4
        m = r.metrics.first()
        assert m.r_at_5 == 1 and m.queries == 4
    assert len(list((tmp_path / "banks").iterdir())) == 2
    r = workflow.retrieve(events, events, options, preview=2, output=out)
    assert r.queries.count() == 2 and r.metrics is None and not (tmp_path / "out" / "metrics.json").exists()
    for bad in (dict(window_ms=0), dict(window_ms=float("nan")), dict(sensor_size=(0, 4)), dict(order="abc"), dict(time_unit="h")):
        with pytest.raises(ValueError):
            StreamOptions(**bad)
    assert StreamOptions().window_us == 50_000 and StreamOptions().offset_us is None
    with pytest.raises(ValueError, match="unsupported"):
        workflow.retrieve(events, events, options, representation="polmask")


def test_pooled(spark):
    def side(shift):
        return spark.createDataFrame([(i, [float(i == j) for j in range(3)], i * 100.0 + shift, 0.0, i < 2) for i in range(3)], "slice long, embedding array<float>, x double, y double, valid boolean")

    r = workflow.run_pooled({"q": side(0), "a": side(10), "b": side(500)}, "q", ["a", "b"], ks=(1, 5)).first()
    assert (r.r_at_1, r.nq, r.nr, r.scorable) == (1.0, 2, 4, 2)
