from placeloom.llm import registry
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.01"


def test_queries_equal_their_sql(spark):
    con = connect(SF)
    for name, sql in registry.ORACLE_SQL.items():
        assert compare(spark, con, SF, registry.QUERIES[name], sql) == ""


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
