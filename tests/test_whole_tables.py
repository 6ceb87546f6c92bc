import pytest
from pyspark.sql import functions as F

from quillstat import queries, queries_models  # noqa: F401

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name, key, count", [
    ("shapiro_wilk_agg", "l_suppkey", "n"), ("distance_cor_agg", "l_partkey", "n"),
    ("mmd_agg", "l_suppkey", "n1 + n2"), ("permutation_t_test_agg", "l_suppkey", "n1 + n2"),
])
def test_queries_take_all_of_lineitem(spark, name, key, count):
    rows = queries.lines(spark, SF).count()
    got = queries.QUERIES[name](spark, SF)
    assert key in got.columns and got.agg(F.sum(F.expr(count))).first()[0] == rows


@pytest.mark.parametrize("name", ["kendall_agg", "energy_distance_agg"])
def test_pairwise_queries_match_sql_over_all_of_lineitem(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    want = dict(con.execute(queries.ORACLE[name]).fetchall())
    got = dict(map(tuple, queries.QUERIES[name](spark, SF).collect()))
    assert len(got) == queries.lines(spark, SF).select("l_suppkey").distinct().count()
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=2e-5) for k in want)
