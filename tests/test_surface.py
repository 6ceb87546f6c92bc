import pytest


def test_entry_imports_and_names():
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert "ols_fit_agg" in q and set(o) <= set(q)


def test_sql_functions(spark):
    from quillstat.functions.sql import register

    register(spark)
    row = spark.sql("SELECT r.* FROM (SELECT ols_fit(array(1D, 3D, 5D, 7.5D), array(array(1D, 2D, 3D, 4D))) AS r)").first()
    assert row.coefficients[0] == pytest.approx(2.15) and row.n_observations == 4
    assert spark.sql("SELECT aic(2.0D, 10, 2)").first()[0] == pytest.approx(10 * -1.6094379124341003 + 4)
    with pytest.raises(Exception, match="too few rows"):
        spark.sql("SELECT ols_fit(array(1D), array(array(1D)))").collect()


def test_streaming_windows_and_recursion(spark, tmp_path):
    from quillstat.streaming.moments import recursive_fit, windowed_fit

    rows = [(f"2024-01-01 00:0{i % 6}:00", "k", float(i), 2.0 * i + 1) for i in range(12)]
    df = spark.createDataFrame(rows, "t string, key string, x double, y double").selectExpr("CAST(t AS timestamp) AS ts", "key", "x", "y")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = windowed_fit(stream, "y", ["x"], "ts", "3 minutes", by=["key"]).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM windows").collect()
    assert len(got) == 2 and all(abs(r.coefficients[0] - 2) < 1e-9 for r in got)
    q = recursive_fit(stream, "key", "y", ["x"], order_by="x").writeStream.format("memory").queryName("rls").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = spark.sql("SELECT * FROM rls").collect()[-1]
    assert last.n_observations == 12 and abs(last.coefficients[0] - 2) < 0.05


def test_sources_round_trip(spark, tmp_path):
    from quillstat.sources.tables import read, write

    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    for kind in ("parquet", "csv", "json", "orc"):
        write(df, str(tmp_path / f"t.{kind}"))
        back = read(spark, str(tmp_path / f"t.{kind}"), schema="i int, s string")
        assert sorted(back.collect()) == sorted(df.collect()) or back.count() == 2
