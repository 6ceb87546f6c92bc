import pytest
from pyspark.sql import functions as F

from quillstat.operators import glm as G
from quillstat.operators import robust as R
from quillstat.plans import newton


@pytest.fixture
def rows(spark):
    t = spark.range(600, numPartitions=4)
    return t.select((F.col("id") % 3).alias("g"), (F.col("id") % 7 + 1).cast("double").alias("a"), (F.col("id") % 2).alias("x"), F.lit(1.0).alias("d"))


def plans_of(monkeypatch, module, name):
    seen, real = [], getattr(module, name)

    def keep(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df)

    monkeypatch.setattr(module, name, keep)
    return seen


def test_a_round_brings_no_group_to_one_task(spark, rows, monkeypatch):
    seen = plans_of(monkeypatch, newton, "settled")
    assert G.glm_fit_agg(rows, "poisson", "a", ["x"], ["g"]).count() == 3
    assert G.aft_fit_agg(rows, "a", ["x"], "d", ["g"]).count() == 3
    assert len(seen) > 4
    for plan in seen:  # rows are summed where they are read: no join or aggregate that sorts them by group
        assert "SortMergeJoin" not in plan and "SortAggregate" not in plan


def test_fit_and_predict_sorts_no_group(spark, rows):
    for out in (R.fit_predict_by(rows, "theilsen", "a", ["x"], ["g"], opts={"max_subpopulation": 50}), G.poisson_fit_predict_by(rows, "a", ["x"], ["g"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "SortAggregate" not in plan
        assert out.count() == 600
