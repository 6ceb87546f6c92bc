import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstat.operators import mixed as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    g = np.repeat(np.arange(25), rng.integers(10, 90, 25))
    u = rng.normal(0, 0.8, 25)
    pdf = pd.DataFrame({"g": [None if k == 3 else f"={k}" if k == 4 else "" if k == 5 else str(k) for k in g], "x": rng.integers(0, 3, len(g)).astype(float)})
    pdf["y"] = (rng.random(len(g)) < 1 / (1 + np.exp(-(0.2 + 0.5 * pdf.x + u[g])))).astype(float)
    return pdf, spark.createDataFrame(pdf).repartition(5).cache()


def fit(df):
    model, ranef = M.glmm_fit_by(df, "g", "y", ["x"], {"family": "binomial"})
    return model, {r.group: (r.n, r.ranef) for r in ranef.collect()}


def test_groups_larger_than_a_task_and_joins_by_shuffle_change_nothing(spark, rows, monkeypatch):
    pdf, df = rows
    model, ranef = fit(df)
    assert {k: n for k, (n, _) in ranef.items()} == {(None if k == "none" else k): n for k, n in pdf.fillna({"g": "none"}).groupby("g").size().items()}
    eta = model["intercept"] + model["coefficients"][0] * pdf.x + [ranef[k][1] for k in pdf.g.astype(object).where(pdf.g.notna(), None)]
    score = pdf.y - 1 / (1 + np.exp(-eta))
    assert model["converged"] and abs(score.sum()) < 1e-3 and abs((score * pdf.x).sum()) < 1e-3  # equal rows count as often as they occur
    monkeypatch.setattr(M, "TASK_ROWS", 40)  # about half of the groups are larger
    monkeypatch.setattr(M, "FEW", 0)
    other, effects = fit(df)
    assert effects.keys() == ranef.keys() and other["iterations"] == model["iterations"]
    for k in ("intercept", "var_group", "log_likelihood", "deviance"):
        assert other[k] == pytest.approx(model[k], rel=1e-6)
    assert all(effects[k] == (n, pytest.approx(v, abs=1e-6)) for k, (n, v) in ranef.items())


def test_rounds_do_not_shuffle_the_rows(spark, rows):
    pdf, df = rows
    named = df.select(F.coalesce("g", F.lit("none")).alias("__g"), F.col("y").alias("__y"), F.col("x").alias("__x0"), F.lit(0.0).alias("__off"))
    counts = M.settled(named.groupBy("__g").agg(F.count(F.lit(1)).alias("n")))
    small, large, _ = M._dealt(named, counts, len(pdf), len(pdf), int(pdf.groupby("g").size().max()))
    assert large is None and small.count() < len(pdf) and small.agg(F.sum("__c")).first()[0] == len(pdf)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        per = small.join(counts, "__g").groupBy("__g").agg(F.sum("__c").alias("c"), F.first("n").alias("n"))
        assert all(r.c == r.n for r in per.collect())
        plan = per._jdf.queryExecution().executedPlan().toString()  # the final and the initial plan
        assert "SortMergeJoin" in plan and plan.count("ENSURE_REQUIREMENTS") == 2  # in each one exchange, of the counts
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        small.unpersist()
