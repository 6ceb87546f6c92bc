import numpy as np
import pandas as pd
import pytest

from quillstat.operators import hypothesis as H
from quillstat.operators import robust as R
from quillstat.plans.order import medians


def test_medians_and_ranks_of_a_hot_group(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 4001 + ["odd", "two", "two"] + [None] * 3, "v": [*rng.integers(0, 900, 4001) / 7, 5.0, 1.0, 2.0, 3.0, 3.0, -1.0]})
    df = spark.createDataFrame(pdf).repartition(7)
    got = {r.g: r.m for r in medians(df, ["g"], "v", "m").collect()}
    want = {k: v.median() for k, v in pdf.fillna({"g": "none"}).groupby("g").v}
    assert got == pytest.approx({(None if k == "none" else k): v for k, v in want.items()})
    ranks = H._midranks(df, ["g"], "v").toPandas().fillna({"g": "none"})
    expected = pdf.fillna({"g": "none"}).groupby("g").v.rank()
    assert sorted(ranks["rank"]) == sorted(expected) and len(ranks) == len(pdf)
    assert (ranks.groupby(["g", "v"])["rank"].nunique() == 1).all()
    assert medians(df.where("v > 1e9"), ["g"], "v", "m").count() == 0


def test_ransac_counts_all_rows_of_a_group_larger_than_its_draw(spark):
    rng = np.random.default_rng(2)
    n = 6000  # subsets are drawn from about 800 of them
    x = rng.uniform(0, 10, n)
    y = 2 + 3 * x + rng.uniform(-0.2, 0.2, n)
    y[:2000] += 50
    pdf = pd.DataFrame({"g": ["a"] * n + ["b"] * 5 + [None] + ["d"], "x": [*x, 1, 2, 3, 4, 5, 1, np.nan], "y": [*y, 1, 2, 3, 4, 50, 1, 1]})
    df = spark.createDataFrame(pdf)
    out = {r.g: r for r in R.sampled_fit_agg(df, "ransac", "y", ["x"], ["g"], {"residual_threshold": 1.0}).collect()}
    assert set(out) == {"a", "b", None} and out[None].coefficients is None  # a single row fits no line
    assert out["a"].n_inliers == 4000 and out["a"].n_observations == n and out["a"].coefficients[0] == pytest.approx(3, abs=0.01)
    assert out["b"].n_inliers == 4 and out["b"].coefficients[0] == pytest.approx(1) and out["b"].intercept == pytest.approx(0, abs=1e-9)
    free = R.sampled_fit_agg(df.where("g = 'a'"), "ransac", "y", ["x"], opts={"fit_intercept": True}).first()
    assert free.residual_threshold == pytest.approx(np.median(np.abs(y - np.median(y)))) and free.n_trials >= 1
    t = R.sampled_fit_agg(df.where("g = 'b'"), "theilsen", "y", ["x"]).first()
    z, v = np.column_stack([np.ones(5), [1, 2, 3, 4, 5]]), np.array([1.0, 2, 3, 4, 50])
    b = R.theilsen_kernel(z, v, R.options.read(None, **R.THEILSEN))
    assert [t.intercept, *t.coefficients] == pytest.approx(b)


def test_the_stopping_rule_counts_trials():
    o = R.options.read({"max_trials": 50}, **R.RANSAC)
    assert R.ransac_choice(np.array([10] * 50), 10, 2, o) == (0, 1)
    assert R.ransac_choice(np.array([2, 9, *[1] * 48]), 10, 2, o)[0] == 1
