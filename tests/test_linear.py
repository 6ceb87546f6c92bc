import math

import numpy as np
import pandas as pd
import pytest

from quillstat.operators import linear as L


def data(n=120, seed=1):
    rng = np.random.default_rng(seed)
    g = np.repeat(["p", "q"], n // 2)
    x1, x2 = rng.normal(5, 2, n), rng.normal(-1, 1, n)
    return pd.DataFrame({"g": g, "t": np.arange(n), "x1": x1, "x2": x2, "w": rng.uniform(0.5, 2, n), "y": 1.5 + 2 * x1 - 3 * x2 + np.where(g == "q", 4, 0) + rng.normal(0, 0.5, n)})


def ols(pdf, ridge=0.0, w=None):
    z = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    w = np.ones(len(pdf)) if w is None else w
    return np.linalg.solve((z.T * w) @ z + np.diag([0, ridge, ridge]), (z.T * w) @ pdf.y)


@pytest.mark.parametrize(("kind", "opts", "weight", "ridge"), [("ols", {}, None, 0), ("ridge", {"lambda": 3.0}, None, 3.0), ("wls", {}, "w", 0)])
def test_coefficients(spark, kind, opts, weight, ridge):
    pdf = data()
    out = L.fit_agg(spark.createDataFrame(pdf), kind, "y", ["x1", "x2"], ["g"], weight=weight, opts=opts).toPandas()
    for _, row in out.iterrows():
        part = pdf[pdf.g == row.g]
        want = ols(part, ridge, part.w.to_numpy() if weight else None)
        assert np.allclose([row.intercept, *row.coefficients], want, atol=1e-9)


def test_elastic_net_meets_its_conditions(spark):
    pdf = data()
    part = pdf[pdf.g == "p"]
    row = L.fit_agg(spark.createDataFrame(part), "elasticnet", "y", ["x1", "x2"], opts={"alpha": 20.0, "l1_ratio": 0.3}).toPandas().iloc[0]
    x = part[["x1", "x2"]].to_numpy()
    x, y = x - x.mean(axis=0), part.y.to_numpy() - part.y.mean()
    b = np.array(row.coefficients)
    slope = x.T @ (y - x @ b) - 20 * 0.7 * b
    assert np.allclose(slope[b != 0], 20 * 0.3 * np.sign(b[b != 0]), atol=1e-3)


def test_rls_is_the_recursion(spark):
    pdf = data(60)
    lam, p, beta = 0.97, np.eye(3) * 100, np.zeros(3)
    for _, r in pdf.iterrows():
        z = np.array([1, r.x1, r.x2])
        k = p @ z / (lam + z @ p @ z)
        beta = beta + k * (r.y - z @ beta)
        p = (p - np.outer(k, z) @ p) / lam
    row = L.fit_agg(spark.createDataFrame(pdf), "rls", "y", ["x1", "x2"], order_by=["t"], opts={"forgetting_factor": lam}).toPandas().iloc[0]
    assert np.allclose([row.intercept, *row.coefficients], beta, atol=1e-6)
    with pytest.raises(ValueError, match="order_by"):
        L.fit_agg(spark.createDataFrame(pdf), "rls", "y", ["x1"], opts={"forgetting_factor": 0.9})


def test_constant_and_dependent_features(spark):
    pdf = data(40).assign(c=7.0)
    pdf["d"] = 2 * pdf.x1
    row = L.fit_agg(spark.createDataFrame(pdf), "ols", "y", ["x1", "c", "d"]).toPandas().iloc[0]
    assert math.isnan(row.coefficients[1]) and math.isnan(row.coefficients[2]) and abs(row.coefficients[0]) > 1
    flat = L.fit_agg(spark.createDataFrame(pdf), "ols", "y", ["c"]).toPandas().iloc[0]
    assert flat.intercept == pytest.approx(pdf.y.mean()) and flat.r_squared == pytest.approx(0)


def test_missing_rows_and_small_groups(spark):
    rows = [("a", 1.0, 1.0), ("a", None, 2.0), ("a", 3.0, None), ("a", 5.0, 3.0), ("a", float("nan"), 9.0), ("a", 9.0, 5.0), ("b", 1.0, 1.0), (None, 1.0, 2.0), (None, 3.0, 4.0)]
    out = L.fit_agg(spark.createDataFrame(rows, "g string, y double, x double"), "ols", "y", ["x"], ["g"]).toPandas().set_index("g")
    assert out.loc["a"].n_observations == 3 and out.loc["a"].coefficients[0] == pytest.approx(2)
    assert out.loc["b"].coefficients is None
    assert out[out.index.isna()].iloc[0].coefficients[0] == pytest.approx(1)
    empty = spark.createDataFrame([], "g string, y double, x double")
    assert L.fit_agg(empty, "ols", "y", ["x"], ["g"]).count() == 0


def test_fit_predict_contract(spark):
    rows = [("a", "train", 2.0, 1.0), ("a", "TRAINING", 4.0, 2.0), ("a", "train", 6.5, 3.0), ("a", "test", 1.0, 4.0), ("a", None, None, 5.0), ("a", "train", 1.0, None), ("b", "test", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, s string, y double, x double")
    out = L.fit_predict_by(df, "ols", "y", ["x"], ["g"], split="s").toPandas()
    assert list(out.columns) == ["g", "s", "y", "x", "yhat", "yhat_lower", "yhat_upper", "is_training"]
    assert out.is_training.sum() == 3 and len(out) == 7
    assert out[out.x == 4].yhat.iloc[0] == pytest.approx(-1 / 3 + 4 * 2.25)
    assert out[(out.g == "a") & out.x.isna()].yhat.isna().all() and out[out.g == "b"].yhat.isna().all()
    assert (out.yhat_upper.dropna() >= out.yhat.dropna()).all()


def test_window_is_a_refit_of_every_frame(spark):
    pdf = data(40)
    out = L.fit_predict_window(spark.createDataFrame(pdf), "ols", "y", ["x1", "x2"], ["g"], ["t"]).toPandas().sort_values("t")
    for g, part in pdf.groupby("g"):
        got = out[out.g == g].yhat.tolist()
        for i in range(len(part)):
            frame = part.iloc[:i]
            if i <= 3:
                assert pd.isna(got[i])
            else:
                assert got[i] == pytest.approx(ols(frame) @ [1, frame.x1.iloc[-1], frame.x2.iloc[-1]], abs=1e-6)


def test_options(spark):
    df = spark.createDataFrame(data(20))
    with pytest.raises(ValueError, match="unknown"):
        L.fit_agg(df, "ols", "y", ["x1"], opts={"nonsense": 1})
    with pytest.raises(ValueError, match="alpha"):
        L.fit_agg(df, "ridge", "y", ["x1"], opts={"ALPHA": -1})
    row = L.fit_agg(df, "ols", "y", ["x1"], opts={"Inference": 1, "confidence": 0.9}).toPandas().iloc[0]
    assert row.ci_lower[0] < row.coefficients[0] < row.ci_upper[0]


def test_rls_window_forgets(spark):
    rng = np.random.default_rng(8)
    n, lam = 120, 0.6  # blocks of 24 rows
    x = rng.normal(size=n)
    y = 2 + 3 * x + rng.normal(size=n)
    y[[0, 30, 77]] = np.nan
    pdf = pd.DataFrame({"g": ["a"] * n, "t": range(n), "x": x, "y": y})
    both = pd.concat([pdf, pdf.assign(g="b", y=pdf.y + 5).head(3)])
    out = L.fit_predict_window(spark.createDataFrame(both), "rls", "y", ["x"], ["g"], ["t"], opts={"forgetting_factor": lam}).where("g = 'a'").orderBy("t").toPandas()
    assert len(out) == n
    for r in range(n):
        seen = [i for i in range(r) if not np.isnan(y[i])]
        if len(seen) <= 2:
            assert np.isnan(out.yhat[r])
            continue
        z = np.column_stack([np.ones(len(seen)), x[seen]])
        w = lam ** np.arange(len(seen) - 1, -1, -1.0)
        b = np.linalg.solve(z.T @ (w[:, None] * z) + np.eye(2) * lam ** len(seen) / 100, z.T @ (w * y[seen]))
        assert out.yhat[r] == pytest.approx(b[0] + b[1] * x[r - 1], rel=1e-6)
    with pytest.raises(ValueError):
        L.fit_predict_window(spark.createDataFrame(pdf), "rls", "y", ["x"], ["g"], ["t"], frame=(-9, 0), opts={"forgetting_factor": lam})
