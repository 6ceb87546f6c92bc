import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstat.operators import diagnostics as D
from quillstat.operators import glm as G
from quillstat.operators import mixed as M
from quillstat.operators import robust as R


def test_poisson_score_is_zero(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    pdf = pd.DataFrame({"x": x, "y": rng.poisson(np.exp(0.5 + 0.8 * x)).astype(float)})
    f = G.glm_fit_agg(spark.createDataFrame(pdf), "poisson", "y", ["x"], opts={"inference": True}).toPandas().iloc[0]
    mu = np.exp(f.intercept + f.coefficients[0] * x)
    assert abs((pdf.y - mu).sum()) < 1e-4 and abs(((pdf.y - mu) * x).sum()) < 1e-4
    assert f.converged and f.deviance < f.null_deviance and f.ci_lower[0] < 0.8 < f.ci_upper[0]


def test_glm_rejects_bad_response(spark):
    df = spark.createDataFrame([(1.0, -1.0), (2.0, 3.0)], "x double, y double")
    with pytest.raises(Exception, match="must satisfy"):
        G.glm_fit_agg(df, "poisson", "y", ["x"]).collect()


def test_aft_recovers_scale(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    t = np.exp(1 + 0.5 * x + 0.6 * np.log(rng.exponential(size=400)))
    c = rng.exponential(20, 400)
    pdf = pd.DataFrame({"x": x, "t": np.minimum(t, c), "d": (t <= c).astype(float)})
    f = G.aft_fit_agg(spark.createDataFrame(pdf), "t", ["x"], "d").toPandas().iloc[0]
    assert f.intercept == pytest.approx(1, abs=0.15) and f.coefficients[0] == pytest.approx(0.5, abs=0.1) and f.scale == pytest.approx(0.6, abs=0.08)
    assert f.n_events + f.n_censored == 400


def test_huber_and_quantile_ignore_outliers(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, 100)
    y = 2 + 3 * x + rng.normal(0, 0.1, 100)
    y[:5] += 100
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    h = R.huber_fit_agg(df, "y", ["x"]).toPandas().iloc[0]
    q = R.quantile_fit_agg(df, "y", ["x"]).toPandas().iloc[0]
    t = R.sampled_fit_agg(df, "theilsen", "y", ["x"]).toPandas().iloc[0]
    r = R.sampled_fit_agg(df, "ransac", "y", ["x"], opts={"residual_threshold": 1.0}).toPandas().iloc[0]
    for f in (h, q, t, r):
        assert f.coefficients[0] == pytest.approx(3, abs=0.05)
    assert h.n_outliers >= 5 and r.n_inliers == 95


def test_isotonic(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 3.0), (3.0, 2.0), (4.0, 5.0), (2.5, None)], "x double, y double")
    out = R.isotonic_fit_predict_by(df, "y", "x").orderBy("x").toPandas()
    assert out.yhat.tolist() == pytest.approx([1, 2.5, 2.5, 2.5, 5])
    assert out.is_training.tolist() == [True, True, False, True, True]


def test_mixed_model_shrinks_group_means(spark):
    rng = np.random.default_rng(6)
    g = np.repeat(np.arange(30), 20)
    u = rng.normal(0, 2, 30)
    x = rng.normal(size=600)
    pdf = pd.DataFrame({"g": g, "x": x, "y": 1 + 0.5 * x + u[g] + rng.normal(0, 1, 600)})
    model, ranef = M.glmm_fit_by(spark.createDataFrame(pdf), "g", "y", ["x"])
    assert model["var_group"] == pytest.approx(4, rel=0.5) and model["var_residual"] == pytest.approx(1, rel=0.2) and model["n_groups"] == 30
    r = ranef.toPandas().assign(group=lambda d: d.group.astype(int)).sort_values("group")
    assert np.corrcoef(r.ranef, u)[0, 1] > 0.95


def test_demand_flags(spark):
    v = [0.0, 0.0, 5.0, 0.0, 6.0, 5.0, None, 0.0]
    df = spark.createDataFrame([("p", i, x) for i, x in enumerate(v)], "g string, t int, v double")
    f = D.aid_anomaly_by(df, ["g"], ["t"], "v").orderBy("t").toPandas()
    assert f.new_product.tolist() == [True, True] + [False] * 6 and f.stockout.tolist() == [False] * 3 + [True] + [False] * 4 and f.obsolete_product.tolist() == [False] * 7 + [True]
    s = D.aid_by(df, ["g"], ["t"], "v").toPandas().iloc[0]
    assert s.demand_type == "intermittent" and s.n_observations == 7 and s.stockout_count == 1


def test_vif_and_criteria(spark):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=50), rng.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "c": a + 2 * b}))
    assert all(np.isinf(D.vif_agg(df, ["a", "b", "c"]).first().vif))
    r2 = np.corrcoef(a, b)[0, 1] ** 2
    assert D.vif_agg(df, ["a", "b"]).first().vif[0] == pytest.approx(1 / (1 - r2))
    row = spark.range(1).select(D.aic(F.lit(0.0), F.lit(5), F.lit(2)).alias("z"), D.bic(F.lit(None), F.lit(5), F.lit(2)).alias("n")).first()
    assert row.z == float("-inf") and row.n is None


CONTINUOUS = {"normal": "real", "laplace": "real", "asymmetric_laplace": "real", "s": "real", "generalised_normal": "real", "student_t": "real", "logistic": "real", "gamma": "positive", "inverse_gaussian": "positive", "exponential": "positive", "beta": "unit", "folded_normal": "positive"}
DISCRETE = ("poisson", "geometric", "negative_binomial")


def test_alm_densities_sum_to_one(spark):
    grids = {"real": np.arange(-400, 400, 0.01), "positive": np.arange(5e-4, 400, 1e-3), "unit": np.arange(5e-6, 1, 1e-5)}
    col = lambda k, y: R.alm_log_density(k, y, F.lit(0.7), F.lit(0.9 if k != "beta" else 6.0), 0.3)
    for grid, y in grids.items():
        kinds = [k for k, g in CONTINUOUS.items() if g == grid]
        df = spark.createDataFrame(pd.DataFrame({"y": y}))
        got = df.agg(*[F.sum(F.exp(col(k, F.col("y")))).alias(k) for k in kinds]).first()
        for k in kinds:
            assert got[k] * (y[1] - y[0]) == pytest.approx(1, abs=3e-3), k
    counts = spark.range(0, 4000).select(F.col("id").cast("double").alias("y"))
    got = counts.agg(*[F.sum(F.exp(col(k, F.col("y")))).alias(k) for k in DISCRETE]).first()
    assert all(got[k] == pytest.approx(1, abs=1e-6) for k in DISCRETE)
    two = spark.createDataFrame([(0.0,), (1.0,)], "y double")
    got = two.agg(*[F.sum(F.exp(col(k, F.col("y")))).alias(k) for k in ("binomial", "cumulative_logistic", "cumulative_normal")]).first()
    assert all(v == pytest.approx(1, abs=1e-7) for v in got)


def test_alm_likelihood_is_greatest_at_its_own_family(spark):
    rng = np.random.default_rng(11)
    x = rng.uniform(0, 2, 600)
    m = np.exp(0.4 + 0.5 * x)
    data = {"gamma": rng.gamma(4, m / 4), "poisson": rng.poisson(m).astype(float), "log_normal": np.exp(1 + x + rng.normal(0, 0.5, 600))}
    rival = {"gamma": "exponential", "poisson": "geometric", "log_normal": "exponential"}
    for own, y in data.items():
        df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
        ll = lambda d: R.alm_fit_agg(df, "y", ["x"], opts={"distribution": d}).first().log_likelihood
        assert ll(own) > ll(rival[own]), own
    n = R.alm_fit_agg(spark.createDataFrame(pd.DataFrame({"x": x, "y": 2 + 3 * x + rng.normal(0, 0.3, 600)})), "y", ["x"], opts={"inference": True}).first()
    assert n.ci_lower[0] < 3 < n.ci_upper[0] and n.std_errors[0] == pytest.approx(0.3 / np.sqrt(((x - x.mean()) ** 2).sum()), rel=0.1)


@pytest.fixture(scope="module")
def counts(spark):
    """Counts whose fits under penalties are known values."""
    return spark.sql("SELECT (id % 10) / 3.0D AS x1, (id * 7) % 5 - 2.0D AS x2, round(exp(0.6D + 0.25D * ((id % 10) / 3.0D) - 0.15D * ((id * 7) % 5 - 2.0D)) + ((id * 13) % 4) * 0.3D) AS y FROM range(60)")


def poisson(counts, **opts):
    return G.glm_fit_agg(counts, "poisson", "y", ["x1", "x2"], opts=opts).first()


def test_vcov_of_penalised_fits(counts):
    se = {v: poisson(counts, glm_lambda=5.0, compute_inference=True, vcov=v).std_errors[0] for v in ("laplace", "naive", "sandwich")}
    assert se == pytest.approx({"laplace": 0.076937, "naive": 0.07814, "sandwich": 0.075752}, abs=2e-6)
    bare = {poisson(counts, compute_inference=True, vcov=v).std_errors[0] for v in ("laplace", "naive", "sandwich")}
    assert max(bare) - min(bare) < 1e-9
    with pytest.raises(ValueError, match="vcov"):
        poisson(counts, vcov="bogus")


def test_priors(counts):
    tight = {"dist": "normal", "loc": 0.0, "scale": 0.02}
    assert poisson(counts).coefficients == pytest.approx([0.241563, -0.128771], abs=1e-6)
    assert poisson(counts, prior={"x1": tight}).coefficients[0] == pytest.approx(0.015081, abs=1e-6)
    assert poisson(counts, prior={"x1": tight | {"loc": 2.0, "scale": 0.01}}).coefficients[0] > 1.5
    laplace = lambda s: poisson(counts, prior={"x1": {"dist": "laplace", "loc": 0.0, "scale": s}}, compute_inference=True)
    held = laplace(1e-4)
    assert held.coefficients[0] == 0 and np.isnan(held.std_errors[0]) and held.std_errors[1] > 0
    some = laplace(0.05)
    # at the optimum the score equals the weight of the absolute distance
    rows = counts.toPandas()
    mu = np.exp(some.intercept + some.coefficients[0] * rows.x1 + some.coefficients[1] * rows.x2)
    assert 0 < some.coefficients[0] < 0.2416 and ((rows.y - mu) * rows.x1).sum() == pytest.approx(1 / 0.05, abs=1e-3) and abs(((rows.y - mu) * rows.x2).sum()) < 1e-3


def test_aft_takes_priors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "t": np.exp(1 + 0.5 * x + 0.6 * np.log(rng.exponential(size=300))), "d": 1.0}))
    fit = lambda **o: G.aft_fit_agg(df, "t", ["x"], "d", opts=o).first()
    assert fit(prior={"x": {"scale": 0.01}}).coefficients[0] < 0.1 < fit().coefficients[0]
    a, b = (fit(prior={"x": {"scale": 0.05}}, compute_inference=True, vcov=v).std_errors[0] for v in ("sandwich", "naive"))
    assert a < b


def test_mixed_models_of_other_families(spark):
    # group effects laid out evenly, so the fits have known neighbourhoods
    i = np.arange(300)
    g, x = i // 20, (i % 20) % 4
    y = np.round(np.exp(0.5 + 0.3 * x + 0.6 * ((g + 0.5) / 15 * 2 - 1)))
    df = spark.createDataFrame(pd.DataFrame({"g": g, "x": x.astype(float), "y": y}))
    model, ranef = M.glmm_fit_by(df, "g", "y", ["x"], {"glmm_family": "poisson"})
    assert model["converged"] and abs(model["coefficients"][0] - 0.3) < 0.1 and model["var_group"] > 0 and model["n_groups"] == 15 and model["std_errors"][0] > 0
    u = ranef.toPandas().assign(g=lambda d: d.group.astype(int)).set_index("g").ranef
    mu = np.exp(model["intercept"] + model["coefficients"][0] * x + u[g].to_numpy())
    # at the mode the scores of the fixed effects and of each group's effect vanish
    assert abs((y - mu).sum()) < 1e-3 and abs(((y - mu) * x).sum()) < 1e-3
    for k in range(15):
        assert (y - mu)[g == k].sum() == pytest.approx(u[k] / model["var_group"], abs=1e-3)
    rng = np.random.default_rng(2)
    b = rng.normal(0, 1.0, 60)
    g = np.repeat(np.arange(60), 40)
    x = rng.normal(size=2400)
    y = (rng.random(2400) < 1 / (1 + np.exp(-(0.3 + 0.8 * x + b[g])))).astype(float)
    model, _ = M.glmm_fit_by(spark.createDataFrame(pd.DataFrame({"g": g, "x": x, "y": y})), "g", "y", ["x"], {"glmm_family": "binomial"})
    assert model["ci_lower"][0] < 0.8 < model["ci_upper"][0] and 0.5 < model["var_group"] < 1.8 and model["var_residual"] == 1.0


def test_mixed_models_with_slopes(spark):
    rng = np.random.default_rng(4)
    b0, b1 = rng.normal(0, 2, 40), rng.normal(0, 0.7, 40)
    g = np.repeat(np.arange(40), 25)
    x = rng.normal(size=1000)
    pdf = pd.DataFrame({"g": g, "x": x, "y": 1 + 0.5 * x + b0[g] + b1[g] * x + rng.normal(0, 1, 1000)})
    df = spark.createDataFrame(pdf)
    model, ranef = M.glmm_fit_by(df, "g", "y", ["x"], {"random": [1]})
    cov = np.array(model["random_cov"])
    assert cov.shape == (2, 2) and cov[0, 0] == pytest.approx(4, rel=0.6) and cov[1, 1] == pytest.approx(0.49, rel=0.6) and model["var_residual"] == pytest.approx(1, rel=0.15)
    e = ranef.toPandas().assign(g=lambda d: d.group.astype(int)).sort_values("g")
    e = np.stack(e.effects)
    assert np.corrcoef(e[:, 0], b0)[0, 1] > 0.95 and np.corrcoef(e[:, 1], b1)[0, 1] > 0.85
    with pytest.raises(ValueError):
        M.glmm_fit_by(df, "g", "y", ["x"], {"random": [5]})
    with pytest.raises(ValueError):
        M.glmm_fit_by(df.withColumn("g", F.lit("only")), "g", "y", ["x"])
    # rounds and grid give the same fit of a random intercept, with and without REML
    shifted = df.withColumn("zero", F.lit(0.0))
    for reml in (True, False):
        grid, _ = M.glmm_fit_by(df, "g", "y", ["x"], {"reml": reml})
        rounds, _ = M.glmm_fit_by(shifted, "g", "y", ["x", "zero"], {"reml": reml, "offset": 2})
        for k in ("intercept", "var_group", "var_residual", "log_likelihood"):
            assert rounds[k] == pytest.approx(grid[k], rel=1e-3), k
        assert rounds["std_errors"] == pytest.approx(grid["std_errors"], rel=1e-3)
