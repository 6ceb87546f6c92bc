import numpy as np
import pandas as pd
import pytest

from quillstat.operators import hypothesis as H
from quillstat.operators import resampling as S


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def test_shapiro_matches_published_example(spark):
    v = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = H.shapiro_wilk_agg(frame(spark, v=v), "v").first()
    assert row.statistic == pytest.approx(0.79, abs=0.01) and 0.005 < row.p_value < 0.012


def test_ranks_with_ties(spark):
    v, g = [1.0, 2, 2, 3, 3, 3, 4, 9], [0, 0, 1, 0, 1, 1, 1, 1]
    row = H.mann_whitney_u_agg(frame(spark, v=v, g=g), "v", "g").first()
    pairs = sum((a > b) + 0.5 * (a == b) for a, x in zip(v, g, strict=True) if x == 0 for b, z in zip(v, g, strict=True) if z)
    assert row.statistic == pairs and 0 < row.p_value <= 1


def test_kendall_against_pairs(spark):
    rng = np.random.default_rng(2)
    x, y = rng.integers(0, 6, 40).astype(float), rng.integers(0, 6, 40).astype(float)
    s = sum(np.sign(x[i] - x[j]) * np.sign(y[i] - y[j]) for i in range(40) for j in range(i))
    ux = sum(x[i] != x[j] for i in range(40) for j in range(i))
    uy = sum(y[i] != y[j] for i in range(40) for j in range(i))
    assert S.kendall_agg(frame(spark, x=x, y=y), "x", "y").first().tau == pytest.approx(s / np.sqrt(ux * uy))


def test_kendall_gives_no_group_to_one_task(spark, monkeypatch):
    monkeypatch.setattr(S, "SLICE_BITS", 2)  # several slices
    rng = np.random.default_rng(4)
    g = rng.integers(0, 2, 300)
    x, y = rng.integers(0, 40, 300).astype(float), rng.integers(0, 40, 300).astype(float)
    got = S.kendall_agg(frame(spark, g=g, x=x, y=y), "x", "y", ["g"])
    assert "InPandas" not in got._jdf.queryExecution().toString()
    rows = {r.g: r for r in got.collect()}
    for k in (0, 1):
        a, b = x[g == k], y[g == k]
        dx, dy = np.sign(a[:, None] - a), np.sign(b[:, None] - b)
        assert rows[k].n == len(a) and rows[k].tau == pytest.approx((dx * dy).sum() / np.sqrt((dx != 0).sum() * (dy != 0).sum()))


def test_energy_and_permutation_t_by_slices_and_ranges(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=150).round(1), rng.normal(0.15, size=250).round(1)
    y[:80] = 0.5  # one value holds a fifth of all rows
    pdf = pd.DataFrame({"k": [None] * 400, "g": [0] * 150 + [1] * 250, "v": np.concatenate([x, y])})
    far = pd.DataFrame({"k": ["far"] * 6 + ["short"] * 3, "g": [0, 0, 0, 1, 1, 1, 0, 1, 1], "v": [1.0, 2, 3, 101, 102, 103, 1, 2, 3]})
    df = spark.createDataFrame(pd.concat([pdf, far]), "k string, g int, v double").repartition(5)
    d = lambda a, b: np.abs(a[:, None] - b[None, :]).mean()
    p = {}
    for size in (8192, 50):  # one slice, then several
        monkeypatch.setattr(S, "SLICE", size)
        e = {r.k: r for r in S.energy_distance_agg(df, "v", "g", ["k"], {"n_permutations": 300}).collect()}
        t = {r.k: r for r in S.permutation_t_test_agg(df, "v", "g", ["k"], {"n_permutations": 300}).collect()}
        assert set(e) == set(t) == {None, "far"}
        assert e[None].statistic == pytest.approx(2 * d(x, y) - d(x, x) - d(y, y)) and (e[None].n1, e[None].n2) == (150, 250)
        pooled = (x.var() * 150 + y.var() * 250) / 398
        assert t[None].statistic == pytest.approx((x.mean() - y.mean()) / np.sqrt(pooled * (1 / 150 + 1 / 250)))
        assert 0.02 < e["far"].p_value < 0.25 and 0.02 < t["far"].p_value < 0.25  # 2 of the 20 splits are as far out
        p[size] = e[None].p_value, t[None].p_value
    assert p[50] == pytest.approx(p[8192], abs=0.12)
    assert S.energy_distance_agg(df.where("v > 1e9"), "v", "g").count() == 0


def test_permutation_p_is_between(spark):
    df = frame(spark, v=[1.0, 2, 3, 10, 11, 12], g=[0, 0, 0, 1, 1, 1])
    row = S.permutation_t_test_agg(df, "v", "g", opts={"permutations": 199}).first()
    assert 0 < row.p_value < 0.3 and row.n1 == 3
    # groups other than 0 are one group
    many = frame(spark, v=[1.0, 2, 3, 10, 11, 12], g=[0, 0, 0, 1, 2, 3])
    assert S.permutation_t_test_agg(many, "v", "g", opts={"permutations": 9}).first().n2 == 3


def test_categorical_tables(spark):
    rows = [(0, 0)] * 10 + [(0, 1)] * 5 + [(1, 0)] * 3 + [(1, 1)] * 12
    df = spark.createDataFrame(rows, "a int, b int")
    n, det = 30, 10 * 12 - 5 * 3
    chi2 = n * det**2 / (15 * 15 * 13 * 17)
    assert H.chisq_test_agg(df, "a", "b").first().statistic == pytest.approx(chi2)
    assert H.phi_coefficient_agg(df, "a", "b").first().phi == pytest.approx(np.sqrt(chi2 / n))
    assert H.fisher_exact_agg(df, "a", "b").first().p_value == pytest.approx(0.02534, abs=2e-3)
    gap = spark.createDataFrame([(0, 0), (0, 2), (2, 0), (2, 2)], "a int, b int")
    assert np.isnan(H.chisq_test_agg(gap, "a", "b").first().statistic)


def test_binomial_interval(spark):
    row = H.binom_test_agg(spark.createDataFrame([(1,)] * 7 + [(0,)] * 3, "v int"), "v").first()
    assert row.p_value == pytest.approx(0.34375) and row.ci_lower == pytest.approx(0.3475, abs=1e-3) and row.ci_upper == pytest.approx(0.9333, abs=1e-3)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "g string, v double, k int")
    for f in (H.jarque_bera_agg, H.shapiro_wilk_agg, H.dagostino_k2_agg):
        assert f(e, "v", ["g"]).count() == 0
    for f in (H.t_test_agg, H.yuen_agg, H.one_way_anova_agg, H.kruskal_wallis_agg, H.mann_whitney_u_agg):
        assert f(e, "v", "k", ["g"]).count() == 0
