import numpy as np
import pandas as pd
import pytest

from quillstat.operators import resampling as S


def groups(rng, sizes, extra=0):
    return pd.concat([pd.DataFrame({"k": f"k{i}", "g": (rng.random(n) < 0.5).astype(int), "x": rng.integers(1, 9, n).astype(float), "v": rng.normal(size=n)}) for i, n in enumerate(sizes)], ignore_index=True)


def centred(v):
    d = np.abs(v[:, None] - v)
    return d - d.mean(axis=0) - d.mean(axis=1)[:, None] + d.mean()


def test_many_small_groups_share_relabellings(spark, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 5)
    rng = np.random.default_rng(5)
    pdf = groups(rng, [3, 4, 4, 4, 12, 12, 12, 12, 12, 40, 40, 41, 60])
    df = spark.createDataFrame(pdf).repartition(5)
    dcor = {r.k: r for r in S.distance_cor_agg(df, "x", "v", ["k"], {"n_permutations": 400}).collect()}
    mmd = {r.k: r for r in S.mmd_agg(df, "v", "g", ["k"], {"n_permutations": 400}).collect()}
    t = {r.k: r for r in S.permutation_t_test_agg(df, "v", "g", ["k"], {"n_permutations": 400}).collect()}
    energy = {r.k: r for r in S.energy_distance_agg(df, "v", "g", ["k"], {"n_permutations": 400}).collect()}
    d = lambda a, b: np.abs(a[:, None] - b).mean()
    for k, part in pdf.groupby("k"):
        x, v, f = part.x.to_numpy(), part.v.to_numpy(), part.g.to_numpy() == 0
        assert (k in dcor) == (len(x) >= 4)
        if len(x) >= 4:
            a, b = centred(x), centred(v)
            cov = (a * b).mean()
            drawn = [(a * b[np.ix_(p, p)]).mean() for p in (rng.permutation(len(x)) for _ in range(400))]
            assert dcor[k].dcor == pytest.approx(np.sqrt(max(cov, 0) / np.sqrt((a * a).mean() * (b * b).mean())) if (a * a).mean() else 0) and dcor[k].n == len(x)
            assert dcor[k].p_value == pytest.approx((np.sum(np.array(drawn) >= cov - 1e-12) + 1) / 401, abs=0.12)
        tests = min(f.sum(), (~f).sum()) >= 2
        assert (k in mmd) == (k in t) == (k in energy) == tests
        if tests:
            far = np.abs(v[:, None] - v)
            w = np.where(f, 1 / f.sum(), -1 / (~f).sum())
            kernel = np.exp(-(far**2) / (2 * np.median(far[np.triu_indices(len(v), 1)]) ** 2))
            assert mmd[k].statistic == pytest.approx(w @ kernel @ w, abs=1e-12)
            drawn = [w[p] @ kernel @ w[p] for p in (rng.permutation(len(v)) for _ in range(400))]
            assert mmd[k].p_value == pytest.approx((np.sum(np.array(drawn) >= w @ kernel @ w - 1e-12) + 1) / 401, abs=0.12)
            assert energy[k].statistic == pytest.approx(2 * d(v[f], v[~f]) - d(v[f], v[f]) - d(v[~f], v[~f]))
            pooled = (v[f].var() * f.sum() + v[~f].var() * (~f).sum()) / (len(v) - 2)
            assert t[k].statistic == pytest.approx((v[f].mean() - v[~f].mean()) / np.sqrt(pooled * (1 / f.sum() + 1 / (~f).sum())))
            assert (t[k].n1, t[k].n2) == (f.sum(), (~f).sum())


def test_sums_along_the_order_are_those_of_all_pairs(monkeypatch):
    rng = np.random.default_rng(6)
    from types import SimpleNamespace

    for n in (5, 64, 200):
        x, y = rng.integers(0, 20, n).astype(float), rng.integers(0, 30, n).astype(float)
        a, b = centred(x), centred(y)
        r, statistic, p, m, _ = S._distance_test(x, y, SimpleNamespace(random_state=1, n_permutations=20))
        assert r == pytest.approx(np.sqrt(max((a * b).mean(), 0) / np.sqrt((a * a).mean() * (b * b).mean())), abs=1e-9)
        assert statistic == pytest.approx(n * (a * b).mean(), abs=1e-8) and 0 < p <= 1 and m == n
    v = np.sort(np.concatenate([rng.normal(size=2000), rng.integers(0, 3, 1000)]))
    far = (v[None] - v[:, None])[np.triu_indices(len(v), 1)]
    assert S._median_distance(v) == pytest.approx(np.median(far), rel=1e-12)
    f = S._gaussian_factor(v, 0.7)
    assert np.abs(f @ f.T - np.exp(-((v[:, None] - v) ** 2) / (2 * 0.49))).max() < 1e-12 and f.shape[1] < 60


def test_large_group_without_its_square(spark):
    """The squares of these groups, 40,000 x 40,000 numbers, fit no task."""
    df = spark.range(40_000, numPartitions=4).selectExpr("double(id % 997) AS x", "double((id * 7919) % 10007) AS v", "id % 2 AS g")
    o = {"n_permutations": 3}
    assert S.mmd_agg(df, "v", "g", opts=o).first().n1 == 20_000
    assert S.distance_cor_agg(df, "x", "v", opts=o).first().n == 40_000
