"""Names for Spark SQL: array-in functions and small scalars.

``SELECT ols_fit(collect_list(y), array(collect_list(a), collect_list(b))) FROM t GROUP BY g``
is the SQL form of a grouped fit.  It gathers a group in one row, which is
inherent to the array form: groups too large for that take the DataFrame
functions, whose aggregates are mergeable.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quillstat.functions import dist
from quillstat.functions import options as opt
from quillstat.operators import diagnostics, linear, robust
from quillstat.plans import solve

SCALAR = ("ols_fit", "ridge_fit", "elasticnet_fit", "wls_fit", "rls_fit", "huber_fit", "ransac_fit", "theilsen_fit")


def _moments(y: np.ndarray, x: np.ndarray, w: np.ndarray | None) -> pd.DataFrame:
    """Moments of one pair of arrays; x has one row per feature."""
    ok = np.isfinite(y) & np.isfinite(x).all(axis=0)
    if w is not None:
        ok &= w > 0
    y, x = y[ok], x[:, ok]
    w = np.ones(len(y)) if w is None else w[ok]
    sw = w.sum()
    if not len(y):
        raise ValueError("no valid rows")
    my, mx = (w * y).sum() / sw, (x * w).sum(axis=1) / sw
    dy, dx = y - my, x - mx[:, None]
    sxx = (dx * w) @ dx.T
    return pd.DataFrame({"n": [float(len(y))], "sw": [sw], "ybar": [my], "xbar": [mx], "syy": [(w * dy * dy).sum()], "sxy": [(dx * w) @ dy], "sxx": [sxx[np.triu_indices(len(x))]], "xmin": [x.min(axis=1)], "xmax": [x.max(axis=1)]})


def fit_arrays(kind: str, y, x, w=None, options: dict | None = None) -> dict:
    """A fit of arrays, as the array-in functions give it; too few rows raise."""
    o = linear._options(kind, options)
    y, x = np.asarray(y, float), np.asarray([np.asarray(c, float) for c in x])
    if x.ndim != 2 or x.shape[1] != len(y):
        raise ValueError("features and response differ in length")
    s, fit = linear.solve_moments(kind, _moments(y, x, None if w is None else np.asarray(w, float)), o)
    if linear._failed(s, fit)[0]:
        raise ValueError("too few rows for the features")
    out = {k: fit[k][0] for k in ("coefficients", "intercept", "r_squared", "adj_r_squared", "residual_std_error")}
    out |= {"n_observations": int(s.n[0]), "n_features": s.p}
    if o.compute_inference and kind in ("ols", "ridge", "wls"):
        out |= {k: v[0] for k, v in solve.inference(s, fit, float(o.confidence_level)).items()}
    return out


def _robust_arrays(kind: str, y, x, options: dict | None) -> dict:
    o = opt.read(options, **{"huber": robust.HUBER, "ransac": robust.RANSAC, "theilsen": robust.THEILSEN}[kind])
    y, x = np.asarray(y, float), np.asarray([np.asarray(c, float) for c in x])
    ok = np.isfinite(y) & np.isfinite(x).all(axis=0)
    z, y = (np.column_stack([np.ones(ok.sum()), x[:, ok].T]) if o.fit_intercept else x[:, ok].T), y[ok]
    if kind == "ransac":
        b = robust.ransac_kernel(z, y, o)[0]
    elif kind == "theilsen":
        b = robust.theilsen_kernel(z, y, o)
    else:
        b = np.linalg.lstsq(z, y, rcond=None)[0]
        for _ in range(int(o.max_iterations)):
            e = np.abs(y - z @ b)
            s = max(np.median(e) / 0.6744897501960817, 1e-12)
            w = np.where(e <= o.epsilon * s, 1.0, o.epsilon * s / np.maximum(e, 1e-300))
            new = np.linalg.lstsq((z.T * w) @ z, (z.T * w) @ y, rcond=None)[0]
            done = np.abs(new - b).max() < float(o.tolerance)
            b = new
            if done:
                break
    k = int(o.fit_intercept)
    rss, sst = ((y - z @ b) ** 2).sum(), ((y - y.mean()) ** 2).sum()
    df = len(y) - z.shape[1]
    r2 = 1 - rss / sst if sst > 0 else 0.0
    return {"coefficients": b[k:], "intercept": b[0] if k else np.nan, "r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (len(y) - 1) / df if df > 0 else np.nan, "residual_std_error": np.sqrt(rss / df) if df > 0 else np.nan, "n_observations": len(y), "n_features": z.shape[1] - k}


def array_function(name: str):
    """The array-in function of a name: (y, x[, weights][, options as a JSON string])."""
    kind, schema = name.removesuffix("_fit"), linear.FIT + ", " + linear.INFERENCE
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def rows(cols) -> pd.DataFrame:
        out = []
        for row in zip(*cols, strict=True):
            args = list(row)
            o = json.loads(args.pop()) if isinstance(args[-1], str) else {}
            if any(a is None for a in args):
                out.append(dict.fromkeys(names))
                continue
            got = _robust_arrays(kind, args[0], args[1], o) if kind in ("huber", "ransac", "theilsen") else fit_arrays(kind, args[0], args[1], args[2] if kind == "wls" else None, o)
            out.append({c: got.get(c) for c in names})
        return pd.DataFrame(out, columns=names)

    def f(a: pd.Series, b: pd.Series, c: pd.Series = None, d: pd.Series = None) -> pd.DataFrame:
        return rows([v for v in (a, b, c, d) if v is not None])

    def two(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return rows([a, b])

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return rows([a, b, c])

    return F.pandas_udf(three if kind == "wls" else two, schema), F.pandas_udf(three, schema)


def _vif(x) -> list[float] | None:
    x = np.asarray([np.asarray(c, float) for c in x])
    x = x[:, np.isfinite(x).all(axis=0)]
    if len(x) < 2 or x.shape[1] < 3:
        return None
    d = x - x.mean(axis=1, keepdims=True)
    return diagnostics.inflation(d @ d.T)


def _residuals(y, y_hat, x) -> dict:
    """raw and leverage of the pairs without a missing value; standardised forms need a standard error and stay null."""
    y, y_hat, x = np.asarray(y, float), np.asarray(y_hat, float), np.asarray([np.asarray(c, float) for c in x])
    ok = np.isfinite(y) & np.isfinite(y_hat) & np.isfinite(x).all(axis=0)
    if ok.sum() < 3:
        return {}
    d = x[:, ok] - x[:, ok].mean(axis=1, keepdims=True)
    inv, good = solve.sweep((d @ d.T)[None])
    lever = 1 / ok.sum() + np.einsum("ir,ij,jr->r", d, inv[0], d) if good.all() else None
    return {"raw": y[ok] - y_hat[ok], "leverage": lever}


def _row_function(f, schema: str):
    names = [c.strip().split(" ")[0] for c in schema.split(", ")] if " " in schema else None  # a struct

    def rows(cols):
        got = [None if any(a is None for a in args) else f(*args) for args in zip(*cols, strict=True)]
        return pd.Series(got) if names is None else pd.DataFrame([{c: (g or {}).get(c) for c in names} for g in got], columns=names)

    def one(a: pd.Series) -> pd.Series:
        return rows([a])

    def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.DataFrame:
        return rows([a, b, c])

    return F.pandas_udf(one if names is None else three, schema)


#: SQL bodies of scalars that need no Python.
SQL_BODIES = {
    "aic": "(rss DOUBLE, n BIGINT, k BIGINT) RETURNS DOUBLE RETURN CASE WHEN n <= 0 OR rss < 0 THEN raise_error('n must be positive and rss not negative') WHEN rss = 0 THEN double('-infinity') ELSE n * ln(rss / n) + 2 * k END",
    "bic": "(rss DOUBLE, n BIGINT, k BIGINT) RETURNS DOUBLE RETURN CASE WHEN n <= 0 OR rss < 0 THEN raise_error('n must be positive and rss not negative') WHEN rss = 0 THEN double('-infinity') ELSE n * ln(rss / n) + k * ln(n) END",
    "predict": "(x ARRAY<ARRAY<DOUBLE>>, coefficients ARRAY<DOUBLE>, intercept DOUBLE) RETURNS ARRAY<DOUBLE> RETURN transform(CASE WHEN size(x[0]) > 0 THEN sequence(0, size(x[0]) - 1) ELSE array() END, i -> aggregate(zip_with(x, coefficients, (c, b) -> c[i] * nanvl(b, 0D)), coalesce(nanvl(intercept, 0D), 0D), (s, v) -> s + v))",
    "jarque_bera_moments": "(v ARRAY<DOUBLE>, m DOUBLE) RETURNS STRUCT<n: BIGINT, m2: DOUBLE, m3: DOUBLE, m4: DOUBLE> RETURN named_struct('n', CAST(size(v) AS BIGINT), 'm2', aggregate(v, 0D, (s, x) -> s + power(x - m, 2)) / size(v), 'm3', aggregate(v, 0D, (s, x) -> s + power(x - m, 3)) / size(v), 'm4', aggregate(v, 0D, (s, x) -> s + power(x - m, 4)) / size(v))",
    "jarque_bera_of": "(q STRUCT<n: BIGINT, m2: DOUBLE, m3: DOUBLE, m4: DOUBLE>) RETURNS STRUCT<statistic: DOUBLE, p_value: DOUBLE, skewness: DOUBLE, kurtosis: DOUBLE, n: BIGINT> RETURN CASE WHEN q.n >= 3 AND q.m2 > 0 THEN named_struct('statistic', q.n / 6 * (power(q.m3 / power(q.m2, 1.5), 2) + power(q.m4 / power(q.m2, 2) - 3, 2) / 4), 'p_value', exp(-q.n / 12 * (power(q.m3 / power(q.m2, 1.5), 2) + power(q.m4 / power(q.m2, 2) - 3, 2) / 4)), 'skewness', q.m3 / power(q.m2, 1.5), 'kurtosis', q.m4 / power(q.m2, 2) - 3, 'n', q.n) END",
    "jarque_bera": "(v ARRAY<DOUBLE>) RETURNS STRUCT<statistic: DOUBLE, p_value: DOUBLE, skewness: DOUBLE, kurtosis: DOUBLE, n: BIGINT> RETURN jarque_bera_of(jarque_bera_moments(filter(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')), aggregate(filter(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')), 0D, (s, x) -> s + x) / nullif(size(filter(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))), 0)))",
    "aft_cdf": "(t DOUBLE, eta DOUBLE, scale DOUBLE, dist STRING) RETURNS DOUBLE RETURN CASE WHEN t IS NULL OR eta IS NULL OR scale IS NULL THEN NULL WHEN t <= 0 THEN 0D WHEN dist = 'exponential' THEN 1 - exp(-exp(ln(t) - eta)) WHEN dist = 'weibull' THEN 1 - exp(-exp((ln(t) - eta) / scale)) WHEN dist = 'loglogistic' THEN 1 / (1 + exp(-(ln(t) - eta) / scale)) WHEN dist = 'lognormal' THEN norm_cdf((ln(t) - eta) / scale) ELSE raise_error('unknown distribution') END",
    "aft_quantile": "(p DOUBLE, eta DOUBLE, scale DOUBLE, dist STRING) RETURNS DOUBLE RETURN CASE WHEN p IS NULL OR eta IS NULL OR scale IS NULL THEN NULL WHEN dist = 'exponential' THEN exp(eta + ln(-ln(1 - p))) WHEN dist = 'weibull' THEN exp(eta + scale * ln(-ln(1 - p))) WHEN dist = 'loglogistic' THEN exp(eta + scale * ln(p / (1 - p))) WHEN dist = 'lognormal' THEN exp(eta + scale * norm_ppf(p)) ELSE raise_error('unknown distribution') END",
}


def _normal(f):
    def values(a: pd.Series) -> pd.Series:
        return pd.Series(f(a.to_numpy(float, na_value=np.nan)))

    return F.pandas_udf(values, "double")


def register(spark: SparkSession) -> list[str]:
    """Registers the SQL names; NAME_with takes options as a JSON string behind its other arguments."""
    done = []
    for name in SCALAR:
        plain, with_options = array_function(name)
        spark.udf.register(name, plain)
        done.append(name)
        if name != "wls_fit":
            spark.udf.register(f"{name}_with", with_options)
            done.append(f"{name}_with")
    for name, f in {
        "vif": _row_function(_vif, "array<double>"),
        "residuals_diagnostics": _row_function(_residuals, "raw array<double>, standardized array<double>, studentized array<double>, leverage array<double>"),
        "norm_cdf": _normal(dist.norm_cdf),
        "norm_ppf": _normal(dist.norm_ppf),
    }.items():
        spark.udf.register(name, f)
        done.append(name)
    for name, body in SQL_BODIES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
        done.append(name)
    return done
