"""Generalised linear models, survival models and robust fits by distributed Newton rounds."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions import dist, options
from quillstat.functions.columns import norm_cdf
from quillstat.operators.linear import predicted, training
from quillstat.plans.moments import double, join_groups, nan_kept, usable
from quillstat.plans.newton import linear_predictor, newton, parameter
from quillstat.sources.tables import settled_groups


def lgamma(c: Column) -> Column:
    def run(a: pd.Series) -> pd.Series:
        return pd.Series(dist.lgamma(a.to_numpy(float, na_value=np.nan)))

    return F.pandas_udf(run, "double")(c)


@dataclass
class Family:
    """Inverse link and its slope in eta, variance, unit deviance and log likelihood of a row."""

    mean: Callable[[Column], Column]
    slope: Callable[[Column, Column], Column]
    variance: Callable[[Column], Column]
    deviance: Callable[[Column, Column], Column]
    loglik: Callable[[Column, Column, Column], Column]
    link: Callable[[Column], Column]
    check: str
    dispersion: str = "fixed"
    nuisance: int = 0


def _xlogy(y: Column, r: Column) -> Column:
    return F.when(y > 0, y * F.log(r)).otherwise(0.0)


def _clip(eta: Column, a: float = 30.0) -> Column:
    return F.greatest(F.lit(-a), F.least(F.lit(a), eta))


def _poisson(link: str) -> Family:
    mean, slope, of = {
        "log": (lambda e: F.exp(_clip(e)), lambda e, m: m, lambda m: F.log(m)),
        "identity": (lambda e: F.greatest(e, F.lit(1e-8)), lambda e, m: F.lit(1.0), lambda m: m),
        "sqrt": (lambda e: F.greatest(e * e, F.lit(1e-8)), lambda e, m: 2 * e, lambda m: F.sqrt(m)),
    }[link]
    return Family(mean, slope, lambda m: m, lambda y, m: 2 * (_xlogy(y, y / m) - (y - m)), lambda y, m, d: y * F.log(m) - m - lgamma(y + 1), of, "y >= 0", "pearson_floor")


def _binomial(link: str) -> Family:
    clip = lambda m: F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), m))
    mean, slope, of = {
        "logit": (lambda e: clip(1 / (1 + F.exp(-_clip(e)))), lambda e, m: m * (1 - m), lambda m: F.log(m / (1 - m))),
        "probit": (lambda e: clip(norm_cdf(_clip(e, 8.0))), lambda e, m: F.exp(-e * e / 2) / math.sqrt(2 * math.pi), lambda m: (m - 0.5) * 2.5),
        "cloglog": (lambda e: clip(1 - F.exp(-F.exp(_clip(e, 20.0)))), lambda e, m: F.exp(_clip(e, 20.0) - F.exp(_clip(e, 20.0))), lambda m: F.log(-F.log(1 - m))),
    }[link]
    dev = lambda y, m: 2 * (_xlogy(y, y / m) + _xlogy(1 - y, (1 - y) / (1 - m)))
    return Family(mean, slope, lambda m: m * (1 - m), dev, lambda y, m, d: y * F.log(m) + (1 - y) * F.log(1 - m), of, "y >= 0 AND y <= 1")


_EXP = dict(mean=lambda e: F.exp(_clip(e)), slope=lambda e, m: m, link=lambda m: F.log(m))


def _gamma() -> Family:
    return Family(
        variance=lambda m: m * m,
        deviance=lambda y, m: 2 * (-F.log(y / m) + (y - m) / m),
        loglik=lambda y, m, d: F.log(y / (m * d)) / d - y / (m * d) - F.log(y) - lgamma(1 / d),
        check="y > 0", dispersion="pearson", nuisance=1, **_EXP,
    )


def _tweedie(power: float) -> Family:
    if not 1 <= power <= 2:
        raise ValueError("option tweedie_power must lie between 1 and 2")
    if power == 1:
        return _poisson("log")
    if power == 2:
        return _gamma()
    dev = lambda y, m: 2 * (F.when(y > 0, F.pow(y, 2 - power) / ((1 - power) * (2 - power))).otherwise(0.0) - y * F.pow(m, 1 - power) / (1 - power) + F.pow(m, 2 - power) / (2 - power))
    # saddle-point density: exact at y = 0, close elsewhere
    ll = lambda y, m, d: F.when(y > 0, -dev(y, m) / (2 * d) - 0.5 * F.log(2 * math.pi * d * F.pow(y, power))).otherwise(-F.pow(m, 2 - power) / (d * (2 - power)))
    return Family(variance=lambda m: F.pow(m, power), deviance=dev, loglik=ll, check="y >= 0", dispersion="pearson", nuisance=1, **_EXP)


def _negbinom() -> Family:
    t = F.col("__nb")
    dev = lambda y, m: 2 * (_xlogy(y, y / m) - (y + t) * F.log((y + t) / (m + t)))
    ll = lambda y, m, d: lgamma(y + t) - lgamma(t) - lgamma(y + 1) + t * F.log(t / (t + m)) + _xlogy(y, m / (t + m))
    return Family(variance=lambda m: m + m * m / t, deviance=dev, loglik=ll, check="y >= 0", dispersion="theta", nuisance=1, **_EXP)


COMMON = dict(fit_intercept=True, compute_inference=False, confidence_level=0.95, max_iterations=100, tolerance=1e-8, glm_lambda=0.0, offset_column=None, prior=None, vcov="laplace", feature_names=None, null_policy="drop")
DEFAULTS = {
    "poisson": COMMON | dict(poisson_link="log"),
    "binomial": COMMON | dict(binomial_link="logit"),
    "logistic": COMMON | dict(threshold=0.5),
    "negbinom": COMMON | dict(nb_theta=None),
    "tweedie": COMMON | dict(tweedie_power=1.5),
    "gamma": COMMON,
}
WALD = "coefficients array<double>, std_errors array<double>, z_values array<double>, p_values array<double>, ci_lower array<double>, ci_upper array<double>"
FIT = "coefficients, intercept, deviance, null_deviance, pseudo_r_squared, aic, dispersion, n_observations, n_features, iterations, converged"


def _family(kind: str, o) -> Family:
    if kind == "poisson":
        return _poisson(o.poisson_link)
    if kind == "tweedie":
        return _tweedie(float(o.tweedie_power))
    return {"binomial": lambda: _binomial(o.binomial_link), "logistic": lambda: _binomial("logit"), "gamma": _gamma, "negbinom": _negbinom}[kind]()


@dataclass
class Penalty:
    """Weights of squared and absolute distances of coefficients from their location, as priors and glm_lambda ask for."""

    ridge: list[float]
    l1: list[float]
    location: list[float]


def _penalty(o, x: list[str]) -> Penalty:
    """glm_lambda on every feature; a prior by feature name, or that of ``_default``: {dist: normal or laplace, loc, scale}.

    A normal prior weighs squared distances by 1 / scale**2, a Laplace prior
    absolute ones by 1 / scale.
    """
    if str(o.vcov) not in ("laplace", "naive", "sandwich"):
        raise ValueError(f"Unknown vcov type '{o.vcov}'")
    out = Penalty([], [], [])
    names = list(o.feature_names or x)
    unknown = set(o.prior or {}) - set(names) - {"_default"}
    if unknown:
        raise ValueError(f"priors for unknown features: {sorted(unknown)}")
    for name in names[: len(x)]:
        prior = (o.prior or {}).get(name, (o.prior or {}).get("_default"))
        ridge, l1, loc = float(getattr(o, "glm_lambda", 0.0)), 0.0, 0.0
        if prior:
            dist_, scale, loc = str(prior.get("dist", "normal")).lower(), float(prior["scale"]), float(prior.get("loc", 0.0))
            if dist_ not in ("normal", "laplace") or not scale > 0:
                raise ValueError("a prior is normal or laplace with a positive scale")
            if ridge and loc:
                raise ValueError("glm_lambda and a prior with a location can't be combined")
            ridge, l1 = (ridge + 1 / scale**2, 0.0) if dist_ == "normal" else (ridge, 1 / scale)
        out.ridge.append(ridge)
        out.l1.append(l1)
        out.location.append(loc)
    return out


def _prepared(df: DataFrame, y: str, x: list[str], by: list[str], check: str) -> DataFrame:
    rows = usable(df, [y, *x]).select(*by, double(y).alias("__y"), *[double(c).alias(f"__x{i}") for i, c in enumerate(x)])
    ok = F.expr(check.replace("y", "__y"))
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit(f"the response must satisfy {check}")).cast("boolean")))


def _start(rows: DataFrame, by: list[str], p: int, intercept: bool, at: Callable[[Column], Column], keep: list[Column] = ()) -> DataFrame:
    per = rows.groupBy(*by).agg(F.avg("__y").alias("__mean"), F.count(F.lit(1)).alias("__count"), *keep)
    first = [at(F.greatest(F.col("__mean"), F.lit(1e-6)))] if intercept else []
    return per.withColumn("__theta", F.array(*[c.cast("double") for c in first], *[F.lit(0.0)] * p))


def _constant(rows: DataFrame, by: list[str], xs: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.array(*[(F.max(c) - F.min(c)) < 1e-10 for c in xs]).alias("__const"))


def glm_fit_agg(df: DataFrame, kind: str, y: str, x: list[str], by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """One row per group: coefficients, deviances, information criterion and, on request, Wald inference.

    Rows with a missing or infinite value are left out.  ``offset_column`` (1-based)
    names a feature that enters with coefficient 1.  Features that are constant
    within a group get a NaN coefficient beside an intercept.
    """
    o, by = options.read(opts, **DEFAULTS[kind]), list(by)
    if kind == "negbinom" and o.nb_theta is None:
        theta = None
    else:
        theta = getattr(o, "nb_theta", None)
    fam = _family(kind, o)
    rows = _prepared(df, y, x, by, fam.check)
    xs = [f"__x{i}" for i in range(len(x))]
    offset = None
    if o.offset_column:
        offset = xs.pop(int(o.offset_column) - 1)
        x = [c for i, c in enumerate(x) if i != int(o.offset_column) - 1]
    p, k = len(xs), int(o.fit_intercept)
    pen = _penalty(o, x)
    prior = dict(ridge=pen.ridge, l1=pen.l1, location=pen.location)
    if kind == "negbinom":
        rows = rows.withColumn("__nb", F.lit(float(theta or 1.0)))
    const = settled_groups(_constant(rows, by, xs)) if xs else None
    if k and xs:  # a constant feature stands beside the intercept: it is taken out as zeros
        rows = join_groups(rows, const, by).withColumns({c: F.when(F.get("__const", F.lit(i)), 0.0).otherwise(F.col(c)) for i, c in enumerate(xs)}).drop("__const")

    def derive(eta: Column) -> dict[str, Column]:
        m = fam.mean(eta)
        d, v = fam.slope(eta, m), fam.variance(m)
        return {"g": (F.col("__y") - m) * d / v, "w": d * d / v}

    start = settled_groups(_start(rows, by, p, bool(k), fam.link))
    fit = newton(rows, by, xs, bool(k), start, derive, **prior, offset=offset, iterations=int(o.max_iterations), tolerance=float(o.tolerance))
    if kind == "negbinom" and theta is None:  # theta by moments, in turn with the coefficients
        for _ in range(5):
            j = join_groups(rows.drop("__nb"), fit.select(*by, "__theta"), by)
            m = fam.mean(linear_predictor(xs, bool(k), offset))
            r = F.sum(m * m) / F.greatest(F.lit(1e-9), F.sum((F.col("__y") - m) ** 2 - m))
            per = settled_groups(j.groupBy(*by).agg(F.greatest(F.lit(1e-6), F.least(F.lit(1e6), r)).alias("__nb")))
            rows = join_groups(rows.drop("__nb"), per, by)
            fit = newton(rows, by, xs, bool(k), fit.select(*by, "__theta"), derive, **prior, offset=offset, iterations=2, tolerance=float(o.tolerance))
    j = join_groups(join_groups(rows, fit, by), start.select(*by, "__mean"), by)
    mu = fam.mean(linear_predictor(xs, bool(k), offset))
    null = F.col("__mean") if k else fam.mean(F.lit(0.0))
    j = j.withColumns({"__mu": mu, "__null": null})
    v = fam.variance(F.col("__mu"))
    # with an offset the null model is the mean rate
    aggs = [
        F.sum(fam.deviance(F.col("__y"), F.col("__mu"))).alias("deviance"), F.sum(fam.deviance(F.col("__y"), F.col("__null"))).alias("null_deviance"),
        F.sum((F.col("__y") - F.col("__mu")) ** 2 / v).alias("pearson"), F.count(F.lit(1)).alias("n"),
    ]
    if kind == "negbinom":
        aggs.append(F.first("__nb").alias("nb"))
    if kind == "logistic":
        aggs.append(F.avg(((F.col("__mu") >= float(o.threshold)) == (F.col("__y") >= 0.5)).cast("double")).alias("accuracy"))
    found = fit.select(*by, F.col("__theta").alias("t"), F.col("__iterations").alias("iterations"), F.col("__converged").alias("converged"), F.col("__information").alias("info"))
    per = settled_groups(join_groups(j.groupBy(*by).agg(*aggs), found, by))
    df_res = F.greatest(F.lit(1.0), F.col("n") - (p + k))
    pearson = F.col("pearson") / df_res
    per = per.withColumn("dispersion", {"fixed": F.lit(1.0), "pearson": pearson, "pearson_floor": F.greatest(F.lit(1.0), pearson), "theta": F.col("nb") if kind == "negbinom" else F.lit(1.0)}[fam.dispersion])
    ll = join_groups(j, per.select(*by, "dispersion"), by).groupBy(*by).agg(F.sum(fam.loglik(F.col("__y"), F.col("__mu"), F.col("dispersion"))).alias("ll"))
    per = join_groups(per, ll, by)
    if xs:
        per = join_groups(per, const, by)
    scale = 1.0 if fam.dispersion in ("fixed", "theta") else None
    udf = F.pandas_udf(_wald(p, k, float(o.confidence_level), scale, pen, o.vcov), WALD)
    per = per.withColumn("r", udf("t", "info", "dispersion", F.col("__const") if xs else F.array().cast("array<boolean>"))).withColumn("r", nan_kept("r", WALD))
    extra = [F.col("accuracy"), F.lit(float(o.threshold)).alias("threshold")] if kind == "logistic" else []
    out = [
        F.col("r.coefficients").alias("coefficients"), (F.get("t", F.lit(0)) if k else F.lit(float("nan"))).alias("intercept"), "deviance", "null_deviance",
        F.when(F.col("null_deviance") > 0, 1 - F.col("deviance") / F.col("null_deviance")).otherwise(0.0).alias("pseudo_r_squared"),
        (-2 * F.col("ll") + 2.0 * (p + k + fam.nuisance)).alias("aic"), *( [] if kind == "logistic" else ["dispersion"]), *extra, F.col("n").alias("n_observations"), F.lit(p).alias("n_features"), "iterations", "converged",
    ]
    if o.compute_inference:
        out += [F.col(f"r.{c}").alias(c) for c in ("std_errors", "z_values", "p_values", "ci_lower", "ci_upper")]
    return per.select(*by, *out)


def _wald(p: int, k: int, level: float, scale, pen: Penalty, vcov: str):
    """Wald inference from the curvature at the mode.

    ``laplace`` inverts the penalised information, ``naive`` that without the
    penalty, ``sandwich`` puts the latter between two of the former.  A
    coefficient that a Laplace prior holds at its location has no curvature and
    gets NaN.
    """
    z = float(dist.norm_ppf(np.array([0.5 + level / 2]))[0])

    def run(t: pd.Series, info: pd.Series, dispersion: pd.Series, const: pd.Series) -> pd.DataFrame:
        b = np.stack(t)[:, k : k + p]
        a = np.stack(info)
        size = int(round(a.shape[1] ** 0.5))
        a = a.reshape(-1, size, size)
        bare = a.copy()
        at = np.arange(k, k + p)
        bare[:, at, at] -= np.asarray(pen.ridge, float)
        cov = np.linalg.pinv(bare if vcov == "naive" else a)
        if vcov == "sandwich":
            cov = cov @ bare @ cov
        if scale is None:
            cov = cov * dispersion.to_numpy(float)[:, None, None]
        se = np.sqrt(np.maximum(0, np.einsum("gii->gi", cov)))[:, k : k + p]
        out = np.stack([np.asarray(c, bool) for c in const]) if p and k else np.zeros_like(b, bool)
        held = (np.asarray(pen.l1, float) > 0) & (b == np.asarray(pen.location, float))
        b, se = np.where(out, np.nan, b), np.where(out | held, np.nan, se)
        with np.errstate(all="ignore"):
            zv = b / se
            pv = 2 * dist.norm_sf(np.abs(zv))
        return pd.DataFrame({"coefficients": list(b), "std_errors": list(se), "z_values": list(zv), "p_values": list(pv), "ci_lower": list(b - z * se), "ci_upper": list(b + z * se)})

    return run


def poisson_fit_predict_by(df: DataFrame, y: str, x: list[str], by: list[str] = (), split: str | None = None, opts: dict | None = None) -> DataFrame:
    """All rows with yhat, its interval by link, and is_training."""
    o, by = options.read(opts, **DEFAULTS["poisson"]), list(by)
    rows = df.withColumn("is_training", training(df, y, x, split, o.null_policy))
    fit = glm_fit_agg(rows.where("is_training"), "poisson", y, x, by, {k: v for k, v in (opts or {}).items() if k != "null_policy"})
    from quillstat.functions.columns import t_ppf

    fit = fit.withColumn("q", t_ppf(F.lit(0.5 + float(o.confidence_level) / 2), F.greatest(F.lit(1.0), F.col("n_observations") - len(x) - int(o.fit_intercept))))
    j = join_groups(rows, settled_groups(fit.select(*by, F.struct("coefficients", "intercept", "dispersion", "q").alias("__r"))), by)
    known = F.lit(True)
    for c in x:
        known = known & F.col(c).isNotNull()
    eta = F.when(known & F.col("__r").isNotNull(), predicted(x, "__r"))
    q, phi = F.col("__r.q"), F.col("__r.dispersion")
    if o.poisson_link == "log":
        yhat = F.exp(eta)
        half = q * F.sqrt(phi) / F.greatest(yhat, F.lit(0.001))
        low, high = F.exp(eta - half), F.exp(eta + half)
    elif o.poisson_link == "identity":
        yhat, half = eta, q * F.sqrt(phi * F.greatest(eta, F.lit(0.0)))
        low, high = eta - half, eta + half
    else:
        yhat, half = eta * eta, q * F.sqrt(phi / 4)
        low, high = F.greatest(F.lit(0.0), eta - half) ** 2, (eta + half) ** 2
    return j.select(*df.columns, yhat.alias("yhat"), F.greatest(F.lit(0.0), low).alias("yhat_lower"), high.alias("yhat_upper"), "is_training")


AFT = dict(aft_dist="weibull", fit_intercept=True, compute_inference=False, confidence_level=0.95, max_iterations=100, tolerance=1e-9, prior=None, vcov="laplace", feature_names=None)


def _aft_terms(name: str, z: Column, d: Column) -> tuple[Column, Column, Column]:
    """Log density or survival of the standardised time, its first derivative, and minus its second."""
    if name in ("weibull", "exponential"):
        e = F.exp(_clip(z, 50.0))
        return d * z - e, d - e, e
    if name == "loglogistic":
        s = 1 / (1 + F.exp(-_clip(z, 50.0)))
        soft = F.when(z > 30, z).otherwise(F.log1p(F.exp(_clip(z, 30.0))))
        return d * z - (1 + d) * soft, d - (1 + d) * s, (1 + d) * s * (1 - s)
    surv = F.greatest(norm_cdf(-z), F.lit(1e-300))
    h = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) / surv
    ll = F.when(d == 1, -z * z / 2 - 0.5 * math.log(2 * math.pi)).otherwise(F.log(surv))
    return ll, F.when(d == 1, -z).otherwise(-h), F.when(d == 1, F.lit(1.0)).otherwise(h * (h - z))


def aft_fit_agg(df: DataFrame, time: str, x: list[str], event: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Accelerated failure time: log time = eta + scale * error, right-censored where event is 0."""
    o, by = options.read(opts, **AFT), list(by)
    rows = usable(df, [time, *x, event])
    ok = (double(time) > 0) & double(event).isin(0.0, 1.0)
    rows = rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("times must be positive and events 0 or 1")).cast("boolean")))
    rows = rows.select(*by, F.log(double(time)).alias("__y"), double(event).alias("__d"), *[double(c).alias(f"__x{i}") for i, c in enumerate(x)])
    xs, k, p = [f"__x{i}" for i in range(len(x))], int(o.fit_intercept), len(x)
    fixed = o.aft_dist == "exponential"
    pen = _penalty(o, x)

    def run(names: list[str]) -> DataFrame:
        q = len(names) + k
        log_scale = parameter(q)

        def derive(eta: Column) -> dict[str, Column]:
            s = F.lit(1.0) if fixed else F.exp(_clip(log_scale, 10.0))
            z = (F.col("__y") - eta) / s
            _, f1, f2 = _aft_terms(o.aft_dist, z, F.col("__d"))
            out = {"g": -f1 / s, "w": f2 / (s * s)}
            if not fixed:
                # the scores vanish at the optimum, where this positive matrix is the exact curvature
                out |= {"g0": -f1 * z - F.col("__d"), "w0": f2 * z * z + F.col("__d"), "c0": f2 * z / s}
            return out

        per = rows.groupBy(*by).agg(F.avg("__y").alias("m"), F.coalesce(F.stddev_samp("__y"), F.lit(1.0)).alias("s"))
        first = ([F.col("m")] if k else []) + [F.lit(0.0)] * len(names) + ([] if fixed else [F.log(F.greatest(F.col("s"), F.lit(1e-3)))])
        start = settled_groups(per.select(*by, F.array(*first).alias("__theta")))
        fit = newton(rows, by, names, bool(k), start, derive, extra=0 if fixed else 1, iterations=int(o.max_iterations), tolerance=max(1e-9, float(o.tolerance)), most_step=20.0, **(dict(ridge=pen.ridge, l1=pen.l1, location=pen.location) if names else {}))
        j = join_groups(rows, fit, by)
        s = F.lit(1.0) if fixed else F.exp(log_scale)
        z = (F.col("__y") - linear_predictor(names, bool(k))) / s
        ll = _aft_terms(o.aft_dist, z, F.col("__d"))[0] - F.col("__d") * (F.log(s) + F.col("__y"))
        return settled_groups(join_groups(j.groupBy(*by).agg(F.sum(ll).alias("ll"), F.count(F.lit(1)).alias("n"), F.sum("__d").cast("long").alias("events")), fit, by))

    full, null = run(xs), run([])
    per = join_groups(full, null.select(*by, F.col("ll").alias("null_ll")), by).where("events > 0")
    q = p + k
    udf = F.pandas_udf(_wald(p, k, float(o.confidence_level), 1.0, pen, o.vcov), "coefficients array<double>, std_errors array<double>, z_values array<double>, p_values array<double>, ci_lower array<double>, ci_upper array<double>")
    none = F.array(*[F.lit(False)] * p) if p else F.array().cast("array<boolean>")
    per = per.withColumn("r", udf("__theta", "__information", F.lit(1.0), none)).withColumn("r", nan_kept("r", WALD))
    params = q + (0 if fixed else 1)
    out = [
        F.col("r.coefficients").alias("coefficients"), (F.get("__theta", F.lit(0)) if k else F.lit(float("nan"))).alias("intercept"), (F.lit(1.0) if fixed else F.exp(F.get("__theta", F.lit(q)))).alias("scale"),
        F.col("ll").alias("log_likelihood"), F.col("null_ll").alias("null_log_likelihood"), (-2 * F.col("ll") + 2.0 * params).alias("aic"), (-2 * F.col("ll") + params * F.log("n")).alias("bic"),
        F.col("n").alias("n_observations"), F.col("events").alias("n_events"), (F.col("n") - F.col("events")).alias("n_censored"), F.lit(p).alias("n_features"), F.col("__iterations").alias("iterations"), F.col("__converged").alias("converged"),
    ]
    if o.compute_inference:
        out += [F.col(f"r.{c}").alias(c) for c in ("std_errors", "z_values", "p_values", "ci_lower", "ci_upper")]
    return per.select(*by, *out)


def aft_cdf(t: Column, eta: Column, scale: Column, name: str) -> Column:
    """P(T <= t); 0 for t of 0 or less, null for any null."""
    z = (F.log(t) - eta) / (F.lit(1.0) if name == "exponential" else scale)
    f = {"weibull": 1 - F.exp(-F.exp(z)), "exponential": 1 - F.exp(-F.exp(z)), "loglogistic": 1 / (1 + F.exp(-z)), "lognormal": None}[name]
    known = t.isNotNull() & eta.isNotNull() & scale.isNotNull()
    return F.when(known, F.when(t <= 0, F.lit(0.0)).otherwise(norm_cdf(z) if f is None else f))


def aft_quantile(p: Column, eta: Column, scale: Column, name: str) -> Column:
    from quillstat.functions.columns import norm_ppf

    w = {"weibull": F.log(-F.log1p(-p)), "exponential": F.log(-F.log1p(-p)), "loglogistic": F.log(p / (1 - p)), "lognormal": None}[name]
    known = p.isNotNull() & eta.isNotNull() & scale.isNotNull()
    return F.when(known, F.exp(eta + (F.lit(1.0) if name == "exponential" else scale) * (norm_ppf(p) if w is None else w)))
