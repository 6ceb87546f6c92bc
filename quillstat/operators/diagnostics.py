"""Diagnostics, information criteria, shrinkage and demand classification."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import options
from quillstat.functions.columns import norm_cdf  # noqa: F401  (part of the surface)
from quillstat.plans.moments import double, finite, join_groups, moment_columns, usable
from quillstat.plans.newton import symmetric
from quillstat.plans.solve import sweep

NAN = float("nan")


def vif_agg(df: DataFrame, x: list[str], by: list[str] = ()) -> DataFrame:
    """Variance inflation factors: two features and three rows at least; +inf from an R squared of 0.9999."""
    rows = usable(df, x)
    m = rows.groupBy(*by).agg(*moment_columns(x[0], x)).where("n >= 3")
    p = len(x)

    def run(sxx: pd.Series) -> pd.Series:
        return pd.Series(list(_inflations(symmetric(sxx, p))))

    if p < 2:
        raise ValueError("vif needs two features")
    return m.select(*by, F.pandas_udf(run, "array<double>")("sxx").alias("vif"))


def _inflations(a: np.ndarray) -> np.ndarray:
    """The factors from moment matrices."""
    inv, ok = sweep(a)
    d = np.einsum("gii->gi", a)
    with np.errstate(all="ignore"):
        v = np.einsum("gii->gi", inv) * d
    v = np.where(ok & (1 - 1 / np.maximum(v, 1) < 0.9999), np.maximum(v, 1.0), np.inf)
    # a column that others explain fully makes those infinite, too
    return np.where((~ok).any(axis=1, keepdims=True) & (d > 0), np.inf, v)


def inflation(moments: np.ndarray) -> np.ndarray:
    return _inflations(moments[None])[0]


def residuals_diagnostics_agg(df: DataFrame, y: str, y_hat: str, x: list[str] | None = None, by: list[str] = ()) -> DataFrame:
    """Rows with raw residual and, with features, leverage; standardised forms stay null without a standard error.  Groups of fewer than three rows are left out."""
    by, x = list(by), list(x or [])
    rows = usable(df, [y, y_hat, *x])
    if x:
        m = rows.groupBy(*by).agg(*moment_columns(y, x)).where("n >= 3")
        p = len(x)

        def run(sxx: pd.Series) -> pd.Series:
            inv, ok = sweep(symmetric(sxx, p))
            return pd.Series([v.ravel() if o.all() else None for v, o in zip(inv, ok, strict=True)])

        m = m.select(*by, "n", "xbar", F.pandas_udf(run, "array<double>")("sxx").alias("inv"))
        j = join_groups(rows, m.select(*by, F.struct("n", "xbar", "inv").alias("__m")), by).where("__m IS NOT NULL")
        z = [double(c) - F.get("__m.xbar", F.lit(i)) for i, c in enumerate(x)]
        lever = 1 / F.col("__m.n")
        for i in range(p):
            for k in range(p):
                lever = lever + z[i] * z[k] * F.get("__m.inv", F.lit(i * p + k))
        j = j.withColumn("leverage", lever)
    else:
        m = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n >= 3")
        j = join_groups(rows, m.select(*by, F.col("n").alias("__m")), by).where("__m IS NOT NULL").withColumn("leverage", F.lit(None).cast("double"))
    null = F.lit(None).cast("double")
    return j.select(*df.columns, (double(y) - double(y_hat)).alias("raw"), null.alias("standardized"), null.alias("studentized"), "leverage")


def aic(rss: Column, n: Column, k: Column) -> Column:
    """n ln(rss/n) + 2k; minus infinity for a perfect fit; null for null; bad input raises."""
    return _criterion(rss, n, 2 * k)


def bic(rss: Column, n: Column, k: Column) -> Column:
    return _criterion(rss, n, k * F.log(n))


def _criterion(rss: Column, n: Column, cost: Column) -> Column:
    rss = rss.cast("double")
    bad = F.raise_error(F.lit("n must be positive and rss not negative")).cast("double")
    value = F.when((n <= 0) | (rss < 0), bad).when(rss == 0, F.lit(float("-inf"))).otherwise(n * F.log(rss / n) + cost)
    return F.when(rss.isNotNull() & n.isNotNull() & cost.isNotNull(), value)


def predict(x: Column, coefficients: Column, intercept: Column) -> Column:
    """Predictions from features as arrays (one inner array per feature), natively."""
    n = F.size(F.get(x, F.lit(0)))
    rows = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def one(i: Column) -> Column:
        terms = F.zip_with(x, coefficients, lambda c, b: F.get(c, i) * F.nanvl(b, F.lit(0.0)))
        return F.aggregate(terms, F.coalesce(F.nanvl(intercept.cast("double"), F.lit(0.0)), F.lit(0.0)), lambda a, v: a + v)

    return F.transform(rows, one)


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, inside one expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def jarque_bera(values: Column) -> Column:
    """Struct of the test over an array, natively; null under three values or without variance."""

    def total(v: Column, term) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + term(x))

    def with_mean(v: Column, mean: Column) -> Column:
        sums = F.struct(*[(total(v, lambda x, k=k: F.pow(x - mean, F.lit(float(k)))) / F.size(v)).alias(f"m{k}") for k in (2, 3, 4)])
        return let(sums, lambda m: finish(F.size(v), m["m2"], m["m3"], m["m4"]))

    def finish(n: Column, m2: Column, m3: Column, m4: Column) -> Column:
        skew, kurt = m3 / F.pow(m2, F.lit(1.5)), m4 / (m2 * m2) - 3
        stat = n / 6 * (skew * skew + kurt * kurt / 4)
        return F.when((n >= 3) & (m2 > 0), F.struct(stat.alias("statistic"), F.exp(-stat / 2).alias("p_value"), skew.alias("skewness"), kurt.alias("kurtosis"), n.cast("long").alias("n")))

    return let(F.filter(values, lambda x: finite(x)), lambda v: let(total(v, lambda x: x) / F.size(v), lambda mean: with_mean(v, mean)))


def eb_shrink_by(df: DataFrame, estimate: str, se: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """All rows with estimates shrunk to their common mean by the DerSimonian-Laird variance between groups.

    Rows with a bad standard error stay, with NaN; two usable rows are needed.
    """
    o, by = options.read(opts, tau_squared=None, tau_method="dl"), list(by)
    good = finite(double(estimate)) & finite(double(se)) & (double(se) > 0)
    w = F.when(good, 1 / (double(se) * double(se)))
    t = double(estimate)
    s = df.groupBy(*by).agg(F.sum(w).alias("sw"), F.sum(w * t).alias("swt"), F.sum(w * w).alias("sw2"), F.sum(w * t * t).alias("swtt"), F.count(w).alias("n")).where("n >= 2")
    sw = F.col("sw")
    q = F.col("swtt") - F.col("swt") ** 2 / sw
    tau = F.lit(float(o.tau_squared)) if o.tau_squared is not None else F.greatest(F.lit(0.0), (q - (F.col("n") - 1)) / (sw - F.col("sw2") / sw))
    s = s.select(*by, q.alias("q"), tau.alias("tau_squared"), F.col("n").alias("n_groups"), F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("n") - 1)) / q)).otherwise(0.0).alias("i_squared"))
    j = join_groups(df.withColumn("__v", F.when(good, double(se) * double(se))), s, by)
    ws = 1 / (F.col("__v") + F.col("tau_squared"))
    mean = j.groupBy(*by).agg((F.sum(ws * t) / F.sum(ws)).alias("mu"), F.sqrt(1 / F.sum(ws)).alias("mu_se"))
    j = join_groups(j, mean, by)
    weight = F.col("tau_squared") / (F.col("tau_squared") + F.col("__v"))
    nan = lambda c: F.when(F.col("__v").isNull() & F.col("mu").isNotNull(), NAN).otherwise(c)
    return j.select(
        *df.columns, nan(weight * t + (1 - weight) * F.col("mu")).alias("shrunken"), nan(F.sqrt(weight * F.col("__v") + (1 - weight) ** 2 * F.col("mu_se") ** 2)).alias("shrunken_se"), nan(weight).alias("weight"),
        "mu", "mu_se", "tau_squared", "i_squared", "q", "n_groups",
    )


# -- demand classification ----------------------------------------------------------------

AID = dict(intermittent_threshold=0.3, outlier_method="zscore")


def _flags(df: DataFrame, by: list[str], order: list[str], y: str, o) -> DataFrame:
    v = F.when(finite(double(y)), double(y))
    w = Window.partitionBy(*by)
    rows = df.select(*by, *order, v.alias("__v")).withColumn("__i", F.row_number().over(w.orderBy(*order)))
    hit = (F.col("__v") != 0) & F.col("__v").isNotNull()
    if o.outlier_method == "iqr":
        # quartiles by place: the sorted values at n/4 and 3n/4
        sorted_ = rows.where("__v IS NOT NULL").withColumns({"__r": F.row_number().over(w.orderBy("__v")) - 1, "__n": F.count(F.lit(1)).over(w)})
        q = sorted_.groupBy(*by).agg(F.max(F.when(F.col("__r") == F.floor(F.col("__n") / 4), F.col("__v"))).alias("q1"), F.max(F.when(F.col("__r") == F.floor(3 * F.col("__n") / 4), F.col("__v"))).alias("q3"))
        bounds = q.select(*by, (F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))).alias("__hi"), F.greatest(F.lit(0.0), F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).alias("__lo"))
    else:
        sd = F.coalesce(F.stddev_samp("__v"), F.lit(0.0))
        bounds = rows.groupBy(*by).agg((F.avg("__v") + 3 * sd).alias("__hi"), F.greatest(F.lit(0.0), F.avg("__v") - 3 * sd).alias("__lo"))
    ends = rows.groupBy(*by).agg(F.min(F.when(hit, F.col("__i"))).alias("__first"), F.max(F.when(hit, F.col("__i"))).alias("__last"))
    j = join_groups(join_groups(rows, bounds, by), ends, by)
    zero, i = F.col("__v") == 0, F.col("__i")
    no = lambda c: F.coalesce(c, F.lit(False))
    return j.withColumns({
        "stockout": no(zero & (i > F.col("__first")) & (i < F.col("__last"))),
        "new_product": no(zero & (i < F.col("__first"))),
        "obsolete_product": no(zero & (i > F.col("__last"))),
        "high_outlier": no(~zero & (F.col("__v") > F.col("__hi"))),
        "low_outlier": no(~zero & (F.col("__v") < F.col("__lo")) & (F.col("__lo") > 0)),
    })


def aid_anomaly_by(df: DataFrame, by: list[str], order: list[str], y: str, opts: dict | None = None) -> DataFrame:
    """Five flags per row: zeros inside, before and after the sales, and outliers."""
    o = options.read(opts, **AID)
    return _flags(df, list(by), list(order), y, o).select(*by, *order, "stockout", "new_product", "obsolete_product", "high_outlier", "low_outlier")


def aid_by(df: DataFrame, by: list[str], order: list[str], y: str, opts: dict | None = None) -> DataFrame:
    """One row per group: demand type, a fitting distribution, moments and flag counts."""
    o, by = options.read(opts, **AID), list(by)
    f = _flags(df, by, list(order), y, o)
    v = F.col("__v")
    flags = ("stockout", "new_product", "obsolete_product", "high_outlier", "low_outlier")
    mean = f.groupBy(*by).agg(F.avg("__v").alias("mean"), F.coalesce(F.var_samp("__v"), F.lit(0.0)).alias("variance"))
    j = join_groups(f, mean, by)
    z = F.when(v > 0, (v - F.col("mean")) / F.sqrt("variance"))
    s = j.groupBy(*by).agg(
        F.first("mean").alias("mean"), F.first("variance").alias("variance"), (F.count_if(v == 0) / F.count("__v")).alias("zero_proportion"), F.count("__v").alias("n_observations"),
        *[F.count_if(F.col(c)).alias(f"{c}_count") for c in flags], F.min((v >= 0) & (v == F.floor(v))).alias("counts"), F.min(v >= 0).alias("positive"), F.count(F.when(v > 0, 1)).alias("m"), F.sum(z * z * z).alias("m3"),
    ).where("n_observations > 0")
    intermittent = F.col("zero_proportion") >= float(o.intermittent_threshold)
    m = F.col("m").cast("double")
    skew = F.when((m >= 3) & (F.col("variance") > 0), F.col("m3") / m * F.sqrt(m * (m - 1)) / (m - 2)).otherwise(0.0)
    over = F.when(F.col("mean") > 0, F.col("variance") / F.col("mean")).otherwise(1.0)
    count_kind = F.when(intermittent, F.when(F.col("variance") > 1.5 * F.col("mean"), "negative_binomial").otherwise("geometric")).otherwise(F.when(over < 1.5, "poisson").otherwise("negative_binomial"))
    real_kind = F.when((m == 0) | ~F.col("positive"), "normal").when(skew > 1, "lognormal").when(skew > 0.5, "gamma").when(intermittent, "rectified_normal").otherwise("normal")
    return s.select(
        *by, F.when(intermittent, "intermittent").otherwise("regular").alias("demand_type"), intermittent.alias("is_intermittent"), F.when(F.col("counts"), count_kind).otherwise(real_kind).alias("distribution"),
        "mean", "variance", "zero_proportion", "n_observations", (F.col("stockout_count") > 0).alias("has_stockouts"), (F.col("new_product_count") > 0).alias("is_new_product"), (F.col("obsolete_product_count") > 0).alias("is_obsolete_product"),
        *[f"{c}_count" for c in flags],
    )
