"""Hypothesis tests and association measures per group, as aggregates and windows.

Every function takes a DataFrame, its value columns and the grouping columns
``by`` and gives one row per group.  Rows with a missing value are left out.
Ranks come from counts of distinct values, so ties cost nothing; statistics are
sums; only the last step, a distribution function of one number per group, runs
in an Arrow-batched NumPy function.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import dist, options
from quillstat.functions.columns import beta_ppf, binom_cdf, chi2_sf, f_ppf, f_sf, norm_cdf, norm_ppf, norm_sf, p_value, t_ppf, t_sf, t_two_sided
from quillstat.plans.moments import double, join_groups, own_names, usable
from quillstat.plans.order import counted_before

NAN = float("nan")
TEST = dict(alternative="two_sided", confidence_level=0.95)


def _col(name: str) -> Column:
    return F.col(name)


def _rows(df: DataFrame, by, **cols: str) -> DataFrame:
    """The grouping columns and the named values as doubles, where all are finite."""
    return usable(df, list(cols.values())).select(*by, *[double(c).alias(k) for k, c in cols.items()])


def _two(df: DataFrame, value: str, group: str, by) -> DataFrame:
    """v and whether the row is in the first group: group 0; everything else is the second."""
    return usable(df, [value]).where(F.col(group).isNotNull()).select(*by, double(value).alias("v"), (F.col(group).cast("long") == 0).alias("first"))


def _lower_upper(centre: Column, half: Column, alternative: str) -> list[Column]:
    inf = F.lit(float("inf"))
    return [(-inf if alternative == "less" else centre - half).alias("ci_lower"), (inf if alternative == "greater" else centre + half).alias("ci_upper")]


def _level(o) -> float:
    """Probability of the quantile behind an interval of this kind."""
    return 0.5 + float(o.confidence_level) / 2 if o.alternative == "two_sided" else float(o.confidence_level)


def _midranks(rows: DataFrame, by: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rows with the mean rank of their value within the group, and ties: how many rows share it."""
    counts = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    ranks = counted_before(counts, list(by), value, "ties", name).withColumn(name, F.col(name) + (F.col("ties") + 1) / 2)
    return join_groups(rows, ranks, [*by, value])


# -- normality ------------------------------------------------------------------------


@own_names
def jarque_bera_agg(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    s = _rows(df, by, v=value).groupBy(*by).agg(F.count("v").alias("n"), F.skewness("v").alias("skewness"), F.kurtosis("v").alias("kurtosis"), F.var_pop("v").alias("var"))
    s = s.where("n >= 3 AND var > 0").withColumn("statistic", F.col("n") / 6 * (F.col("skewness") ** 2 + F.col("kurtosis") ** 2 / 4))
    return s.select(*by, "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"), "skewness", "kurtosis", "n")


@own_names
def dagostino_k2_agg(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """D'Agostino and Pearson's K squared from the transformed skewness and kurtosis; needs 20 values."""
    s = _rows(df, by, v=value).groupBy(*by).agg(F.count("v").alias("n"), F.skewness("v").alias("g1"), F.kurtosis("v").alias("g2")).where("n >= 20")
    n = F.col("n").cast("double")
    yv = F.col("g1") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    b2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (b2 - 1)) - 1
    a = F.sqrt(2 / (w2 - 1))
    z1 = F.asinh(yv / a) / F.sqrt(F.log(F.sqrt(w2)))
    mean, var = -6 / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (F.col("g2") - mean) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    c = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    inner = (1 - 2 / c) / (1 + x * F.sqrt(2 / (c - 4)))
    z2 = (1 - 2 / (9 * c) - F.cbrt(inner)) / F.sqrt(2 / (9 * c))
    s = s.withColumn("statistic", z1 * z1 + z2 * z2)
    return s.select(*by, "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"), "n", F.lit("D'Agostino-Pearson K2").alias("method"))


@own_names
def shapiro_wilk_agg(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """Shapiro-Wilk by Royston's approximation, for 3 to 5000 values: a dot product with weights of the ranks."""
    rows = _rows(df, by, v=value)
    s = rows.groupBy(*by).agg(F.count("v").alias("n"), (F.var_pop("v") * F.count("v")).alias("ss")).where("n BETWEEN 3 AND 5000 AND ss > 0")
    j = join_groups(rows, s, list(by)).where("n IS NOT NULL").withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("v")))

    def weight(i: pd.Series, n: pd.Series) -> pd.Series:
        out = np.empty(len(i))
        nn, ii = n.to_numpy(int), i.to_numpy(int)
        for k in np.unique(nn):
            out[nn == k] = shapiro_weights(int(k))[ii[nn == k] - 1]
        return pd.Series(out)

    w = F.pandas_udf(weight, "double")
    s = j.withColumn("a", w("i", "n")).groupBy(*by).agg(F.first("n").alias("n"), F.least(F.lit(1.0), F.sum(F.col("a") * F.col("v")) ** 2 / F.first("ss")).alias("statistic"))
    n, stat = F.col("n").cast("double"), F.col("statistic")
    ln = F.log(n)
    small = stat  # three values: exact
    exact = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(small)) - math.asin(math.sqrt(0.75))))
    g = -2.273 + 0.459 * n
    z_small = (-F.log(g - F.log1p(-stat)) - (0.544 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3)) / F.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    z_large = (F.log1p(-stat) - (-1.5861 - 0.31082 * ln - 0.083751 * ln**2 + 0.0038915 * ln**3)) / F.exp(-0.4803 - 0.082676 * ln + 0.0030302 * ln**2)
    p = F.when(n == 3, exact).when(stat >= 1, 1.0).otherwise(norm_sf(F.when(n <= 11, z_small).otherwise(z_large)))
    return s.select(*by, "statistic", p.alias("p_value"), "n", F.lit("Shapiro-Wilk").alias("method"))


def shapiro_weights(n: int) -> np.ndarray:
    """Royston's weights of the ordered values (fixed polynomial values of AS R94)."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = dist.norm_ppf((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    total, u = float(m @ m), 1 / math.sqrt(n)
    a = m / math.sqrt(total)
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
    if n <= 5:
        phi = (total - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = m / math.sqrt(phi)
        a[-1], a[0] = last, -last
    else:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
        phi = (total - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[-1], a[0], a[-2], a[1] = last, -last, second, -second
    return a


# -- location -------------------------------------------------------------------------


def _two_moments(df: DataFrame, value: str, group: str, by) -> DataFrame:
    r = _two(df, value, group, by)
    a, b = F.when(F.col("first"), F.col("v")), F.when(~F.col("first"), F.col("v"))
    return r.groupBy(*by).agg(F.count(a).alias("n1"), F.count(b).alias("n2"), F.avg(a).alias("m1"), F.avg(b).alias("m2"), F.var_samp(a).alias("v1"), F.var_samp(b).alias("v2")).where("n1 >= 2 AND n2 >= 2")


def _welch(s: DataFrame, kind: str, mu: float) -> DataFrame:
    n1, n2, v1, v2 = map(_col, ("n1", "n2", "v1", "v2"))
    if kind == "student":
        df = (n1 + n2 - 2).cast("double")
        se = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / df * (1 / n1 + 1 / n2))
    else:
        q1, q2 = v1 / n1, v2 / n2
        se, df = F.sqrt(q1 + q2), (q1 + q2) ** 2 / (q1 * q1 / (n1 - 1) + q2 * q2 / (n2 - 1))
    return s.withColumns({"diff": F.col("m1") - F.col("m2"), "se": se, "df": df}).withColumn("statistic", (F.col("diff") - mu) / F.col("se"))


@own_names
def t_test_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o = options.read(opts, **TEST, kind="welch", mu=0.0, paired=False)
    s = _welch(_two_moments(df, value, group, by), o.kind, float(o.mu))
    half = t_ppf(F.lit(_level(o)), F.col("df")) * F.col("se")
    return s.select(*by, "statistic", p_value(F.col("statistic"), F.col("df"), o.alternative).alias("p_value"), "df", F.lit(NAN).alias("effect_size"), *_lower_upper(F.col("diff"), half, o.alternative), "n1", "n2", F.lit("Welch t-test" if o.kind != "student" else "Student t-test").alias("method"))


@own_names
def yuen_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Trimmed means, winsorised variances; four values per group at least."""
    o = options.read(opts, **TEST, trim=0.2)
    r = _two(df, value, group, by)
    w = Window.partitionBy(*by, "first")
    r = r.withColumns({"i": F.row_number().over(w.orderBy("v")), "n": F.count("v").over(w)}).withColumn("g", F.floor(float(o.trim) * F.col("n")))
    inside = (F.col("i") > F.col("g")) & (F.col("i") <= F.col("n") - F.col("g"))
    r = r.withColumns({"lo": F.min(F.when(inside, F.col("v"))).over(w), "hi": F.max(F.when(inside, F.col("v"))).over(w), "in": inside})
    r = r.withColumn("win", F.greatest("lo", F.least("hi", "v")))
    agg = []
    for k, of in ((1, F.col("first")), (2, ~F.col("first"))):
        agg += [F.count(F.when(of, 1)).alias(f"n{k}"), F.avg(F.when(of & F.col("in"), F.col("v"))).alias(f"m{k}"), F.var_samp(F.when(of, F.col("win"))).alias(f"w{k}"), F.max(F.when(of, F.col("g"))).alias(f"g{k}")]
    s = r.groupBy(*by).agg(*agg).where("n1 >= 4 AND n2 >= 4")
    d = {k: (F.col(f"n{k}") - 1) * F.col(f"w{k}") / ((F.col(f"n{k}") - 2 * F.col(f"g{k}")) * (F.col(f"n{k}") - 2 * F.col(f"g{k}") - 1)) for k in (1, 2)}
    h = {k: F.col(f"n{k}") - 2 * F.col(f"g{k}") for k in (1, 2)}
    s = s.withColumns({"d1": d[1], "d2": d[2], "h1": h[1], "h2": h[2]})
    s = s.withColumns({"diff": F.col("m1") - F.col("m2"), "se": F.sqrt(F.col("d1") + F.col("d2")), "df": (F.col("d1") + F.col("d2")) ** 2 / (F.col("d1") ** 2 / (F.col("h1") - 1) + F.col("d2") ** 2 / (F.col("h2") - 1))}).withColumn("statistic", F.col("diff") / F.col("se"))
    half = t_ppf(F.lit(_level(o)), F.col("df")) * F.col("se")
    return s.select(*by, "statistic", p_value(F.col("statistic"), F.col("df"), o.alternative).alias("p_value"), "df", F.lit(NAN).alias("effect_size"), *_lower_upper(F.col("diff"), half, o.alternative), "n1", "n2", F.lit("Yuen trimmed means test").alias("method"))


def _anova(rows: DataFrame, by: list[str]) -> DataFrame:
    per = rows.groupBy(*by, "g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("ss"))
    s = per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("k"), F.min("n").alias("least"), F.sum("n").alias("n"), F.sum("ss").alias("ss_within"), F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") ** 2).alias("t2")
    ).where("k >= 2 AND least >= 2")
    s = s.withColumns({"ss_between": F.col("t2") - F.col("t") ** 2 / F.col("n"), "df_between": F.col("k") - 1, "df_within": F.col("n") - F.col("k")})
    s = s.withColumn("f_statistic", F.col("ss_between") / F.col("df_between") / (F.col("ss_within") / F.col("df_within")))
    return s.withColumn("p_value", f_sf(F.col("f_statistic"), F.col("df_between"), F.col("df_within")))


def _grouped(df: DataFrame, value: str, group: str, by) -> DataFrame:
    return usable(df, [value]).where(F.col(group).isNotNull()).select(*by, double(value).alias("v"), F.col(group).alias("g"))


@own_names
def one_way_anova_agg(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    s = _anova(_grouped(df, value, group, by), list(by))
    return s.select(*by, "f_statistic", "p_value", "df_between", "df_within", "ss_between", "ss_within", F.col("k").alias("n_groups"), "n", F.lit("One-way ANOVA").alias("method"))


@own_names
def brown_forsythe_agg(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    r = _grouped(df, value, group, by)
    med = r.groupBy(*by, "g").agg(F.median("v").alias("med"))
    s = _anova(join_groups(r, med, [*by, "g"]).withColumn("v", F.abs(F.col("v") - F.col("med"))), list(by))
    return s.select(*by, F.col("f_statistic").alias("statistic"), "p_value", F.col("df_between").alias("df"), "n", F.lit("Brown-Forsythe test").alias("method"))


@own_names
def mann_whitney_u_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Normal approximation with tie correction; the interval of the shift is by normal theory on ranks and given as null."""
    o = options.read(opts, **TEST, continuity_correction=True)
    by = list(by)
    r = _midranks(_two(df, value, group, by), by, "v")
    first = F.col("first")
    s = r.groupBy(*by).agg(F.count(F.when(first, 1)).alias("n1"), F.count(F.when(~first, 1)).alias("n2"), F.sum(F.when(first, F.col("rank"))).alias("r1"), F.sum(F.col("ties") ** 2 - 1).alias("t")).where("n1 > 0 AND n2 > 0")
    n = F.col("n1") + F.col("n2")
    s = s.withColumn("statistic", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    d = F.col("statistic") - F.col("n1") * F.col("n2") / 2
    sd = F.sqrt(F.col("n1") * F.col("n2") / 12.0 * (n + 1 - F.col("t") / (n * (n - 1))))
    cc = {"two_sided": F.signum(d) * 0.5, "greater": F.lit(0.5), "less": F.lit(-0.5)}[o.alternative] if o.continuity_correction else F.lit(0.0)
    null = F.lit(None).cast("double")
    return s.select(*by, "statistic", p_value((d - cc) / sd, None, o.alternative).alias("p_value"), F.lit(NAN).alias("effect_size"), null.alias("ci_lower"), null.alias("ci_upper"), "n1", "n2", F.lit("Mann-Whitney U test").alias("method"))


@own_names
def wilcoxon_signed_rank_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Paired; zero differences are dropped; normal approximation with tie correction."""
    o = options.read(opts, **TEST, continuity_correction=True)
    by = list(by)
    r = _rows(df, by, x=x, y=y).withColumn("d", F.col("x") - F.col("y")).where("d <> 0").withColumn("a", F.abs("d"))
    r = _midranks(r, by, "a")
    s = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0)).alias("statistic"), F.sum(F.col("ties") ** 2 - 1).alias("t"))
    n = F.col("n")
    d = F.col("statistic") - n * (n + 1) / 4
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("t") / 48)
    cc = {"two_sided": F.signum(d) * 0.5, "greater": F.lit(0.5), "less": F.lit(-0.5)}[o.alternative] if o.continuity_correction else F.lit(0.0)
    null = F.lit(None).cast("double")
    return s.select(*by, "statistic", p_value((d - cc) / sd, None, o.alternative).alias("p_value"), null.alias("ci_lower"), null.alias("ci_upper"), "n", F.lit("Wilcoxon signed-rank test").alias("method"))


@own_names
def kruskal_wallis_agg(df: DataFrame, value: str, group: str, by: list[str] = ()) -> DataFrame:
    by = list(by)
    r = _midranks(_grouped(df, value, group, by), by, "v")
    per = r.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("n"), F.sum("rank").alias("r"), F.sum(F.col("ties") ** 2 - 1).alias("t"))
    s = per.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") ** 2 / F.col("n")).alias("q"), F.sum("t").alias("t")).where("k >= 2")
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("t") / (n**3 - n))
    s = s.withColumns({"statistic": h, "df": F.col("k") - 1})
    return s.select(*by, "statistic", chi2_sf(F.col("statistic"), F.col("df")).alias("p_value"), "df", F.col("n"), F.lit("Kruskal-Wallis test").alias("method"))


@own_names
def brunner_munzel_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o = options.read(opts, **TEST)
    by = list(by)
    r = _midranks(_two(df, value, group, by), by, "v", "all")
    r = _midranks(r.drop("ties"), [*by, "first"], "v", "own").withColumn("p", F.col("all") - F.col("own"))
    agg = []
    for k, of in ((1, F.col("first")), (2, ~F.col("first"))):
        agg += [F.count(F.when(of, 1)).alias(f"n{k}"), F.avg(F.when(of, F.col("all"))).alias(f"r{k}"), F.var_samp(F.when(of, F.col("p"))).alias(f"s{k}")]
    s = r.groupBy(*by).agg(*agg).where("n1 >= 2 AND n2 >= 2")
    n1, n2, s1, s2 = map(_col, ("n1", "n2", "s1", "s2"))
    v = n1 * s1 + n2 * s2
    s = s.withColumns({"statistic": n1 * n2 * (F.col("r2") - F.col("r1")) / ((n1 + n2) * F.sqrt(v)), "df": v**2 / ((n1 * s1) ** 2 / (n1 - 1) + (n2 * s2) ** 2 / (n2 - 1)), "effect_size": (F.col("r2") - (n2 + 1) / 2) / n1, "se": F.sqrt(s1 / (n1 * n2 * n2 / n1) + s2 / (n2 * n1 * n1 / n2))})
    half = t_ppf(F.lit(_level(o)), F.col("df")) * F.sqrt(s1 / n1 / n2**2 + s2 / n2 / n1**2)
    return s.select(*by, "statistic", p_value(F.col("statistic"), F.col("df"), o.alternative).alias("p_value"), "df", "effect_size", *_lower_upper(F.col("effect_size"), half, o.alternative), "n1", "n2", F.lit("Brunner-Munzel test").alias("method"))


# -- correlation and agreement --------------------------------------------------------


def _pearson(s: DataFrame, by, level: float, method: str) -> DataFrame:
    """From r and n: t test and Fisher's interval."""
    s = s.where("n >= 3 AND r IS NOT NULL")
    r, n = F.col("r"), F.col("n")
    z = F.atanh(F.greatest(F.lit(-1 + 1e-15), F.least(F.lit(1 - 1e-15), r)))
    half = norm_ppf(F.lit(0.5 + level / 2)) / F.sqrt(F.when(n > 3, n - 3))
    s = s.withColumn("statistic", r * F.sqrt((n - 2) / (1 - r * r)))
    p = F.when(F.abs(r) >= 1, 0.0).otherwise(t_two_sided(F.col("statistic"), n - 2))
    return s.select(*by, "r", "statistic", p.alias("p_value"), F.tanh(z - half).alias("ci_lower"), F.tanh(z + half).alias("ci_upper"), "n", F.lit(method).alias("method"))


@own_names
def pearson_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o = options.read(opts, confidence_level=0.95)
    s = _rows(df, by, x=x, y=y).groupBy(*by).agg(F.corr("x", "y").alias("r"), F.count(F.lit(1)).alias("n"))
    return _pearson(s, by, float(o.confidence_level), "Pearson correlation")


def _ranked(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    r = _rows(df, by, x=x, y=y)
    r = _midranks(r, by, "x", "rx").drop("ties")
    return _midranks(r, by, "y", "ry")


@own_names
def spearman_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o, by = options.read(opts, confidence_level=0.95), list(by)
    s = _ranked(df, x, y, by).groupBy(*by).agg(F.corr("rx", "ry").alias("r"), F.count(F.lit(1)).alias("n"))
    return _pearson(s, by, float(o.confidence_level), "Spearman correlation")


@own_names
def icc_agg(df: DataFrame, value: str, subject: str, rater: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Two-way random effects, absolute agreement: single rating or, with type average, the mean of all raters.  Null unless every rater rated every subject."""
    o, by = options.read(opts, type="single", confidence_level=0.95), list(by)
    r = usable(df, [value]).groupBy(*by, F.col(subject).alias("s"), F.col(rater).alias("q")).agg(F.last(double(value)).alias("v"))
    total = r.groupBy(*by).agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("s").alias("n"), F.countDistinct("q").alias("k"), F.avg("v").alias("m"), (F.var_pop("v") * F.count("v")).alias("sst"))
    rows = r.groupBy(*by, "s").agg(F.avg("v").alias("a")).groupBy(*by).agg((F.var_pop("a") * F.count("a")).alias("ssr"))
    cols = r.groupBy(*by, "q").agg(F.avg("v").alias("a")).groupBy(*by).agg((F.var_pop("a") * F.count("a")).alias("ssc"))
    t = join_groups(join_groups(total, rows, by), cols, by).where("cells = n * k AND n >= 2 AND k >= 2")
    n, k = F.col("n").cast("double"), F.col("k").cast("double")
    msr, msc = k * F.col("ssr") / (n - 1), n * F.col("ssc") / (k - 1)
    mse = (F.col("sst") - k * F.col("ssr") - n * F.col("ssc")) / ((n - 1) * (k - 1))
    t = t.withColumns({"msr": msr, "msc": msc, "mse": mse})
    r_, c_, e_ = map(_col, ("msr", "msc", "mse"))
    single = (r_ - e_) / (r_ + (k - 1) * e_ + k * (c_ - e_) / n)
    t = t.withColumns({"one": single, "f_statistic": r_ / e_})
    one = F.col("one")
    a, b = k * one / (n * (1 - one)), 1 + k * one * (n - 1) / (n * (1 - one))
    v = (a * c_ + b * e_) ** 2 / ((a * c_) ** 2 / (k - 1) + (b * e_) ** 2 / ((n - 1) * (k - 1)))
    q = 0.5 + float(o.confidence_level) / 2
    fl, fu = f_ppf(F.lit(q), n - 1, v), f_ppf(F.lit(q), v, n - 1)
    low = n * (r_ - fl * e_) / (fl * (k * c_ + (k * n - k - n) * e_) + n * r_)
    high = n * (fu * r_ - e_) / (k * c_ + (k * n - k - n) * e_ + n * fu * r_)
    up = (lambda x: k * x / (1 + (k - 1) * x)) if str(o.type).lower() == "average" else (lambda x: x)
    return t.select(*by, up(one).alias("icc"), "f_statistic", up(low).alias("ci_lower"), up(high).alias("ci_upper"), F.col("n").alias("n_subjects"), F.col("k").alias("n_raters"), F.lit("ICC(A,1)" if up(F.lit(1)) is None else f"ICC ({o.type})").alias("method"))


@own_names
def cohen_kappa_agg(df: DataFrame, rater1: str, rater2: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Unweighted, or with ``weighted`` linearly by the order of the categories."""
    o, by = options.read(opts, weighted=False, confidence_level=0.95), list(by)
    c = df.where(F.col(rater1).isNotNull() & F.col(rater2).isNotNull()).groupBy(*by, F.col(rater1).cast("long").alias("a"), F.col(rater2).cast("long").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    cats = c.select(*by, F.col("a").alias("v")).union(c.select(*by, F.col("b").alias("v"))).distinct()
    place = cats.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("v")) - 1)
    size = place.groupBy(*by).agg(F.count(F.lit(1)).alias("k"))
    n = c.groupBy(*by).agg(F.sum("c").alias("n")).where("n >= 2")
    marg = lambda col, name: join_groups(c.groupBy(*by, F.col(col).alias("v")).agg(F.sum("c").alias(name)), place, [*by, "v"])
    rows, cols = marg("a", "ra").select(*by, "ra", F.col("i").alias("i"), F.col("v").alias("a")), marg("b", "cb").select(*by, "cb", F.col("i").alias("j"), F.col("v").alias("b"))
    # all pairs of categories (a table of categories, not of rows)
    grid = join_groups(rows, cols.groupBy(*by).agg(F.collect_list(F.struct("cb", "j", "b")).alias("l")), by).withColumn("x", F.explode("l")).select(*by, "a", "i", "ra", "x.*").drop("l")
    t = join_groups(join_groups(join_groups(grid, c, [*by, "a", "b"]), n, by), size, by).where("n IS NOT NULL")
    w = (1 - F.abs(F.col("i") - F.col("j")) / F.greatest(F.lit(1), F.col("k") - 1)) if o.weighted else F.when(F.col("a") == F.col("b"), 1.0).otherwise(0.0)
    t = t.withColumns({"w": w, "po": F.coalesce("c", F.lit(0)) / F.col("n"), "pe": F.col("ra") * F.col("cb") / (F.col("n") * F.col("n"))})
    s = t.groupBy(*by).agg(F.first("n").alias("n"), F.sum(F.col("w") * F.col("po")).alias("po"), F.sum(F.col("w") * F.col("pe")).alias("pe")).where("pe < 1")
    po, pe, nn = map(_col, ("po", "pe", "n"))
    s = s.withColumns({"kappa": (po - pe) / (1 - pe), "se": F.sqrt(po * (1 - po) / nn) / (1 - pe), "se0": F.sqrt(pe / (nn * (1 - pe)))})
    z = norm_ppf(F.lit(0.5 + float(o.confidence_level) / 2))
    s = s.withColumn("z", F.col("kappa") / F.col("se0"))
    return s.select(*by, "kappa", "se", (F.col("kappa") - z * F.col("se")).alias("ci_lower"), (F.col("kappa") + z * F.col("se")).alias("ci_upper"), "z", p_value(F.col("z"), None, "two_sided").alias("p_value"))


# -- categorical ----------------------------------------------------------------------


def _cells(df: DataFrame, row: str, col: str, by: list[str]) -> DataFrame:
    """(by, a, b, c) counts with row and column sums, as windows over the small table of cells."""
    c = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(*by, F.col(row).alias("a"), F.col(col).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("c"))
    part = lambda *k: Window.partitionBy(*by, *k)
    return c.withColumns({"ra": F.sum("c").over(part("a")), "cb": F.sum("c").over(part("b")), "n": F.sum("c").over(part())})


def _table(df: DataFrame, row: str, col: str, by: list[str]) -> DataFrame:
    """n, rows, cols, chi2, g (sums over cells; empty cells follow from the margins)."""
    c = _cells(df, row, col, by)
    e = F.col("ra") * F.col("cb") / F.col("n")
    # chi2 = sum c^2/e - n also counts the empty cells
    return c.groupBy(*by).agg(F.first("n").alias("n"), F.countDistinct("a").alias("rows"), F.countDistinct("b").alias("cols"), (F.sum(F.col("c") ** 2 / e) - F.first("n")).alias("chi2"), (2 * F.sum(F.col("c") * F.log(F.col("c") / e))).alias("g"), F.max("a").alias("max_a"), F.max("b").alias("max_b"))


@own_names
def chisq_test_agg(df: DataFrame, row: str, col: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Codes are places in a dense table 0 to the greatest: a gap is an empty row or column, and then the statistic is NaN."""
    o, by = options.read(opts, continuity_correction=False, correction=False), list(by)
    t = _table(df, row, col, by).withColumns({"r": F.col("max_a") + 1, "k": F.col("max_b") + 1})
    stat = F.when((F.col("r") > F.col("rows")) | (F.col("k") > F.col("cols")), F.lit(NAN)).otherwise(F.greatest(F.lit(0.0), F.col("chi2")))
    if o.continuity_correction or o.correction:
        four = _four(df, row, col, by)
        yates = F.greatest(F.lit(0.0), F.abs(F.col("p00") * F.col("p11") - F.col("p01") * F.col("p10")) - F.col("m") / 2) ** 2 * F.col("m") / ((F.col("p00") + F.col("p01")) * (F.col("p10") + F.col("p11")) * (F.col("p00") + F.col("p10")) * (F.col("p01") + F.col("p11")))
        t = join_groups(t, four, by)
        stat = F.when((F.col("r") == 2) & (F.col("k") == 2), yates).otherwise(stat)
    t = t.withColumns({"statistic": stat, "df": (F.col("r") - 1) * (F.col("k") - 1)}).where("df >= 1")
    return t.select(*by, "statistic", chi2_sf(F.col("statistic"), F.col("df")).alias("p_value"), "df", F.lit("Pearson chi-squared test").alias("method"))


@own_names
def chisq_gof_agg(df: DataFrame, observed: str, expected: str, by: list[str] = ()) -> DataFrame:
    r = _rows(df, by, o=observed, p=expected)
    s = r.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.sum("o").alias("n"), F.sum("p").alias("sp"), F.sum(F.col("o") ** 2 / F.col("p")).alias("q")).where("k >= 2")
    # expected counts are n p / sum p
    s = s.withColumns({"statistic": F.col("q") * F.col("sp") / F.col("n") - F.col("n"), "df": F.col("k") - 1})
    return s.select(*by, "statistic", chi2_sf(F.col("statistic"), F.col("df")).alias("p_value"), "df", F.lit("Chi-squared goodness of fit").alias("method"))


@own_names
def g_test_agg(df: DataFrame, row: str, col: str, by: list[str] = ()) -> DataFrame:
    t = _table(df, row, col, list(by)).where("n >= 4").withColumn("df", (F.col("rows") - 1) * (F.col("cols") - 1))
    return t.select(*by, F.col("g").alias("statistic"), chi2_sf(F.col("g"), F.col("df")).alias("p_value"), "df", F.lit("G-test").alias("method"))


@own_names
def cramers_v_agg(df: DataFrame, row: str, col: str, by: list[str] = ()) -> DataFrame:
    t = _table(df, row, col, list(by)).where("n >= 2")
    return t.select(*by, F.sqrt(F.greatest(F.lit(0.0), F.col("chi2")) / (F.col("n") * (F.least("rows", "cols") - 1))).alias("cramers_v"))


@own_names
def contingency_coef_agg(df: DataFrame, row: str, col: str, by: list[str] = ()) -> DataFrame:
    t = _table(df, row, col, list(by)).where("n >= 4").withColumn("x", F.greatest(F.lit(0.0), F.col("chi2")))
    return t.select(*by, F.sqrt(F.col("x") / (F.col("x") + F.col("n"))).alias("contingency_coef"))


def _four(df: DataFrame, row: str, col: str, by: list[str]) -> DataFrame:
    """Cells of a 2 x 2 table by the two least labels of each side, and m, their sum."""
    c = _cells(df, row, col, by)
    w = lambda k: Window.partitionBy(*by).orderBy(k)
    c = c.withColumns({"i": F.dense_rank().over(w("a")) - 1, "j": F.dense_rank().over(w("b")) - 1})
    cell = lambda i, j: F.coalesce(F.sum(F.when((F.col("i") == i) & (F.col("j") == j), F.col("c"))), F.lit(0.0)).alias(f"p{i}{j}")
    return c.groupBy(*by).agg(*[cell(i, j) for i in (0, 1) for j in (0, 1)], F.sum("c").alias("m"), F.max("i").alias("top_a"), F.max("j").alias("top_b"))


@own_names
def phi_coefficient_agg(df: DataFrame, row: str, col: str, by: list[str] = ()) -> DataFrame:
    t = _four(df, row, col, list(by)).where("m >= 4 AND top_a = 1 AND top_b = 1")
    a, b, c, d = map(_col, ("p00", "p01", "p10", "p11"))
    return t.select(*by, ((a * d - b * c) / F.sqrt((a + b) * (c + d) * (a + c) * (b + d))).alias("phi"))


@own_names
def mcnemar_agg(df: DataFrame, var1: str, var2: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Values are taken as zero or not; the correction is on by default."""
    o = options.read(opts, correction=True)
    r = df.where(F.col(var1).isNotNull() & F.col(var2).isNotNull())
    b = F.count_if((F.col(var1) != 0) & (F.col(var2) == 0)).cast("double")
    c = F.count_if((F.col(var1) == 0) & (F.col(var2) != 0)).cast("double")
    s = r.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), b.alias("b"), c.alias("c")).where("n >= 4")
    d = F.abs(F.col("b") - F.col("c"))
    top = F.greatest(F.lit(0.0), d - 1) if o.correction else d
    s = s.withColumn("statistic", F.when(F.col("b") + F.col("c") > 0, top**2 / (F.col("b") + F.col("c"))).otherwise(0.0))
    return s.select(*by, "statistic", chi2_sf(F.col("statistic"), F.lit(1.0)).alias("p_value"), F.lit(1.0).alias("df"), F.lit("McNemar test").alias("method"))


@own_names
def fisher_exact_agg(df: DataFrame, row: str, col: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """2 x 2 only; the odds ratio is the sample's, its interval Woolf's."""
    o = options.read(opts, **TEST)
    t = _four(df, row, col, list(by)).where("top_a = 1 AND top_b = 1")
    alternative = o.alternative

    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([hypergeometric_p(int(w), int(x), int(y), int(z), alternative) for w, x, y, z in zip(a, b, c, d, strict=True)])

    a, b, c, d = map(_col, ("p00", "p01", "p10", "p11"))
    odds = F.when(b * c > 0, a * d / (b * c)).otherwise(F.lit(float("inf")))
    z = norm_ppf(F.lit(0.5 + float(o.confidence_level) / 2)) * F.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (c + 0.5) + 1 / (d + 0.5))
    mid = F.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))
    p = F.pandas_udf(run, "double")(a, b, c, d)
    return t.select(*by, odds.alias("statistic"), p.alias("p_value"), odds.alias("odds_ratio"), F.exp(mid - z).alias("ci_lower"), F.exp(mid + z).alias("ci_upper"), F.col("m").cast("long").alias("n"), F.lit("Fisher exact test").alias("method"))


def hypergeometric_p(a: int, b: int, c: int, d: int, alternative: str) -> float:
    r, k, n = a + b, a + c, a + b + c + d
    x = np.arange(max(0, r + k - n), min(r, k) + 1)
    lf = dist.lgamma
    lp = lf(r + 1) - lf(x + 1) - lf(r - x + 1) + lf(n - r + 1) - lf(k - x + 1) - lf(n - r - k + x + 1) - (lf(n + 1) - lf(k + 1) - lf(n - k + 1))
    p = np.exp(lp)
    if alternative == "less":
        return float(min(1.0, p[x <= a].sum()))
    if alternative == "greater":
        return float(min(1.0, p[x >= a].sum()))
    return float(min(1.0, p[p <= p[x == a][0] * (1 + 1e-7)].sum()))


def _successes(df: DataFrame, value: str, by) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value) != 0).cast("double").alias("k"))


def _share(o) -> float:
    if not 0 <= float(o.p0) <= 1:
        raise ValueError("option p0 must lie between 0 and 1")
    return float(o.p0)


@own_names
def prop_test_one_agg(df: DataFrame, value: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Normal test of a share; Wilson's interval."""
    o = options.read(opts, **TEST, p0=0.5)
    p0 = _share(o)
    s = _successes(df, value, by).withColumn("estimate", F.col("k") / F.col("n"))
    s = s.withColumn("statistic", (F.col("estimate") - p0) / F.sqrt(F.lit(p0 * (1 - p0)) / F.col("n")))
    z, n, e = norm_ppf(F.lit(0.5 + float(o.confidence_level) / 2)), F.col("n"), F.col("estimate")
    mid, half = (e + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(e * (1 - e) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return s.select(*by, "statistic", p_value(F.col("statistic"), None, o.alternative).alias("p_value"), "estimate", (mid - half).alias("ci_lower"), (mid + half).alias("ci_upper"), "n", F.lit("One-sample proportion test").alias("method"))


@own_names
def prop_test_two_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o = options.read(opts, **TEST, correction=True)
    r = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    first, hit = F.col(group).cast("long") == 0, F.col(value) != 0
    s = r.groupBy(*by).agg(F.count_if(first).alias("n1"), F.count_if(~first).alias("n2"), F.count_if(first & hit).alias("k1"), F.count_if(~first & hit).alias("k2")).where("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    p1, p2 = F.col("k1") / n1, F.col("k2") / n2
    s = s.withColumns({"estimate": p1 - p2, "pool": (F.col("k1") + F.col("k2")) / (n1 + n2), "se1": F.sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2)})
    cc = F.least(0.5 * (1 / n1 + 1 / n2), F.abs("estimate")) if o.correction else F.lit(0.0)
    s = s.withColumn("statistic", F.signum("estimate") * (F.abs("estimate") - cc) / F.sqrt(F.col("pool") * (1 - F.col("pool")) * (1 / n1 + 1 / n2)))
    half = norm_ppf(F.lit(0.5 + float(o.confidence_level) / 2)) * F.col("se1") + cc
    return s.select(*by, "statistic", p_value(F.col("statistic"), None, o.alternative).alias("p_value"), "estimate", (F.col("estimate") - half).alias("ci_lower"), (F.col("estimate") + half).alias("ci_upper"), (F.col("n1") + F.col("n2")).alias("n"), F.lit("Two-sample proportion test").alias("method"))


@own_names
def binom_test_agg(df: DataFrame, value: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Exact; two-sided by doubling is not used: outcomes no likelier than the observed are summed.  Clopper-Pearson interval."""
    o = options.read(opts, **TEST, p0=0.5)
    p0, alternative = _share(o), o.alternative
    s = _successes(df, value, by).withColumn("estimate", F.col("k") / F.col("n"))

    def two_sided(k: pd.Series, n: pd.Series) -> pd.Series:
        out = []
        for kk, nn in zip(k.astype(int), n.astype(int), strict=True):
            x = np.arange(nn + 1)
            with np.errstate(all="ignore"):
                lp = dist.lgamma(nn + 1) - dist.lgamma(x + 1) - dist.lgamma(nn - x + 1) + np.where(x > 0, x * np.log(p0), 0) + np.where(x < nn, (nn - x) * np.log1p(-p0), 0)
            p = np.exp(lp)
            out.append(min(1.0, float(p[p <= p[kk] * (1 + 1e-7)].sum())))
        return pd.Series(out)

    k, n = F.col("k"), F.col("n").cast("double")
    p = {"two_sided": F.pandas_udf(two_sided, "double")(k, F.col("n")), "less": binom_cdf(k, n, F.lit(p0)), "greater": 1 - binom_cdf(k - 1, n, F.lit(p0))}[alternative]
    a = (1 - float(o.confidence_level)) / 2
    low = F.when(k == 0, 0.0).otherwise(beta_ppf(F.lit(a), k, n - k + 1))
    high = F.when(k == n, 1.0).otherwise(beta_ppf(F.lit(1 - a), k + 1, n - k))
    return s.select(*by, F.lit(NAN).alias("statistic"), p.alias("p_value"), "estimate", low.alias("ci_lower"), high.alias("ci_upper"), "n", F.lit("Exact binomial test").alias("method"))


# -- equivalence ----------------------------------------------------------------------


def _bounds(o, default: float) -> tuple[float, float]:
    if o.delta is not None:
        return -abs(float(o.delta)), abs(float(o.delta))
    return (-default if o.bound_lower is None else float(o.bound_lower)), (default if o.bound_upper is None else float(o.bound_upper))


@own_names
def tost_t_test_agg(df: DataFrame, value: str, group: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o = options.read(opts, delta=None, bound_lower=None, bound_upper=None, confidence_level=0.95, kind="welch")
    low, high = _bounds(o, 1.0)
    alpha = 1 - float(o.confidence_level)
    s = _welch(_two_moments(df, value, group, by), o.kind, 0.0)
    s = s.withColumns({"t_lower": (F.col("diff") - low) / F.col("se"), "t_upper": (F.col("diff") - high) / F.col("se")})
    s = s.withColumns({"p_lower": t_sf(F.col("t_lower"), F.col("df")), "p_upper": 1 - t_sf(F.col("t_upper"), F.col("df"))}).withColumn("p_value", F.greatest("p_lower", "p_upper"))
    half = t_ppf(F.lit(1 - alpha), F.col("df")) * F.col("se")
    return s.select(*by, "t_lower", "t_upper", "p_lower", "p_upper", "p_value", "df", F.col("diff").alias("estimate"), (F.col("diff") - half).alias("ci_lower"), (F.col("diff") + half).alias("ci_upper"), F.lit(low).alias("bound_lower"), F.lit(high).alias("bound_upper"), (F.col("p_value") < alpha).alias("equivalent"), (F.col("n1") + F.col("n2")).alias("n"), F.lit("TOST t-test").alias("method"))


@own_names
def tost_paired_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o = options.read(opts, delta=None, bound_lower=None, bound_upper=None, alpha=0.05)
    low, high = _bounds(o, 0.5)
    alpha = float(o.alpha)
    d = F.col("x") - F.col("y")
    s = _rows(df, by, x=x, y=y).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("estimate"), F.stddev_samp(d).alias("sd")).where("n >= 2")
    se, dfree = F.col("sd") / F.sqrt("n"), F.col("n") - 1
    p = F.greatest(t_sf((F.col("estimate") - low) / se, dfree), 1 - t_sf((F.col("estimate") - high) / se, dfree))
    half = t_ppf(F.lit(1 - alpha), dfree) * se
    return s.select(*by, "estimate", (F.col("estimate") - half).alias("ci_lower"), (F.col("estimate") + half).alias("ci_upper"), p.alias("p_value"), (p < alpha).alias("equivalent"), "n", F.lit("TOST paired t-test").alias("method"))


@own_names
def tost_correlation_agg(df: DataFrame, x: str, y: str, by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Fisher's z of the correlation against both bounds around rho_null."""
    o, by = options.read(opts, rho_null=0.0, bound_lower=None, bound_upper=None, delta=None, alpha=0.05, method="pearson"), list(by)
    low, high = _bounds(o, 0.1)
    alpha, rho = float(o.alpha), float(o.rho_null)
    if str(o.method).lower() == "spearman":
        s = _ranked(df, x, y, by).groupBy(*by).agg(F.corr("rx", "ry").alias("estimate"), F.count(F.lit(1)).alias("n"))
    else:
        s = _rows(df, by, x=x, y=y).groupBy(*by).agg(F.corr("x", "y").alias("estimate"), F.count(F.lit(1)).alias("n"))
    s = s.where("n > 3").withColumn("z", F.atanh("estimate"))
    se = 1 / F.sqrt(F.col("n") - 3)
    p = F.greatest(norm_sf((F.col("z") - math.atanh(rho + low)) / se), norm_cdf((F.col("z") - math.atanh(rho + high)) / se))
    half = norm_ppf(F.lit(1 - alpha)) * se
    return s.select(*by, "estimate", F.tanh(F.col("z") - half).alias("ci_lower"), F.tanh(F.col("z") + half).alias("ci_upper"), p.alias("p_value"), (p < alpha).alias("equivalent"), "n", F.lit("TOST correlation").alias("method"))


# -- forecast evaluation --------------------------------------------------------------


def _loss_test(rows: DataFrame, by: list[str], order_by: list[str], horizon: int, harvey: bool, estimator: str = "acf") -> DataFrame:
    """Mean of d over its long-run standard deviation from horizon - 1 autocovariances."""
    mean = rows.groupBy(*by).agg(F.avg("d").alias("m"), F.count("d").alias("n"), F.var_pop("d").alias("g0")).where("n >= 3")
    if horizon > 1:
        j = join_groups(rows, mean, by).withColumn("c", F.col("d") - F.col("m"))
        w = Window.partitionBy(*by).orderBy(*order_by)
        weight = lambda k: (1 - k / horizon) if estimator == "bartlett" else 1.0
        lagged = j.select(*by, *[(F.col("c") * F.lag("c", k).over(w)).alias(f"l{k}") for k in range(1, horizon)])
        extra = lagged.groupBy(*by).agg(reduce(lambda a, b: a + b, [2 * weight(k) * F.coalesce(F.sum(f"l{k}"), F.lit(0.0)) for k in range(1, horizon)]).alias("x"))
        mean = join_groups(mean, extra, by).withColumn("g0", F.col("g0") + F.col("x") / F.col("n"))
    n = F.col("n")
    s = mean.withColumn("statistic", F.col("m") / F.sqrt(F.when(F.col("g0") > 0, F.col("g0")) / n))
    if harvey:
        s = s.withColumn("statistic", F.col("statistic") * F.sqrt((n + 1 - 2 * horizon + horizon * (horizon - 1) / n) / n))
    return s


@own_names
def diebold_mariano_agg(df: DataFrame, actual: str, forecast1: str, forecast2: str, by: list[str] = (), order_by: list[str] | None = None, opts: dict | None = None) -> DataFrame:
    """Squared or absolute loss; needs ``order_by`` for a horizon above 1."""
    o, by = options.read(opts, alternative="two_sided", loss="squared", var_estimator="acf", horizon=1), list(by)
    if int(o.horizon) > 1 and not order_by:
        raise ValueError("a horizon above 1 needs order_by: autocovariances depend on the order of rows")
    e1, e2 = double(actual) - double(forecast1), double(actual) - double(forecast2)
    d = F.abs(e1) - F.abs(e2) if o.loss == "absolute" else e1 * e1 - e2 * e2
    rows = usable(df, [actual, forecast1, forecast2]).select(*by, *(order_by or []), d.alias("d"))
    s = _loss_test(rows, by, order_by or [], int(o.horizon), True, str(o.var_estimator).lower())
    return s.select(*by, "statistic", p_value(F.col("statistic"), F.col("n") - 1, o.alternative).alias("p_value"), "n", F.lit("Diebold-Mariano test").alias("method"))


@own_names
def clark_west_agg(df: DataFrame, actual: str, restricted: str, unrestricted: str, by: list[str] = (), order_by: list[str] | None = None, opts: dict | None = None) -> DataFrame:
    """From the two error series; one-sided: the larger model forecasts better."""
    o, by = options.read(opts, horizon=1), list(by)
    if int(o.horizon) > 1 and not order_by:
        raise ValueError("a horizon above 1 needs order_by: autocovariances depend on the order of rows")
    e1, e2 = double(actual) - double(restricted), double(actual) - double(unrestricted)
    rows = usable(df, [actual, restricted, unrestricted]).select(*by, *(order_by or []), (e1 * e1 - e2 * e2 + (e1 - e2) ** 2).alias("d"))
    s = _loss_test(rows, by, order_by or [], int(o.horizon), False)
    return s.select(*by, "statistic", norm_sf(F.col("statistic")).alias("p_value"), "n", F.lit("Clark-West test").alias("method"))
