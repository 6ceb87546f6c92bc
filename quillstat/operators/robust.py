"""Robust, quantile and other likelihood fits.

Reweighted fits (Huber, quantile, Laplace, Student t) are rounds of weighted
moments over all groups at once.  Sampling fits (RANSAC, Theil-Sen) draw their
subsets from a bounded random share of a group; what counts rows counts all.
Isotonic regression runs a short NumPy kernel on a group's distinct values.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from quillstat.functions import dist, options
from quillstat.functions.columns import norm_cdf
from quillstat.operators import glm
from quillstat.operators.linear import predicted, training
from quillstat.plans.moments import double, join_groups, usable, weighted_moments_once
from quillstat.plans.newton import add, linear_predictor, newton, parameter
from quillstat.plans.order import TASK_ROWS, blocked, by_blocks, halo, medians, placed, tasks
from quillstat.plans.solve import CONSTANT, Stack, sweep
from quillstat.sources.tables import settled, settled_groups

BASE = dict(fit_intercept=True, compute_inference=False, confidence_level=0.95, null_policy="drop")
HUBER = BASE | dict(epsilon=1.35, alpha=1e-4, max_iterations=100, tolerance=1e-5)
QUANTILE = BASE | dict(tau=0.5, max_iterations=60, tolerance=1e-8)
RANSAC = BASE | dict(max_trials=100, stop_probability=0.99, random_state=42, min_samples=None, residual_threshold=None, stop_n_inliers=None)
THEILSEN = BASE | dict(max_subpopulation=10_000, max_iterations=300, tolerance=1e-3, random_state=42, n_subsamples=None)


def _named(df: DataFrame, y: str, x: list[str], by: list[str]) -> tuple[DataFrame, list[str]]:
    xs = [f"__x{i}" for i in range(len(x))]
    return usable(df, [y, *x]).select(*by, double(y).alias("__y"), *[double(c).alias(k) for c, k in zip(x, xs, strict=True)]), xs


def _weighted_solver(p: int, intercept: bool, ridge: float):
    def run(m: pd.DataFrame) -> pd.DataFrame:
        s = Stack(m, intercept)
        inv, ok = sweep(s.gram + np.eye(p) * ridge * (~s.constant)[:, :, None])
        b = np.where(ok, np.einsum("gij,gj->gi", inv, s.xy), np.nan)
        first = s.ybar - (np.nan_to_num(b) * s.xbar).sum(axis=1) if intercept else np.full(len(b), np.nan)
        return pd.DataFrame({"coefficients": list(b), "intercept": first, "n": s.n.astype("int64")})

    return F.pandas_udf(run, "coefficients array<double>, intercept double, n long")


def reweighted(rows: DataFrame, xs: list[str], by: list[str], intercept: bool, weigh: Callable[[DataFrame], DataFrame], ridge: float = 0.0, iterations: int = 50, tolerance: float = 1e-8) -> DataFrame:
    """(by, r): struct of coefficients, intercept and n, after rounds of weighted least squares.

    ``weigh`` gets the rows with __e, the residual, and adds __w.
    """
    solver = _weighted_solver(len(xs), intercept, ridge)
    cols = ["__y", *xs]
    centre = settled_groups(rows.groupBy(*by).agg(F.array(*[F.avg(c) if intercept else F.lit(0.0) for c in cols]).alias("__c")))
    rows = join_groups(rows, centre, by).withColumns({c: F.col(c) - F.get("__c", F.lit(i)) for i, c in enumerate(cols)}).drop("__c")

    def fit(r: DataFrame) -> DataFrame:
        m = weighted_moments_once(r, "__y", xs, by, "__w")
        r = solver(F.struct(*[c for c in m.columns if c not in by]))
        kept = F.transform("r.coefficients", lambda v: F.coalesce(v, F.lit(float("nan"))))  # else a constant feature makes nulls of all
        return settled_groups(m.select(*by, r.alias("r")).select(*by, F.struct(kept.alias("coefficients"), "r.intercept", "r.n").alias("r")))

    state = fit(rows.withColumn("__w", F.lit(1.0)))
    for _ in range(iterations):
        j = join_groups(rows, state.withColumnRenamed("r", "__r"), by)
        j = j.withColumn("__e", F.col("__y") - predicted(xs, "__r")).drop("__r")
        new = fit(weigh(j))
        both = join_groups(new, state.withColumnRenamed("r", "o"), by)
        flat = lambda c: F.concat(F.array(F.nanvl(F.col(f"{c}.intercept"), F.lit(0.0))), F.col(f"{c}.coefficients"))
        moved = F.aggregate(F.arrays_zip(flat("r").alias("a"), flat("o").alias("b")), F.lit(0.0), lambda m, z: F.greatest(m, F.nanvl(F.abs(z["a"] - z["b"]) / (1 + F.abs(z["b"])), F.lit(0.0))))
        most = both.agg(F.max(moved)).first()[0]
        state = new
        if most is None or most < tolerance:
            break
    out = join_groups(state, centre, by)
    shift = F.get("__c", F.lit(0)) - add([F.lit(0.0), *[F.nanvl(F.get("r.coefficients", F.lit(i)), F.lit(0.0)) * F.get("__c", F.lit(i + 1)) for i in range(len(xs))]])
    return settled_groups(out.select(*by, F.struct("r.coefficients", (F.col("r.intercept") + shift).alias("intercept"), "r.n").alias("r")))


def _statistics(rows: DataFrame, fits: DataFrame, xs: list[str], by: list[str], *more: Column) -> DataFrame:
    """Fits with r_squared and the like from one more pass."""
    fits = settled_groups(fits)
    j = join_groups(rows, fits.withColumnRenamed("r", "__r"), by)
    j = j.withColumn("__e", F.col("__y") - predicted(xs, "__r"))
    n, k = F.count(F.lit(1)), len(xs)
    s = j.groupBy(*by).agg(n.alias("n"), F.sum(F.col("__e") ** 2).alias("rss"), (F.var_pop("__y") * n).alias("sst"), *more)
    s = join_groups(s, fits, by)
    r2 = F.when(F.col("sst") > 0, 1 - F.col("rss") / F.col("sst")).otherwise(0.0)
    df = F.col("n") - k - 1
    return s.withColumns({"r_squared": r2, "adj_r_squared": 1 - (1 - r2) * (F.col("n") - 1) / F.when(df > 0, df), "residual_std_error": F.sqrt(F.col("rss") / F.when(df > 0, df))})


def _huber(rows: DataFrame, xs: list[str], by: list[str], o) -> DataFrame:
    cut = float(o.epsilon)
    if cut <= 1:
        raise ValueError("option epsilon must be above 1")

    n = settled(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")))
    total, most, small = n.agg(F.sum("__n"), F.max("__n"), F.count_if(F.col("__n") <= SMALL)).first()

    def weigh(j: DataFrame) -> DataFrame:
        scale = j.groupBy(*by).agg((F.median(F.abs("__e")) / 0.6744897501960817).alias("__s"))
        j = join_groups(j, scale, by)
        r = F.abs("__e") / F.greatest(F.col("__s"), F.lit(1e-12))
        return j.withColumn("__w", F.when(r <= cut, 1.0).otherwise(cut / r)).drop("__s")

    rounds = lambda part: reweighted(part, xs, by, bool(o.fit_intercept), weigh, float(o.alpha), int(o.max_iterations), float(o.tolerance))
    if not total or not small:
        return rounds(rows)
    if most <= SMALL:
        return settled_groups(_huber_buckets(rows, xs, by, o, total))
    marked = join_groups(rows, settled_groups(n.where(F.col("__n") > SMALL).select(*by, F.lit(True).alias("__large"))), by)
    fits = _huber_buckets(marked.where("__large IS NULL").drop("__large"), xs, by, o, total)
    return settled_groups(fits.unionByName(rounds(marked.where("__large").drop("__large"))))


#: Groups of up to this many rows are fitted side by side in NumPy, larger ones by rounds of aggregates.
SMALL = 8_192
#: Rows of small groups that a kernel gets, and numbers that one of its arrays holds per column.
BUCKET_ROWS, CELLS = 65_536, 131_072


def _group_numbers(table: pa.Table, by: list[str]) -> np.ndarray:
    """A number per row, the same for rows with equal keys."""
    at = np.zeros(len(table), dtype=np.int64)
    for c in by:
        codes = table[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        at = np.unique(at * (codes.max(initial=0) + 1) + codes, return_inverse=True)[1].reshape(-1)
    return at


def _huber_buckets(rows: DataFrame, xs: list[str], by: list[str], o, total: int) -> DataFrame:
    """(by, r) as from ``reweighted``, for groups that one task can hold: rows are dealt to buckets of whole groups once, and all rounds run there."""
    key = F.pmod(F.xxhash64(*by), F.lit(max(1, math.ceil(total / BUCKET_ROWS)))) if by else F.lit(0)
    n_tasks = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total / TASK_ROWS))

    def run(table: pa.Table) -> pa.Table:
        at = _group_numbers(table, by)
        order = np.argsort(at, kind="stable")
        begin = np.flatnonzero(np.diff(at[order], prepend=-1))
        size = np.diff(begin, append=len(order))
        v = np.column_stack([table[c].to_numpy() for c in ("__y", *xs)])[order]
        b, first = np.empty((len(size), len(xs))), np.empty(len(size))
        by_size = np.argsort(-size, kind="stable")
        i = 0
        while i < len(by_size):
            k = by_size[i : i + max(1, CELLS // int(size[by_size[i]]))]
            i += len(k)
            places = np.arange(size[k[0]])
            real = places < size[k][:, None]
            b[k], first[k] = _huber_groups(v[np.where(real, begin[k][:, None] + places, begin[k][:, None])], real, o)
        fits = {"coefficients": pa.array(b.tolist(), pa.list_(pa.float64())), "intercept": pa.array(first, mask=np.isnan(first)), "n": pa.array(size.astype("int64"))}
        return pa.table({c: table[c].take(pa.array(order[begin])) for c in by} | {"r": pa.StructArray.from_arrays(list(fits.values()), list(fits))})

    r = StructType([StructField("coefficients", ArrayType(DoubleType())), StructField("intercept", DoubleType()), StructField("n", LongType())])
    schema = StructType([*[rows.schema[c] for c in by], StructField("r", r)])
    return rows.withColumn("__bucket", key).repartition(n_tasks, "__bucket").groupBy("__bucket").applyInArrow(run, schema)


def _huber_groups(v: np.ndarray, real: np.ndarray, o) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of groups x rows x (y, x...); rows that aren't ``real`` repeat the group's first.

    The rounds of ``reweighted``, for each group until one round after it moved
    less than the tolerance.
    """
    intercept, p, cut = bool(o.fit_intercept), v.shape[2] - 1, float(o.epsilon)
    n = real.sum(axis=1)
    constant = (v[:, :, 1:].max(axis=1) - v[:, :, 1:].min(axis=1)) < CONSTANT
    centre = (v * real[:, :, None]).sum(axis=1) / n[:, None] if intercept else np.zeros((len(v), p + 1))
    v = v - centre[:, None]
    ridge = np.eye(p) * float(o.alpha) * (~constant)[:, :, None]
    half = np.stack([(n - 1) // 2, n // 2], axis=1)

    def fit(v, w, at):
        sums = np.einsum("gm,gmi->gi", w, v)
        products = np.matmul((v * w[:, :, None]).transpose(0, 2, 1), v)
        mean = sums / w.sum(axis=1)[:, None]
        if intercept:
            products -= sums[:, :, None] * mean[:, None]
        free = ~constant[at]
        inverse, ok = sweep(products[:, 1:, 1:] * free[:, :, None] * free[:, None] + ridge[at])
        b = np.where(ok, np.einsum("gij,gj->gi", inverse, products[:, 1:, 0] * free), np.nan)
        return np.column_stack([mean[:, 0] - (np.nan_to_num(b) * mean[:, 1:]).sum(axis=1) if intercept else np.zeros(len(b)), b])

    live = np.arange(len(v))
    b = fit(v, real.astype(float), live)
    ending = np.zeros(len(v), bool)
    for _ in range(int(o.max_iterations)):
        vl, rl = v[live], real[live]
        t = np.nan_to_num(b[live])
        e = np.abs(vl[:, :, 0] - t[:, :1] - np.matmul(vl[:, :, 1:], t[:, 1:, None])[:, :, 0])
        s = np.take_along_axis(np.sort(np.where(rl, e, np.inf), axis=1), half[live], axis=1).mean(axis=1) / 0.6744897501960817
        limit = cut * np.maximum(s, 1e-12)[:, None]
        new = fit(vl, np.where(e <= limit, 1.0, limit / np.maximum(e, 1e-300)) * rl, live)
        moved = np.nan_to_num(np.abs(new - b[live]) / (1 + np.abs(b[live]))).max(axis=1)
        b[live] = new
        done = ending[live]
        ending[live] = moved < float(o.tolerance)
        live = live[~(done & ending[live])]
        if not len(live):
            break
    first = b[:, 0] + centre[:, 0] - (np.nan_to_num(b[:, 1:]) * centre[:, 1:]).sum(axis=1) if intercept else np.full(len(b), np.nan)
    return b[:, 1:], first


def huber_fit_agg(df: DataFrame, y: str, x: list[str], by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Huber's M-estimate with the scale by the median absolute residual; counts residuals beyond epsilon scales."""
    o, by = options.read(opts, **HUBER), list(by)
    rows, xs = _named(df, y, x, by)
    fits = _huber(rows, xs, by, o)
    s = settled_groups(_statistics(rows, fits, xs, by, (F.median(F.abs("__e")) / 0.6744897501960817).alias("scale")))
    j = join_groups(rows, s.select(*by, F.col("r").alias("__r"), "scale"), by)
    out = j.groupBy(*by).agg(F.count_if(F.abs(F.col("__y") - predicted(xs, "__r")) > float(o.epsilon) * F.col("scale")).cast("int").alias("n_outliers"))
    s = join_groups(s, out, by).where(F.col("n") >= len(x) + 1)
    return s.select(*by, "r.coefficients", "r.intercept", "r_squared", "adj_r_squared", "residual_std_error", F.col("n").alias("n_observations"), F.lit(len(x)).alias("n_features"), "scale", "n_outliers")


def _quantile(rows: DataFrame, xs: list[str], by: list[str], tau: float, intercept: bool, iterations: int, tolerance: float) -> DataFrame:
    if not 0 < tau < 1:
        raise ValueError("option tau must lie between 0 and 1")

    rows = join_groups(rows, settled_groups(rows.groupBy(*by).agg(F.greatest(F.coalesce(F.stddev_samp("__y"), F.lit(0.0)) * 1e-6, F.lit(1e-12)).alias("__least"))), by)

    def weigh(j: DataFrame) -> DataFrame:
        return j.withColumn("__w", F.when(F.col("__e") > 0, tau).otherwise(1 - tau) / F.greatest(F.abs("__e"), F.col("__least")))

    return reweighted(rows, xs, by, intercept, weigh, 0.0, iterations, tolerance)


def quantile_fit_agg(df: DataFrame, y: str, x: list[str], by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """Quantile regression by majorising the check loss with weighted squares."""
    o, by = options.read(opts, **QUANTILE), list(by)
    rows, xs = _named(df, y, x, by)
    s = _statistics(rows, _quantile(rows, xs, by, float(o.tau), bool(o.fit_intercept), int(o.max_iterations), float(o.tolerance)), xs, by)
    return s.select(*by, "r.coefficients", "r.intercept", F.lit(float(o.tau)).alias("tau"), F.col("n").alias("n_observations"), F.lit(len(x)).alias("n_features"))


# -- sampling fits ------------------------------------------------------------------------


def _design(pdf: pd.DataFrame, xs: list[str], intercept: bool) -> tuple[np.ndarray, np.ndarray]:
    x = pdf[xs].to_numpy(float)
    return (np.column_stack([np.ones(len(x)), x]) if intercept else x), pdf["__y"].to_numpy(float)


def ransac_candidates(z: np.ndarray, y: np.ndarray, o) -> np.ndarray:
    """(trials, coefficients): least squares on random subsets of the rows."""
    rng, n = np.random.default_rng(int(o.random_state)), len(y)
    size = min(int(o.min_samples or z.shape[1]), n)
    picks = [rng.choice(n, size, replace=False) for _ in range(int(o.max_trials))]
    return np.array([np.linalg.lstsq(z[k], y[k], rcond=None)[0] for k in picks])


def ransac_choice(hits: np.ndarray, n: int, size: int, o) -> tuple[int, int]:
    """(best trial, trials until the stopping rule holds) from the inliers that each trial found among n rows."""
    best, trials, need = 0, 0, int(o.max_trials)
    while trials < min(need, len(hits)):
        h = int(hits[trials])
        if trials == 0 or h > hits[best]:
            best = trials
            share = min(1 - 1e-12, max(1e-12, (h / n) ** size))
            need = math.ceil(math.log(1 - float(o.stop_probability)) / math.log(1 - share)) if share > 1e-9 else need
            if o.stop_n_inliers is not None and h >= int(o.stop_n_inliers):
                return best, trials + 1
        trials += 1
    return best, trials


def ransac_kernel(z: np.ndarray, y: np.ndarray, o) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(coefficients on inliers, inliers, threshold, trials) of rows at hand: for the array form."""
    threshold = float(o.residual_threshold) if o.residual_threshold is not None else float(np.median(np.abs(y - np.median(y))))
    inliers = np.abs(y[:, None] - z @ ransac_candidates(z, y, o).T) <= threshold
    best, trials = ransac_choice(inliers.sum(axis=0), len(y), int(o.min_samples or z.shape[1]), o)
    good = inliers[:, best]
    if good.sum() < z.shape[1]:
        good[:] = True
    return np.linalg.lstsq(z[good], y[good], rcond=None)[0], good, threshold, trials


def theilsen_kernel(z: np.ndarray, y: np.ndarray, o) -> np.ndarray:
    """Spatial median of exact fits to subsets: all pairs of rows while they are few, else random subsets."""
    rng = np.random.default_rng(int(o.random_state))
    n, size = len(y), int(o.n_subsamples or z.shape[1])
    most = int(o.max_subpopulation)
    if math.comb(n, size) <= most:
        picks = _subsets(n, size)
    else:
        picks = np.argsort(rng.random((most, n)), axis=1)[:, :size] if n <= 200 else np.stack([rng.choice(n, size, replace=False) for _ in range(most)])
    a, c = z[picks], y[picks]
    b = np.einsum("mij,mj->mi", np.linalg.pinv(a), c)
    m = np.median(b, axis=0)
    for _ in range(int(o.max_iterations)):
        d = np.maximum(np.linalg.norm(b - m, axis=1), 1e-12)
        new = (b / d[:, None]).sum(axis=0) / (1 / d).sum()
        done = np.linalg.norm(new - m) < float(o.tolerance) * 1e-3
        m = new
        if done:
            break
    return m


#: For each row that subsets take, this many rows are drawn at random to take them from.
SPARE = 4


def _sampled(df: DataFrame, y: str, x: list[str], by: list[str], kind: str, o) -> DataFrame:
    """(by, r) of RANSAC or Theil-Sen.

    Both fit random subsets, so a kernel needs only the rows to draw them from:
    all of a small group, a random share of a large one.  RANSAC then counts the
    inliers of every trial, and fits those of the best, over all rows by
    aggregates.
    """
    rows, xs = _named(df, y, x, by)
    p = len(x) + int(bool(o.fit_intercept))
    size = int((o.min_samples if kind == "ransac" else o.n_subsamples) or p)
    wanted = SPARE * size * int(o.max_trials if kind == "ransac" else o.max_subpopulation)
    counts = settled_groups(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= max(p, 1)))
    drawn = join_groups(rows, counts, by).where(F.rand(int(o.random_state)) * F.col("__n") < wanted).drop("__n")
    keys = [f.simpleString().replace(":", " ") for f in rows.select(*by).schema.fields]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        z, v = _design(pdf.sort_values(["__y", *xs]), xs, bool(o.fit_intercept))
        got = ransac_candidates(z, v, o) if kind == "ransac" else theilsen_kernel(z, v, o)[None]
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], got.tolist()]], columns=[*by, "__b"])

    grouped = drawn.groupBy(*by) if by else drawn.groupBy()
    fits = settled_groups(grouped.applyInPandas(run, ", ".join([*keys, "__b array<array<double>>"])))
    if kind == "ransac":
        return _ransac(rows, fits, counts, xs, by, o, p, size)
    k, b = int(bool(o.fit_intercept)), F.get("__b", F.lit(0))
    first = F.get(b, F.lit(0)) if k else F.lit(float("nan"))
    none = [F.lit(float("nan")).alias("residual_threshold"), F.lit(0).alias("n_inliers"), F.lit(0).alias("n_trials")]
    return join_groups(fits, counts, by).select(*by, F.struct(F.slice(b, 1 + k, len(x)).alias("coefficients"), first.alias("intercept"), F.col("__n").alias("n"), *none).alias("r"))


def _residual(xs: list[str], b: str, intercept: bool) -> Column:
    k = int(intercept)
    return F.col("__y") - add([F.get(b, F.lit(0)) if k else F.lit(0.0), *[F.get(b, F.lit(i + k)) * F.col(c) for i, c in enumerate(xs)]])


def _ransac(rows: DataFrame, trials: DataFrame, counts: DataFrame, xs: list[str], by: list[str], o, p: int, size: int) -> DataFrame:
    intercept = bool(o.fit_intercept)
    if o.residual_threshold is not None:
        limits = counts.withColumn("__limit", F.lit(float(o.residual_threshold)))
    else:
        off = join_groups(rows, medians(rows, by, "__y", "__m"), by).withColumn("__d", F.abs(F.col("__y") - F.col("__m")))
        limits = settled_groups(join_groups(counts, medians(off, by, "__d", "__limit"), by))

    def choose(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([ransac_choice(np.asarray(h), int(m), size, o) for h, m in zip(hits, n, strict=True)], columns=["best", "trials"])

    every = join_groups(join_groups(rows, limits, by), trials, by).select("*", F.posexplode("__b").alias("__i", "__t")).drop("__b")
    hit = F.when(F.abs(_residual(xs, "__t", intercept)) <= F.col("__limit"), 1).otherwise(0)
    hits = every.groupBy(*by, "__i").agg(F.sum(hit).alias("__h"))
    # one number a trial and group: their count is max_trials
    hits = hits.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__h"))), lambda s: s["__h"]).alias("__hits"))
    j = join_groups(join_groups(hits, limits, by), trials, by).withColumn("__c", F.pandas_udf(choose, "best int, trials int")("__hits", "__n"))
    found = F.get("__hits", F.col("__c.best"))
    j = j.select(*by, "__n", "__limit", F.col("__c.trials").alias("__trials"), F.get("__b", F.col("__c.best")).alias("__t"), found.alias("__found"))
    best = settled_groups(j)
    near = join_groups(rows, best, by).where((F.abs(_residual(xs, "__t", intercept)) <= F.col("__limit")) | (F.col("__found") < p))
    fit = reweighted(near.select(*by, "__y", *xs), xs, by, intercept, weigh=lambda d: d, iterations=0)
    inliers = F.when(F.col("__found") < p, F.col("__n")).otherwise(F.col("__found")).cast("int")
    r = F.struct("r.coefficients", "r.intercept", F.col("__n").alias("n"), F.col("__limit").alias("residual_threshold"), inliers.alias("n_inliers"), F.col("__trials").alias("n_trials"))
    return settled_groups(join_groups(fit, best, by).select(*by, r.alias("r")))


def sampled_fit_agg(df: DataFrame, kind: str, y: str, x: list[str], by: list[str] = (), opts: dict | None = None) -> DataFrame:
    o, by = options.read(opts, **(RANSAC if kind == "ransac" else THEILSEN)), list(by)
    rows, xs = _named(df, y, x, by)
    s = _statistics(rows, _sampled(df, y, x, by, kind, o), xs, by)
    more = ["r.residual_threshold", "r.n_inliers", "r.n_trials"] if kind == "ransac" else []
    return s.select(*by, "r.coefficients", "r.intercept", "r_squared", "adj_r_squared", "residual_std_error", F.col("n").alias("n_observations"), F.lit(len(x)).alias("n_features"), *more)


def isotonic_fit_predict_by(df: DataFrame, y: str, x: str, by: list[str] = (), split: str | None = None, opts: dict | None = None) -> DataFrame:
    """Monotone fit by pooling adjacent violators; x beyond the data takes the nearest fitted value.

    Rows are first summed per distinct x, so a task pools distinct values only.
    """
    o, by = options.read(opts, increasing=True), list(by)
    rows = df.withColumn("is_training", training(df, y, [x], split))
    sums = rows.where("is_training").groupBy(*by, double(x).alias("__x")).agg(F.avg(double(y)).alias("__m"), F.count(F.lit(1)).cast("double").alias("__n"))
    sign = 1.0 if o.increasing else -1.0

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__x")
        level: list[list[float]] = []
        for m, n in zip(sign * pdf["__m"].to_numpy(), pdf["__n"].to_numpy(), strict=True):
            level.append([m, n, 1])
            while len(level) > 1 and level[-2][0] >= level[-1][0]:
                b, a = level.pop(), level.pop()
                n2 = a[1] + b[1]
                level.append([(a[0] * a[1] + b[0] * b[1]) / n2, n2, a[2] + b[2]])
        fit = sign * np.repeat([v[0] for v in level], [v[2] for v in level])
        return pd.DataFrame([[*[pdf[c].iloc[0] for c in by], pdf["__x"].tolist(), fit.tolist()]], columns=[*by, "__k", "__f"])

    keys = [f.simpleString().replace(":", " ") for f in sums.select(*by).schema.fields]
    curves = (sums.groupBy(*by) if by else sums.groupBy()).applyInPandas(pool, ", ".join([*keys, "__k array<double>, __f array<double>"]))
    j = join_groups(rows, curves, by)

    def lookup(v: pd.Series, k: pd.Series, f: pd.Series) -> pd.Series:
        return pd.Series([np.nan if a is None or np.isnan(a) or kk is None else float(np.interp(a, kk, ff)) for a, kk, ff in zip(v, k, f, strict=True)])

    return j.select(*df.columns, F.pandas_udf(lookup, "double")(double(x), "__k", "__f").alias("yhat"), "is_training")


def fit_predict_by(df: DataFrame, kind: str, y: str, x: list[str], by: list[str] = (), split: str | None = None, opts: dict | None = None) -> DataFrame:
    """All rows with yhat, its interval and is_training, for huber, ransac, theilsen, quantile and alm."""
    from quillstat.functions.columns import t_ppf

    by = list(by)
    o = options.read(opts, **{"huber": HUBER, "ransac": RANSAC, "theilsen": THEILSEN, "quantile": QUANTILE, "alm": ALM}[kind])
    rows = df.withColumn("is_training", training(df, y, x, split, o.null_policy))
    train = rows.where("is_training")
    named, xs = _named(train, y, x, by)
    if kind == "huber":
        fits = _huber(named, xs, by, o)
    elif kind == "quantile":
        fits = _quantile(named, xs, by, float(o.tau), bool(o.fit_intercept), int(o.max_iterations), float(o.tolerance))
    elif kind == "alm":
        a = alm_fit_agg(train, y, x, by, {k: v for k, v in (opts or {}).items() if k != "null_policy"})
        fits = a.select(*by, F.struct("coefficients", "intercept", F.col("n_observations").alias("n"), "scale").alias("r"))
    else:
        fits = _sampled(train, y, x, by, kind, o)
    s = _statistics(named, fits, xs, by).where(F.col("n") >= 2)
    sigma = F.col("r.scale") if kind == "alm" else F.col("residual_std_error")
    s = s.select(*by, F.struct("r.coefficients", "r.intercept", sigma.alias("s"), "n").alias("__r"))
    s = settled_groups(s.withColumn("__q", t_ppf(F.lit(0.5 + float(o.confidence_level) / 2), F.greatest(F.lit(1.0), F.col("__r.n") - len(x) - int(o.fit_intercept)))))
    j = join_groups(rows, s, by)
    known = F.lit(True)
    for c in x:
        known = known & F.col(c).isNotNull()
    j = j.withColumn("yhat", F.when(known & F.col("__r").isNotNull(), predicted(x, "__r")))
    if kind == "quantile":
        return j.select(*df.columns, "yhat", "is_training")
    wide = F.when((F.col("__r.s") > 0) & (F.col("__r.n") > len(x) + 1), F.col("__q") * F.col("__r.s") * F.sqrt(1 + 1 / F.col("__r.n"))).otherwise(0.0)
    return j.select(*df.columns, "yhat", (F.col("yhat") - wide).alias("yhat_lower"), (F.col("yhat") + wide).alias("yhat_upper"), "is_training")


# -- robust fits over window frames ------------------------------------------------------


def _solved(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solutions of many small systems; singular ones by least norm."""
    p = a.shape[-1]
    size = np.abs(a).max(axis=(-2, -1), initial=0.0) ** p
    det = a[..., 0, 0] if p == 1 else a[..., 0, 0] * a[..., 1, 1] - a[..., 0, 1] * a[..., 1, 0] if p == 2 else np.linalg.det(a)
    flat = ~(np.abs(det) > 1e-12 * size)
    if p == 1:
        out = c / np.where(flat, 1.0, det)[..., None]
    elif p == 2:
        top = np.stack([c[..., 0] * a[..., 1, 1] - c[..., 1] * a[..., 0, 1], a[..., 0, 0] * c[..., 1] - a[..., 1, 0] * c[..., 0]], axis=-1)
        out = top / np.where(flat, 1.0, det)[..., None]
    else:
        out = np.linalg.solve(np.where(flat[..., None, None], np.eye(p), a), c[..., None])[..., 0]
    if flat.any():
        out[flat] = np.einsum("mij,mj->mi", np.linalg.pinv(a[flat]), c[flat])
    return out


def _stacked_least_squares(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted fits of many frames at once: frames x rows x coefficients."""
    zw = z * w[:, :, None]
    return _solved(np.matmul(zw.transpose(0, 2, 1), z), np.matmul(zw.transpose(0, 2, 1), y[:, :, None])[:, :, 0])


def _row_median(v: np.ndarray) -> np.ndarray:
    n = v.shape[-1]
    v = np.sort(v, axis=-1)
    return (v[..., (n - 1) // 2] + v[..., n // 2]) / 2


def _huber_frames(z, y, o, most) -> np.ndarray:
    b = _stacked_least_squares(z, y, np.ones_like(y))
    live = np.arange(len(z))  # frames that still move
    for _ in range(int(o.max_iterations)):
        zl, yl = z[live], y[live]
        e = np.abs(yl - np.matmul(zl, b[live][:, :, None])[:, :, 0])
        s = np.maximum(_row_median(e) / 0.6744897501960817, 1e-12)[:, None]
        new = _stacked_least_squares(zl, yl, np.where(e <= o.epsilon * s, 1.0, o.epsilon * s / np.maximum(e, 1e-300)))
        moved = np.abs(new - b[live]).max(axis=1, initial=0.0)
        b[live] = new
        live = live[~(moved < float(o.tolerance))]
        if not len(live):
            break
    return b


@lru_cache(maxsize=256)
def _subsets(n: int, size: int) -> np.ndarray:
    """All subsets of n rows, as places."""
    return np.array(list(combinations(range(n), size)))


@lru_cache(maxsize=256)
def _drawn(n: int, most: int, size: int, trials: int, seed: int) -> np.ndarray:
    """(trials, size) places among n rows, the same draw for every frame of n rows."""
    draw = np.random.default_rng(seed).random((trials, most))
    return np.argsort(draw[:, :n], axis=1)[:, :size]


def _subset_fits(z, y, picks) -> np.ndarray:
    a, c = np.take(z, picks, axis=1), np.take(y, picks, axis=1)
    if a.shape[2] != a.shape[3]:
        a, c = np.einsum("ftri,ftrj->ftij", a, a), np.einsum("ftri,ftr->fti", a, c)
    return _solved(a, c)


def _ransac_frames(z, y, o, most) -> np.ndarray:
    size = int(o.min_samples or z.shape[2])
    b = _subset_fits(z, y, _drawn(y.shape[1], most, size, int(o.max_trials), int(o.random_state)))
    limit = np.full(len(z), float(o.residual_threshold)) if o.residual_threshold is not None else _row_median(np.abs(y - _row_median(y)[:, None]))
    good = np.abs(y[:, None] - np.matmul(b, z.transpose(0, 2, 1))) <= limit[:, None, None]
    best = good[np.arange(len(z)), good.sum(axis=2).argmax(axis=1)]
    best[best.sum(axis=1) < z.shape[2]] = True
    return _stacked_least_squares(z, y, best.astype(float))


def _all_subsets(n: int, p: int, o) -> np.ndarray | None:
    """All subsets of n rows that Theil-Sen fits, unless they are more than the option max_subpopulation."""
    size = min(int(o.n_subsamples or p), n)
    return _subsets(n, size) if math.comb(n, size) <= int(o.max_subpopulation) else None


def _theilsen_frames(z, y, o, most) -> np.ndarray:
    """As theilsen_kernel: all subsets of a frame's rows, or the option's number of random ones if there are more."""
    n, p = z.shape[1:]
    picks = _all_subsets(n, p, o)
    if picks is None:
        picks = _drawn(n, most, min(int(o.n_subsamples or p), n), int(o.max_subpopulation), int(o.random_state))
    return _spatial_medians(np.ascontiguousarray(_subset_fits(z, y, picks).transpose(0, 2, 1)), o)


def _shared_fits(z, y, first: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """(frames, coefficients, subsets) of frames that begin at the rows ``first``: a subset that many frames have is fitted once."""
    shapes, shape = np.unique(picks - picks[:, :1], axis=0, return_inverse=True)
    least = int(first.min())
    n = int(first.max()) + int(picks.max()) + 1 - least
    each = np.minimum(np.arange(n)[:, None, None] + shapes, n - 1).reshape(-1, shapes.shape[1])
    fits = _subset_fits(z[None, least : least + n], y[None, least : least + n], each)[0]
    at = ((first - least) * len(shapes))[:, None] + (picks[:, 0] * len(shapes) + shape.reshape(-1))
    return np.stack([np.take(np.ascontiguousarray(c), at) for c in fits.T], axis=1)


def _spatial_medians(b: np.ndarray, o) -> np.ndarray:
    """The spatial median over the last axis of (frames, coefficients, subsets)."""
    m = np.median(b, axis=2)
    live = np.arange(len(b))  # frames that still move
    for _ in range(int(o.max_iterations)):
        bl, ml = (b, m) if len(live) == len(b) else (b[live], m[live])
        d = 1 / np.maximum(np.sqrt(((bl - ml[:, :, None]) ** 2).sum(axis=1)), 1e-12)
        new = np.matmul(bl, d[:, :, None])[:, :, 0] / d.sum(axis=1)[:, None]
        moved = np.abs(new - ml).max(axis=1, initial=0.0)
        m[live] = new
        live = live[~(moved < float(o.tolerance) * 1e-3)]
        if not len(live):
            break
    return m


#: Rows of frames that one step of a kernel holds.
FRAME_STEP = 512


def fit_predict_window(df: DataFrame, kind: str, y: str, x: list[str], by: list[str], order_by: list[str], frame: tuple[int, int] = (-29, 0), predict_x: str = "frame_last", opts: dict | None = None, keep: list[str] | None = None, over: dict[str, Callable[[WindowSpec], Column]] | None = None) -> DataFrame:
    """All rows with yhat of the Huber, RANSAC or Theil-Sen fit of their frame of (start, end) rows.

    These fits need the rows of a frame, not only their sums, so the frame must
    be bounded on both sides.  A group is cut into blocks of its order that have
    the rows of their frames at hand; frames of as many usable rows are fitted
    many at once in NumPy, each until it no longer moves.  A frame needs more
    usable rows than coefficients, else yhat is null.  ``predict_x`` as in the
    linear family.  ``keep`` names the columns that the result has (all if it
    isn't given): others are not stored.  ``over`` gives more columns over the
    same frames, from those that are kept.
    """
    if frame[0] is None or frame[1] is None:
        raise ValueError("a robust fit over a window needs a frame that is bounded on both sides")
    o, by = options.read(opts, **{"huber": HUBER, "ransac": RANSAC, "theilsen": THEILSEN}[kind]), list(by)
    kernel = {"huber": _huber_frames, "ransac": _ransac_frames, "theilsen": _theilsen_frames}[kind]
    ok = training(df, y, x, None, o.null_policy)
    for c in (y, *x):
        ok = ok & F.coalesce(~F.isnan(double(c)) & (F.abs(double(c)) != float("inf")), F.lit(False))
    names = ["__y", *[f"__x{i}" for i in range(len(x))]]
    keep, over = list(df.columns if keep is None else keep), over or {}
    shared = _all_subsets(frame[1] - frame[0] + 1, len(x) + int(o.fit_intercept), o) if kind == "theilsen" else None
    rows = placed(df.withColumns({"__ok": ok} | {k: double(c) for k, c in zip(names, (y, *x), strict=True)}), by, order_by, [*keep, *names, "__ok"])
    behind, ahead = halo(frame)
    w = Window.partitionBy(*by, "__block").orderBy("__pos").rowsBetween(*frame)
    blocks = by_blocks(blocked(rows, behind, ahead), by, tasks(rows)).withColumns({k: c(w) for k, c in over.items()})
    intercept, p, most, (start, end), columns = bool(o.fit_intercept), len(x), frame[1] - frame[0] + 1, frame, [*keep, *over]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("__pos")
        v = np.column_stack([table[c].to_numpy() for c in names])
        own, usable_ = (table[c].to_numpy() for c in ("__own", "__ok"))
        mine, rows = np.flatnonzero(own), len(v)
        last = np.minimum(mine + end, rows - 1)
        seen = (last >= 0) & (last >= mine + start)
        at = v[mine if predict_x == "current" else np.where(seen, last, 0), 1:]
        padded = np.pad(np.where(usable_[:, None], v, 0.0), ((behind, ahead), (0, 0)))
        frames = np.lib.stride_tricks.sliding_window_view(padded, most, axis=0).transpose(0, 2, 1)
        whole = np.column_stack([*([np.ones(len(padded))] if intercept else []), padded[:, 1:]])
        good = np.lib.stride_tricks.sliding_window_view(np.pad(usable_, (behind, ahead)), most)
        first = mine + behind + start
        n = good[first].sum(axis=1)
        fits = (n > p + int(intercept)) & ~np.isnan(at).any(axis=1) & (seen | (predict_x == "current"))
        out = np.full(len(mine), np.nan)
        for m in np.unique(n[fits]):
            todo = np.flatnonzero(fits & (n == m))
            for i in range(0, len(todo), FRAME_STEP):
                k = todo[i : i + FRAME_STEP]
                with np.errstate(all="ignore"):
                    if shared is not None and m == most and np.ptp(first[k]) < 2 * FRAME_STEP:
                        b = _spatial_medians(_shared_fits(whole, padded[:, 0], first[k], shared), o)
                    else:
                        f = frames[first[k]]
                        f = (f if m == most else f[good[first[k]]]).reshape(len(k), m, p + 1)
                        z = np.concatenate([np.ones((len(k), m, 1)), f[:, :, 1:]], axis=2) if intercept else f[:, :, 1:].copy()
                        b = kernel(z, f[:, :, 0].copy(), o, most)
                out[k] = (b[:, 0] + (b[:, 1:] * at[k]).sum(axis=1)) if intercept else (b * at[k]).sum(axis=1)
        return table.filter(pa.array(own)).select(columns).append_column("yhat", pa.array(out, mask=np.isnan(out)))

    schema = StructType([*[blocks.schema[c] for c in columns], StructField("yhat", DoubleType())])
    return blocks.groupBy(*by, "__block").applyInArrow(run, schema)


# -- augmented linear models -------------------------------------------------------------

ALM = BASE | dict(distribution="normal", loss="likelihood", max_iterations=100, tolerance=1e-8, quantile=0.5, role_trim=0.05)
#: Models of log y: the likelihood of log y, less the sum of log y.
_LOGGED = {"log_normal": "normal", "log_laplace": "laplace", "log_s": "s", "log_generalised_normal": "generalised_normal", "box_cox_normal": "normal"}
T_FREEDOM, GN_SHAPE = 4.0, 1.5
_LEAST = 1e-12


def _alm_rounds(rows: DataFrame, xs: list[str], by: list[str], o) -> DataFrame:
    """(by, r) of the linear predictor."""
    d, k = o.distribution, bool(o.fit_intercept)
    if d in ("normal", "logit_normal", "rectified_normal", "folded_normal"):
        return reweighted(rows, xs, by, k, lambda j: j.withColumn("__w", F.lit(1.0)), iterations=0)
    if d in ("laplace", "asymmetric_laplace"):
        return _quantile(rows, xs, by, float(o.quantile) if d == "asymmetric_laplace" else 0.5, k, 60, float(o.tolerance))
    if d == "student_t":

        def weigh(j: DataFrame) -> DataFrame:
            s = j.groupBy(*by).agg((F.avg(F.col("__e") ** 2) * (T_FREEDOM - 2) / T_FREEDOM).alias("__s"))
            return join_groups(j, s, by).withColumn("__w", (T_FREEDOM + 1) / (T_FREEDOM + F.col("__e") ** 2 / F.greatest(F.col("__s"), F.lit(_LEAST)))).drop("__s")

        return reweighted(rows, xs, by, k, weigh, iterations=int(o.max_iterations), tolerance=float(o.tolerance))
    if d in ("s", "generalised_normal"):
        power = 0.5 if d == "s" else GN_SHAPE
        return reweighted(rows, xs, by, k, lambda j: j.withColumn("__w", F.pow(F.greatest(F.abs("__e"), F.lit(1e-6)), power - 2)), iterations=40, tolerance=1e-7)
    if d == "logistic":

        def derive_logistic(eta: Column) -> dict[str, Column]:
            s = F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(10.0), parameter(len(xs) + int(k)))))
            z = (F.col("__y") - eta) / s
            t = F.tanh(z / 2)
            return {"g": t / s, "w": (1 - t * t) / 2 / (s * s) + 1e-12, "g0": z * t - 1, "w0": F.lit(1.0) + z * z * (1 - t * t) / 2, "c0": F.lit(0.0)}

        start = rows.groupBy(*by).agg(F.avg("__y").alias("m"), F.stddev_samp("__y").alias("s"))
        start = settled_groups(start.select(*by, F.array(*([F.col("m")] if k else []), *[F.lit(0.0)] * len(xs), F.log(F.greatest(F.col("s") * 0.55, F.lit(1e-6)))).alias("__theta")))
        fit = newton(rows, by, xs, k, start, derive_logistic, extra=1, iterations=int(o.max_iterations), tolerance=float(o.tolerance), most_step=50.0)
        return settled_groups(_as_result(fit, len(xs), k, by))
    fam = {"poisson": lambda: glm._poisson("log"), "gamma": glm._gamma, "exponential": glm._gamma, "geometric": glm._negbinom, "negative_binomial": glm._negbinom, "binomial": lambda: glm._binomial("logit"), "cumulative_logistic": lambda: glm._binomial("logit"), "cumulative_normal": lambda: glm._binomial("probit"), "beta": lambda: glm._binomial("logit"), "inverse_gaussian": _inverse_gaussian}[d]()
    rows = rows.withColumn("__nb", F.lit(1.0))

    def derive(eta: Column) -> dict[str, Column]:
        m = fam.mean(eta)
        s, v = fam.slope(eta, m), fam.variance(m)
        return {"g": (F.col("__y") - m) * s / v, "w": s * s / v}

    start = settled_groups(glm._start(rows, by, len(xs), k, fam.link))
    return settled_groups(_as_result(newton(rows, by, xs, k, start, derive, iterations=int(o.max_iterations), tolerance=float(o.tolerance)), len(xs), k, by))


def _inverse_gaussian() -> glm.Family:
    return glm.Family(variance=lambda m: m * m * m, deviance=lambda y, m: (y - m) ** 2 / (m * m * y), loglik=lambda y, m, d: -0.5 * (F.log(2 * math.pi * d * y * y * y) + (y - m) ** 2 / (d * m * m * y)), check="y > 0", dispersion="pearson", nuisance=1, **glm._EXP)


def _as_result(fit: DataFrame, p: int, k: bool, by: list[str]) -> DataFrame:
    at = int(k)
    return fit.select(*by, F.struct(F.slice("__theta", at + 1, p).alias("coefficients"), (F.get("__theta", F.lit(0)) if k else F.lit(float("nan"))).alias("intercept"), F.lit(None).cast("long").alias("n")).alias("r"))


def alm_scale(kind: str, y: Column, eta: Column, quantile: float = 0.5) -> Column:
    """The scale of a group, as an aggregate: each family's own estimate given the linear predictor; 1 where there is none."""
    e, mu = y - eta, F.exp(eta)
    p = 1 / (1 + F.exp(-eta))
    return {
        "laplace": lambda: F.avg(F.abs(e)),
        "asymmetric_laplace": lambda: F.avg(F.when(e > 0, quantile * e).otherwise((quantile - 1) * e)),
        "s": lambda: F.avg(F.sqrt(F.abs(e))) / 2,
        "generalised_normal": lambda: F.pow(GN_SHAPE * F.avg(F.pow(F.abs(e), GN_SHAPE)), 1 / GN_SHAPE),
        "student_t": lambda: F.sqrt(F.avg(e * e) * (T_FREEDOM - 2) / T_FREEDOM),
        "logistic": lambda: F.stddev_pop(e) * math.sqrt(3) / math.pi,
        "gamma": lambda: F.avg((y / mu - 1) ** 2),
        "inverse_gaussian": lambda: F.avg((y - mu) ** 2 / (mu * mu * y)),
        "negative_binomial": lambda: F.sum(mu * mu) / F.greatest(F.sum((y - mu) ** 2 - mu), F.lit(1e-6) * F.sum(mu * mu)),
        "beta": lambda: F.greatest(F.sum(p * (1 - p)) / F.greatest(F.sum((y - p) ** 2), F.lit(1e-300)) - 1, F.lit(1e-3)),
        **{k: lambda: F.avg(F.lit(1.0)) for k in ("exponential", "poisson", "geometric", "binomial", "cumulative_logistic", "cumulative_normal")},
    }.get(kind, lambda: F.sqrt(F.avg(e * e)))()


def alm_log_density(kind: str, y: Column, eta: Column, s: Column, quantile: float = 0.5) -> Column:
    """The log density of a row, given its linear predictor and the group's scale."""
    s = F.greatest(s, F.lit(1e-300))
    e, mu = y - eta, F.exp(eta)
    z, lg = e / s, glm.lgamma
    soft = lambda t: F.greatest(t, F.lit(0.0)) + F.log1p(F.exp(-F.abs(t)))
    normal = lambda t: -0.5 * math.log(2 * math.pi) - F.log(s) - t * t / 2
    p = F.greatest(F.lit(_LEAST), F.least(F.lit(1 - _LEAST), 1 / (1 + F.exp(-eta))))
    phi = lambda t: F.greatest(F.lit(1e-300), norm_cdf(t))
    check = F.when(e > 0, quantile * e).otherwise((quantile - 1) * e)
    v, t_constant = T_FREEDOM, math.lgamma((T_FREEDOM + 1) / 2) - math.lgamma(T_FREEDOM / 2) - 0.5 * math.log(T_FREEDOM * math.pi)
    return {
        "laplace": lambda: -F.log(2 * s) - F.abs(z),
        "asymmetric_laplace": lambda: math.log(quantile * (1 - quantile)) - F.log(s) - check / s,
        "s": lambda: -F.log(4 * s * s) - F.sqrt(F.abs(e)) / s,
        "generalised_normal": lambda: math.log(GN_SHAPE / 2) - F.log(s) - math.lgamma(1 / GN_SHAPE) - F.pow(F.abs(z), GN_SHAPE),
        "student_t": lambda: t_constant - F.log(s) - (v + 1) / 2 * F.log1p(z * z / v),
        "logistic": lambda: -z - F.log(s) - 2 * soft(-z),
        "folded_normal": lambda: normal(z) + F.log1p(F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), 2 * y * eta / (s * s))))),
        "rectified_normal": lambda: F.when(y > 0, normal(z)).otherwise(F.log(phi(-eta / s))),
        "exponential": lambda: -eta - y / mu,
        "gamma": lambda: F.log(y / (mu * s)) / s - y / (mu * s) - F.log(y) - lg(1 / s),
        "inverse_gaussian": lambda: -0.5 * F.log(2 * math.pi * s * y * y * y) - (y - mu) ** 2 / (2 * s * mu * mu * y),
        "poisson": lambda: y * eta - mu - lg(y + 1),
        "geometric": lambda: y * eta - (y + 1) * F.log1p(mu),
        "negative_binomial": lambda: lg(y + s) - lg(s) - lg(y + 1) + s * F.log(s / (s + mu)) + y * F.log(mu / (s + mu)),
        "binomial": lambda: y * eta - soft(eta),
        "cumulative_logistic": lambda: y * eta - soft(eta),
        "cumulative_normal": lambda: y * F.log(phi(eta)) + (1 - y) * F.log(phi(-eta)),
        "beta": lambda: lg(s) - lg(p * s) - lg((1 - p) * s) + (p * s - 1) * F.log(y) + ((1 - p) * s - 1) * F.log1p(-y),
    }.get(kind, lambda: normal(z))()


_WITHOUT_SCALE = ("exponential", "poisson", "geometric", "binomial", "cumulative_logistic", "cumulative_normal")
_DOMAIN = {"gamma": "__y > 0", "inverse_gaussian": "__y > 0", "exponential": "__y >= 0", "beta": "__y > 0 AND __y < 1", "poisson": "__y >= 0", "geometric": "__y >= 0", "negative_binomial": "__y >= 0", "folded_normal": "__y >= 0"}


def alm_fit_agg(df: DataFrame, y: str, x: list[str], by: list[str] = (), opts: dict | None = None) -> DataFrame:
    """A linear predictor under one of many likelihoods; ``iterations`` is always 0, as in the documented interface.

    Rows outside a likelihood's domain are left out.  The folded and rectified
    normal take the coefficients of the normal fit, Box-Cox those of log y (its
    parameter is 0); their likelihoods are their own.  With ``compute_inference``
    standard errors come from the inverse of the features' moments, scaled by the
    residual variance: exact for the normal, an approximation for others.
    """
    o, by = options.read(opts, **ALM), list(by)
    o.distribution = str(o.distribution).lower()
    rows, xs = _named(df, y, x, by)
    d, q = o.distribution, float(o.quantile)
    if d in _LOGGED:
        rows = rows.where("__y > 0").withColumn("__y", F.log("__y"))
        o.distribution = _LOGGED[d]
    elif d == "logit_normal":
        rows = rows.where("__y > 0 AND __y < 1").withColumn("__y", F.log(F.col("__y") / (1 - F.col("__y"))))
    elif d in _DOMAIN:
        rows = rows.where(_DOMAIN[d])
    if str(o.loss) in ("mse", "mae", "ham"):
        o.distribution = {"mse": "normal", "mae": "laplace", "ham": "s"}[o.loss]
    kind = o.distribution
    fits = _alm_rounds(rows, xs, by, o)
    j = join_groups(rows, fits.withColumnRenamed("r", "__r"), by).withColumn("__eta", predicted(xs, "__r"))
    response, eta, n = F.col("__y"), F.col("__eta"), F.count(F.lit(1))
    scales = j.groupBy(*by).agg(n.alias("n"), alm_scale(kind, response, eta, q).alias("scale"), F.sum((response - eta) ** 2).alias("rss"))
    scales = settled_groups(join_groups(scales, fits, by))
    density = alm_log_density(kind, response, eta, F.col("scale"), q)
    if d in _LOGGED:  # density of y, not of its logarithm
        density = density - response
    elif d == "logit_normal":
        density = density + F.abs(response) + 2 * F.log1p(F.exp(-F.abs(response)))
    ll = join_groups(j, scales.select(*by, "scale"), by).groupBy(*by).agg(F.sum(density).alias("ll"))
    s = join_groups(scales, ll, by)
    k = len(x) + int(o.fit_intercept) + int(kind not in _WITHOUT_SCALE)
    out = [*by, "r.coefficients", "r.intercept", F.col("ll").alias("log_likelihood"), (2.0 * k - 2 * F.col("ll")).alias("aic"), (k * F.log("n") - 2 * F.col("ll")).alias("bic"), "scale", F.col("n").alias("n_observations"), F.lit(len(x)).alias("n_features"), F.lit(0).alias("iterations")]
    if o.compute_inference and x:
        s, more = _moment_inference(s, rows, xs, by, bool(o.fit_intercept), float(o.confidence_level))
        out += more
    return s.select(*out)


def _moment_inference(s: DataFrame, rows: DataFrame, xs: list[str], by: list[str], intercept: bool, level: float) -> tuple[DataFrame, list[Column]]:
    """Adds t inference for r.coefficients from rss, n and the moments of the features."""
    names = ["std_errors", "t_values", "p_values", "ci_lower", "ci_upper"]
    m = weighted_moments_once(rows.withColumn("__w", F.lit(1.0)), "__y", xs, by, "__w")
    p = len(xs)

    def run(m: pd.DataFrame, r: pd.DataFrame, rss: pd.Series, n: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            inverse, _ = sweep(Stack(m, intercept).gram)
            free = n.to_numpy(float) - p - int(intercept)
            se = np.sqrt(np.einsum("gii->gi", inverse) * (rss.to_numpy(float) / free)[:, None])
            b = np.stack(r["coefficients"])
            t, half = b / se, dist.t_ppf(np.full(len(b), 0.5 + level / 2), free)[:, None] * se
            pv = dist.t_two_sided(t, free[:, None])
        return pd.DataFrame(dict(zip(names, map(list, (se, t, pv, b - half, b + half)), strict=True)))

    udf = F.pandas_udf(run, ", ".join(f"{c} array<double>" for c in names))
    packed = m.select(*by, F.struct(*[c for c in m.columns if c not in by]).alias("__m"))
    return join_groups(s, packed, by).withColumn("__i", udf("__m", "r", "rss", "n")), [F.col(f"__i.{c}").alias(c) for c in names]
