"""The linear family: least squares, ridge, elastic net, lasso path point, weighted, bounded, partial least squares, recursive.

Every model is a function of moments, so a fit is one mergeable aggregate per
group (Catalyst plans partial and final steps), then a small solve over the
groups of an Arrow batch.  The same solve serves per-group fits, fit-and-predict
and window frames.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.functions import dist, options
from quillstat.plans import solve
from quillstat.plans.moments import double, join_groups, moments, nan_kept, usable
from quillstat.plans.order import blocked, by_blocks, carried, halo, placed, tasks
from quillstat.sources.tables import settled_groups

BASE = dict(fit_intercept=True, compute_inference=False, confidence_level=0.95, solver="svd", hc_type="none", null_policy="drop")
DEFAULTS = {
    "ols": BASE,
    "wls": BASE,
    "ridge": BASE | dict(alpha=1.0, lambda_scaling="raw"),
    "elasticnet": BASE | dict(alpha=1.0, l1_ratio=0.5, max_iterations=1000, tolerance=1e-6, lambda_scaling="raw"),
    "lars": BASE | dict(alpha=0.0),
    "bls": BASE | dict(fit_intercept=False, lower_bound=None, upper_bound=None, max_iterations=1000, tolerance=1e-10),
    "nnls": BASE | dict(fit_intercept=False, lower_bound=None, upper_bound=None, max_iterations=1000, tolerance=1e-10),
    "pls": BASE | dict(n_components=1),
    "rls": BASE | dict(forgetting_factor=1.0, initial_p_diagonal=100.0),
}
INFERENCE = "std_errors array<double>, t_values array<double>, p_values array<double>, ci_lower array<double>, ci_upper array<double>, f_statistic double, f_pvalue double"
FIT = "coefficients array<double>, intercept double, r_squared double, adj_r_squared double, residual_std_error double, n_observations long, n_features int"
BOUNDED = "coefficients array<double>, intercept double, ssr double, r_squared double, n_observations long, n_features int, n_active_constraints int, at_lower_bound array<boolean>, at_upper_bound array<boolean>"


def _options(kind: str, given: dict | None):
    o = options.read(given, **DEFAULTS[kind])
    if getattr(o, "alpha", 0) is not None and float(getattr(o, "alpha", 0)) < 0:
        raise ValueError("option alpha must not be negative")
    if not 0 <= float(getattr(o, "l1_ratio", 0)) <= 1:
        raise ValueError("option l1_ratio must lie between 0 and 1")
    if not 0 < float(getattr(o, "forgetting_factor", 1)) <= 1:
        raise ValueError("option forgetting_factor must lie in (0, 1]")
    return o


def _bounds(value, p: int, default: float) -> np.ndarray:
    v = default if value is None else value
    return np.broadcast_to(np.asarray(v, float), (p,))


def solve_moments(kind: str, m: pd.DataFrame | solve.Stack, o) -> tuple[solve.Stack, dict]:
    """Coefficients and fit statistics of every group."""
    s = m if isinstance(m, solve.Stack) else solve.Stack(m, bool(o.fit_intercept))
    n = s.sw
    if kind in ("ols", "wls"):
        return s, solve.least_squares(s)
    if kind == "ridge":
        return s, solve.least_squares(s, float(o.alpha) * (n if o.lambda_scaling == "glmnet" else np.ones_like(n)))
    none = ~s.constant
    if kind in ("elasticnet", "lars"):
        ratio = 1.0 if kind == "lars" else float(o.l1_ratio)
        scale = n if kind == "lars" or o.lambda_scaling == "glmnet" else np.ones_like(n)
        b = solve.coordinate_descent(s, float(o.alpha) * ratio * scale, float(o.alpha) * (1 - ratio) * scale, iterations=int(getattr(o, "max_iterations", 5000)), tolerance=float(getattr(o, "tolerance", 1e-12)) * 1e-3)
    elif kind in ("bls", "nnls"):
        free = o.lower_bound is None and o.upper_bound is None
        low = _bounds(0.0 if free or kind == "nnls" else o.lower_bound, s.p, -np.inf)
        high = _bounds(None if kind == "nnls" else o.upper_bound, s.p, np.inf)
        b = solve.coordinate_descent(s, 0.0, 0.0, np.tile(low, (len(n), 1)), np.tile(high, (len(n), 1)), 20_000, 1e-13)
        fit = solve.summary(s, np.where(none, b, np.nan), None, none)
        return s, fit | {"at_lower": none & (b <= low + 1e-9), "at_upper": none & (b >= high - 1e-9)}
    elif kind == "pls":
        if not 1 <= int(o.n_components) <= s.p:
            raise ValueError("option n_components must lie between 1 and the number of features")
        b = solve.partial_least_squares(s, int(o.n_components))
    else:  # rls: the recursion from P0 * I is a ridge on all coefficients, the constant one too
        around0 = solve.Stack(m, False) if isinstance(m, pd.DataFrame) else s
        k = int(o.fit_intercept)
        a, c = np.zeros((len(n), s.p + k, s.p + k)), np.zeros((len(n), s.p + k))
        a[:, k:, k:], c[:, k:] = around0.sxx, around0.sxy
        if k:
            a[:, 0, 0], a[:, 0, 1:], a[:, 1:, 0], c[:, 0] = n, n[:, None] * s.xbar, n[:, None] * s.xbar, n * s.ybar
        weight = np.ones_like(n) if o.forgetting_factor == 1 else float(o.forgetting_factor) ** s.n
        a += np.eye(s.p + k) * (weight / float(o.initial_p_diagonal))[:, None, None]
        full = np.linalg.solve(a, c[..., None])[..., 0] if len(n) else c
        fit = solve.summary(s, full[:, k:], None, np.ones((len(n), s.p), bool))
        if k:
            fit["intercept"] = full[:, 0]
        return s, fit
    return s, solve.summary(s, np.where(none, b, np.nan), None, none)


def _failed(s: solve.Stack, fit: dict) -> np.ndarray:
    return (s.n < 2) | (s.n < fit["k"] + int(s.intercept)) | ((fit["k"] == 0) & (not s.intercept))


def _solver(kind: str, o, schema: str, want_inverse: bool = False):
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(m: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            s, fit = solve_moments(kind, m, o)
            fit = fit | {"n_observations": s.n.astype("int64"), "n_features": np.full(len(m), s.p, "int32"), "ssr": fit["rss"], "df_model": fit["k"], "xbar": s.xbar}
            if "std_errors" in names:
                fit |= solve.inference(s, fit, float(o.confidence_level))
            if "inverse" in names:
                fit["inverse"] = fit["inv"].reshape(len(m), -1)
            if "at_lower" in fit:
                fit |= {"at_lower_bound": fit["at_lower"], "at_upper_bound": fit["at_upper"], "n_active_constraints": (fit["at_lower"] | fit["at_upper"]).sum(axis=1).astype("int32")}
            if "t_critical" in names:
                fit["t_critical"] = dist.t_ppf(np.full(len(m), 0.5 + float(o.confidence_level) / 2), s.n - s.p - int(s.intercept))
            fit["failed"] = _failed(s, fit)
        return pd.DataFrame({c: (list(fit[c]) if np.ndim(fit[c]) > 1 else fit[c]) for c in names})

    return F.pandas_udf(run, schema)


def _fitted(df: DataFrame, kind: str, y: str, x: list[str], by: list[str], weight: str | None, o, schema: str) -> DataFrame:
    if kind == "rls" and o.forgetting_factor != 1:
        weight = "__decay"
    m = moments(df, y, x, by, weight)
    cols = [c for c in m.columns if c not in by]
    udf = _solver(kind, o, schema + ", failed boolean")
    out = m.select(*by, udf(F.struct(*cols)).alias("r"))
    return out.select(*by, F.when(~F.col("r.failed"), nan_kept("r", schema)).alias("r"))


def _decayed(df: DataFrame, y: str, x: list[str], by: list[str], order: list[str] | None, factor: float) -> DataFrame:
    """Weight factor**(rows behind) in the given order."""
    if not order:
        raise ValueError("a forgetting factor below 1 needs order_by: the result depends on the order of rows")
    back = Window.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return usable(df, [y, *x]).withColumn("__decay", F.pow(F.lit(float(factor)), F.row_number().over(back) - 1))


def fit_agg(df: DataFrame, kind: str, y: str, x: list[str], by: list[str] = (), weight: str | None = None, order_by: list[str] | None = None, opts: dict | None = None) -> DataFrame:
    """One row per group: the group columns and the result fields.

    Rows with a null, NaN or infinite value don't take part, nor weights of 0 or
    less.  Constant and linearly dependent features get NaN coefficients.  Groups
    with too few rows get null fields.
    """
    o, by = _options(kind, opts), list(by)
    if kind in ("bls", "nnls"):
        schema = BOUNDED
    else:
        schema = FIT + (", " + INFERENCE if o.compute_inference and kind in ("ols", "wls", "ridge") else "")
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    if kind == "rls" and o.forgetting_factor != 1:
        df = _decayed(df, y, x, by, order_by, o.forgetting_factor)
    robust = o.hc_type != "none" and "std_errors" in names and kind in ("ols", "wls")
    full = schema + (", inverse array<double>, xbar array<double>, df_model int" if robust else "")
    out = _fitted(df, kind, y, x, by, weight, o, full)
    if not robust:
        return out.select(*by, *[F.col(f"r.{c}").alias(c) for c in names])
    return _robust(df, out, y, x, by, weight, o, names)


def _dot(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out


def _robust(df: DataFrame, fits: DataFrame, y: str, x: list[str], by: list[str], weight: str | None, o, names: list[str]) -> DataFrame:
    """Standard errors from a second pass: sums of squared errors times products of centred features."""
    p = len(x)
    fits = settled_groups(fits)
    rows = join_groups(usable(df, [y, *x, *([weight] if weight else [])]), fits.select(*by, F.col("r").alias("__r")), by).where("__r IS NOT NULL")
    w = double(weight) if weight else F.lit(1.0)
    coef = lambda i: F.nanvl(F.get(F.col("__r.coefficients"), F.lit(i)), F.lit(0.0))
    z = [double(c) - (F.get(F.col("__r.xbar"), F.lit(i)) if o.fit_intercept else F.lit(0.0)) for i, c in enumerate(x)]
    rows = rows.withColumn("__e", double(y) - F.coalesce(F.nanvl(F.col("__r.intercept"), F.lit(0.0)), F.lit(0.0)) - _dot([coef(i) * double(c) for i, c in enumerate(x)]))
    rows = rows.withColumns({f"__z{i}": v for i, v in enumerate(z)})
    inv = lambda i, j: F.get(F.col("__r.inverse"), F.lit(i * p + j))
    lever = w * ((1 / F.col("__r.n_observations") if o.fit_intercept else F.lit(0.0)) + _dot([F.col(f"__z{i}") * F.col(f"__z{j}") * inv(i, j) for i in range(p) for j in range(p)]))
    scale = {"hc0": F.lit(1.0), "hc1": F.lit(1.0), "hc2": 1 / (1 - lever), "hc3": 1 / ((1 - lever) * (1 - lever))}[o.hc_type]
    rows = rows.withColumn("__s", w * w * F.col("__e") * F.col("__e") * scale)
    meat = rows.groupBy(*by).agg(F.array(*[F.sum(F.col("__s") * F.col(f"__z{i}") * F.col(f"__z{j}")) for i in range(p) for j in range(p)]).alias("meat"))
    meat = join_groups(meat, fits, by)
    replaced = ["std_errors", "t_values", "p_values", "ci_lower", "ci_upper"]

    def run(r: pd.DataFrame, meat: pd.Series) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            inverse = np.stack(r["inverse"]).reshape(-1, p, p)
            cov = inverse @ np.stack(meat).reshape(-1, p, p) @ inverse
            n, k = r["n_observations"].to_numpy(float), r["df_model"].to_numpy(float) + int(o.fit_intercept)
            if o.hc_type == "hc1":
                cov = cov * (n / (n - k))[:, None, None]
            b = np.stack(r["coefficients"])
            se = np.where(np.isnan(b), np.nan, np.sqrt(np.einsum("gii->gi", cov)))
            q = dist.t_ppf(np.full(len(b), 0.5 + float(o.confidence_level) / 2), n - k)[:, None]
            t = b / se
            pv = dist.t_two_sided(t, (n - k)[:, None])
        return pd.DataFrame(dict(zip(replaced, map(list, (se, t, pv, b - q * se, b + q * se)), strict=True)))

    udf = F.pandas_udf(run, ", ".join(f"{c} array<double>" for c in replaced))
    out = meat.withColumn("h", udf("r", "meat"))
    return out.select(*by, *[F.col(f"h.{c}" if c in replaced else f"r.{c}").alias(c) for c in names])


def training(df: DataFrame, y: str, x: list[str], split: str | None, null_policy: str = "drop") -> Column:
    """Whether a row trains: its split says so (any case of train or training), and y and all features are there."""
    ok = F.col(y).isNotNull()
    if split:
        ok = ok & F.lower(F.col(split)).isin("train", "training")
    for c in x:
        ok = ok & F.col(c).isNotNull()
        if null_policy == "drop_y_zero_x":
            ok = ok & (F.col(c) != 0)
    return F.coalesce(ok, F.lit(False))


def predicted(x: list[str], r: str) -> Column:
    """Intercept and dot product, natively; NaN coefficients count for nothing."""
    parts = [F.nanvl(F.get(F.col(f"{r}.coefficients"), F.lit(i)), F.lit(0.0)) * double(c) for i, c in enumerate(x)]
    return F.coalesce(F.nanvl(F.col(f"{r}.intercept"), F.lit(0.0)), F.lit(0.0)) + _dot(parts)


def fit_predict_by(df: DataFrame, kind: str, y: str, x: list[str], by: list[str] = (), split: str | None = None, weight: str | None = None, order_by: list[str] | None = None, opts: dict | None = None) -> DataFrame:
    """All rows and columns with yhat, yhat_lower, yhat_upper and is_training.

    Fits each group on its training rows, joins the coefficients back by group
    and predicts natively.  The interval is yhat +- t * s * sqrt(1 + 1/n).
    """
    o, by = _options(kind, opts), list(by)
    flag = training(df, y, x, split, o.null_policy)
    rows = df.withColumn("is_training", flag)
    train = rows.where("is_training")
    if kind == "rls" and o.forgetting_factor != 1:
        train = _decayed(train, y, x, by, order_by, o.forgetting_factor)
    fits = _fitted(train, kind, y, x, by, weight, o, "coefficients array<double>, intercept double, residual_std_error double, n_observations long, n_features int, t_critical double")
    j = join_groups(rows, fits.withColumnRenamed("r", "__r"), by)
    known = F.lit(True)
    for c in x:
        known = known & F.col(c).isNotNull()
    j = j.withColumn("yhat", F.when(known & F.col("__r").isNotNull(), predicted(x, "__r")))
    if kind == "pls":
        return j.select(*df.columns, "yhat", "is_training")
    s, n = F.col("__r.residual_std_error"), F.col("__r.n_observations")
    wide = F.when((s > 0) & ~F.isnan(s) & (n > F.col("__r.n_features") + 1), F.col("__r.t_critical") * s * F.sqrt(1 + 1 / n)).otherwise(0.0)
    return j.select(*df.columns, "yhat", (F.col("yhat") - wide).alias("yhat_lower"), (F.col("yhat") + wide).alias("yhat_upper"), "is_training")


def as_lists(rows: DataFrame, y: str, by: list[str], order_by: list[str]) -> DataFrame:
    """The list form: one array of (y, yhat, ..., is_training) per group, in the given order."""
    fields = [c for c in ("yhat", "yhat_lower", "yhat_upper", "is_training") if c in rows.columns]
    item = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_by)], double(y).alias("y"), *fields)
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return lists.select(*by, F.transform("l", lambda r: F.struct(*[r[c].alias(c) for c in ("y", *fields)])).alias("predictions"))


def fit_predict_window(df: DataFrame, kind: str, y: str, x: list[str], by: list[str], order_by: list[str], frame: tuple[int | None, int] = (None, -1), weight: str | None = None, predict_x: str = "frame_last", opts: dict | None = None) -> DataFrame:
    """All rows with yhat, yhat_lower and yhat_upper of the model of their frame.

    One range sort, then running sums of products in Spark's window operator and
    one vectorised solve per Arrow batch.  A group is cut into blocks of its
    order; a block gets the rows its frames reach and the sums of what lies
    before, so no group meets in one task.  ``frame`` is (start, end) in rows,
    None for unbounded.  A frame needs more rows than coefficients.
    ``predict_x``: the features of the frame's last row, or with "current" the
    row's own.  Products are taken around the group's first values; the sums of a
    frame of more than LONG_FRAME rows that is bounded below are differences of
    two running sums, so a row costs the same for every length of frame.  A
    forgetting factor below 1 (rls) discounts by usable rows behind the frame's
    last one; there a group is sorted in one task.
    """
    o, p = _options(kind, opts), len(x)
    if kind not in ("ols", "ridge", "elasticnet", "wls", "rls"):
        raise ValueError(f"{kind} has no window form by moments")
    factor = float(o.forgetting_factor) if kind == "rls" else 1.0
    if factor != 1 and (frame[0] is not None or not 0 < factor < 1):
        raise ValueError("a forgetting factor of the window form lies in (0, 1] and, below 1, needs a frame that starts at the first row")
    whole = factor != 1
    keys, order = (by, order_by) if whole else ([*by, "__block"], ["__pos"])
    ordered = Window.partitionBy(*keys).orderBy(*order)
    from_start = lambda end: ordered.rowsBetween(Window.unboundedPreceding, end)
    w = ordered.rowsBetween(Window.unboundedPreceding if frame[0] is None else frame[0], frame[1])
    ok = training(df, y, x, None, o.null_policy)
    for c in (y, *x, *([weight] if weight else [])):
        ok = ok & F.coalesce(~F.isnan(double(c)) & (F.abs(double(c)) != float("inf")), F.lit(False))
    if weight:
        ok = ok & (double(weight) > 0)
    centres = [f"__c{i}" for i in range(p + 1)]
    if whole:
        rows = df.withColumn("__ok", ok).withColumns({k: F.first(F.when(F.col("__ok"), double(c)), ignorenulls=True).over(from_start(0)) for k, c in zip(centres, (y, *x), strict=True)})
    else:
        rows = placed(df.withColumn("__ok", ok), by, order_by)
        n_tasks = tasks(rows)
        first = rows.where("__ok").groupBy(*by).agg(*[F.min_by(double(c), "__pos").alias(k) for k, c in zip(centres, (y, *x), strict=True)])
        rows = join_groups(rows, settled_groups(first), by)
    usable_ = F.col("__ok")
    vals = {"__n": F.when(usable_, 1.0), "__w": F.when(usable_, double(weight) if weight else F.lit(1.0))}
    vals |= {k: F.when(usable_, double(c) - F.col(m)) for k, c, m in zip(("__y", *[f"__x{i}" for i in range(p)]), (y, *x), centres, strict=True)}
    rows = rows.withColumns(vals)
    wc = F.col("__w")
    sums = {"n": F.col("__n"), "y": wc * F.col("__y"), "yy": wc * F.col("__y") * F.col("__y")} | ({"w": wc} if weight or factor != 1 else {})
    sums |= {f"x{i}": wc * F.col(f"__x{i}") for i in range(p)} | {f"y{i}": wc * F.col("__y") * F.col(f"__x{i}") for i in range(p)}
    sums |= {f"x{i}x{j}": wc * F.col(f"__x{i}") * F.col(f"__x{j}") for i in range(p) for j in range(i, p)}
    rows = rows.withColumns({f"__p_{k}": v for k, v in sums.items()})
    if not whole:
        behind, ahead = halo(frame)
        carry = carried(rows, by, [f"__p_{k}" for k in sums], behind, ahead) if frame[0] is None else None
        rows = blocked(rows, behind, ahead)
        if carry is not None:
            rows = rows.unionByName(carry, allowMissingColumns=True)
        rows = by_blocks(rows, by, n_tasks)
    differences = frame[0] is not None and frame[1] - frame[0] >= LONG_FRAME
    if not differences:
        summed = lambda k: F.sum(f"__p_{k}").over(w)
    else:
        summed = lambda k: F.coalesce(F.sum(f"__p_{k}").over(from_start(frame[1])), F.lit(0.0)) - F.coalesce(F.sum(f"__p_{k}").over(from_start(frame[0] - 1)), F.lit(0.0))
    if factor != 1:
        rows = _discounted(rows, [f"__p_{k}" for k in sums if k != "n"], by, order_by, factor)
        summed = lambda k: F.sum("__p_n").over(w) if k == "n" else F.last(f"__p_{k}").over(w)
    at = [double(c) if predict_x == "current" else F.last(double(c)).over(w) for c in x]
    own = [] if whole else ["__own"]
    rows = rows.select(*df.columns, *centres, *own, *[summed(k).alias(f"__s_{k}") for k in sums], *[a.alias(f"__a{i}") for i, a in enumerate(at)])
    if own:
        rows = rows.where("__own")
    names = list(sums)
    level, intercept = float(o.confidence_level), bool(o.fit_intercept)
    inputs = [*[f"__s_{k}" for k in names], *[f"__a{i}" for i in range(p)], *centres]

    def run(it):
        for cols in it:
            v = {k: c.to_numpy(float, na_value=np.nan) for k, c in zip([k.removeprefix("__s_").removeprefix("__") for k in inputs], cols, strict=True)}
            v.setdefault("w", v["n"])
            yield _frame_predictions(kind, o, v, p, level, intercept, 1e-10 if differences else 1e-12)

    from collections.abc import Iterator

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.DataFrame]}
    udf = F.pandas_udf(run, "yhat double, yhat_lower double, yhat_upper double")
    out = rows.withColumn("__r", udf(*inputs))
    found = lambda c: F.when(~F.isnan(F.col(f"__r.{c}")), F.col(f"__r.{c}")).alias(c)
    return out.select(*df.columns, found("yhat"), found("yhat_lower"), found("yhat_upper"))


def _discounted(rows: DataFrame, cols: list[str], by: list[str], order_by: list[str], factor: float) -> DataFrame:
    """Each column replaced by its running sum with weight factor**(usable rows behind).

    Powers of the factor would overflow over a long group, so a group is cut into
    blocks over which the weight falls by e**-12: running sums inside a block, and
    the totals of the four blocks before it; older ones are below rounding.
    """
    size = math.ceil(-12 / math.log(factor))
    ordered = Window.partitionBy(*by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    place = F.greatest(F.count(F.when(F.col("__ok"), 1)).over(ordered), F.lit(1)) - 1
    rows = rows.withColumn("__place", place).withColumn("__block", F.floor(F.col("__place") / size)).withColumn("__j", F.col("__place") - F.col("__block") * size)
    inside = Window.partitionBy(*by, "__block").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    power = lambda e: F.pow(F.lit(factor), e)
    j, blocks = F.col("__j"), Window.partitionBy(*by).orderBy("__block")
    out = {}
    for c in cols:
        total = power(j) * F.coalesce(F.sum(F.col(c) * power(-j)).over(inside), F.lit(0.0))
        for m in range(1, 5):
            total = total + power(j + 1 + (m - 1) * size) * F.coalesce(F.sum(F.col(c) * power(size - 1 - j)).over(blocks.rangeBetween(-m, -m)), F.lit(0.0))
        out[c] = total
    return rows.withColumns(out)


#: Frames of more rows are summed as differences of running sums.
LONG_FRAME = 8


def _frame_predictions(kind: str, o, v: dict, p: int, level: float, intercept: bool, flat: float) -> pd.DataFrame:
    """Predictions and intervals of frames from their sums; NaN where a frame has too few rows.  Features whose variation is below ``flat`` of their squares are constant."""
    n = np.round(np.nan_to_num(v["n"]))
    sw = np.where(n > 0, v["w"], 1.0)
    at = np.stack([v[f"a{i}"] for i in range(p)], axis=1)
    use = (n > p + int(intercept)) & ~np.isnan(at).any(axis=1)
    out = np.full((len(n), 3), np.nan)
    if use.any():
        g = lambda k: v[k][use]
        sw = sw[use]
        s = solve.Stack.__new__(solve.Stack)
        s.n, s.sw, s.p, s.intercept = n[use], sw, p, intercept
        mx = np.stack([g(f"x{i}") for i in range(p)], axis=1) / sw[:, None]
        my = g("y") / sw
        s.sxx = np.empty((len(sw), p, p))
        for i in range(p):
            for j in range(i, p):
                s.sxx[:, i, j] = s.sxx[:, j, i] = g(f"x{i}x{j}") - sw * mx[:, i] * mx[:, j]
        s.sxy = np.stack([g(f"y{i}") for i in range(p)], axis=1) - (sw * my)[:, None] * mx
        s.syy = g("yy") - sw * my * my
        s.xbar, s.ybar = mx + np.stack([g(f"c{i + 1}") for i in range(p)], axis=1), my + g("c0")
        raw = np.stack([g(f"x{i}x{i}") for i in range(p)], axis=1)
        diagonal = np.einsum("gii->gi", s.sxx)
        s.constant = diagonal <= np.maximum(1e-20 * s.n[:, None], flat * raw)
        if not intercept or kind == "rls":
            s0 = s.sxx + sw[:, None, None] * s.xbar[:, :, None] * s.xbar[:, None, :], s.sxy + sw[:, None] * s.xbar * s.ybar[:, None]
            if not intercept or kind == "rls":
                s.sxx, s.sxy, s.syy = s0[0], s0[1], s.syy + sw * s.ybar**2
        s.gram = np.where(s.constant[:, :, None] | s.constant[:, None, :], 0.0, s.sxx)
        s.xy = np.where(s.constant, 0.0, s.sxy)
        with np.errstate(all="ignore"):
            _, fit = solve_moments(kind, s, o)
            b = np.nan_to_num(fit["coefficients"])
            yhat = np.nan_to_num(fit["intercept"]) + np.einsum("gi,gi->g", b, at[use])
            sigma = fit["residual_std_error"]
            q = dist.t_ppf(np.full(len(yhat), 0.5 + level / 2), s.n - p - int(intercept))
            wide = np.where((sigma > 0) & (s.n > p + 1), q * sigma * np.sqrt(1 + 1 / s.n), 0.0)
        out[use] = np.stack([yhat, yhat - wide, yhat + wide], axis=1)
    return pd.DataFrame(out, columns=["yhat", "yhat_lower", "yhat_upper"])
