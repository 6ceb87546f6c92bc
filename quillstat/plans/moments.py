"""Moments per group as mergeable aggregates.

Unweighted moments are Spark's covariance aggregates, which update and merge
around running means and so stay accurate in one pass.  Weighted moments are
sums of products around each group's mean, from a first pass.
"""

from __future__ import annotations

import functools
import inspect

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def usable(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows whose columns are all finite."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & finite(F.col(c).cast("double"))
    return df.where(ok)


def double(c: str) -> Column:
    return F.col(c).cast("double")


def moment_columns(y: str, x: list[str]) -> list[Column]:
    """n, sw, ybar, xbar[], syy, sxy[], sxx[] (upper triangle by rows), xmin[], xmax[]; sums of products around means."""
    n = F.count(F.lit(1)).cast("double")
    p = len(x)
    return [
        n.alias("n"),
        n.alias("sw"),
        F.avg(double(y)).alias("ybar"),
        F.array(*[F.avg(double(c)) for c in x]).alias("xbar"),
        (F.var_pop(double(y)) * n).alias("syy"),
        F.array(*[F.covar_pop(double(c), double(y)) * n for c in x]).alias("sxy"),
        F.array(*[(F.var_pop(double(x[i])) if i == j else F.covar_pop(double(x[i]), double(x[j]))) * n for i in range(p) for j in range(i, p)]).alias("sxx"),
        F.array(*[F.min(double(c)) for c in x]).alias("xmin"),
        F.array(*[F.max(double(c)) for c in x]).alias("xmax"),
    ]


def join_groups(df: DataFrame, per: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their group's values; null groups match.  Spark broadcasts ``per`` only if its measured size allows it."""
    if not by:
        return df.crossJoin(per)  # one row
    keyed = per.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(by)], *[c for c in per.columns if c not in by])
    on = F.lit(True)
    for i, c in enumerate(by):
        on = on & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return df.join(keyed, on, "left").drop(*[f"__k{i}" for i in range(len(by))])


def moments(df: DataFrame, y: str, x: list[str], by: list[str], weight: str | None = None) -> DataFrame:
    """One row per group with moment_columns; rows with a missing or infinite value, or a weight of 0 or less, are left out."""
    rows = usable(df, [y, *x, *([weight] if weight else [])])
    if not weight:
        return rows.groupBy(*by).agg(*moment_columns(y, x))
    rows = rows.where(double(weight) > 0).select(*by, double(y).alias("__y"), *[double(c).alias(f"__x{i}") for i, c in enumerate(x)], double(weight).alias("__w"))
    cols, p = ["__y", *[f"__x{i}" for i in range(len(x))]], len(x)
    means = rows.groupBy(*by).agg(*[(F.sum(F.col(c) * F.col("__w")) / F.sum("__w")).alias(f"__m{c}") for c in cols])
    r = join_groups(rows, means, by)
    d = {c: F.col(c) - F.col(f"__m{c}") for c in cols}
    w = F.col("__w")
    xs = cols[1:]
    return r.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(w).alias("sw"),
        F.first("__m__y").alias("ybar"),
        F.array(*[F.first(f"__m{c}") for c in xs]).alias("xbar"),
        F.sum(w * d["__y"] * d["__y"]).alias("syy"),
        F.array(*[F.sum(w * d[c] * d["__y"]) for c in xs]).alias("sxy"),
        F.array(*[F.sum(w * d[xs[i]] * d[xs[j]]) for i in range(p) for j in range(i, p)]).alias("sxx"),
        F.array(*[F.min(c) for c in xs]).alias("xmin"),
        F.array(*[F.max(c) for c in xs]).alias("xmax"),
    )


def weighted_moments_once(rows: DataFrame, y: str, x: list[str], by: list[str], weight: str) -> DataFrame:
    """The same columns from one aggregate of plain sums, for rows that are already near zero mean."""
    w, p = F.col(weight), len(x)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    s = rows.groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(w).alias("sw"), F.sum(w * F.col(y)).alias("sy"), F.sum(w * F.col(y) * F.col(y)).alias("yy"),
        *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(x)], *[F.sum(w * F.col(c) * F.col(y)).alias(f"y{i}") for i, c in enumerate(x)],
        *[F.sum(w * F.col(x[i]) * F.col(x[j])).alias(f"x{i}_{j}") for i, j in pairs],
        F.array(*[F.min(c) for c in x]).alias("xmin"), F.array(*[F.max(c) for c in x]).alias("xmax"),
    )
    sw, sy = F.col("sw"), F.col("sy")
    return s.select(
        *by, "n", "sw", (sy / sw).alias("ybar"), F.array(*[F.col(f"s{i}") / sw for i in range(p)]).alias("xbar"), (F.col("yy") - sy * sy / sw).alias("syy"),
        F.array(*[F.col(f"y{i}") - F.col(f"s{i}") * sy / sw for i in range(p)]).alias("sxy"),
        F.array(*[F.col(f"x{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / sw for i, j in pairs]).alias("sxx"), "xmin", "xmax",
    )


def own_names(f):
    """Lets ``f`` use column names of its own: grouping columns get reserved names inside, and theirs back in the result."""
    shape = inspect.signature(f)

    @functools.wraps(f)
    def run(*args, **kw):
        call = shape.bind(*args, **kw)
        by = list(call.arguments.get("by", ()))
        inner = [f"__by{i}" for i in range(len(by))]
        call.arguments["df"] = call.arguments["df"].withColumns({k: F.col(c) for k, c in zip(inner, by, strict=True)})
        call.arguments["by"] = inner
        return f(*call.args, **call.kwargs).withColumnsRenamed(dict(zip(inner, by, strict=True)))

    return run


def nan_kept(r: str, schema: str) -> Column:
    """A struct result of a pandas function with NaN where pandas made nulls of them."""
    nan = F.lit(float("nan"))
    out = []
    for field in schema.split(","):
        name, kind = field.strip().split(" ")
        c = F.col(f"{r}.{name}")
        if kind == "double":
            c = F.coalesce(c, nan)
        elif kind == "array<double>":
            c = F.transform(c, lambda v: F.coalesce(v, nan))
        out.append(c.alias(name))
    return F.struct(*out)
