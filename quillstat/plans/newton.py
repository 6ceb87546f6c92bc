"""Newton iterations for all groups at once, as rounds of aggregates.

A model gives, as Spark columns, the score and the curvature of a row's log
likelihood in its linear predictor (and in further parameters).  One round joins
the parameters to the rows, sums score and curvature per group, and solves the
groups' small systems.  No group is ever gathered in one place, so one group may
hold all rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.plans.moments import join_groups
from quillstat.sources.tables import few, settled


def add(terms) -> Column:
    return reduce(lambda a, b: a + b, terms)


def parameter(i: int, name: str = "__theta") -> Column:
    return F.get(F.col(name), F.lit(i))


def linear_predictor(x: list[str], intercept: bool, offset: str | None = None, name: str = "__theta") -> Column:
    k = int(intercept)
    terms = [parameter(i + k, name) * F.col(c) for i, c in enumerate(x)]
    if intercept:
        terms.insert(0, parameter(0, name))
    if offset:
        terms.append(F.col(offset))
    return add(terms) if terms else F.lit(0.0)


def triangle(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def symmetric(flat, p: int) -> np.ndarray:
    """Upper triangles to symmetric matrices."""
    flat = np.stack(flat)
    a, at = np.zeros((len(flat), p, p)), np.triu_indices(p)
    a[:, at[0], at[1]] = flat
    a[:, at[1], at[0]] = flat
    return a


def _soft_steps(a: np.ndarray, c: np.ndarray, t: np.ndarray, absolute: np.ndarray, mode: np.ndarray) -> np.ndarray:
    """Minima of b'ab / 2 - c'b + sum(absolute * |b - mode|) of all groups, coordinate by coordinate."""
    b = t.copy()
    for _ in range(1000):
        last = b.copy()
        for j in range(b.shape[1]):
            d = a[:, j, j]
            pull = c[:, j] - np.einsum("gi,gi->g", a[:, j], b) + d * (b[:, j] - mode[j])
            b[:, j] = mode[j] + np.sign(pull) * np.maximum(np.abs(pull) - absolute[j], 0) / d
        if np.abs(b - last).max(initial=0.0) < 1e-12:
            break
    return b


def newton(
    rows: DataFrame,
    by: list[str],
    x: list[str],
    intercept: bool,
    start: DataFrame,
    derive: Callable[[Column], dict[str, Column]],
    extra: int = 0,
    ridge: float | list[float] = 0.0,
    offset: str | None = None,
    iterations: int = 25,
    tolerance: float = 1e-8,
    most_step: float = 5.0,
    l1: list[float] | None = None,
    location: list[float] | None = None,
) -> DataFrame:
    """(by, __theta, __iterations, __converged, __information).

    ``start`` has by and __theta (array: intercept first, then x, then extra).
    ``derive(eta)`` gives columns: g (score in eta), w (curvature), and for each
    extra parameter k: g{k}, w{k} (curvature) and c{k} (cross curvature with eta).
    ``ridge`` and ``l1`` are the weights of squared and absolute distances of the
    coefficients of x from ``location``; __information includes the former.
    """
    p = len(x) + int(intercept)
    total = p + extra
    design = ([F.lit(1.0)] if intercept else []) + [F.col(c) for c in x]
    whole = lambda v: np.concatenate([np.zeros(int(intercept)), np.broadcast_to(np.asarray(v, float), (len(x),)), np.zeros(extra)])
    penalty, absolute, mode = whole(ridge), whole(l1 or 0.0), whole(location or 0.0)

    def solve(theta: pd.Series, score: pd.Series, info: pd.Series) -> pd.DataFrame:
        t, g, a = np.stack(theta), np.stack(score), symmetric(info, total)
        g = g - penalty * (t - mode)
        a = a + np.diag(penalty)
        d = np.einsum("gii->gi", a)
        dead = ~(d > 1e-12 * np.maximum(1.0, d.max(axis=1, keepdims=True)))
        a[dead[:, :, None] | dead[:, None, :]] = 0
        a += np.eye(total) * dead[:, None, :]
        a = np.nan_to_num(a, posinf=1e300, neginf=-1e300)
        try:
            step = np.linalg.solve(a, np.nan_to_num(g)[..., None])[..., 0]
        except np.linalg.LinAlgError:
            step = np.einsum("gij,gj->gi", np.linalg.pinv(a), np.nan_to_num(g))
        if absolute.any():
            step = _soft_steps(a, np.einsum("gij,gj->gi", a, t) + np.nan_to_num(g), t, absolute, mode) - t
        step[dead] = 0
        step[:, p:] = np.clip(step[:, p:], -1.0, 1.0)
        size = np.abs(step[:, :p]).max(axis=1, initial=0.0)
        step *= np.minimum(1.0, most_step / np.maximum(size, 1e-300))[:, None]
        moved = (np.abs(step) / (1 + np.abs(t))).max(axis=1)
        return pd.DataFrame({"theta": list(t + step), "moved": moved, "info": list(a.reshape(len(a), -1))})

    udf = F.pandas_udf(solve, "theta array<double>, moved double, info array<double>")
    state = start.select(*by, "__theta", F.lit(0).alias("__iterations"), F.lit(False).alias("__converged"), F.array().cast("array<double>").alias("__information"))
    small = few(state) is not state
    for _ in range(iterations):
        state = F.broadcast(state) if small else state
        j = join_groups(rows, state.select(*by, "__theta"), by)
        d = derive(linear_predictor(x, intercept, offset))
        j = j.withColumns({f"__d_{k}": v for k, v in d.items()})
        col = lambda k: F.col(f"__d_{k}")
        score = [col("g") * z for z in design] + [col(f"g{k}") for k in range(extra)]

        def curvature(a: int, b: int):
            if b < p:
                return col("w") * design[a] * design[b]
            if a < p:
                return col(f"c{b - p}") * design[a]
            return col(f"w{b - p}") if a == b else F.lit(0.0)

        sums = j.groupBy(*by).agg(
            F.array(*[F.sum(s) for s in score]).alias("__g"),
            F.array(*[F.sum(curvature(a, b)) for a, b in triangle(total)]).alias("__a"),
        )
        old = state.select(*[F.col(c).alias(f"__o_{c}") for c in by], F.col("__iterations").alias("__was"), F.col("__converged").alias("__done"), F.col("__theta").alias("__kept"), F.col("__information").alias("__info"))
        on = F.lit(True)
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"__o_{c}"))
        merged = (sums.join(old, on) if by else sums.crossJoin(old)).withColumn("__s", udf("__kept", "__g", "__a"))
        done = F.col("__done")
        state = settled(
            merged.select(
                *by,
                F.when(done, F.col("__kept")).otherwise(F.col("__s.theta")).alias("__theta"),
                F.when(done, F.col("__was")).otherwise(F.col("__was") + 1).alias("__iterations"),
                (done | (F.col("__s.moved") < tolerance)).alias("__converged"),
                F.when(done, F.col("__info")).otherwise(F.col("__s.info")).alias("__information"),
            )
        )
        if state.where("NOT __converged").isEmpty():
            break
    return F.broadcast(state) if small else state
