"""Streams: least squares over event-time windows, and recursive least squares with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.operators.linear import FIT, _options, _solver
from quillstat.plans.moments import moment_columns, usable


def windowed_fit(stream: DataFrame, y: str, x: list[str], ts: str, window: str, slide: str | None = None, late: str = "10 minutes", by: list[str] = (), kind: str = "ols", opts: dict | None = None) -> DataFrame:
    """A fit per event-time window and group.  Moments merge, so the state holds a few numbers per window; rows later than ``late`` are dropped by the watermark."""
    o = _options(kind, opts)
    rows = usable(stream, [y, *x]).withWatermark(ts, late)
    m = rows.groupBy(F.window(ts, window, slide or window), *by).agg(*moment_columns(y, x))
    cols = [c for c in m.columns if c not in (*by, "window")]
    r = m.select("window.start", "window.end", *by, _solver(kind, o, FIT + ", failed boolean")(F.struct(*cols)).alias("r"))
    return r.select("start", "end", *by, *[F.when(~F.col("r.failed"), F.col(f"r.{c.strip().split(' ')[0]}")).alias(c.strip().split(" ")[0]) for c in FIT.split(",")])


def recursive_fit(stream: DataFrame, key: str, y: str, x: list[str], forgetting_factor: float = 1.0, initial_p_diagonal: float = 100.0, order_by: str | None = None) -> DataFrame:
    """Recursive least squares per key with an intercept: the state is the coefficients and the inverse moment matrix; each trigger gives the present coefficients of the keys it touched."""
    k = len(x) + 1

    def step(key_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.exists:
            beta, p, n = state.get
            beta, p = np.array(beta), np.array(p).reshape(k, k)
        else:
            beta, p, n = np.zeros(k), np.eye(k) * initial_p_diagonal, 0
        pdf = pd.concat(list(frames))
        if order_by:
            pdf = pdf.sort_values(order_by)
        for row in pdf[[y, *x]].dropna().to_numpy(float):
            z = np.r_[1.0, row[1:]]
            pz = p @ z
            gain = pz / (forgetting_factor + z @ pz)
            beta = beta + gain * (row[0] - z @ beta)
            p = (p - np.outer(gain, pz)) / forgetting_factor
            n += 1
        state.update((beta.tolist(), p.ravel().tolist(), n))
        yield pd.DataFrame({key: [key_[0]], "intercept": [beta[0]], "coefficients": [beta[1:].tolist()], "n_observations": [n]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, intercept double, coefficients array<double>, n_observations long", "beta array<double>, p array<double>, n long", "update", "NoTimeout")
