"""Distribution functions as Spark columns: Arrow-batched, one NumPy call per batch."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstat.functions import dist


def _wrap(f):
    def values(*cols: pd.Series) -> pd.Series:
        arrays = [c.to_numpy(dtype=float, na_value=np.nan) for c in cols]
        with np.errstate(all="ignore"):
            return pd.Series(f(*arrays))

    arity = f.__code__.co_argcount
    if arity == 1:

        def one(a: pd.Series) -> pd.Series:
            return values(a)

        g = one
    elif arity == 2:

        def two(a: pd.Series, b: pd.Series) -> pd.Series:
            return values(a, b)

        g = two
    else:

        def three(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return values(a, b, c)

        g = three
    made = []  # on first use: workers import this module without a session

    def column(*args) -> Column:
        if not made:
            made.append(F.pandas_udf(g, "double"))
        return made[0](*[a.cast("double") if isinstance(a, Column) else F.lit(float(a)) for a in args])

    return column


norm_cdf = _wrap(dist.norm_cdf)
norm_sf = _wrap(dist.norm_sf)
norm_ppf = _wrap(dist.norm_ppf)
t_sf = _wrap(dist.t_sf)
t_two_sided = _wrap(dist.t_two_sided)
t_ppf = _wrap(dist.t_ppf)
f_sf = _wrap(dist.f_sf)
chi2_sf = _wrap(dist.chi2_sf)
binom_cdf = _wrap(dist.binom_cdf)
beta_ppf = _wrap(dist.beta_ppf)
f_ppf = _wrap(dist.f_ppf)
chi2_ppf = _wrap(dist.chi2_ppf)


def p_value(stat: Column, df: Column | None, alternative: str) -> Column:
    """Of a t (or, without df, normal) statistic."""
    upper = norm_sf(stat) if df is None else t_sf(stat, df)
    if alternative == "greater":
        return upper
    if alternative == "less":
        return 1 - upper
    return F.least(F.lit(1.0), 2 * norm_sf(F.abs(stat))) if df is None else t_two_sided(stat, df)
