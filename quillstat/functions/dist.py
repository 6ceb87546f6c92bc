"""Distribution functions in NumPy: normal, t, F, chi-squared, binomial.

Written from the standard series and continued fractions for the regularised
incomplete gamma and beta functions.  All functions take and return arrays.
"""

from __future__ import annotations

import math

import numpy as np

_lgamma = np.frompyfunc(math.lgamma, 1, 1)
_erfc = np.frompyfunc(math.erfc, 1, 1)


def lgamma(x):
    return np.asarray(_lgamma(np.asarray(x, float)), float)


def _beta_fraction(a, b, x):
    """Lentz's method for the continued fraction of the incomplete beta function."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def betainc(a, b, x):
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    if ok.any():
        aa, bb, xx = a[ok], b[ok], x[ok]
        inner = np.clip(xx, 1e-300, 1 - 1e-16)
        front = np.exp(lgamma(aa + bb) - lgamma(aa) - lgamma(bb) + aa * np.log(inner) + bb * np.log1p(-inner))
        swap = inner >= (aa + 1) / (aa + bb + 2)
        p, q, z = np.where(swap, bb, aa), np.where(swap, aa, bb), np.where(swap, 1 - inner, inner)
        v = front * _beta_fraction(p, q, z) / p
        v = np.where(swap, 1 - v, v)
        out[ok] = np.where(xx <= 0, 0.0, np.where(xx >= 1, 1.0, v))
    return out


def gammainc(a, x):
    """Regularised lower incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (x >= 0)
    if not ok.any():
        return out
    a, x = a[ok], x[ok]
    front = np.exp(-x + a * np.log(np.maximum(x, 1e-300)) - lgamma(a))
    term, total = 1 / a, 1 / a
    for n in range(1, 1000):
        term = term * x / (a + n)
        total = total + term
        if np.all(term < total * 1e-16):
            break
    low = front * total
    b = x + 1 - a
    c, d = np.full_like(x, 1e300), 1 / np.where(b == 0, 1e-300, b)
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b = b + 2
        d = an * d + b
        d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
        c = b + an / c
        c = np.where(np.abs(c) < 1e-300, 1e-300, c)
        h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out[ok] = np.where(x == 0, 0.0, np.where(x < a + 1, low, 1 - front * h))
    return out


def norm_cdf(x):
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def norm_sf(x):
    return norm_cdf(-np.asarray(x, float))


def t_sf(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        tail = 0.5 * betainc(df / 2, 0.5, df / (df + t * t))
    return np.where(t >= 0, tail, 1 - tail)


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(all="ignore"):
        return betainc(df / 2, 0.5, df / (df + t * t))


def f_sf(f, d1, d2):
    f, d1, d2 = np.broadcast_arrays(np.asarray(f, float), np.asarray(d1, float), np.asarray(d2, float))
    with np.errstate(all="ignore"):
        return np.where(f < 0, 1.0, betainc(d2 / 2, d1 / 2, np.where(np.isinf(f), 0.0, d2 / (d2 + d1 * f))))


def chi2_sf(x, df):
    return 1 - gammainc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def binom_cdf(k, n, p):
    """P(X <= k)."""
    k, n, p = np.broadcast_arrays(np.floor(np.asarray(k, float)), np.asarray(n, float), np.asarray(p, float))
    return np.where(k < 0, 0.0, np.where(k >= n, 1.0, betainc(np.maximum(n - k, 1e-9), np.maximum(k + 1, 1e-9), 1 - p)))


def _inverse(cdf, p, low, high, steps=200):
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, low, float), np.full(p.shape, high, float)
    for _ in range(steps):
        mid = (lo + hi) / 2
        below = cdf(mid) < p
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        if np.all(hi - lo <= 1e-15 * np.maximum(1, np.abs(hi))):
            break
    return (lo + hi) / 2


def norm_ppf(p):
    p = np.asarray(p, float)
    out = _inverse(norm_cdf, np.clip(p, 1e-300, 1 - 1e-16), -40, 40)
    return np.where((p > 0) & (p < 1), out, np.where(p == 0, -np.inf, np.where(p == 1, np.inf, np.nan)))


def _t_expansion_from(z, df):
    """Quantile of t by the expansion in 1/df around the normal quantile z."""
    g1 = (z**3 + z) / 4
    g2 = (5 * z**5 + 16 * z**3 + 3 * z) / 96
    g3 = (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    g4 = (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160
    return z + g1 / df + g2 / df**2 + g3 / df**3 + g4 / df**4


def t_ppf(p, df):
    """Quantile of t, found once per distinct (p, df): by expansion in 1 / df, below 1000 refined by Newton steps on the tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    shape, p, df = p.shape, p.ravel(), df.ravel()
    out = np.full(len(p), np.nan)
    ok = (p > 0) & (p < 1) & (df > 0)
    z = np.full(len(p), np.nan)
    levels, of = np.unique(p[ok], return_inverse=True)
    z[ok] = norm_ppf(levels)[of]
    far = ok & (df > 1000) & (np.abs(p - 0.5) < 0.4999)
    out[far] = _t_expansion_from(z[far], df[far])
    near = np.flatnonzero(ok & ~far)
    if len(near):
        _, first, back = np.unique(p[near] + 2j * df[near], return_index=True, return_inverse=True)
        out[near] = _t_by_newton(p[near][first], df[near][first], z[near][first])[back.ravel()]
    return out.reshape(shape)


def _t_by_newton(p, d, z):
    tail = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        x = np.abs(_t_expansion_from(z, d))
        for _ in range(12):
            log_density = lgamma((d + 1) / 2) - lgamma(d / 2) - 0.5 * np.log(d * np.pi) - (d + 1) / 2 * np.log1p(x * x / d)
            step = (t_sf(x, d) - tail) / np.exp(log_density)
            x = np.maximum(x + step, 0)
            if np.all(np.abs(step) <= 1e-14 * np.maximum(1, x)):
                break
        off = ~(np.abs(t_sf(x, d) - tail) <= 1e-11 * tail)
    if off.any():  # few degrees of freedom far out in the tail
        x[off] = _inverse(lambda v: 1 - t_sf(v, d[off]), 1 - tail[off], 0.0, 1e12)
    return np.where(p < 0.5, -x, x)


def beta_ppf(p, a, b):
    p, a, b = np.broadcast_arrays(np.asarray(p, float), np.asarray(a, float), np.asarray(b, float))
    return _inverse(lambda x: betainc(a, b, x), p, 0.0, 1.0)


def chi2_ppf(p, df):
    df = np.asarray(df, float)
    return _inverse(lambda x: 1 - chi2_sf(x, df), np.asarray(p, float) + 0 * df, 0.0, 1e6)


def f_ppf(p, d1, d2):
    p, d1, d2 = np.broadcast_arrays(np.asarray(p, float), np.asarray(d1, float), np.asarray(d2, float))
    return _inverse(lambda x: 1 - f_sf(x, d1, d2), p, 0.0, 1e6)
