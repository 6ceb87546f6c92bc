"""Small dense solvers over moments, for all groups of an Arrow batch at once.

Spark makes the moments; here each batch of groups becomes stacked p x p arrays
and one NumPy pass solves them all.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from quillstat.functions import dist

CONSTANT = 1e-10


class Stack:
    """Moments of G groups as arrays."""

    def __init__(self, m: pd.DataFrame, intercept: bool):
        g = lambda c: np.stack([np.asarray(v, float) for v in m[c]]) if len(m) else np.empty((0, 0))
        self.n, self.sw = m["n"].to_numpy(float), m["sw"].to_numpy(float)
        self.ybar, self.xbar = m["ybar"].to_numpy(float), g("xbar")
        self.p = self.xbar.shape[1]
        up, i = g("sxx"), np.triu_indices(self.p)
        self.sxx = np.zeros((len(m), self.p, self.p))
        self.sxx[:, i[0], i[1]] = up
        self.sxx[:, i[1], i[0]] = up
        self.sxy, self.syy = g("sxy"), m["syy"].to_numpy(float)
        self.intercept = intercept
        self.constant = (g("xmax") - g("xmin")) < CONSTANT
        self.var = np.einsum("gii->gi", self.sxx) / self.sw[:, None]
        if not intercept:  # products around zero
            self.sxx = self.sxx + self.sw[:, None, None] * self.xbar[:, :, None] * self.xbar[:, None, :]
            self.sxy = self.sxy + self.sw[:, None] * self.xbar * self.ybar[:, None]
            self.syy = self.syy + self.sw * self.ybar**2
        a = self.sxx.copy()
        g_, j_ = np.nonzero(self.constant)
        a[g_, j_, :] = 0
        a[g_, :, j_] = 0
        self.gram, self.xy = a, np.where(self.constant, 0.0, self.sxy)


def sweep(gram: np.ndarray, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """(inverse over the columns that are independent, which those are): pivots that vanish are left out."""
    a = gram.copy()
    G, p, _ = a.shape
    size = np.einsum("gii->gi", gram)
    ok = np.zeros((G, p), bool)
    for k in range(p):
        d = a[:, k, k]
        good = d > tol * np.maximum(size[:, k], 1e-300)
        ok[:, k] = good
        r = np.where(good, 1 / np.where(good, d, 1), 0.0)
        row, col = a[:, k, :].copy(), a[:, :, k].copy()
        b = a - r[:, None, None] * col[:, :, None] * row[:, None, :]
        b[:, k, :] = r[:, None] * row
        b[:, :, k] = -r[:, None] * col
        b[:, k, k] = r
        a = np.where(good[:, None, None], b, a)
    both = ok[:, :, None] & ok[:, None, :]
    return np.where(both, a, 0.0), ok


def least_squares(s: Stack, penalty: np.ndarray | float = 0.0) -> dict[str, np.ndarray]:
    gram = s.gram + np.eye(s.p) * np.reshape(penalty, (-1, 1, 1)) * (~s.constant)[:, :, None]
    inv, ok = sweep(gram)
    beta = np.einsum("gij,gj->gi", inv, s.xy)
    return summary(s, np.where(ok, beta, np.nan), inv, ok)


def summary(s: Stack, beta: np.ndarray, inv: np.ndarray | None, ok: np.ndarray) -> dict[str, np.ndarray]:
    """Fit statistics of coefficients, NaN for those left out."""
    b = np.nan_to_num(beta)
    rss = np.maximum(0.0, s.syy - 2 * np.einsum("gi,gi->g", b, s.sxy) + np.einsum("gi,gij,gj->g", b, s.sxx, b))
    rss = np.where(rss < 1e-13 * s.syy, 0.0, rss)
    k = ok.sum(axis=1)
    extra = int(s.intercept)
    df = s.n - k - extra
    with np.errstate(all="ignore"):
        r2 = np.where(s.syy > 0, 1 - rss / s.syy, 0.0)
        adj = np.where(df > 0, 1 - (1 - r2) * (s.n - extra) / df, np.nan)
        sigma = np.where(df > 0, np.sqrt(rss / df), np.nan)
    intercept = s.ybar - np.einsum("gi,gi->g", b, s.xbar) if s.intercept else np.full(len(b), np.nan)
    return {"coefficients": beta, "intercept": intercept, "r_squared": r2, "adj_r_squared": adj, "residual_std_error": sigma, "rss": rss, "df": df, "k": k, "inv": inv, "ok": ok}


def inference(s: Stack, fit: dict, level: float, cov: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Standard errors, t, p and interval of the coefficients, and the F test."""
    with np.errstate(all="ignore"):
        var = np.einsum("gii->gi", cov) if cov is not None else fit["residual_std_error"][:, None] ** 2 * np.einsum("gii->gi", fit["inv"])
        se = np.where(fit["ok"], np.sqrt(var), np.nan)
        t = fit["coefficients"] / se
        p = dist.t_two_sided(t, np.maximum(fit["df"], 0)[:, None])
        q = dist.t_ppf(np.full(len(se), 0.5 + level / 2), fit["df"])[:, None]
        f = (s.syy - fit["rss"]) / fit["k"] / (fit["rss"] / fit["df"])
        fp = dist.f_sf(f, fit["k"], fit["df"])
    return {"std_errors": se, "t_values": t, "p_values": p, "ci_lower": fit["coefficients"] - q * se, "ci_upper": fit["coefficients"] + q * se, "f_statistic": f, "f_pvalue": fp}


def coordinate_descent(s: Stack, l1: np.ndarray, l2: np.ndarray, lower=None, upper=None, iterations: int = 1000, tolerance: float = 1e-10) -> np.ndarray:
    """min (b'Ab)/2 - c'b + l1|b| + l2 b'b/2 within bounds, for all groups at once."""
    a, c = s.gram, s.xy
    b = np.zeros_like(c)
    if lower is not None:
        b = np.maximum(b, lower)
    if upper is not None:
        b = np.minimum(b, upper)
    diag = np.einsum("gii->gi", a)
    for _ in range(iterations):
        old = b.copy()
        for j in range(s.p):
            z = c[:, j] - np.einsum("gi,gi->g", a[:, j, :], b) + diag[:, j] * b[:, j]
            d = diag[:, j] + l2
            v = np.where(d > 0, np.sign(z) * np.maximum(np.abs(z) - l1, 0) / np.where(d > 0, d, 1), 0.0)
            if lower is not None:
                v = np.maximum(v, lower[:, j])
            if upper is not None:
                v = np.minimum(v, upper[:, j])
            b[:, j] = v
        if np.all(np.abs(b - old) <= tolerance * (1 + np.abs(b))):
            break
    return b


def partial_least_squares(s: Stack, components: int) -> np.ndarray:
    """PLS1 coefficients from the Gram matrix: conjugate directions of (A, c)."""
    r, b = s.xy.copy(), np.zeros_like(s.xy)
    d = r.copy()
    for _ in range(components):
        ad = np.einsum("gij,gj->gi", s.gram, d)
        dad = np.einsum("gi,gi->g", d, ad)
        rr = np.einsum("gi,gi->g", r, r)
        step = np.where(dad > 0, rr / np.where(dad > 0, dad, 1), 0.0)
        b += step[:, None] * d
        new = r - step[:, None] * ad
        ratio = np.where(rr > 0, np.einsum("gi,gi->g", new, new) / np.where(rr > 0, rr, 1), 0.0)
        d, r = new + ratio[:, None] * d, new
    return b
