"""Mixed models with random effects of one grouping factor.

Gaussian with a random intercept: the likelihood depends on the data through
group moments only.  One pass makes them; the profile likelihood is then a sum
over groups for each trial value of the variance ratio, and all trial values are
summed in the same job.

Other families and random slopes: rounds of penalised weighted least squares.  A
round sums score and information per group, solves the groups' small blocks in
batches, sums what the blocks leave for the fixed effects, and updates the
random effects' covariance.  The random effects stay a distributed table; only
sums the size of the fixed effects' information reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from quillstat.functions import dist, options
from quillstat.operators.glm import lgamma
from quillstat.plans.moments import double, moments, usable
from quillstat.plans.newton import add, symmetric, triangle
from quillstat.plans.order import TASK_ROWS
from quillstat.sources.tables import FEW, few, settled, settled_groups, written

GLMM = dict(glmm_family="gaussian", fit_intercept=True, compute_inference=False, confidence_level=0.95, max_iterations=None, tolerance=1e-8, reml=True, offset_column=None, random_slopes=())

#: The family names of the documented interface.
FAMILIES = {"gaussian": "gaussian", "normal": "gaussian", "lmm": "gaussian", "poisson": "poisson", "binomial": "binomial", "logistic": "binomial"}


class TooFewGroups(ValueError):
    """Fewer than two groups, or groups of one row only."""


def _profiles(per: DataFrame, ratios: list[float], p: int, reml: bool) -> pd.DataFrame:
    """For each variance ratio: the fit of the fixed effects and the log likelihood; a few numbers per ratio reach the driver."""
    t = per.withColumn("ratio", F.explode(F.array(*[F.lit(float(r)) for r in ratios])))
    n = F.col("n")
    shrink = n / (1 + F.col("ratio") * n)
    cols = [F.lit(1.0)] + [F.get("xbar", F.lit(i)) for i in range(p)]
    upper = {ij: k for k, ij in enumerate(triangle(p))}

    def cross(i: int, j: int):
        within = F.get("sxx", F.lit(upper[(i - 1, j - 1)])) if i else F.lit(0.0)
        return F.sum(within + shrink * cols[i] * cols[j])

    s = t.groupBy("ratio").agg(
        F.array(*[cross(i, j) for i, j in triangle(p + 1)]).alias("a"),
        F.array(*[F.sum((F.get("sxy", F.lit(i - 1)) if i else F.lit(0.0)) + shrink * cols[i] * F.col("ybar")) for i in range(p + 1)]).alias("b"),
        F.sum(F.col("syy") + shrink * F.col("ybar") ** 2).alias("yy"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sum(F.log1p(F.col("ratio") * n)).alias("logdet"),
    ).toPandas()
    a, b = symmetric(s["a"], p + 1), np.stack(s["b"])
    beta = np.einsum("gij,gj->gi", np.linalg.pinv(a), b)
    rss = s["yy"] - (beta * b).sum(axis=1)
    dof = s["n"] - (p + 1 if reml else 0)
    s["s2"] = rss / dof
    s["ll"] = -0.5 * (dof * (np.log(2 * math.pi * s["s2"]) + 1) + s["logdet"])
    if reml:
        s["ll"] -= 0.5 * np.linalg.slogdet(a)[1]
    s["beta"], s["cov"] = list(beta), list(np.linalg.pinv(a))
    return s


def _row_terms(family: str, y, eta, s2: float) -> dict:
    """Score and information of a row in its linear predictor, its log likelihood, deviance and squared error."""
    if family == "gaussian":
        e = y - eta
        return {"g": e / s2, "w": F.lit(1 / s2), "ll": -0.5 * (e * e / s2 + math.log(2 * math.pi * s2)), "dev": e * e}
    if family == "poisson":
        m = F.exp(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta)))
        top = F.when(y > 0, y * F.log(y) - y).otherwise(0.0)
        return {"g": y - m, "w": m, "ll": y * eta - m, "dev": 2 * (top - (y * eta - m))}
    m = 1 / (1 + F.exp(-eta))
    ll = y * eta - F.greatest(eta, F.lit(0.0)) - F.log1p(F.exp(-F.abs(eta)))
    return {"g": y - m, "w": F.greatest(m * (1 - m), F.lit(1e-10)), "ll": ll, "dev": -2 * ll}


def _blocks(per: DataFrame, fixed: list[int], random: list[int], d: int, inverse: np.ndarray) -> DataFrame:
    """Groups with m (covariance of the effects given the fixed ones), c (cross information), r (penalised score), and what the block leaves for the fixed effects: a, b."""

    def run(it):
        for part in it:
            if part.empty:
                continue
            info, score, u = symmetric(part["info"], d), np.stack(part["score"]), np.stack(part["u"])
            cross = info[:, random][:, :, fixed]
            m = np.linalg.inv(info[:, random][:, :, random] + inverse)
            r = score[:, random] - u @ inverse
            left = np.einsum("gqf,gqr->gfr", cross, m)
            flat = lambda v: list(v.reshape(len(part), -1))
            done = {"m": flat(m), "c": flat(cross), "r": list(r), "a": flat(info[:, fixed][:, :, fixed] - left @ cross), "b": list(score[:, fixed] - np.einsum("gfr,gr->gf", left, r))}
            yield pd.DataFrame({"__g": part["__g"], "u": part["u"], "n": part["n"], "ll": part["ll"], "dev": part["dev"], **done})

    return per.mapInPandas(run, "__g string, u array<double>, n long, ll double, dev double, m array<double>, c array<double>, r array<double>, a array<double>, b array<double>")


def _stepped(blocks: DataFrame, step: np.ndarray, v: np.ndarray, sigma: np.ndarray, inverse: np.ndarray) -> DataFrame:
    """Groups with their next effects, outer products of those and of their uncertainty, and their share of the marginal log likelihood."""
    q = len(sigma)

    def run(it):
        for part in it:
            if part.empty:
                continue
            k = len(part)
            m, c, r, u = np.stack(part["m"]).reshape(k, q, q), np.stack(part["c"]).reshape(k, q, -1), np.stack(part["r"]), np.stack(part["u"])
            new = u + np.einsum("gqr,gr->gq", m, r - c @ step)
            mc = m @ c
            spread = m + mc @ v @ np.swapaxes(mc, 1, 2)
            marginal = part["ll"].to_numpy() - 0.5 * np.einsum("gi,ij,gj->g", u, inverse, u) + 0.5 * np.linalg.slogdet(m)[1] - 0.5 * np.linalg.slogdet(sigma)[1]
            flat = lambda z: list(z.reshape(k, -1))
            yield pd.DataFrame({"__g": part["__g"], "u": list(new), "n": part["n"], "dev": part["dev"], "uu": flat(new[:, :, None] * new[:, None, :]), "spread": flat(spread), "marginal": marginal})

    return blocks.mapInPandas(run, "__g string, u array<double>, n long, dev double, uu array<double>, spread array<double>, marginal double")


def _total(c: str, size: int) -> Column:
    return F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(size)]).alias(c)


def _extrapolated(passed: list[float], now: float, new: float) -> float:
    """Every third value is Aitken's limit of the last three, at most a thousandth or ten times of the last one: a variance of 0 is approached in few rounds."""
    passed.append(now)
    if len(passed) < 3:
        return new
    a, b = passed[-2], passed[-1]
    passed.clear()
    bend = new - 2 * b + a
    limit = a - (b - a) ** 2 / bend if bend else new
    return min(max(limit, new / 1000), new * 10)


#: How null groups are written among keys that begin with "=": joins by plain equality keep rows where they are.
NULL_KEY = ""


def _dealt(rows: DataFrame, counts: DataFrame, n: int, different: int, largest: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(rows of groups that a task can hold, rows of larger groups, keys of those); a row counts __c times.

    The first are dealt by whole groups and stored in their order, equal rows as
    one: every round joins and sums them without shuffling or sorting them
    again.  The second are summed where they are read.  ``different`` estimates
    how many rows are left; only the number of tasks depends on it.
    """
    large = keys = None
    small = rows
    if largest > TASK_ROWS:
        keys = settled_groups(counts.where(F.col("n") > TASK_ROWS).select("__g"))
        large = written(rows.join(keys, "__g", "left_semi").withColumn("__c", F.lit(1).cast("long")), "large")
        small = rows.join(keys, "__g", "left_anti")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(different / TASK_ROWS), math.ceil(n / (16 * TASK_ROWS)))
    small = small.repartition(parts, "__g").groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__c"))
    return small.sortWithinPartitions("__g").persist(StorageLevel.DISK_ONLY), large, keys


def _penalised(rows: DataFrame, p: int, family: str, random: list[int], o) -> tuple[dict, DataFrame]:
    """Fixed effects, covariance and the table (__g, u, n) by rounds; ``rows`` has __g, __y, __x0.., __off."""
    d, q = p + 1, len(random)
    fixed = list(range(0 if o.fit_intercept else 1, d))
    rows = written(rows.withColumn("__g", F.coalesce(F.concat(F.lit("="), "__g"), F.lit(NULL_KEY))), "rows")
    base = rows.agg(F.avg("__y"), F.var_samp("__y"), F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64(*rows.columns))).first()
    n = int(base[2])
    state = settled(rows.groupBy("__g").agg(F.count(F.lit(1)).alias("n")).withColumn("u", F.array(*[F.lit(0.0)] * q)))
    groups, largest = state.agg(F.count(F.lit(1)), F.max("n")).first()
    if groups < 2 or largest < 2:
        raise TooFewGroups("a mixed model needs two groups and a group of two rows")
    mean = float(base[0])
    beta = np.zeros(d)
    if o.fit_intercept:
        beta[0] = {"gaussian": mean, "poisson": math.log(max(mean, 1e-8)), "binomial": math.log(max(mean, 1e-8) / max(1 - mean, 1e-8))}[family]
    s2 = max(float(base[1] or 0.0), 1e-12) if family == "gaussian" else 1.0
    sigma = np.eye(q) * s2
    reml = family == "gaussian" and bool(o.reml)
    design = [F.lit(1.0)] + [F.col(f"__x{i}") for i in range(p)]
    small, large, keys = _dealt(rows, state, n, int(base[3]), largest)

    def sums(rows: DataFrame, effects: DataFrame, beta: np.ndarray, s2: float) -> DataFrame:
        eta = add([float(beta[i]) * z for i, z in enumerate(design)] + [F.get("u", F.lit(k)) * design[i] for k, i in enumerate(random)] + [F.col("__off")])
        j = rows.join(effects, "__g").withColumn("__eta", eta)
        j = j.withColumns({f"__d_{k}": v * F.col("__c") for k, v in _row_terms(family, F.col("__y"), F.col("__eta"), s2).items()})
        return j.groupBy("__g").agg(
            F.first("u").alias("u"), F.sum("__c").alias("n"), F.sum("__d_ll").alias("ll"), F.sum("__d_dev").alias("dev"),
            F.array(*[F.sum(F.col("__d_g") * z) for z in design]).alias("score"), F.array(*[F.sum(F.col("__d_w") * design[a] * design[b]) for a, b in triangle(d)]).alias("info"),
        )

    converged, passed = False, []
    for rounds in range(1, int(o.max_iterations or 100) + 1):
        inverse = np.linalg.inv(sigma)
        effects = state.select("__g", "u")
        per = sums(small, F.broadcast(effects) if groups <= FEW else effects, beta, s2)
        if large is not None:
            per = per.unionByName(sums(large, few(effects.join(keys, "__g", "left_semi")), beta, s2))
        blocks = settled(_blocks(per, fixed, random, d, inverse))
        f = len(fixed)
        t = blocks.agg(_total("a", f * f), _total("b", f)).first()
        a, b = np.array(t["a"]).reshape(f, f), np.array(t["b"])
        v = np.linalg.pinv(a)
        step = v @ b
        next_ = settled(_stepped(blocks, step, v if reml else np.zeros_like(v), sigma, inverse))
        t = next_.agg(_total("uu", q * q), _total("spread", q * q), F.sum("marginal").alias("ll"), F.sum("dev").alias("dev")).first()
        uu, spread = np.array(t["uu"]).reshape(q, q), np.array(t["spread"]).reshape(q, q)
        free = groups * q - float(np.sum(inverse * spread))  # what the effects take of the rows, in degrees of freedom
        # In the scale where the covariance is the identity, bb + mm is its next value; (I - mm)^-1/2 bb (I - mm)^-1/2 has the same fixed point and gets there sooner.
        root = np.linalg.cholesky(sigma)
        white = np.linalg.inv(root)
        bb, mm = white @ uu @ white.T / groups, white @ spread @ white.T / groups
        gap = float(np.abs(bb + mm - np.eye(q)).max())
        values, vectors = np.linalg.eigh(np.eye(q) - (mm + mm.T) / 2)
        known = root @ (vectors / np.sqrt(np.maximum(values, 1e-9))) @ vectors.T
        new_sigma = known @ bb @ known.T
        new_sigma = (new_sigma + new_sigma.T) / 2 + 1e-10 * s2 * np.eye(q)
        if q == 1:
            new_sigma = np.array([[_extrapolated(passed, float(sigma[0, 0]), float(new_sigma[0, 0]))]])
        new_s2 = max(float(t["dev"]) / max(n - free - (f if reml else 0), 1.0), 1e-300) if family == "gaussian" else 1.0
        moved = max(np.abs(step / (1 + np.abs(beta[fixed]))).max(initial=0.0), gap, abs(new_s2 / s2 - 1))
        model = {"beta": beta.copy(), "v": v, "sigma": sigma, "s2": s2, "ll": float(t["ll"]) - (0.5 * np.linalg.slogdet(a)[1] - 0.5 * f * math.log(2 * math.pi) if reml else 0.0), "deviance": float(t["dev"])}
        beta[fixed] += step
        state = next_.select("__g", "u", "n")
        converged = moved < max(float(o.tolerance), 1e-6)
        if converged:
            break
        sigma, s2 = new_sigma, new_s2
    small.unpersist()
    state = state.withColumn("__g", F.when(F.col("__g") != NULL_KEY, F.expr("substring(__g, 2)")))
    if family == "poisson":
        model["ll"] -= float(rows.agg(F.sum(lgamma(F.col("__y") + 1))).first()[0])
    return model | {"beta": beta, "iterations": rounds, "converged": bool(converged), "n": n, "groups": int(groups)}, state


def _wald(model: dict, beta: np.ndarray, se: np.ndarray, intercept: bool, level: float) -> dict:
    """Fields of inference; ``beta`` and ``se`` have the intercept first if there is one."""
    k = int(intercept)
    with np.errstate(all="ignore"):
        z = beta[k:] / se[k:]
    half = float(dist.norm_ppf(np.array([0.5 + level / 2]))[0]) * se[k:]
    return model | {
        "std_errors": se[k:].tolist(), "intercept_std_error": float(se[0]) if k else None, "z_values": z.tolist(), "p_values": (2 * dist.norm_sf(np.abs(z))).tolist(),
        "ci_lower": (beta[k:] - half).tolist(), "ci_upper": (beta[k:] + half).tolist(),
    }


def _rounds(df: DataFrame, group: str, y: str, x: list[str], offset: str | None, slopes: list[int], family: str, o) -> tuple[dict, DataFrame]:
    p = len(x)
    cols = [y, *x, *([offset] if offset else [])]
    rows = usable(df, cols).select(F.col(group).cast("string").alias("__g"), double(y).alias("__y"), *[double(c).alias(f"__x{i}") for i, c in enumerate(x)], (double(offset) if offset else F.lit(0.0)).alias("__off"))
    if family == "poisson":
        rows = rows.where("__y >= 0")
    elif family == "binomial":
        rows = rows.where("__y BETWEEN 0 AND 1")
    m, state = _penalised(rows, p, family, [0, *[1 + i for i in slopes]], o)
    fixed = m["beta"] if o.fit_intercept else m["beta"][1:]
    q = 1 + len(slopes)
    params = len(fixed) + q * (q + 1) // 2 + int(family == "gaussian")
    var_group = float(m["sigma"][0, 0])
    model = {
        "intercept": float(m["beta"][0]) if o.fit_intercept else None, "coefficients": m["beta"][1:].tolist(), "var_group": var_group, "var_residual": float(m["s2"]),
        "icc": var_group / (var_group + float(m["s2"])), "random_cov": m["sigma"].tolist(), "random_dim": q, "log_likelihood": m["ll"], "aic": 2 * params - 2 * m["ll"],
        "bic": params * math.log(m["n"]) - 2 * m["ll"], "deviance": m["deviance"], "n_observations": m["n"], "n_groups": m["groups"], "n_features": p, "iterations": m["iterations"], "converged": m["converged"],
    }
    model = _wald(model, fixed, np.sqrt(np.maximum(0, np.diag(m["v"]))), bool(o.fit_intercept), float(o.confidence_level))
    nan = F.lit(float("nan"))
    return model, state.select(
        F.col("__g").alias("group"), F.get("u", F.lit(0)).alias("ranef"), nan.alias("ranef_se"), F.col("n").cast("long").alias("n"), F.lit(model["intercept"]).cast("double").alias("fixed_intercept"),
        F.array(*[F.lit(c) for c in model["coefficients"]]).cast("array<double>").alias("fixed_coefficients"), F.lit(var_group).alias("var_group"), F.lit(model["var_residual"]).alias("var_residual"), F.lit(model["icc"]).alias("icc"),
        F.col("u").alias("effects"),
    )


def glmm_fit_by(df: DataFrame, group: str, y: str, x: list[str], opts: dict | None = None) -> tuple[dict, DataFrame]:
    """(model, random effects): fixed effects, variances and intraclass correlation, and one row per group.

    A gaussian random intercept is fitted by REML or ML: the ratio of variances
    is searched on a logarithmic grid that is refined around its best value.
    poisson (log link), binomial (logit) and ``random_slopes`` (1-based places in
    x, with an unstructured covariance beside the intercept) go by rounds of
    penalised least squares (penalised quasi-likelihood), the covariance by the
    working model's equations, for the gaussian by REML or ML; ``log_likelihood``
    is the Laplace approximation at the fit, exact for the gaussian.  ``offset_column`` is the 1-based place in x of an offset.  Rows
    with a missing or infinite value, or a response the family can't have, are
    left out; null groups are one group.  Fewer than two groups, or groups of one
    row only, raise.  ranef_se is NaN; ``effects`` are intercept and slopes.
    """
    o = options.read({"glmm_family" if k.lower() == "family" else k: v for k, v in (opts or {}).items()}, **GLMM)
    family = FAMILIES.get(str(o.glmm_family).lower())
    if family is None:
        raise ValueError(f"family {o.glmm_family!r} is none of {sorted(FAMILIES)}")
    x = list(x)
    slopes = [int(i) for i in (o.random_slopes if isinstance(o.random_slopes, (list, tuple)) else [o.random_slopes])]
    places = [*slopes, *([int(o.offset_column)] if o.offset_column else [])]
    if any(not 1 <= i <= len(x) for i in places) or len(set(places)) < len(places):
        raise ValueError("random_slopes and offset_column are different places in x, from 1")
    carried = [x[i - 1] for i in slopes]
    offset = x.pop(int(o.offset_column) - 1) if o.offset_column else None
    if family != "gaussian" or slopes or offset or not o.fit_intercept:
        return _rounds(df, group, y, x, offset, [x.index(c) for c in carried], family, o)
    keyed = df.withColumn("__g", F.col(group).cast("string"))
    p = len(x)
    per = settled(moments(keyed, y, x, ["__g"]))
    groups, largest = per.agg(F.count(F.lit(1)), F.max("n")).first()
    if groups < 2 or largest < 2:
        raise TooFewGroups("a mixed model needs two groups and a group of two rows")
    grid = [0.0, *np.geomspace(1e-6, 1e4, 41)]
    for rounds in range(1, int(o.max_iterations or 6) + 1):
        s = _profiles(per, grid, p, bool(o.reml)).sort_values("ratio").reset_index(drop=True)
        k = int(s["ll"].idxmax())
        low, high = s["ratio"][max(0, k - 1)], s["ratio"][min(len(s) - 1, k + 1)]
        if high - low < float(o.tolerance) * (1 + high):
            break
        grid = list(np.linspace(low, high, 25))
    best = s.loc[k]
    ratio, s2 = float(best["ratio"]), float(best["s2"])
    beta, se = best["beta"], np.sqrt(np.maximum(0, np.diag(best["cov"]) * s2))
    params = p + 3
    model = {
        "intercept": float(beta[0]), "coefficients": beta[1:].tolist(), "var_group": ratio * s2, "var_residual": s2, "icc": ratio / (1 + ratio), "log_likelihood": float(best["ll"]),
        "aic": 2 * params - 2 * float(best["ll"]), "bic": params * math.log(best["n"]) - 2 * float(best["ll"]), "n_observations": int(best["n"]), "n_groups": int(best["groups"]), "n_features": p,
        "random_cov": [[ratio * s2]], "random_dim": 1, "iterations": rounds, "converged": bool(high - low < 1e-4 * (1 + high)),
    }
    model = _wald(model, beta, se, True, float(o.confidence_level))
    fixed = F.lit(float(beta[0]))
    for i in range(p):
        fixed = fixed + float(beta[i + 1]) * F.get("xbar", F.lit(i))
    effect = F.lit(ratio) * F.col("n") / (1 + ratio * F.col("n")) * (F.col("ybar") - fixed)
    ranef = per.select(
        F.col("__g").alias("group"), effect.alias("ranef"), F.lit(float("nan")).alias("ranef_se"), F.col("n").cast("long").alias("n"), F.lit(model["intercept"]).alias("fixed_intercept"),
        F.array(*[F.lit(c) for c in model["coefficients"]]).alias("fixed_coefficients"), F.lit(model["var_group"]).alias("var_group"), F.lit(s2).alias("var_residual"), F.lit(model["icc"]).alias("icc"),
        F.array(effect).alias("effects"),
    )
    return model, ranef


#: Fields of glmm_fit_agg.
AGG = """intercept double, coefficients array<double>, var_group double, var_residual double, icc double, random_cov array<array<double>>, random_dim int, log_likelihood double, aic double, bic double,
deviance double, n_observations long, n_groups long, n_features int, iterations int, converged boolean, std_errors array<double>, intercept_std_error double, z_values array<double>,
p_values array<double>, ci_lower array<double>, ci_upper array<double>"""


def glmm_fit_agg(df: DataFrame, group: str, y: str, x: list[str], opts: dict | None = None) -> DataFrame:
    """One row: the model of glmm_fit_by.  Its random effects are a table there, as a row that lists all groups grows with the data.  Too few groups or rows give no row."""
    try:
        model, _ = glmm_fit_by(df, group, y, x, opts)
    except TooFewGroups:
        return df.sparkSession.createDataFrame([], AGG)
    names = [part.split()[0] for part in AGG.split(",")]
    return df.sparkSession.createDataFrame([tuple(model.get(k) for k in names)], AGG)
