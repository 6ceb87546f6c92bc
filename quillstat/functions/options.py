"""Options of all functions: names, aliases, defaults, checks."""

from __future__ import annotations

#: Aliases of option names, as the documented interface has them.
ALIASES = {
    "intercept": "fit_intercept",
    "inference": "compute_inference",
    "confidence": "confidence_level",
    "max_iter": "max_iterations",
    "tol": "tolerance",
    "seed": "random_state",
    "p_diagonal": "initial_p_diagonal",
    "link": "poisson_link",
    "power": "tweedie_power",
    "dist": "aft_dist",
    "lower": "lower_bound",
    "upper": "upper_bound",
    "components": "n_components",
    "features": "feature_names",
    "priors": "prior",
    "offset": "offset_column",
    "random": "random_slopes",
    "groups": "group_columns",
    "crossed": "group_columns",
    "tau2": "tau_squared",
    "shrinkage": "tau_method",
    "theta": "nb_theta",
    "vcov_type": "vcov",
    "permutations": "n_permutations",
    "p": "p0",
    "rho": "rho_null",
}
CHOICES = {
    "solver": {"qr", "svd", "cholesky"},
    "hc_type": {"none", "hc0", "hc1", "hc2", "hc3"},
    "alternative": {"two_sided", "less", "greater"},
    "null_policy": {"drop", "drop_y_zero_x"},
    "lambda_scaling": {"raw", "glmnet"},
    "poisson_link": {"log", "identity", "sqrt"},
    "binomial_link": {"logit", "probit", "cloglog"},
    "aft_dist": {"weibull", "lognormal", "loglogistic", "exponential"},
    "vcov": {"laplace", "sandwich", "naive"},
    "outlier_method": {"zscore", "iqr"},
    "kind": {"welch", "student"},
    "loss": {"likelihood", "mse", "mae", "ham", "role", "squared", "absolute"},
}


def read(options: dict | None, **defaults):
    """The options over their defaults.  Names are case-insensitive; ``alpha`` wins over ``lambda``; unknown names and bad choices raise."""
    given = {}
    for k, v in (options or {}).items():
        k = k.lower()
        k = ALIASES.get(k, k)
        given.setdefault(k, v)
    if "lambda" in given:
        given.setdefault("alpha", given.pop("lambda"))
        given.pop("lambda", None)
    out = dict(defaults)
    for k, v in given.items():
        if k not in out and k not in COMMON:
            raise ValueError(f"unknown option {k!r}; known: {sorted(out)}")
        if isinstance(v, str) and k in CHOICES:
            v = v.lower().replace("two-sided", "two_sided")
            if v not in CHOICES[k]:
                raise ValueError(f"option {k}: {v!r} is none of {sorted(CHOICES[k])}")
        out[k] = bool(v) if isinstance(defaults.get(k), bool) else v
    if not 0 < float(out.get("confidence_level", 0.5)) < 1:
        raise ValueError("option confidence_level must lie between 0 and 1")
    return type("Options", (), out)


#: Accepted by every fit and without effect where a model has no use for them.
COMMON = {"solver", "hc_type", "compute_inference", "confidence_level", "fit_intercept", "null_policy", "feature_names"}
