"""One registered query per operator over the test tables, with DuckDB SQL where SQL can say the same.

Floating results are rounded alike on both sides.  p-values need distribution
functions that the oracle lacks; where they have no closed form, the query gives
the statistic and the oracle checks that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.operators import diagnostics as D
from quillstat.operators import glm as G
from quillstat.operators import hypothesis as H
from quillstat.operators import linear as L
from quillstat.operators import mixed as M
from quillstat.operators import resampling as S
from quillstat.operators import robust as R
from quillstat.sources.tables import table

ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as y, a, b, w, group g, binary group grp, success hit."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("a"), F.col("l_discount").alias("b"), F.col("l_tax").alias("w"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("grp"), F.when(F.col("l_discount") > 0.05, 1).otherwise(0).alias("hit"), F.col("l_linenumber").alias("k"), *ORDER,
    )


T = """t AS (SELECT l_returnflag AS g, l_extendedprice / 1000 AS y, l_quantity AS a, l_discount AS b, l_tax AS w,
  CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS grp, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS hit, l_linenumber AS k,
  l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM lineitem)"""
MOMENTS = T + """, m AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS saa, var_pop(b) * count(*) AS sbb, covar_pop(a, b) * count(*) AS sab,
  covar_pop(a, y) * count(*) AS say, covar_pop(b, y) * count(*) AS sby, var_pop(y) * count(*) AS syy FROM t GROUP BY g)"""


def r(c: str | Column, digits: int = 6, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col, digits).alias(name or str(c))


def coefs(df: DataFrame, *more: str, digits: int = 5) -> DataFrame:
    return df.select("g", r(F.get("coefficients", F.lit(0)), digits, "c1"), r(F.get("coefficients", F.lit(1)), digits, "c2"), r("intercept", digits), *[r(c, digits) for c in more], "n_observations")


def two_feature_sql(lam: str, more: str = "") -> str:
    return f"""WITH {MOMENTS},
f AS (SELECT *, ((sbb + {lam}) * say - sab * sby) / ((saa + {lam}) * (sbb + {lam}) - sab * sab) AS c1, ((saa + {lam}) * sby - sab * say) / ((saa + {lam}) * (sbb + {lam}) - sab * sab) AS c2 FROM m),
h AS (SELECT *, syy - 2 * (c1 * say + c2 * sby) + c1 * c1 * saa + 2 * c1 * c2 * sab + c2 * c2 * sbb AS rss FROM f)
SELECT g, round(c1, 5) AS c1, round(c2, 5) AS c2, round(my - c1 * ma - c2 * mb, 5) AS intercept, round(1 - rss / syy, 5) AS r_squared, round(1 - rss / syy * (n - 1) / (n - 3), 5) AS adj_r_squared,
  round(sqrt(rss / (n - 3)), 5) AS residual_std_error, n::BIGINT AS n_observations{more} FROM h"""


STATS = ("r_squared", "adj_r_squared", "residual_std_error")


@query("ols_fit_agg", two_feature_sql("0"))
def _(spark, sf):
    return coefs(L.fit_agg(lines(spark, sf), "ols", "y", ["a", "b"], ["g"]), *STATS)


@query("ridge_fit_agg", two_feature_sql("2.5"))
def _(spark, sf):
    return coefs(L.fit_agg(lines(spark, sf), "ridge", "y", ["a", "b"], ["g"], opts={"alpha": 2.5}), *STATS)


@query("ols_inference", f"""WITH {MOMENTS},
f AS (SELECT *, saa * sbb - sab * sab AS det FROM m), c AS (SELECT *, (sbb * say - sab * sby) / det AS c1, (saa * sby - sab * say) / det AS c2 FROM f),
h AS (SELECT *, (syy - c1 * say - c2 * sby) / (n - 3) AS s2 FROM c)
SELECT g, round(sqrt(s2 * sbb / det), 6) AS se1, round(sqrt(s2 * saa / det), 6) AS se2, round(c1 / sqrt(s2 * sbb / det), 4) AS t1, round(c2 / sqrt(s2 * saa / det), 4) AS t2,
  round((c1 * say + c2 * sby) / 2 / s2, 4) AS f_statistic, true AS p_in_range FROM h""")
def _(spark, sf):
    f = L.fit_agg(lines(spark, sf), "ols", "y", ["a", "b"], ["g"], opts={"compute_inference": True})
    at = lambda c, i: F.get(c, F.lit(i))
    return f.select("g", r(at("std_errors", 0), 6, "se1"), r(at("std_errors", 1), 6, "se2"), r(at("t_values", 0), 4, "t1"), r(at("t_values", 1), 4, "t2"), r("f_statistic", 4), F.forall("p_values", lambda p: (p >= 0) & (p <= 1)).alias("p_in_range"))


@query("ols_robust_errors", f"""WITH {MOMENTS},
e AS (SELECT t.g, t.a - ma AS z, t.y - my - say / saa * (t.a - ma) AS e, saa, n FROM t JOIN m USING (g))
SELECT g, round(sqrt(sum(e * e * z * z) / max(saa * saa)), 6) AS hc0, round(sqrt(max(n) / (max(n) - 2) * sum(e * e * z * z) / max(saa * saa)), 6) AS hc1,
  round(sqrt(sum(e * e * z * z / power(1 - 1 / n - z * z / saa, 2)) / max(saa * saa)), 6) AS hc3 FROM e GROUP BY g""")
def _(spark, sf):
    t = lines(spark, sf)
    one = lambda hc: L.fit_agg(t, "ols", "y", ["a"], ["g"], opts={"inference": True, "hc_type": hc}).select("g", r(F.get("std_errors", F.lit(0)), 6, hc))
    return one("hc0").join(one("hc1"), "g").join(one("hc3"), "g")


@query("wls_fit_agg", f"""WITH {T}, u AS (SELECT * FROM t WHERE w > 0), mm AS (SELECT g, sum(w * y) / sum(w) AS my, sum(w * a) / sum(w) AS ma, count(*) AS n FROM u GROUP BY g),
f AS (SELECT g, my, ma, n, sum(w * (a - ma) * (y - my)) / sum(w * (a - ma) * (a - ma)) AS c1 FROM u JOIN mm USING (g) GROUP BY g, my, ma, n)
SELECT g, round(c1, 5) AS c1, round(my - c1 * ma, 5) AS intercept, n::BIGINT AS n_observations FROM f""")
def _(spark, sf):
    f = L.fit_agg(lines(spark, sf), "wls", "y", ["a"], ["g"], weight="w")
    return f.select("g", r(F.get("coefficients", F.lit(0)), 5, "c1"), r("intercept", 5), "n_observations")


def one_feature(kind: str, opts: dict):
    def run(spark, sf):
        f = L.fit_agg(lines(spark, sf), kind, "y", ["a"], ["g"], opts=opts)
        return f.select("g", r(F.get("coefficients", F.lit(0)), 6, "c1"), r("intercept", 5), "n_observations")

    return run


def one_feature_sql(c1: str) -> str:
    return f"WITH {MOMENTS}, f AS (SELECT *, {c1} AS c1 FROM m) SELECT g, round(c1, 6) AS c1, round(my - c1 * ma, 5) AS intercept, n::BIGINT AS n_observations FROM f"


query("elasticnet_fit_agg", one_feature_sql("sign(say) * greatest(abs(say) - 500, 0) / (saa + 500)"))(one_feature("elasticnet", {"alpha": 1000.0, "l1_ratio": 0.5}))
query("lars_fit_agg", one_feature_sql("sign(say) * greatest(abs(say) - 0.2 * n, 0) / saa"))(one_feature("lars", {"alpha": 0.2}))
query("pls_fit_agg", one_feature_sql("say / saa"))(one_feature("pls", {}))
query("rls_fit_agg", f"""WITH {MOMENTS}, q AS (SELECT *, n + 0.01 AS k, n * ma AS sa, saa + n * ma * ma + 0.01 AS qa, say + n * ma * my AS qy FROM m),
f AS (SELECT *, (k * qy - sa * n * my) / (k * qa - sa * sa) AS c1, (qa * n * my - sa * qy) / (k * qa - sa * sa) AS c0 FROM q)
SELECT g, round(c1, 6) AS c1, round(c0, 5) AS intercept, n::BIGINT AS n_observations FROM f""")(one_feature("rls", {}))


@query("bls_fit_agg", f"""WITH {T}, f AS (SELECT g, sum(a * y) / sum(a * a) AS c, count(*) AS n FROM t GROUP BY g)
SELECT g, round(least(c, 1.2), 6) AS c1, c >= 1.2 AS at_upper, n::BIGINT AS n_observations FROM f""")
def _(spark, sf):
    f = L.fit_agg(lines(spark, sf), "bls", "y", ["a"], ["g"], opts={"lower_bound": 0.0, "upper_bound": 1.2})
    return f.select("g", r(F.get("coefficients", F.lit(0)), 6, "c1"), F.get("at_upper_bound", F.lit(0)).alias("at_upper"), "n_observations")


@query("nnls_fit_agg", f"WITH {T} SELECT g, round(greatest(sum(a * y) / sum(a * a), 0), 6) AS c1, count(*) AS n_observations FROM t GROUP BY g")
def _(spark, sf):
    f = L.fit_agg(lines(spark, sf), "nnls", "y", ["a"], ["g"])
    return f.select("g", r(F.get("coefficients", F.lit(0)), 6, "c1"), "n_observations")


def predictions(kind: str, **kw):
    """yhat of lines that a split keeps out of training, and all others."""

    def run(spark, sf):
        t = lines(spark, sf).withColumn("split", F.when(F.col("k") == 1, "test").otherwise("Train"))
        p = L.fit_predict_by(t, kind, "y", ["a"], ["g"], split="split", **kw)
        return p.select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 4), "is_training")

    return run


def predictions_sql(c1: str) -> str:
    return f"""WITH {T}, m AS (SELECT g, count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, var_pop(a) * count(*) AS saa, covar_pop(a, y) * count(*) AS say FROM t WHERE k <> 1 GROUP BY g),
f AS (SELECT g, my, ma, {c1} AS c1 FROM m)
SELECT l_orderkey, l_partkey, l_suppkey, round(my + c1 * (a - ma), 4) AS yhat, k <> 1 AS is_training FROM t JOIN f USING (g)"""


query("ols_fit_predict_by", predictions_sql("say / saa"))(predictions("ols"))
query("ridge_fit_predict_by", predictions_sql("say / (saa + 5000)"))(predictions("ridge", opts={"alpha": 5000.0}))
query("elasticnet_fit_predict_by", predictions_sql("sign(say) * greatest(abs(say) - 500, 0) / (saa + 500)"))(predictions("elasticnet", opts={"alpha": 1000.0}))
query("pls_fit_predict_by", predictions_sql("say / saa"))(predictions("pls"))
query("wls_fit_predict_by", f"""WITH {T}, m AS (SELECT g, sum(w * y) / sum(w) AS my, sum(w * a) / sum(w) AS ma FROM t WHERE k <> 1 AND w > 0 GROUP BY g),
f AS (SELECT g, my, ma, sum(w * (a - ma) * (y - my)) / sum(w * (a - ma) * (a - ma)) AS c1 FROM t JOIN m USING (g) WHERE k <> 1 AND w > 0 GROUP BY g, my, ma)
SELECT l_orderkey, l_partkey, l_suppkey, round(my + c1 * (a - ma), 4) AS yhat, k <> 1 AS is_training FROM t JOIN f USING (g)""")(predictions("wls", weight="w"))
query("rls_fit_predict_by", f"""WITH {T}, m AS (SELECT g, count(*) + 0.01 AS n, sum(y) AS sy, sum(a) AS sa, sum(a * a) + 0.01 AS qa, sum(a * y) AS qy FROM t WHERE k <> 1 GROUP BY g),
f AS (SELECT g, (n * qy - sa * sy) / (n * qa - sa * sa) AS c1, (qa * sy - sa * qy) / (n * qa - sa * sa) AS c0 FROM m)
SELECT l_orderkey, l_partkey, l_suppkey, round(c0 + c1 * a, 4) AS yhat, k <> 1 AS is_training FROM t JOIN f USING (g)""")(predictions("rls"))
query("bls_fit_predict_by", f"""WITH {T}, f AS (SELECT g, greatest(sum(a * y) / sum(a * a), 0) AS c1 FROM t WHERE k <> 1 GROUP BY g)
SELECT l_orderkey, l_partkey, l_suppkey, round(c1 * a, 4) AS yhat, k <> 1 AS is_training FROM t JOIN f USING (g)""")(predictions("bls"))


FRAME = "OVER (PARTITION BY g ORDER BY " + ", ".join(ORDER) + " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def window_sql(slope: str, where: str = "") -> str:
    """yhat of all rows: null up to the third, whose frames have no more rows than coefficients; ``slope`` counts 0 while a is constant."""
    return f"""WITH {T}, v AS (SELECT *, count(*) {FRAME} AS n, avg(y) {FRAME} AS my, avg(a) {FRAME} AS ma, var_pop(a) {FRAME} * count(*) {FRAME} AS saa, covar_pop(a, y) {FRAME} * count(*) {FRAME} AS say, last_value(a) {FRAME} AS last_a FROM t{where})
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN n > 2 THEN round(my + CASE WHEN saa > 1e-9 THEN {slope} ELSE 0 END * (last_a - ma), 3) END AS yhat FROM v"""


def window_query(kind: str, **kw):
    def run(spark, sf):
        p = L.fit_predict_window(lines(spark, sf), kind, "y", ["a"], ["g"], ORDER, **kw)
        return p.select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 3))

    return run


query("ols_fit_predict", window_sql("say / saa"))(window_query("ols"))
query("ridge_fit_predict", window_sql("say / (saa + 100)"))(window_query("ridge", opts={"alpha": 100.0}))
query("elasticnet_fit_predict", window_sql("sign(say) * greatest(abs(say) - 50, 0) / (saa + 50)"))(window_query("elasticnet", opts={"alpha": 100.0}))
# weights of 0 leave a row out of the frame's fit, not out of its place
query("wls_fit_predict", f"""WITH {T}, u AS (SELECT *, CASE WHEN b > 0 THEN b END AS w1 FROM t), v AS (SELECT *, count(w1) {FRAME} AS n, sum(w1) {FRAME} AS sw, sum(w1 * (y - 40)) {FRAME} / sum(w1) {FRAME} AS my, sum(w1 * (a - 25)) {FRAME} / sum(w1) {FRAME} AS ma,
  sum(w1 * (a - 25) * (a - 25)) {FRAME} AS qa, sum(w1 * (a - 25) * (y - 40)) {FRAME} AS qy, last_value(a) {FRAME} - 25 AS last_a FROM u), h AS (SELECT *, qa - sw * ma * ma AS saa, qy - sw * ma * my AS say FROM v)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN n > 2 THEN round(40 + my + CASE WHEN saa > 1e-9 THEN say / saa ELSE 0 END * (last_a - ma), 3) END AS yhat FROM h""")(window_query("wls", weight="b"))
query("rls_fit_predict", f"""WITH {T}, v AS (SELECT *, count(*) {FRAME} AS n, sum(y) {FRAME} AS sy, sum(a) {FRAME} AS sa, sum(a * a) {FRAME} + 0.01 AS qa, sum(a * y) {FRAME} AS qy, last_value(a) {FRAME} AS last_a FROM t),
h AS (SELECT *, ((n + 0.01) * qy - sa * sy) / ((n + 0.01) * qa - sa * sa) AS c1, (qa * sy - sa * qy) / ((n + 0.01) * qa - sa * sa) AS c0 FROM v)
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN n > 2 THEN round(c0 + c1 * last_a, 3) END AS yhat FROM h""")(window_query("rls"))


@query("window_rolling_30", f"""WITH {T}, v AS (SELECT *, regr_slope(y, a) OVER f AS s, avg(y) OVER f AS my, avg(a) OVER f AS ma, var_pop(a) OVER f AS va, count(*) OVER f AS n FROM t
  WINDOW f AS (PARTITION BY g ORDER BY {', '.join(ORDER)} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN n > 2 THEN round(my + CASE WHEN va > 1e-9 THEN s ELSE 0 END * (a - ma), 3) END AS yhat FROM v""")
def _(spark, sf):
    p = L.fit_predict_window(lines(spark, sf), "ols", "y", ["a"], ["g"], ORDER, frame=(-29, 0))
    return p.select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 3))


#: A line through all lines but those of line number 7, which lie far off: robust fits find it exactly.
EXACT = "CASE WHEN k = 7 THEN 500 + 9 * b ELSE 2 + 3 * a END"


def exact(spark, sf):
    return lines(spark, sf).withColumn("e", F.expr(EXACT))


#: In so many lines of a frame of 30 the fit must still find the line.
for _kind, _far in (("huber", 1), ("ransac", 8), ("theilsen", 5)):
    query(f"{_kind}_fit_predict", f"""WITH {T}, v AS (SELECT *, count(*) OVER f AS n, count(*) FILTER (k = 7) OVER f AS far FROM t WINDOW f AS (PARTITION BY g ORDER BY {', '.join(ORDER)} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT l_orderkey, l_partkey, l_suppkey, n, far, CASE WHEN n = 30 AND far <= {_far} THEN round(2 + 3 * a, 2) END AS yhat FROM v""")(
        lambda spark, sf, kind=_kind, most=_far: robust_window(exact(spark, sf), kind, most)
    )


def robust_window(t: DataFrame, kind: str, most: int) -> DataFrame:
    counts = {"n": lambda w: F.count(F.lit(1)).over(w), "far": lambda w: F.count(F.when(F.col("k") == 7, 1)).over(w)}
    p = R.fit_predict_window(t, kind, "e", ["a"], ["g"], ORDER, keep=["l_orderkey", "l_partkey", "l_suppkey", "k"], over=counts)
    return p.select("l_orderkey", "l_partkey", "l_suppkey", "n", "far", F.when((F.col("n") == 30) & (F.col("far") <= most), F.round("yhat", 2)).alias("yhat"))


# -- iterative fits -------------------------------------------------------------------

# a model with an intercept alone has its mean as fitted value, so SQL gives deviances
@query("poisson_fit_agg", f"""WITH {T}, m AS (SELECT g, avg(a) AS mu, count(*) AS n FROM t GROUP BY g)
SELECT g, round(ln(max(mu)), 5) AS intercept, round(2 * sum(a * ln(a / mu) - (a - mu)), 2) AS null_deviance, max(n)::BIGINT AS n_observations FROM t JOIN m USING (g) GROUP BY g""")
def _(spark, sf):
    t = lines(spark, sf).withColumn("one", F.lit(1.0))
    return G.glm_fit_agg(t, "poisson", "a", ["one"], ["g"]).select("g", r("intercept", 5), r("null_deviance", 2), "n_observations")


def glm_query(kind: str, y: str, opts: dict | None = None):
    def run(spark, sf):
        f = G.glm_fit_agg(lines(spark, sf), kind, y, ["b"], ["g"], {"max_iterations": 25} | (opts or {}))
        return f.select("g", r(F.get("coefficients", F.lit(0)), 3, "c1"), r("intercept", 3), "n_observations", "converged")

    return run


@query("logistic_fit_agg", f"""WITH {T}, m AS (SELECT g, grp, avg(hit) AS p, count(*) AS n FROM t GROUP BY g, grp)
SELECT g, round(max(ln(p / (1 - p))) FILTER (grp = 0), 4) AS intercept, round(max(ln(p / (1 - p))) FILTER (grp = 1) - max(ln(p / (1 - p))) FILTER (grp = 0), 4) AS c1, sum(n)::BIGINT AS n_observations FROM m GROUP BY g""")
def _(spark, sf):
    f = G.glm_fit_agg(lines(spark, sf), "logistic", "hit", ["grp"], ["g"])
    return f.select("g", r("intercept", 4), r(F.get("coefficients", F.lit(0)), 4, "c1"), "n_observations")


@query("gamma_fit_agg", f"""WITH {T}, m AS (SELECT g, grp, avg(y) AS p, count(*) AS n FROM t GROUP BY g, grp)
SELECT g, round(max(ln(p)) FILTER (grp = 0), 4) AS intercept, round(max(ln(p)) FILTER (grp = 1) - max(ln(p)) FILTER (grp = 0), 4) AS c1, sum(n)::BIGINT AS n_observations FROM m GROUP BY g""")
def _(spark, sf):
    f = G.glm_fit_agg(lines(spark, sf), "gamma", "y", ["grp"], ["g"])
    return f.select("g", r("intercept", 4), r(F.get("coefficients", F.lit(0)), 4, "c1"), "n_observations")


ORACLE["tweedie_fit_agg"] = ORACLE["gamma_fit_agg"]


@query("tweedie_fit_agg", ORACLE["gamma_fit_agg"])
def _(spark, sf):
    f = G.glm_fit_agg(lines(spark, sf), "tweedie", "y", ["grp"], ["g"])
    return f.select("g", r("intercept", 4), r(F.get("coefficients", F.lit(0)), 4, "c1"), "n_observations")


query("binomial_fit_agg", ORACLE["logistic_fit_agg"])(lambda spark, sf: G.glm_fit_agg(lines(spark, sf), "binomial", "hit", ["grp"], ["g"]).select("g", r("intercept", 4), r(F.get("coefficients", F.lit(0)), 4, "c1"), "n_observations"))
query("negbinom_fit_agg", f"""WITH {T}, m AS (SELECT g, grp, avg(a) AS p, count(*) AS n FROM t GROUP BY g, grp)
SELECT g, round(max(ln(p)) FILTER (grp = 0), 4) AS intercept, round(max(ln(p)) FILTER (grp = 1) - max(ln(p)) FILTER (grp = 0), 4) AS c1, sum(n)::BIGINT AS n_observations FROM m GROUP BY g""")(
    lambda spark, sf: G.glm_fit_agg(lines(spark, sf), "negbinom", "a", ["grp"], ["g"], {"theta": 2.0}).select("g", r("intercept", 4), r(F.get("coefficients", F.lit(0)), 4, "c1"), "n_observations")
)


@query("aft_weibull")
def _(spark, sf):
    t = lines(spark, sf).withColumn("event", F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(1.0))
    f = G.aft_fit_agg(t, "a", ["b"], "event", ["g"])
    return f.select("g", r("intercept", 3), r("scale", 3), "n_events", "n_censored", "converged")


@query("aft_cdf", f"WITH {T} SELECT l_orderkey, l_partkey, l_suppkey, round(1 - exp(-exp((ln(a) - 3) / 0.7)), 6) AS weibull, round(1 / (1 + exp(-(ln(a) - 3) / 0.7)), 6) AS loglogistic FROM t")
def _(spark, sf):
    f = lambda d: r(G.aft_cdf(F.col("a"), F.lit(3.0), F.lit(0.7), d), 6, d)
    return lines(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", f("weibull"), f("loglogistic"))


@query("aft_quantile", f"WITH {T} SELECT l_orderkey, l_partkey, l_suppkey, round(exp(3 + 0.7 * ln(-ln(1 - (b + 0.2)))), 5) AS weibull, round(exp(3 + 0.7 * ln((b + 0.2) / (0.8 - b))), 5) AS loglogistic FROM t")
def _(spark, sf):
    f = lambda d: r(G.aft_quantile(F.col("b") + 0.2, F.lit(3.0), F.lit(0.7), d), 5, d)
    return lines(spark, sf).select("l_orderkey", "l_partkey", "l_suppkey", f("weibull"), f("loglogistic"))


query("alm_fit_agg", one_feature_sql("say / saa").replace("round(c1, 6)", "round(c1, 5)").replace("intercept, n", "intercept, round(-n / 2 * (ln(2 * pi()) + 1) - n / 2 * ln((syy - c1 * say) / n), 2) AS log_likelihood, n"))(
    lambda spark, sf: R.alm_fit_agg(lines(spark, sf), "y", ["a"], ["g"]).select("g", r(F.get("coefficients", F.lit(0)), 5, "c1"), r("intercept", 5), r("log_likelihood", 2), "n_observations")
)
# -- tests ----------------------------------------------------------------------------

query("jarque_bera_agg", f"""WITH {T}, m AS (SELECT g, avg(y) AS m FROM t GROUP BY g), q AS (SELECT g, count(*)::DOUBLE AS n, avg(power(y - m, 2)) AS m2, avg(power(y - m, 3)) AS m3, avg(power(y - m, 4)) AS m4 FROM t JOIN m USING (g) GROUP BY g),
s AS (SELECT g, n, m3 / power(m2, 1.5) AS sk, m4 / (m2 * m2) - 3 AS ku FROM q)
SELECT g, round(n / 6 * (sk * sk + ku * ku / 4), 3) AS statistic, round(sk, 5) AS skewness, round(ku, 5) AS kurtosis, n::BIGINT AS n FROM s""")(
    lambda spark, sf: H.jarque_bera_agg(lines(spark, sf), "y", ["g"]).select("g", r("statistic", 3), r("skewness", 5), r("kurtosis", 5), "n")
)
query("shapiro_wilk_agg")(lambda spark, sf: H.shapiro_wilk_agg(lines(spark, sf), "y", ["l_suppkey"]).select("l_suppkey", r("statistic", 5), r("p_value", 5), "n"))
TWO = f"""WITH {T}, m AS (SELECT g, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp <> 0) AS n2, avg(y) FILTER (grp = 0) AS m1, avg(y) FILTER (grp <> 0) AS m2, var_samp(y) FILTER (grp = 0) AS v1, var_samp(y) FILTER (grp <> 0) AS v2 FROM t GROUP BY g)"""
query("t_test_agg", TWO + " SELECT g, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS statistic, round(power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1)), 3) AS df, n1, n2 FROM m")(
    lambda spark, sf: H.t_test_agg(lines(spark, sf), "y", "grp", ["g"]).select("g", r("statistic", 5), r("df", 3), "n1", "n2")
)
query("tost_t_test_agg", TWO + " SELECT g, round((m1 - m2 + 1.5) / sqrt(v1 / n1 + v2 / n2), 5) AS t_lower, round((m1 - m2 - 1.5) / sqrt(v1 / n1 + v2 / n2), 5) AS t_upper, round(m1 - m2, 5) AS estimate, n1 + n2 AS n FROM m")(
    lambda spark, sf: H.tost_t_test_agg(lines(spark, sf), "y", "grp", ["g"], {"delta": 1.5}).select("g", r("t_lower", 5), r("t_upper", 5), r("estimate", 5), "n")
)
ANOVA = "per AS (SELECT g, k, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS ss FROM {0} GROUP BY g, k), q AS (SELECT g, count(*) AS k, sum(n) AS n, sum(ss) AS w, sum(n * m * m) - power(sum(n * m), 2) / sum(n) AS b FROM per GROUP BY g)"
query("one_way_anova_agg", f"WITH {T}, u AS (SELECT *, y AS v FROM t), {ANOVA.format('u')} SELECT g, round(b / (k - 1) / (w / (n - k)), 5) AS f_statistic, round(b, 3) AS ss_between, round(w, 1) AS ss_within, k AS n_groups, n::BIGINT AS n FROM q")(
    lambda spark, sf: H.one_way_anova_agg(lines(spark, sf), "y", "k", ["g"]).select("g", r("f_statistic", 5), r("ss_between", 3), r("ss_within", 1), "n_groups", "n")
)
query("brown_forsythe_agg", f"WITH {T}, md AS (SELECT g, k, median(y) AS md FROM t GROUP BY g, k), u AS (SELECT t.g, t.k, abs(y - md) AS v FROM t JOIN md ON t.g = md.g AND t.k = md.k), {ANOVA.format('u')} SELECT g, round(b / (k - 1) / (w / (n - k)), 5) AS statistic, n::BIGINT AS n FROM q")(
    lambda spark, sf: H.brown_forsythe_agg(lines(spark, sf), "y", "k", ["g"]).select("g", r("statistic", 5), "n")
)
RANKS = "rk AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY g, a) AS ties, count(*) OVER (PARTITION BY g) AS nn FROM t)"
query("mann_whitney_u_agg", f"WITH {T}, {RANKS} SELECT g, round(sum(rk) FILTER (grp = 0) - count(*) FILTER (grp = 0) * (count(*) FILTER (grp = 0) + 1) / 2.0, 1) AS statistic, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp <> 0) AS n2 FROM rk GROUP BY g")(
    lambda spark, sf: H.mann_whitney_u_agg(lines(spark, sf), "a", "grp", ["g"]).select("g", r("statistic", 1), "n1", "n2")
)
query("kruskal_wallis_agg", f"""WITH {T}, {RANKS}, per AS (SELECT g, k, count(*) AS n, sum(rk) AS s, sum(ties * ties - 1) AS t FROM rk GROUP BY g, k),
q AS (SELECT g, count(*) AS k, sum(n)::DOUBLE AS n, sum(s * s / n) AS q, sum(t) AS t FROM per GROUP BY g)
SELECT g, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS statistic, k - 1 AS df, n::BIGINT AS n FROM q""")(
    lambda spark, sf: H.kruskal_wallis_agg(lines(spark, sf), "a", "k", ["g"]).select("g", r("statistic", 4), "df", "n")
)
query("wilcoxon_signed_rank_agg", f"""WITH {T}, d AS (SELECT g, a - k * 5 AS d FROM t WHERE a <> k * 5), u AS (SELECT *, rank() OVER (PARTITION BY g ORDER BY abs(d)) + (count(*) OVER (PARTITION BY g, abs(d)) - 1) / 2.0 AS rk FROM d)
SELECT g, round(sum(CASE WHEN d > 0 THEN rk ELSE 0 END), 1) AS statistic, count(*) AS n FROM u GROUP BY g""")(
    lambda spark, sf: H.wilcoxon_signed_rank_agg(lines(spark, sf).withColumn("k5", F.col("k") * 5), "a", "k5", ["g"]).select("g", r("statistic", 1), "n")
)
query("brunner_munzel_agg", f"""WITH {T}, {RANKS}, q AS (SELECT g, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp <> 0) AS n2, avg(rk) FILTER (grp <> 0) AS r2 FROM rk GROUP BY g)
SELECT g, round((r2 - (n2 + 1) / 2.0) / n1, 6) AS effect_size, n1, n2 FROM q""")(
    lambda spark, sf: H.brunner_munzel_agg(lines(spark, sf), "a", "grp", ["g"]).select("g", r("effect_size", 6), "n1", "n2")
)
query("pearson_agg", f"""WITH {T}, q AS (SELECT g, corr(a, y) AS r, count(*) AS n FROM t GROUP BY g)
SELECT g, round(r, 6) AS r, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS statistic, round((exp(2 * (atanh(r) - 1.959963984540054 / sqrt(n - 3))) - 1) / (exp(2 * (atanh(r) - 1.959963984540054 / sqrt(n - 3))) + 1), 5) AS ci_lower, n FROM q""")(
    lambda spark, sf: H.pearson_agg(lines(spark, sf), "a", "y", ["g"]).select("g", r("r", 6), r("statistic", 5), r("ci_lower", 5), "n")
)
query("spearman_agg", f"""WITH {T}, u AS (SELECT g, rank() OVER (PARTITION BY g ORDER BY a) + (count(*) OVER (PARTITION BY g, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY g ORDER BY y) + (count(*) OVER (PARTITION BY g, y) - 1) / 2.0 AS ry FROM t)
SELECT g, round(corr(ra, ry), 6) AS r, count(*) AS n FROM u GROUP BY g""")(lambda spark, sf: H.spearman_agg(lines(spark, sf), "a", "y", ["g"]).select("g", r("r", 6), "n"))
query("kendall_agg", f"""WITH {T}, p AS (SELECT x.l_suppkey, sign(x.a - z.a) * sign(x.y - z.y) AS s, sign(x.a - z.a) <> 0 AS ua, sign(x.y - z.y) <> 0 AS uy FROM t x JOIN t z ON x.l_suppkey = z.l_suppkey)
SELECT l_suppkey, round(sum(s) / sqrt(count(*) FILTER (ua)::DOUBLE * count(*) FILTER (uy)), 6) AS tau FROM p GROUP BY l_suppkey""")(lambda spark, sf: S.kendall_agg(lines(spark, sf), "a", "y", ["l_suppkey"]).select("l_suppkey", r("tau", 6)))
query("energy_distance_agg", f"""WITH {T}, p AS (SELECT x.l_suppkey, x.grp AS p, z.grp AS q, avg(abs(x.y - z.y)) AS d FROM t x JOIN t z ON x.l_suppkey = z.l_suppkey GROUP BY 1, 2, 3), c AS (SELECT l_suppkey, grp, count(*) AS n FROM t GROUP BY 1, 2),
k AS (SELECT l_suppkey FROM c GROUP BY l_suppkey HAVING min(n) >= 2)
SELECT l_suppkey, round(2 * max(d) FILTER (p = 0 AND q = 1) - max(d) FILTER (p = 0 AND q = 0) - max(d) FILTER (p = 1 AND q = 1), 5) AS statistic FROM p JOIN k USING (l_suppkey) GROUP BY l_suppkey HAVING count(*) = 4""")(
    lambda spark, sf: S.energy_distance_agg(lines(spark, sf), "y", "grp", ["l_suppkey"]).select("l_suppkey", r("statistic", 5))
)
query("mmd_agg")(lambda spark, sf: S.mmd_agg(lines(spark, sf), "y", "grp", ["l_suppkey"]).select("l_suppkey", r("statistic", 6), "n1", "n2"))
@query("icc_agg", """WITH c AS (SELECT l_suppkey % 5 AS s, l_linenumber AS q, avg(l_extendedprice / 1000) AS v FROM lineitem GROUP BY 1, 2),
k AS (SELECT count(DISTINCT s)::DOUBLE AS n, count(DISTINCT q)::DOUBLE AS k, var_pop(v) * count(*) AS sst FROM c), a AS (SELECT var_pop(m) * count(*) AS ssr FROM (SELECT s, avg(v) AS m FROM c GROUP BY s)), b AS (SELECT var_pop(m) * count(*) AS ssc FROM (SELECT q, avg(v) AS m FROM c GROUP BY q)),
e AS (SELECT n, k, k * ssr / (n - 1) AS r, n * ssc / (k - 1) AS c, (sst - k * ssr - n * ssc) / ((n - 1) * (k - 1)) AS e FROM k, a, b)
SELECT round((r - e) / (r + (k - 1) * e + k * (c - e) / n), 6) AS icc, round(r / e, 5) AS f_statistic FROM e""")
def _(spark, sf):
    c = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 5).alias("s"), F.col("l_linenumber").alias("q")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("v"))
    return H.icc_agg(c, "v", "s", "q").select(r("icc", 6), r("f_statistic", 5))


FOUR = "WITH p AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0)::DOUBLE AS a, count(*) FILTER (quality = 0 AND toxic = 1)::DOUBLE AS b, count(*) FILTER (quality = 1 AND toxic = 0)::DOUBLE AS c, count(*) FILTER (quality = 1 AND toxic = 1)::DOUBLE AS d, count(*)::DOUBLE AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), x AS (SELECT *, n * power(a * d - b * c, 2) / ((a + b) * (c + d) * (a + c) * (b + d)) AS chi2 FROM p)"
labels = lambda spark, sf: table(spark, sf, "labels")
query("chisq_test_agg", FOUR + " SELECT round(chi2, 6) AS statistic, 1 AS df FROM x")(lambda spark, sf: H.chisq_test_agg(labels(spark, sf), "quality", "toxic").select(r("statistic", 6), F.col("df").cast("int").alias("df")))
query("g_test_agg", FOUR + " SELECT round(2 * (CASE WHEN a > 0 THEN a * ln(a * n / ((a + b) * (a + c))) ELSE 0 END + CASE WHEN b > 0 THEN b * ln(b * n / ((a + b) * (b + d))) ELSE 0 END + CASE WHEN c > 0 THEN c * ln(c * n / ((c + d) * (a + c))) ELSE 0 END + CASE WHEN d > 0 THEN d * ln(d * n / ((c + d) * (b + d))) ELSE 0 END), 6) AS statistic FROM x")(
    lambda spark, sf: H.g_test_agg(labels(spark, sf), "quality", "toxic").select(r("statistic", 6))
)
query("cramers_v_agg", FOUR + " SELECT round(sqrt(chi2 / n), 6) AS cramers_v FROM x")(lambda spark, sf: H.cramers_v_agg(labels(spark, sf), "quality", "toxic").select(r("cramers_v", 6)))
query("contingency_coef_agg", FOUR + " SELECT round(sqrt(chi2 / (chi2 + n)), 6) AS contingency_coef FROM x")(lambda spark, sf: H.contingency_coef_agg(labels(spark, sf), "quality", "toxic").select(r("contingency_coef", 6)))
query("phi_coefficient_agg", FOUR + " SELECT round((a * d - b * c) / sqrt((a + b) * (c + d) * (a + c) * (b + d)), 6) AS phi FROM x")(lambda spark, sf: H.phi_coefficient_agg(labels(spark, sf), "quality", "toxic").select(r("phi", 6)))
query("mcnemar_agg", FOUR + " SELECT round(power(greatest(abs(b - c) - 1, 0), 2) / (b + c), 6) AS statistic FROM x")(lambda spark, sf: H.mcnemar_agg(labels(spark, sf), "quality", "toxic").select(r("statistic", 6)))
query("cohen_kappa_agg", FOUR + ", k AS (SELECT (a + d) / n AS po, ((a + b) * (a + c) + (c + d) * (b + d)) / (n * n) AS pe, n FROM x) SELECT round((po - pe) / (1 - pe), 6) AS kappa, round(sqrt(po * (1 - po) / n) / (1 - pe), 6) AS se FROM k")(
    lambda spark, sf: H.cohen_kappa_agg(labels(spark, sf), "quality", "toxic").select(r("kappa", 6), r("se", 6))
)
query("chisq_gof_agg", "WITH c AS (SELECT l_linenumber, count(*)::DOUBLE AS o FROM lineitem GROUP BY 1), s AS (SELECT sum(o) AS n, count(*) AS k FROM c) SELECT round(sum(power(o - n / k, 2) / (n / k)), 5) AS statistic, max(k) - 1 AS df FROM c, s")(
    lambda spark, sf: H.chisq_gof_agg(table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("o")).withColumn("p", F.lit(1.0)), "o", "p").select(r("statistic", 5), "df")
)
query("prop_test_one_agg", f"WITH {T} SELECT g, round((avg(hit) - 0.5) / sqrt(0.25 / count(*)), 5) AS statistic, round(avg(hit), 6) AS estimate, count(*) AS n FROM t GROUP BY g")(lambda spark, sf: H.prop_test_one_agg(lines(spark, sf), "hit", ["g"]).select("g", r("statistic", 5), r("estimate", 6), "n"))
query("prop_test_two_agg", f"""WITH {T}, q AS (SELECT g, avg(hit) FILTER (grp = 0) AS p1, avg(hit) FILTER (grp = 1) AS p2, avg(hit) AS p, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp = 1) AS n2 FROM t GROUP BY g)
SELECT g, round(sign(p1 - p2) * (abs(p1 - p2) - least(0.5 * (1 / n1 + 1 / n2), abs(p1 - p2))) / sqrt(p * (1 - p) * (1 / n1 + 1 / n2)), 5) AS statistic, round(p1 - p2, 6) AS estimate FROM q WHERE n1 > 0 AND n2 > 0""")(
    lambda spark, sf: H.prop_test_two_agg(lines(spark, sf), "hit", "grp", ["g"]).select("g", r("statistic", 5), r("estimate", 6))
)
query("tost_paired_agg", f"WITH {T} SELECT g, round(avg(a - y), 5) AS estimate, count(*) AS n FROM t GROUP BY g")(lambda spark, sf: H.tost_paired_agg(lines(spark, sf), "a", "y", ["g"]).select("g", r("estimate", 5), "n"))
query("tost_correlation_agg", f"WITH {T} SELECT g, round(corr(a, y), 6) AS estimate, count(*) AS n FROM t GROUP BY g")(lambda spark, sf: H.tost_correlation_agg(lines(spark, sf), "a", "y", ["g"]).select("g", r("estimate", 6), "n"))
query("diebold_mariano_agg", f"""WITH {T}, d AS (SELECT g, power(y - a, 2) - power(y - k * 10, 2) AS d FROM t), q AS (SELECT g, avg(d) AS m, var_pop(d) AS v, count(*)::DOUBLE AS n FROM d GROUP BY g)
SELECT g, round(m / sqrt(v / n) * sqrt((n - 1) / n), 5) AS statistic, n::BIGINT AS n FROM q""")(
    lambda spark, sf: H.diebold_mariano_agg(lines(spark, sf).withColumn("f2", F.col("k") * 10), "y", "a", "f2", ["g"]).select("g", r("statistic", 5), "n")
)
query("clark_west_agg", f"""WITH {T}, d AS (SELECT g, power(y - a, 2) - power(y - k * 10, 2) + power(k * 10 - a, 2) AS d FROM t), q AS (SELECT g, avg(d) AS m, var_pop(d) AS v, count(*)::DOUBLE AS n FROM d GROUP BY g)
SELECT g, round(m / sqrt(v / n), 5) AS statistic, n::BIGINT AS n FROM q""")(
    lambda spark, sf: H.clark_west_agg(lines(spark, sf).withColumn("f2", F.col("k") * 10), "y", "a", "f2", ["g"]).select("g", r("statistic", 5), "n")
)

# -- diagnostics ----------------------------------------------------------------------

query("vif_agg", f"WITH {T} SELECT g, round(1 / (1 - power(corr(a, b), 2)), 6) AS v1, round(1 / (1 - power(corr(a, b), 2)), 6) AS v2 FROM t GROUP BY g")(
    lambda spark, sf: D.vif_agg(lines(spark, sf), ["a", "b"], ["g"]).select("g", r(F.get("vif", F.lit(0)), 6, "v1"), r(F.get("vif", F.lit(1)), 6, "v2"))
)
query("residuals_diagnostics_agg", f"WITH {MOMENTS} SELECT l_orderkey, l_partkey, l_suppkey, round(y - a, 5) AS raw, round(1 / n + power(a - ma, 2) / saa, 8) AS leverage FROM t JOIN m USING (g)")(
    lambda spark, sf: D.residuals_diagnostics_agg(lines(spark, sf), "y", "a", ["a"], ["g"]).select("l_orderkey", "l_partkey", "l_suppkey", r("raw", 5), r("leverage", 8))
)
query("aic", f"WITH {T} SELECT g, round(count(*) * ln(sum(y * y) / count(*)) + 6, 4) AS aic, round(count(*) * ln(sum(y * y) / count(*)) + 3 * ln(count(*)), 4) AS bic FROM t GROUP BY g")(
    lambda spark, sf: lines(spark, sf).groupBy("g").agg(F.sum(F.col("y") * F.col("y")).alias("rss"), F.count(F.lit(1)).alias("n")).select("g", r(D.aic(F.col("rss"), F.col("n"), F.lit(3)), 4, "aic"), r(D.bic(F.col("rss"), F.col("n"), F.lit(3)), 4, "bic"))
)
@query("eb_shrink_by", """WITH e AS (SELECT l_suppkey AS s, avg(l_extendedprice / 1000) AS t, stddev_samp(l_extendedprice / 1000) / sqrt(count(*)) AS se FROM lineitem GROUP BY 1),
q AS (SELECT sum(1 / (se * se)) AS sw, sum(t / (se * se)) AS swt, sum(1 / power(se, 4)) AS sw2, sum(t * t / (se * se)) AS swtt, count(*) AS n FROM e),
u AS (SELECT greatest(0, (swtt - swt * swt / sw - (n - 1)) / (sw - sw2 / sw)) AS tau FROM q), mu AS (SELECT sum(t / (se * se + tau)) / sum(1 / (se * se + tau)) AS mu FROM e, u)
SELECT s, round(tau / (tau + se * se) * t + (1 - tau / (tau + se * se)) * mu, 5) AS shrunken, round(mu, 5) AS mu, round(tau, 5) AS tau_squared FROM e, u, mu""")
def _(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.avg(F.col("l_extendedprice") / 1000).alias("t"), (F.stddev_samp(F.col("l_extendedprice") / 1000) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    return D.eb_shrink_by(e, "t", "se").select("s", r("shrunken", 5), r("mu", 5), r("tau_squared", 5))


DEMAND = "d AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'view' THEN 0 ELSE round(value) END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), b AS (SELECT user_id, avg(v) AS m, coalesce(stddev_samp(v), 0) AS s, min(i) FILTER (v <> 0) AS f, max(i) FILTER (v <> 0) AS l FROM d GROUP BY user_id)"
demand = lambda spark, sf: table(spark, sf, "events").withColumn("v", F.when(F.col("event_type") == "view", 0.0).otherwise(F.round("value")))
query("aid_anomaly_by", f"WITH {DEMAND} SELECT event_id, coalesce(v = 0 AND i > f AND i < l, false) AS stockout, coalesce(v = 0 AND i < f, false) AS new_product, coalesce(v = 0 AND i > l, false) AS obsolete_product, v <> 0 AND v > m + 3 * s AS high_outlier FROM d JOIN b USING (user_id)")(
    lambda spark, sf: D.aid_anomaly_by(demand(spark, sf), ["user_id"], ["ts", "event_id"], "v").select("event_id", "stockout", "new_product", "obsolete_product", "high_outlier")
)
query("aid_by", f"""WITH {DEMAND}, q AS (SELECT user_id, avg(v) AS mean, avg(CASE WHEN v = 0 THEN 1.0 ELSE 0 END) AS z, count(*) AS n, count(*) FILTER (v = 0 AND i > f AND i < l) AS stockout_count FROM d JOIN b USING (user_id) GROUP BY user_id)
SELECT user_id, CASE WHEN z >= 0.3 THEN 'intermittent' ELSE 'regular' END AS demand_type, round(mean, 5) AS mean, round(z, 6) AS zero_proportion, n AS n_observations, stockout_count FROM q""")(
    lambda spark, sf: D.aid_by(demand(spark, sf), ["user_id"], ["ts", "event_id"], "v").select("user_id", "demand_type", r("mean", 5), r("zero_proportion", 6), "n_observations", "stockout_count")
)
query("glmm_fit_by")(lambda spark, sf: M.glmm_fit_by(lines(spark, sf).withColumn("s", F.col("l_suppkey")), "s", "y", ["a"])[1].select("group", r("ranef", 3), "n", r("fixed_intercept", 3)))


def mixed_gap(spark: SparkSession, sf: str, y: str, x: list[str], opts: dict) -> DataFrame:
    """Per group the distance from the mixed model's own equation: sum of scores = effect / variance (0 at the fit)."""
    rows = lines(spark, sf).withColumn("s", F.col("l_suppkey").cast("string"))
    _, e = M.glmm_fit_by(rows, "s", y, x, opts)
    e = e.withColumnRenamed("n", "n_rows")
    j = L.join_groups(rows, e.withColumnRenamed("group", "s"), ["s"])
    eta = F.col("fixed_intercept") + F.col("ranef")
    for i, c in enumerate(x):
        eta = eta + F.get("fixed_coefficients", F.lit(i)) * F.col(c)
    mean = {"gaussian": eta, "poisson": F.exp(eta), "binomial": 1 / (1 + F.exp(-eta))}[opts["family"]]
    per = j.groupBy("s", "n_rows", "ranef", "var_group", "var_residual").agg(F.sum((F.col(y) - mean) / F.col("var_residual")).alias("score"))
    return per.select(F.col("s").alias("supplier"), F.col("n_rows").alias("n"), r(F.abs(F.col("score") - F.col("ranef") / F.col("var_group")), 1, "gap"))


GAP = "SELECT CAST(l_suppkey AS VARCHAR) AS supplier, count(*) AS n, CAST(0.0 AS DOUBLE) AS gap FROM lineitem GROUP BY 1"
query("glmm_poisson_by", GAP)(lambda spark, sf: mixed_gap(spark, sf, "a", ["b"], {"family": "poisson"}))
query("glmm_binomial_by", GAP)(lambda spark, sf: mixed_gap(spark, sf, "hit", ["a"], {"family": "binomial"}))
query("glmm_fit_agg", "SELECT count(*) AS n_observations, count(DISTINCT l_suppkey) AS n_groups, 1 AS n_features, 1 AS random_dim FROM lineitem")(
    lambda spark, sf: M.glmm_fit_agg(lines(spark, sf), "l_suppkey", "y", ["a"]).select("n_observations", "n_groups", "n_features", "random_dim")
)
