"""More registered queries: list and array forms, likelihoods, inference and robust fits against closed forms in SQL.

List and array forms gather a group in one row, so they go by supplier, whose
number of lines is bounded.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.operators import glm as G
from quillstat.operators import hypothesis as H
from quillstat.operators import linear as L
from quillstat.operators import resampling as S
from quillstat.operators import robust as R
from quillstat.queries import EXACT, ORACLE, ORDER, QUERIES, T, exact, labels, lines, query, r

SUPPLIER = "l_suppkey"
at = lambda c, i=0: F.get(c, F.lit(i))
EXACT_T = T + f", u AS (SELECT *, {EXACT} AS e FROM t)"

# -- robust fits on a line with far outliers ----------------------------------------------

LINE = f"WITH {EXACT_T} SELECT g, 3.0 AS c1, 2.0 AS intercept, count(*) AS n_observations"
found = lambda f, *more: f.select("g", r(at("coefficients"), 2, "c1"), r("intercept", 2), "n_observations", *more)
query("huber_fit_agg", LINE + ", count(*) FILTER (k = 7) AS n_outliers FROM u GROUP BY g")(lambda spark, sf: found(R.huber_fit_agg(exact(spark, sf), "e", ["a"], ["g"]), "n_outliers"))
query("quantile_fit_agg", LINE + " FROM u GROUP BY g")(lambda spark, sf: found(R.quantile_fit_agg(exact(spark, sf), "e", ["a"], ["g"])))
query("ransac_fit_agg", LINE + ", count(*) FILTER (k <> 7) AS n_inliers FROM u GROUP BY g")(lambda spark, sf: found(R.sampled_fit_agg(exact(spark, sf), "ransac", "e", ["a"], ["g"], {"residual_threshold": 1.0}), "n_inliers"))
query("theilsen_fit_agg", LINE + " FROM u GROUP BY g")(lambda spark, sf: found(R.sampled_fit_agg(exact(spark, sf), "theilsen", "e", ["a"], ["g"])))
for _kind in ("huber", "ransac", "theilsen", "quantile"):
    query(f"{_kind}_fit_predict_by", f"WITH {T} SELECT l_orderkey, l_partkey, l_suppkey, round(2 + 3 * a, 1) AS yhat, k <> 1 AS is_training FROM t")(
        lambda spark, sf, kind=_kind: R.fit_predict_by(
            exact(spark, sf).withColumn("split", F.when(F.col("k") == 1, "test").otherwise("train")), kind, "e", ["a"], ["g"], "split", {"residual_threshold": 1.0} if kind == "ransac" else None
        ).select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 1), "is_training")
    )
query("alm_fit_predict_by", f"""WITH {T}, m AS (SELECT g, avg(y) AS my, avg(a) AS ma, regr_slope(y, a) AS c1 FROM t GROUP BY g)
SELECT l_orderkey, l_partkey, l_suppkey, round(my + c1 * (a - ma), 4) AS yhat, true AS is_training FROM t JOIN m USING (g)""")(
    lambda spark, sf: R.fit_predict_by(lines(spark, sf), "alm", "y", ["a"], ["g"]).select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 4), "is_training")
)


def isotonic_sql(by: str) -> str:
    """The monotone fit as the greatest, over beginnings, of the least mean up to any end."""
    return f"""d AS (SELECT {by} AS g2, a AS x, count(*)::DOUBLE AS n, sum(y) AS s FROM t GROUP BY 1, 2), c AS (SELECT g2, x, n, s, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM d WINDOW w AS (PARTITION BY g2 ORDER BY x)),
m AS (SELECT j.g2, j.x AS j, k.x AS k, (k.cs - j.cs + j.s) / (k.cn - j.cn + j.n) AS m FROM c j JOIN c k ON j.g2 = k.g2 AND k.x >= j.x),
l AS (SELECT m.g2, m.j, i.x, min(m.m) AS m FROM m JOIN c i ON i.g2 = m.g2 AND i.x >= m.j AND m.k >= i.x GROUP BY 1, 2, 3), iso AS (SELECT g2, x, max(m) AS fit FROM l GROUP BY 1, 2)"""


query("isotonic_fit_predict_by", f"WITH {T}, {isotonic_sql('g')} SELECT l_orderkey, l_partkey, l_suppkey, round(fit, 5) AS yhat, true AS is_training FROM t JOIN iso ON g = g2 AND a = x")(
    lambda spark, sf: R.isotonic_fit_predict_by(lines(spark, sf), "y", "a", ["g"]).select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 5), "is_training")
)

# -- likelihoods ----------------------------------------------------------------------------
# with one binary feature a model with a link has the means of its cells as fitted values

CELLS = T + ", m AS (SELECT g, hit, avg(y) AS mu, avg(ln(y)) AS ml, avg(a) AS mc FROM t GROUP BY g, hit), u AS (SELECT t.*, mu, ml, mc FROM t JOIN m ON t.g = m.g AND t.hit = m.hit)"


def likelihoods(y: str, feature: str, **kinds: str):
    def run(spark, sf):
        out = None
        for name, distribution in kinds.items():
            f = R.alm_fit_agg(lines(spark, sf), y, [feature], ["g"], {"distribution": distribution}).select("g", r("log_likelihood", 2, name))
            out = f if out is None else out.join(f, "g")
        return out

    return run


query("alm_positive", f"""WITH {CELLS}, s AS (SELECT g, avg(power(y / mu - 1, 2)) AS phi, avg(power(y - mu, 2) / (mu * mu * y)) AS ig, sqrt(avg(power(ln(y) - ml, 2))) AS sl FROM u GROUP BY g)
SELECT g, round(sum(ln(y / (mu * phi)) / phi - y / (mu * phi) - ln(y) - lgamma(1 / phi)), 2) AS gamma, round(sum(-ln(mu) - y / mu), 2) AS exponential,
  round(sum(-0.5 * ln(2 * pi() * ig * power(y, 3)) - power(y - mu, 2) / (2 * ig * mu * mu * y)), 2) AS inverse_gaussian, round(sum(-0.5 * ln(2 * pi()) - ln(sl) - power((ln(y) - ml) / sl, 2) / 2 - ln(y)), 2) AS log_normal FROM u JOIN s USING (g) GROUP BY g""")(
    likelihoods("y", "hit", gamma="gamma", exponential="exponential", inverse_gaussian="inverse_gaussian", log_normal="log_normal")
)
query("alm_counts", f"""WITH {CELLS}, s AS (SELECT g, sum(mc * mc) / greatest(sum(power(a - mc, 2) - mc), 1e-6 * sum(mc * mc)) AS th FROM u GROUP BY g)
SELECT g, round(sum(a * ln(mc) - mc - lgamma(a + 1)), 2) AS poisson, round(sum(a * ln(mc) - (a + 1) * ln(1 + mc)), 2) AS geometric,
  round(sum(lgamma(a + th) - lgamma(th) - lgamma(a + 1) + th * ln(th / (th + mc)) + a * ln(mc / (th + mc))), 2) AS negative_binomial FROM u JOIN s USING (g) GROUP BY g""")(
    likelihoods("a", "hit", poisson="poisson", geometric="geometric", negative_binomial="negative_binomial")
)
query("alm_binary", f"""WITH {T}, m AS (SELECT g, grp, avg(hit) AS p FROM t GROUP BY g, grp)
SELECT g, round(sum(hit * ln(p) + (1 - hit) * ln(1 - p)), 2) AS binomial, round(sum(hit * ln(p) + (1 - hit) * ln(1 - p)), 2) AS cumulative_normal FROM t JOIN m USING (g, grp) GROUP BY g""")(
    likelihoods("hit", "grp", binomial="binomial", cumulative_normal="cumulative_normal")
)

# -- inference of generalised linear and survival models ---------------------------------------


def wald(f):
    return f.select("g", r("intercept", 4), r(at("coefficients"), 4, "c1"), r(at("std_errors"), 6, "se"), r(at("z_values"), 3, "z"), "n_observations")


TWO_CELLS = T + ", q AS (SELECT g, hit, avg(a) AS m, avg(y) AS my, count(*) AS n, sum(a) AS s FROM t GROUP BY g, hit)"
query("poisson_inference", f"""WITH {TWO_CELLS}, p AS (SELECT g, greatest(1, sum(power(a - m, 2) / m) / (count(*) - 2)) AS phi FROM t JOIN q USING (g, hit) GROUP BY g),
f AS (SELECT g, max(ln(m)) FILTER (hit = 0) AS c0, max(ln(m)) FILTER (hit = 1) - max(ln(m)) FILTER (hit = 0) AS c1, sqrt(sum(1 / s) * max(phi)) AS se, sum(n)::BIGINT AS n FROM q JOIN p USING (g) GROUP BY g)
SELECT g, round(c0, 4) AS intercept, round(c1, 4) AS c1, round(se, 6) AS se, round(c1 / se, 3) AS z, n AS n_observations FROM f""")(
    lambda spark, sf: wald(G.glm_fit_agg(lines(spark, sf), "poisson", "a", ["hit"], ["g"], {"compute_inference": True, "vcov": "sandwich"}))
)
query("gamma_inference", f"""WITH {TWO_CELLS}, p AS (SELECT g, sum(power(y / my - 1, 2)) / (count(*) - 2) AS phi FROM t JOIN q USING (g, hit) GROUP BY g),
f AS (SELECT g, max(ln(my)) FILTER (hit = 0) AS c0, max(ln(my)) FILTER (hit = 1) - max(ln(my)) FILTER (hit = 0) AS c1, sqrt(sum(1 / n) * max(phi)) AS se, sum(n)::BIGINT AS n FROM q JOIN p USING (g) GROUP BY g)
SELECT g, round(c0, 4) AS intercept, round(c1, 4) AS c1, round(se, 6) AS se, round(c1 / se, 3) AS z, n AS n_observations FROM f""")(
    lambda spark, sf: wald(G.glm_fit_agg(lines(spark, sf), "gamma", "y", ["hit"], ["g"], {"compute_inference": True, "vcov": "naive"}))
)
# exponential times: the hazard of a cell is its events over its time, also under censoring
query("aft_fit_agg", f"""WITH {T}, q AS (SELECT g, hit, sum(a) AS s, count(*) FILTER (l_orderkey % 3 <> 0) AS d, count(*) AS n FROM t GROUP BY g, hit),
f AS (SELECT g, max(ln(s / d)) FILTER (hit = 0) AS c0, max(ln(s / d)) FILTER (hit = 1) - max(ln(s / d)) FILTER (hit = 0) AS c1, sqrt(sum(1 / d)) AS se, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM q GROUP BY g)
SELECT g, round(c0, 4) AS intercept, round(c1, 4) AS c1, round(se, 6) AS se, round(c1 / se, 3) AS z, n AS n_observations, d AS n_events, n - d AS n_censored FROM f""")(
    lambda spark, sf: (lambda f: wald(f.withColumn("x", F.lit(1))).join(f.select("g", "n_events", "n_censored"), "g"))(
        G.aft_fit_agg(lines(spark, sf).withColumn("event", F.when(F.col("l_orderkey") % 3 == 0, 0.0).otherwise(1.0)), "a", ["hit"], "event", ["g"], {"dist": "exponential", "compute_inference": True})
    )
)
query("poisson_fit_predict_by", f"WITH {T}, m AS (SELECT g, hit, avg(a) AS mu FROM t GROUP BY g, hit) SELECT l_orderkey, l_partkey, l_suppkey, round(mu, 4) AS yhat, true AS is_training FROM t JOIN m USING (g, hit)")(
    lambda spark, sf: G.poisson_fit_predict_by(lines(spark, sf), "a", ["hit"], ["g"]).select("l_orderkey", "l_partkey", "l_suppkey", r("yhat", 4), "is_training")
)

# -- tests ------------------------------------------------------------------------------------

query("dagostino_k2_agg", f"""WITH {T}, q AS (SELECT g, avg(y) AS m FROM t GROUP BY g), p AS (SELECT g, count(*)::DOUBLE AS n, avg(power(y - m, 2)) AS m2, avg(power(y - m, 3)) AS m3, avg(power(y - m, 4)) AS m4 FROM t JOIN q USING (g) GROUP BY g),
a AS (SELECT g, n, m3 / power(m2, 1.5) AS g1, m4 / (m2 * m2) - 3 AS g2 FROM p),
b AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS yv, sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 AS w2,
  (g2 + 6 / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb FROM a),
c AS (SELECT *, asinh(yv * sqrt((w2 - 1) / 2)) / sqrt(ln(sqrt(w2))) AS z1, 6 + 8 / sb * (2 / sb + sqrt(1 + 4 / (sb * sb))) AS c FROM b),
e AS (SELECT *, (1 - 2 / (9 * c) - cbrt((1 - 2 / c) / (1 + x * sqrt(2 / (c - 4))))) / sqrt(2 / (9 * c)) AS z2 FROM c)
SELECT g, round(z1 * z1 + z2 * z2, 3) AS statistic, round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS p_value, n::BIGINT AS n FROM e""")(
    lambda spark, sf: H.dagostino_k2_agg(lines(spark, sf), "y", ["g"]).select("g", r("statistic", 3), r("p_value", 6), "n")
)
query("yuen_agg", f"""WITH {T}, i AS (SELECT g, grp, y, row_number() OVER w AS i, count(*) OVER (PARTITION BY g, grp) AS n, floor(0.2 * count(*) OVER (PARTITION BY g, grp)) AS k FROM t WINDOW w AS (PARTITION BY g, grp ORDER BY y)),
b AS (SELECT g, grp, max(n)::DOUBLE AS n, max(k) AS k, avg(y) FILTER (i > k AND i <= n - k) AS m, min(y) FILTER (i > k AND i <= n - k) AS lo, max(y) FILTER (i > k AND i <= n - k) AS hi FROM i GROUP BY g, grp),
w AS (SELECT g, grp, var_samp(greatest(lo, least(hi, y))) AS v FROM t JOIN b USING (g, grp) GROUP BY g, grp),
d AS (SELECT *, n - 2 * k AS h, (n - 1) * v / ((n - 2 * k) * (n - 2 * k - 1)) AS d FROM b JOIN w USING (g, grp)),
p AS (SELECT x.g, x.m - z.m AS diff, x.d AS d1, z.d AS d2, x.h AS h1, z.h AS h2, x.n AS n1, z.n AS n2 FROM d x JOIN d z ON x.g = z.g AND x.grp = 0 AND z.grp = 1)
SELECT g, round(diff / sqrt(d1 + d2), 5) AS statistic, round(power(d1 + d2, 2) / (d1 * d1 / (h1 - 1) + d2 * d2 / (h2 - 1)), 3) AS df, n1::BIGINT AS n1, n2::BIGINT AS n2 FROM p""")(
    lambda spark, sf: H.yuen_agg(lines(spark, sf), "y", "grp", ["g"]).select("g", r("statistic", 5), r("df", 3), "n1", "n2")
)
PAIRS = "i AS (SELECT *, row_number() OVER () AS i FROM t), c AS (SELECT l_suppkey, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp <> 0) AS n2 FROM t GROUP BY 1 HAVING least(count(*) FILTER (grp = 0), count(*) FILTER (grp <> 0)) >= 2)"
query("mmd_agg", f"""WITH {T}, {PAIRS}, p AS (SELECT x.l_suppkey, x.i < z.i AS up, x.grp AS p, z.grp AS q, abs(x.y - z.y) AS d FROM i x JOIN i z USING (l_suppkey)), w AS (SELECT l_suppkey, median(d) AS w FROM p WHERE up GROUP BY 1)
SELECT l_suppkey, round(sum(CASE WHEN p = 0 AND q = 0 THEN 1 / (n1 * n1) WHEN p <> 0 AND q <> 0 THEN 1 / (n2 * n2) ELSE -1 / (n1 * n2) END * exp(-d * d / (2 * w * w))), 6) AS statistic, max(n1)::INT AS n1, max(n2)::INT AS n2
FROM p JOIN w USING (l_suppkey) JOIN c USING (l_suppkey) GROUP BY l_suppkey""")(QUERIES["mmd_agg"])
query("permutation_t_test_agg", f"""WITH {T}, m AS (SELECT l_suppkey, count(*) FILTER (grp = 0) AS n1, count(*) FILTER (grp <> 0) AS n2, avg(y) FILTER (grp = 0) AS m1, avg(y) FILTER (grp <> 0) AS m2, var_samp(y) FILTER (grp = 0) AS v1, var_samp(y) FILTER (grp <> 0) AS v2 FROM t GROUP BY 1)
SELECT l_suppkey, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1 / n1 + 1 / n2)), 4) AS statistic, n1::INT AS n1, n2::INT AS n2 FROM m WHERE n1 >= 2 AND n2 >= 2""")(
    lambda spark, sf: S.permutation_t_test_agg(lines(spark, sf), "y", "grp", [SUPPLIER]).select(SUPPLIER, r("statistic", 4), "n1", "n2")
)
query("distance_cor_agg", f"""WITH {T}, i AS (SELECT *, row_number() OVER () AS i FROM t), p AS (SELECT x.l_partkey, x.i AS i, z.i AS j, abs(x.a - z.a) AS d, abs(x.y - z.y) AS e FROM i x JOIN i z USING (l_partkey)),
c AS (SELECT *, d - avg(d) OVER (PARTITION BY l_partkey, i) - avg(d) OVER (PARTITION BY l_partkey, j) + avg(d) OVER (PARTITION BY l_partkey) AS a, e - avg(e) OVER (PARTITION BY l_partkey, i) - avg(e) OVER (PARTITION BY l_partkey, j) + avg(e) OVER (PARTITION BY l_partkey) AS b FROM p)
SELECT l_partkey, round(sqrt(greatest(0, avg(a * b)) / sqrt(avg(a * a) * avg(b * b))), 5) AS dcor, sqrt(count(*))::INT AS n FROM c GROUP BY 1 HAVING count(*) >= 16 AND avg(a * a) * avg(b * b) > 0""")(
    lambda spark, sf: S.distance_cor_agg(lines(spark, sf), "a", "y", ["l_partkey"]).select("l_partkey", r("dcor", 5), "n")
)
query("binom_test_agg", """WITH k AS (SELECT sum(toxic) AS k, count(*) AS n FROM labels WHERE toxic IS NOT NULL), x AS (SELECT k, n, unnest(range(0, n + 1)) AS x FROM k),
p AS (SELECT k, n, x, exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(0.1) + (n - x) * ln(0.9)) AS p FROM x)
SELECT round(max(k) / max(n), 6) AS estimate, round(least(1, sum(p) FILTER (p <= (1 + 1e-7) * (SELECT p FROM p WHERE x = k))), 6) AS p_value, max(n) AS n FROM p""")(
    lambda spark, sf: H.binom_test_agg(labels(spark, sf), "toxic", opts={"p0": 0.1}).select(r("estimate", 6), r("p_value", 6), "n")
)
query("fisher_exact_agg", """WITH q AS (SELECT count(*) FILTER (quality = 0 AND toxic = 0) AS a, count(*) FILTER (quality = 0 AND toxic = 1) AS b, count(*) FILTER (quality = 1 AND toxic = 0) AS c, count(*) FILTER (quality = 1 AND toxic = 1) AS d FROM labels),
x AS (SELECT a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS x FROM q),
p AS (SELECT *, exp(lgamma(a + b + 1) + lgamma(c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1) - lgamma(a + b + c + d + 1) - lgamma(x + 1) - lgamma(a + b - x + 1) - lgamma(a + c - x + 1) - lgamma(d - a + x + 1)) AS p FROM x)
SELECT round(max(a) * max(d) / (max(b) * max(c)), 6) AS odds_ratio, round(least(1, sum(p) FILTER (p <= (1 + 1e-7) * (SELECT p FROM p WHERE x = a))), 6) AS p_value, max(a + b + c + d) AS n FROM p""")(
    lambda spark, sf: H.fisher_exact_agg(labels(spark, sf), "quality", "toxic").select(r("odds_ratio", 6), r("p_value", 6), "n")
)

# -- list forms: one array of predictions for a group ----------------------------------------------

SM = T + """, m AS (SELECT l_suppkey AS s, count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, var_pop(a) * count(*) AS saa, covar_pop(a, y) * count(*) AS say, sum(y) AS sy, sum(a) AS sa, sum(a * a) AS qa, sum(a * y) AS qy,
  sum(w) AS sw, sum(w * y) / sum(w) AS wy, sum(w * a) / sum(w) AS wa FROM t GROUP BY 1)"""


def list_sql(c0: str, c1: str) -> str:
    return f"WITH {SM}, f AS (SELECT *, {c1} AS c1 FROM m), h AS (SELECT s, {c0} AS c0, c1 FROM f) SELECT l_suppkey, count(*) AS n, round(sum(c0 + c1 * a), 2) AS sum_yhat FROM t JOIN h ON s = l_suppkey GROUP BY 1"


def summed(predictions):
    lists = L.as_lists(predictions, "y", [SUPPLIER], ORDER)
    return lists.select(SUPPLIER, F.size("predictions").cast("long").alias("n"), r(F.aggregate("predictions", F.lit(0.0), lambda s, p: s + p["yhat"]), 2, "sum_yhat"))


AROUND = "my - c1 * ma"
for _kind, _sql, _kw in (
    ("ols", list_sql(AROUND, "say / saa"), {}),
    ("ridge", list_sql(AROUND, "say / (saa + 500)"), {"opts": {"alpha": 500.0}}),
    ("elasticnet", list_sql(AROUND, "sign(say) * greatest(abs(say) - 50, 0) / (saa + 50)"), {"opts": {"alpha": 100.0}}),
    ("pls", list_sql(AROUND, "say / saa"), {}),
    ("rls", list_sql("(qa + 0.01) * sy / ((n + 0.01) * (qa + 0.01) - sa * sa) - sa * qy / ((n + 0.01) * (qa + 0.01) - sa * sa)", "((n + 0.01) * qy - sa * sy) / ((n + 0.01) * (qa + 0.01) - sa * sa)"), {}),
    ("bls", list_sql("0", "greatest(qy / qa, 0)"), {}),
):
    query(f"{_kind}_fit_predict_agg", _sql)(lambda spark, sf, kind=_kind, kw=_kw: summed(L.fit_predict_by(lines(spark, sf), kind, "y", ["a"], [SUPPLIER], **kw)))
query("wls_fit_predict_agg", f"""WITH {SM}, f AS (SELECT s, wy, wa, sum(w * (a - wa) * (y - wy)) / sum(w * (a - wa) * (a - wa)) AS c1 FROM t JOIN m ON s = l_suppkey WHERE w > 0 GROUP BY 1, 2, 3)
SELECT l_suppkey, count(*) AS n, round(sum(wy + c1 * (a - wa)), 2) AS sum_yhat FROM t JOIN f ON s = l_suppkey GROUP BY 1""")(lambda spark, sf: summed(L.fit_predict_by(lines(spark, sf), "wls", "y", ["a"], [SUPPLIER], weight="w")))
for _kind in ("huber", "ransac", "theilsen", "quantile"):
    query(f"{_kind}_fit_predict_agg", f"WITH {T} SELECT l_suppkey, count(*) AS n, round(sum(2 + 3 * a), 0) AS sum_yhat FROM t GROUP BY 1")(
        lambda spark, sf, kind=_kind: summed(R.fit_predict_by(exact(spark, sf), kind, "e", ["a"], [SUPPLIER], opts={"residual_threshold": 1.0} if kind == "ransac" else {"max_subpopulation": 1000} if kind == "theilsen" else None)).withColumn("sum_yhat", F.round("sum_yhat", 0))
    )
query("alm_fit_predict_agg", list_sql(AROUND, "say / saa"))(lambda spark, sf: summed(R.fit_predict_by(lines(spark, sf), "alm", "y", ["a"], [SUPPLIER])))
query("poisson_fit_predict_agg", f"WITH {T} SELECT l_suppkey, count(*) AS n, round(sum(a), 2) AS sum_yhat FROM t GROUP BY 1")(lambda spark, sf: summed(G.poisson_fit_predict_by(lines(spark, sf), "a", ["hit"], [SUPPLIER])))
query("isotonic_fit_predict_agg", f"WITH {T}, {isotonic_sql('l_suppkey')} SELECT l_suppkey, count(*) AS n, round(sum(fit), 2) AS sum_yhat FROM t JOIN iso ON l_suppkey = g2 AND a = x GROUP BY 1")(lambda spark, sf: summed(R.isotonic_fit_predict_by(lines(spark, sf), "y", "a", [SUPPLIER])))

# -- array forms in SQL ------------------------------------------------------------------------------


def in_sql(expression: str, view=lines):
    """rows of (supplier, the expression's struct r) over arrays of the supplier's lines."""

    def run(spark, sf):
        from quillstat.functions.sql import register

        register(spark)
        view(spark, sf).createOrReplaceTempView("quillstat_lines")
        return spark.sql(f"SELECT l_suppkey, {expression} AS r FROM (SELECT l_suppkey, collect_list(y) AS y, array(collect_list(a)) AS x, collect_list(a) AS a, collect_list(b) AS b, collect_list(w) AS w FROM quillstat_lines GROUP BY l_suppkey)")

    return run


def array_fit(expression: str, view=lines):
    return lambda spark, sf: in_sql(expression, view)(spark, sf).select(SUPPLIER, r(at("r.coefficients"), 4, "c1"), r(F.col("r.intercept"), 3, "intercept"), F.col("r.n_observations").alias("n"))


def array_sql(c0: str, c1: str) -> str:
    return f"WITH {SM}, f AS (SELECT *, {c1} AS c1 FROM m) SELECT s AS l_suppkey, round(c1, 4) AS c1, round({c0}, 3) AS intercept, n::BIGINT AS n FROM f"


query("ols_fit", array_sql(AROUND, "say / saa"))(array_fit("ols_fit(y, x)"))
query("ridge_fit", array_sql(AROUND, "say / (saa + 500)"))(array_fit("ridge_fit_with(y, x, '{\"alpha\": 500}')"))
query("elasticnet_fit", array_sql(AROUND, "sign(say) * greatest(abs(say) - 50, 0) / (saa + 50)"))(array_fit("elasticnet_fit_with(y, x, '{\"alpha\": 100}')"))
query("rls_fit", array_sql("(qa + 0.01) * sy / ((n + 0.01) * (qa + 0.01) - sa * sa) - sa * qy / ((n + 0.01) * (qa + 0.01) - sa * sa)", "((n + 0.01) * qy - sa * sy) / ((n + 0.01) * (qa + 0.01) - sa * sa)"))(array_fit("rls_fit(y, x)"))
query("wls_fit", f"""WITH {SM}, f AS (SELECT s, wy, wa, count(*) AS n, sum(w * (a - wa) * (y - wy)) / sum(w * (a - wa) * (a - wa)) AS c1 FROM t JOIN m ON s = l_suppkey WHERE w > 0 GROUP BY 1, 2, 3)
SELECT s AS l_suppkey, round(c1, 4) AS c1, round(wy - c1 * wa, 3) AS intercept, n FROM f""")(array_fit("wls_fit(y, x, w)"))
_line = lambda spark, sf: exact(spark, sf).withColumn("y", F.col("e"))
for _kind, _call in (("huber", "huber_fit(y, x)"), ("ransac", "ransac_fit_with(y, x, '{\"residual_threshold\": 1.0}')"), ("theilsen", "theilsen_fit_with(y, x, '{\"max_subpopulation\": 1000}')")):
    query(f"{_kind}_fit", f"WITH {T} SELECT l_suppkey, 3.0 AS c1, 2.0 AS intercept, count(*) AS n FROM t GROUP BY 1")(
        lambda spark, sf, call=_call: array_fit(call, _line)(spark, sf).select(SUPPLIER, F.round("c1", 2).alias("c1"), F.round("intercept", 1).alias("intercept"), "n")
    )
query("vif", f"WITH {T} SELECT l_suppkey, round(1 / (1 - power(corr(a, b), 2)), 6) AS v1, round(1 / (1 - power(corr(a, b), 2)), 6) AS v2 FROM t GROUP BY 1")(
    lambda spark, sf: in_sql("vif(array(a, b))")(spark, sf).select(SUPPLIER, r(at("r"), 6, "v1"), r(at("r", 1), 6, "v2"))
)
query("residuals_diagnostics", f"WITH {SM} SELECT l_suppkey, count(*) AS n, round(sum(abs(y - a)), 3) AS raw, round(max(1 / n + power(a - ma, 2) / saa), 8) AS leverage FROM t JOIN m ON s = l_suppkey GROUP BY 1")(
    lambda spark, sf: in_sql("residuals_diagnostics(y, a, x)")(spark, sf).select(
        SUPPLIER, F.size("r.raw").cast("long").alias("n"), r(F.aggregate("r.raw", F.lit(0.0), lambda s, v: s + F.abs(v)), 3, "raw"), r(F.array_max("r.leverage"), 8, "leverage")
    )
)
query("jarque_bera", ORACLE["jarque_bera_agg"].replace("l_returnflag AS g", "l_suppkey AS g").replace("SELECT g, round(n / 6", "SELECT g AS l_suppkey, round(n / 6"))(
    lambda spark, sf: in_sql("jarque_bera(y)")(spark, sf).select(SUPPLIER, r(F.col("r.statistic"), 3, "statistic"), r(F.col("r.skewness"), 5, "skewness"), r(F.col("r.kurtosis"), 5, "kurtosis"), "r.n")
)
query("predict", "SELECT l_suppkey, count(*) AS n, round(sum(1.5 + 2 * l_quantity - 3 * l_discount), 4) AS yhat FROM lineitem GROUP BY 1")(
    lambda spark, sf: in_sql("predict(array(a, b), array(2D, -3D), 1.5D)")(spark, sf).select(SUPPLIER, F.size("r").cast("long").alias("n"), r(F.aggregate("r", F.lit(0.0), lambda s, v: s + v), 4, "yhat"))
)
