"""Queries of estimators and tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as S
from .registry import query

_BETA = """CASE WHEN n < 5 THEN 1e0 WHEN v IS NULL OR v <= 0 OR v >= m * (1 - m) THEN greatest(20 * m, 5e-1) ELSE m * (m * (1 - m) / nullif(v, 0e0) - 1) END AS a,
  CASE WHEN n < 5 THEN 1e0 WHEN v IS NULL OR v <= 0 OR v >= m * (1 - m) THEN greatest(20 * (1 - m), 5e-1) ELSE (1 - m) * (m * (1 - m) / nullif(v, 0e0) - 1) END AS b"""


@query("beta_fit", f"WITH s AS (SELECT deal_type, count(x) AS n, avg(x) AS m, var_samp(x) AS v FROM (SELECT deal_type, CASE WHEN f_cash > 0 AND f_cash < 1 THEN f_cash END AS x FROM {{deals}}) GROUP BY deal_type) SELECT deal_type, n, {_BETA} FROM s")
def beta_fit(t):
    return S.beta_fit(t.deals, ["deal_type"], "f_cash")


@query(
    "beta_loo",
    f"""WITH d AS (SELECT event_id, deal_type, CASE WHEN f_cash > 0 AND f_cash < 1 THEN f_cash END AS x FROM {{deals}}),
g AS (SELECT deal_type, count(x) AS n, sum(x - 5e-1) AS s, sum((x - 5e-1) * (x - 5e-1)) AS q FROM d GROUP BY deal_type),
o AS (SELECT event_id, n - count(x) OVER (PARTITION BY event_id) AS n, s - coalesce(x - 5e-1, 0) AS s, q - coalesce((x - 5e-1) * (x - 5e-1), 0) AS q FROM d JOIN g USING (deal_type)),
s AS (SELECT event_id, n, s / nullif(n, 0) + 5e-1 AS m, CASE WHEN n > 1 THEN (q - s * s / n) / (n - 1) END AS v FROM o)
SELECT event_id, n, round(a, 6) AS a, round(b, 6) AS b FROM (SELECT event_id, n, {_BETA} FROM s)""",
)
def beta_loo(t):
    d = t.deals.select("event_id", "deal_type", "f_cash")
    return S.beta_leave_one_out(d, ["deal_type"], "f_cash").select("event_id", "n", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query(
    "logit_slope",
    """WITH d AS (SELECT deal_type, ln(f_cash / (1 - f_cash)) AS y, cash - ratio * acq_price AS x FROM {deals} WHERE f_cash > 0 AND f_cash < 1),
s AS (SELECT deal_type, count(*) AS n, regr_intercept(y, x) AS intercept, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy FROM d GROUP BY 1)
SELECT deal_type, n, round(intercept, 8) AS intercept, round(slope, 8) AS slope, round(sqrt((syy - slope * sxy) / (n - 2) / sxx), 8) AS se_slope FROM s WHERE n >= 8""",
)
def logit_slope(t):
    d = S.logit_slope(t.deals.withColumn("x", F.expr("cash - ratio * acq_price")), ["deal_type"], "f_cash", "x")
    return d.select("deal_type", "n", *[F.round(c, 8).alias(c) for c in ("intercept", "slope", "se_slope")])


@query(
    "linreg",
    "SELECT count(*) AS n, round(regr_slope(f_cash, x), 8) AS slope, round(regr_intercept(f_cash, x), 8) AS intercept, round(corr(f_cash, x), 8) AS r FROM (SELECT f_cash, cash - ratio * acq_price AS x FROM {deals}) WHERE f_cash IS NOT NULL AND x IS NOT NULL AND abs(x) <= 20",
)
def linreg(t):
    d = S.linear_fit(t.deals.withColumn("x", F.expr("cash - ratio * acq_price")), "f_cash", "x", 20)
    return d.select("n", *[F.round(c, 8).alias(c) for c in ("slope", "intercept", "r")])


@query(
    "ols_moments",
    """SELECT round(sum(1e0), 6) AS one_one, round(sum(x), 6) AS one_x, round(sum(z), 6) AS one_z, round(sum(f_cash), 6) AS one_f_cash, round(sum(x * x), 4) AS x_x, round(sum(x * z), 4) AS x_z, round(sum(x * f_cash), 4) AS x_f_cash,
  round(sum(z * z), 4) AS z_z, round(sum(z * f_cash), 4) AS z_f_cash, round(sum(f_cash * f_cash), 4) AS f_cash_f_cash FROM (SELECT f_cash, pi_cash AS x, ln(1e0 + value_mil) AS z FROM {deals}) WHERE f_cash IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL""",
)
def ols_moments(t):
    d = S.normal_equations(t.deals.select("f_cash", F.col("pi_cash").alias("x"), F.ln(1 + F.col("value_mil")).alias("z")), "f_cash", ["x", "z"])
    return d.select(*[F.round(c, 6 if c.startswith("one") else 4).alias(c) for c in d.columns])


@query(
    "ks_two_sample",
    """WITH d AS (SELECT f_cash AS x, payment_type LIKE '1%' AS a FROM {deals} WHERE f_cash IS NOT NULL AND (payment_type LIKE '1%' OR payment_type LIKE '2%')),
c AS (SELECT x, count(*) FILTER (a) AS na, count(*) FILTER (NOT a) AS nb FROM d GROUP BY x), f AS (SELECT sum(na) OVER (ORDER BY x) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY x) / sum(nb) OVER () AS fb FROM c)
SELECT (SELECT count(*) FROM d WHERE a) AS n_a, (SELECT count(*) FROM d WHERE NOT a) AS n_b, max(abs(fa - fb)) AS statistic FROM f""",
)
def ks_two_sample(t):
    d = t.deals.select("f_cash", F.when(F.col("payment_type").startswith("1"), "cash").when(F.col("payment_type").startswith("2"), "stock").alias("rule"))
    return S.ks_two_samples(d, "rule", "cash", "stock", "f_cash")


@query(
    "wls_logit",
    """WITH d AS (SELECT ln(greatest(1e-4, least(1 - 1e-4, f_cash)) / (1 - greatest(1e-4, least(1 - 1e-4, f_cash)))) AS y, cash - ratio * acq_price AS x, CASE event_id % 3 WHEN 0 THEN 25e-2 WHEN 1 THEN 65e-2 ELSE 1e0 END AS w FROM {deals} WHERE f_cash IS NOT NULL),
s AS (SELECT count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM d)
SELECT n, round((sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0e0), 8) AS slope, round((sy - (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0e0) * sx) / sw, 8) AS intercept FROM s""",
)
def wls_logit(t):
    d = t.deals.select("f_cash", F.expr("cash - ratio * acq_price").alias("x"), F.expr("CASE event_id % 3 WHEN 0 THEN 0e0 WHEN 1 THEN 65e-2 ELSE 1e0 END").alias("w"))
    return S.weighted_logit_line(d, "f_cash", "x", "w").select("n", F.round("slope", 8).alias("slope"), F.round("intercept", 8).alias("intercept"))


_PIT = """
d AS (SELECT deal_type, CASE WHEN f_cash > 0 AND f_cash < 1 THEN f_cash END AS x FROM {deals}),
g AS (SELECT deal_type, count(x) AS n, sum(x - 5e-1) AS s, sum((x - 5e-1) * (x - 5e-1)) AS q FROM d GROUP BY deal_type),
o AS (SELECT x, n - 1 AS n, (s - (x - 5e-1)) / (n - 1) + 5e-1 AS mean, ((q - (x - 5e-1) * (x - 5e-1)) - (s - (x - 5e-1)) * (s - (x - 5e-1)) / (n - 1)) / (n - 2) AS var FROM d JOIN g ON g.deal_type = d.deal_type WHERE x IS NOT NULL),
b AS (SELECT x, CASE WHEN n < 5 THEN 1e0 WHEN var <= 0 OR var >= mean * (1 - mean) THEN greatest(20 * mean, 5e-1) ELSE mean * (mean * (1 - mean) / var - 1) END AS a,
  CASE WHEN n < 5 THEN 1e0 WHEN var <= 0 OR var >= mean * (1 - mean) THEN greatest(20 * (1 - mean), 5e-1) ELSE (1 - mean) * (mean * (1 - mean) / var - 1) END AS b FROM o),
t AS (SELECT x > (a + 1) / (a + b + 2) AS turned, CASE WHEN x > (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS x, CASE WHEN x > (a + 1) / (a + b + 2) THEN b ELSE a END AS a, CASE WHEN x > (a + 1) / (a + b + 2) THEN a ELSE b END AS b FROM b),
c(turned, x, a, b, m, c, d, f) AS (
  SELECT turned, x, a, b, 0, 1e0, 1 / (1 - (a + b) * x / (a + 1)), 1 / (1 - (a + b) * x / (a + 1)) FROM t
  UNION ALL
  SELECT turned, x, a, b, m, c2, d2, f1 * c2 * d2
  FROM (SELECT turned, x, a, b, m, f1, 1 + e2 / c1 AS c2, 1 / (1 + e2 * d1) AS d2
    FROM (SELECT turned, x, a, b, m, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) AS e2, c1, d1, f * c1 * d1 AS f1
      FROM (SELECT turned, x, a, b, m, f, 1 + e1 / c AS c1, 1 / (1 + e1 * d) AS d1
        FROM (SELECT turned, x, a, b, m + 1 AS m, c, d, f, (m + 1) * (b - (m + 1)) * x / ((a + 2 * (m + 1) - 1) * (a + 2 * (m + 1))) AS e1 FROM c WHERE m < 120))))),
p AS (SELECT CASE WHEN turned THEN 1 - v ELSE v END AS p FROM (SELECT turned, f * exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * ln(x) + b * ln(1 - x)) / a AS v FROM c WHERE m = 120)),
u AS (SELECT p, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM p),
s AS (SELECT max(n) AS n, avg(p) AS mean, avg(CASE WHEN p BETWEEN 1e-1 AND 9e-1 THEN 1e0 ELSE 0e0 END) AS inside_80, max(greatest(k * 1e0 / n - p, p - (k - 1) * 1e0 / n)) AS ks FROM u),
z AS (SELECT *, (sqrt(n) + 12e-2 + 11e-2 / sqrt(n)) * ks AS t FROM s)
SELECT n, round(mean, 8) AS mean, round(inside_80, 8) AS inside_80, round(ks, 8) AS ks,
  round(CASE WHEN t < 2e-1 THEN 1e0 ELSE greatest(0e0, least(1e0, 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2e0 * k * k * t * t)) FROM range(1, 101) r(k)))) END, 8) AS p FROM z"""


@query("pit_calibration", "WITH RECURSIVE " + _PIT.strip())
def pit_calibration(t):
    """Held-out probabilities of the leave-one-out fits against the uniform distribution, with the statistic's p-value; the Beta function is columns too."""
    d = S.pit_calibration(S.beta_leave_one_out(t.deals.select("deal_type", "f_cash"), ["deal_type"], "f_cash"), "f_cash")
    return d.select("n", *[F.round(c, 8).alias(c) for c in ("mean", "inside_80", "ks", "p")])


@query(
    "ols_fit",
    """WITH d AS (SELECT f_cash AS y, pi_cash AS x, ln(1e0 + value_mil) AS z FROM {deals}), o AS (SELECT * FROM d WHERE y IS NOT NULL AND x IS NOT NULL AND z IS NOT NULL),
m AS (SELECT avg(x) AS mx, avg(z) AS mz, avg(y) AS my, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, var_pop(y) AS yy FROM o),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM m)
SELECT unnest(['intercept', 'x', 'z', 'r_squared']) AS term, unnest([round(my - bx * mx - bz * mz, 7), round(bx, 7), round(bz, 7), round((bx * xy + bz * zy) / yy, 7)]) AS value FROM b""",
)
def ols_fit(t):
    """Least squares of demand on the pool and the log of size, solved where the row of sums is."""
    d = t.deals.select("f_cash", F.col("pi_cash").alias("x"), F.ln(1 + F.col("value_mil")).alias("z"))
    return S.least_squares(d, "f_cash", ["x", "z"]).select("term", F.round("value", 7).alias("value"))


@query("qq_positions", "SELECT deal_type, f_cash, (row_number() OVER (PARTITION BY deal_type ORDER BY f_cash, event_id) - 5e-1) / count(*) OVER (PARTITION BY deal_type) AS position, event_id FROM {deals} WHERE f_cash > 0 AND f_cash < 1")
def qq_positions(t):
    from pyspark.sql import Window

    w = Window.partitionBy("deal_type")
    d = t.in_order.deals.where("f_cash > 0 AND f_cash < 1")
    return d.select("deal_type", "f_cash", ((F.row_number().over(w.orderBy("f_cash", "event_id")) - 0.5) / F.count(F.lit(1)).over(w)).alias("position"), "event_id")
