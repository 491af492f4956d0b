"""Queries of the outcome model's tuning and of its nested evaluation over years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tuning as T
from ..operators.cuts import cut
from ..operators.naive_bayes import STATES
from .outcome import CATEGORICAL, CENTRES, NUMERIC, long_sql
from .registry import query

FEATURES = T.Features(CENTRES, CATEGORICAL)
_NAMES = ", ".join(T.NAMES)


_GRID = ", ".join(f"({', '.join(f'{v}e0' for v in c)})" for c in (*T.GRID, T.UNTUNED))
#: Fits on the years before each one, long: states, numeric features, categories; and the scores of each row under each candidate.
SCORES_SQL = f"""g AS (SELECT * FROM (VALUES {_GRID}) g({_NAMES})), st AS (SELECT * FROM (VALUES ('completed', 88e-2), ('terminated', 7e-2), ('withdrawn', 5e-2)) s(state, base)),
ys AS (SELECT DISTINCT year FROM {{training}}),
cl AS (SELECT ys.year, state, base, count(t.label) AS n FROM ys CROSS JOIN st LEFT JOIN {{training}} t ON t.label = state AND t.year < ys.year GROUP BY ALL),
tt AS (SELECT year, sum(n) AS fit_n, min(n) AS least FROM cl GROUP BY year),
nl AS ({long_sql("event_id, year, label", "{training}", NUMERIC, "x")}),
gm AS (SELECT ys.year, feature, avg(x) AS gmean, greatest(CASE WHEN count(x) > 1 THEN var_samp(x) ELSE 1e0 END, 1e-4) AS gvar FROM ys JOIN nl ON nl.year < ys.year AND x IS NOT NULL GROUP BY ALL),
om AS (SELECT ys.year, label, feature, count(x) AS n, avg(x) AS mean, var_samp(x) AS var FROM ys JOIN nl ON nl.year < ys.year AND x IS NOT NULL GROUP BY ALL),
nm AS (SELECT gm.year, state, gm.feature, sh.shrink, CASE WHEN n >= 2 THEN mean ELSE gmean END AS mean, CASE WHEN n >= 2 THEN greatest((1 - shrink) * var + shrink * gvar, 1e-4) ELSE gvar END AS var
  FROM gm CROSS JOIN st CROSS JOIN (SELECT DISTINCT shrink FROM g) sh LEFT JOIN om ON om.year = gm.year AND om.label = state AND om.feature = gm.feature),
ln1 AS (SELECT event_id, state, shrink, sum(-5e-1 * (ln(2 * 3.141592653589793e0 * var) + (x - mean) * (x - mean) / var)) AS num FROM nl JOIN nm ON nm.year = nl.year AND nm.feature = nl.feature WHERE x IS NOT NULL GROUP BY ALL),
lc AS ({long_sql("event_id, year, label", "{training}", CATEGORICAL, "v")}),
cc AS (SELECT ys.year, label, feature, v, count(*) AS c FROM ys JOIN lc ON lc.year < ys.year GROUP BY ALL), ct AS (SELECT year, label, feature, sum(c) AS total FROM cc GROUP BY ALL),
vw AS (SELECT year, feature, list_distinct(list(v) || ['__missing__', '__other__']) AS words FROM cc GROUP BY ALL),
qc AS (SELECT lc.event_id, lc.year, lc.feature, CASE WHEN list_contains(words, v) THEN v ELSE '__other__' END AS v, len(words) AS k FROM lc JOIN vw ON vw.year = lc.year AND vw.feature = lc.feature),
lc1 AS (SELECT event_id, state, alpha, sum(ln((coalesce(c, 0) + alpha) / (coalesce(total, 0) + alpha * k))) AS cat FROM qc CROSS JOIN st CROSS JOIN (SELECT DISTINCT alpha FROM g) al
  LEFT JOIN cc ON cc.year = qc.year AND cc.label = state AND cc.feature = qc.feature AND cc.v = qc.v LEFT JOIN ct ON ct.year = qc.year AND ct.label = state AND ct.feature = qc.feature GROUP BY ALL),
sc AS (SELECT t.event_id, t.year, t.label AS actual, state, g.*, (n + strength * base) / (fit_n + strength) AS prior, ln(greatest((n + strength * base) / (fit_n + strength), 1e-12)) + weight * (num + cat) AS s
  FROM {{training}} t JOIN cl ON cl.year = t.year JOIN tt ON tt.year = t.year CROSS JOIN g JOIN ln1 USING (event_id, state, shrink) JOIN lc1 USING (event_id, state, alpha)),
ex AS (SELECT *, exp(s - max(s) OVER w) AS e FROM sc WINDOW w AS (PARTITION BY event_id, {_NAMES})),
pp AS (SELECT *, (1 - blend) * e / sum(e) OVER (PARTITION BY event_id, {_NAMES}) + blend * prior AS p FROM ex),
er AS (SELECT year, {_NAMES}, count(*) // 3 AS n, sum((p - CASE WHEN state = actual THEN 1 ELSE 0 END) ** 2) AS error FROM pp GROUP BY ALL)"""

_TUNED = "(alpha <> 1e0 OR strength <> 1e0 OR weight <> 1e0)"


@query(
    "nb_tune",
    f"WITH {SCORES_SQL}, ok AS (SELECT year FROM tt WHERE least >= 10 ORDER BY year DESC LIMIT 5) SELECT {_NAMES}, CAST(sum(n) AS BIGINT) AS n, round(sum(error) / sum(n), 8) AS brier FROM er WHERE year IN (SELECT year FROM ok) AND {_TUNED} GROUP BY ALL",
)
def nb_tune(t):
    """Mean Brier score of all 52 candidates over the last five validation years."""
    d = t.training
    models = cut(T.yearly_models(d, FEATURES))
    years = models.join(d.select("year").distinct(), "year").where("least >= 10").select("year").orderBy(F.col("year").desc()).limit(5)
    errors = T.errors_by_year(d.join(F.broadcast(years), "year", "left_semi"), models, FEATURES)
    return errors.groupBy(*T.NAMES).agg(F.sum("n").alias("n"), F.round(F.sum("error") / F.sum("n"), 8).alias("brier"))


_CHOSEN_SQL = f"""{SCORES_SQL}, ou AS (SELECT year AS o FROM tt WHERE least >= 10), pr AS (SELECT o, year FROM (SELECT o, year, row_number() OVER (PARTITION BY o ORDER BY year DESC) AS r FROM ou JOIN tt ON year < o AND least >= 5) WHERE r <= 5),
me AS (SELECT o, {_NAMES}, sum(error) / sum(n) AS brier, sum(n) AS rows FROM pr JOIN er USING (year) WHERE {_TUNED} GROUP BY ALL),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY round(brier, 10), weight DESC, alpha, strength, shrink, blend) AS r FROM me) WHERE r = 1),
ch AS (SELECT ou.o, coalesce(alpha, 1e0) AS alpha, coalesce(strength, 1e0) AS strength, coalesce(shrink, 0e0) AS shrink, coalesce(weight, 1e0) AS weight, coalesce(blend, 0e0) AS blend, brier, coalesce(rows, 0) AS rows FROM ou LEFT JOIN be ON be.o = ou.o)"""


@query("nested_tuning", f"WITH {_CHOSEN_SQL} SELECT o AS outer_year, {_NAMES}, round(brier, 8) AS inner_brier, CAST(rows AS BIGINT) AS inner_rows FROM ch")
def nested_tuning(t):
    """For each outer year the candidate that does best on earlier years."""
    *_, chosen = T.tuned_years(t.training, FEATURES)
    return chosen.select(F.col("outer").alias("outer_year"), *T.NAMES, F.round("brier", 8).alias("inner_brier"), F.col("rows").alias("inner_rows"))


@query(
    "nested_oos",
    f"""WITH {_CHOSEN_SQL},
tu AS (SELECT pp.* FROM pp JOIN ch ON ch.o = pp.year AND ch.alpha = pp.alpha AND ch.strength = pp.strength AND ch.shrink = pp.shrink AND ch.weight = pp.weight AND ch.blend = pp.blend),
un AS (SELECT pp.* FROM pp JOIN ou ON o = year WHERE NOT {_TUNED}),
s AS (SELECT tu.year, tu.actual, tu.state, tu.p, un.p AS up, un.prior AS q, CASE WHEN tu.state = tu.actual THEN 1 ELSE 0 END AS hit FROM tu JOIN un ON un.event_id = tu.event_id AND un.state = tu.state)
SELECT year AS outer_year, count(*) // 3 AS n, round(sum((p - hit) ** 2) / (count(*) // 3), 8) AS brier, round(sum((up - hit) ** 2) / (count(*) // 3), 8) AS untuned_brier, round(sum((q - hit) ** 2) / (count(*) // 3), 8) AS prior_brier,
  round(avg(-ln(greatest(p, 1e-12))) FILTER (hit = 1), 8) AS nll, round(1 - sum((p - hit) ** 2) / sum((q - hit) ** 2), 8) AS skill FROM s GROUP BY year""",
)
def nested_oos(t):
    """Scores of tuned, untuned and prior probabilities in each outer year, none of which its fit or its tuning has seen."""
    p = T.nested(t.training, FEATURES).predictions
    own = F.coalesce(*[F.when(F.col("actual") == s, F.col(f"p_{s}")) for s in STATES])
    e, u, q = T.squared_error(), T.squared_error("untuned_p"), T.squared_error("untuned_prior")
    return p.groupBy(F.col("year").alias("outer_year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(e), 8).alias("brier"), F.round(F.avg(u), 8).alias("untuned_brier"), F.round(F.avg(q), 8).alias("prior_brier"),
        F.round(F.avg(-F.ln(F.greatest(own, F.lit(1e-12)))), 8).alias("nll"), F.round(1 - F.sum(e) / F.sum(q), 8).alias("skill"),
    )


@query("nested_decisions")
def nested_decisions(t):
    """For each outer year the decision powers that do best on earlier years, and the class scores that they give in it; tests refit by hand."""
    found = T.nested(t.training, FEATURES)
    choices = found.choices.select(F.col("outer").alias("year"), *T.NAMES, "power", "untuned_power")
    scores = T.class_scores(found.taken.join(choices, ["year", *T.NAMES, "power"]), ["year", "power", "untuned_power"], F.col("n"))
    return scores.select(F.col("year").alias("outer_year"), "balanced_accuracy", "macro_f1", F.col("rows").alias("n"), "power", "untuned_power")
