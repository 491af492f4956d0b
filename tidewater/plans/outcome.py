"""Queries of the outcome model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import first_number
from ..operators import naive_bayes as B
from .registry import query

#: The model's features: numeric ones with a value about which sums are taken, and categorical ones.
CENTRES = {"log_value": 5.0, "tv_ebitda": 4.0, "announce_year": 1995.0}
NUMERIC, CATEGORICAL = tuple(CENTRES), ("deal_type", "payment_type", "target_market", "acquirer_market", "target_cusip", "acquirer_cusip")
_STATES = "(VALUES ('completed', 88e-2), ('terminated', 7e-2), ('withdrawn', 5e-2)) b(label, base)"


def long_sql(keys: str, table: str, features: tuple[str, ...], value: str) -> str:
    """A row for each feature of each row, those of one name under another; a category is never null."""
    one = "{k}" if value == "x" else "coalesce(nullif({k}, ''), '__missing__')"
    return " UNION ALL ".join(f"SELECT {keys}, '{k}' AS feature, {one.format(k=k)} AS {value} FROM {table}" for k in features)


@query(
    "nb_features",
    """SELECT event_id, CASE WHEN value_mil >= 0 THEN ln(1e0 + value_mil) END AS log_value, CASE WHEN event_id % 5 <> 0 THEN (event_id % 400) / 1e1 - 3e0 END AS tv_ebitda, CAST(year(announce_date) AS DOUBLE) AS announce_year, lower(deal_type) AS deal_type,
  trim(regexp_replace(lower(payment_type), '[^a-z0-9]+', ' ', 'g')) AS payment_type, CASE WHEN party % 7 = 0 THEN '__missing__' WHEN party % 7 = 1 THEN 'LN' ELSE 'US' END AS target_market, CASE WHEN event_id % 9 = 0 THEN '__missing__' ELSE 'US' END AS acquirer_market,
  CASE WHEN event_id % 3 = 0 THEN 'missing' ELSE 'present' END AS target_cusip, CASE WHEN party % 6 = 0 THEN 'missing' ELSE 'present' END AS acquirer_cusip FROM {deals}""",
)
def nb_features(t):
    """The nine features out of a deal's raw fields: tickers with their market, multiples as text, identifiers that may be missing."""
    k, p = F.col("event_id"), F.col("party")
    party = p.cast("string")
    target = F.when(p % 7 == 0, party).otherwise(F.concat(party, F.when(p % 7 == 1, " LN").otherwise(" US")))
    acquirer = F.when(k % 9 == 0, "n.a.").otherwise(F.concat(k.cast("string"), F.lit(" us ")))
    multiple = F.when(k % 5 == 0, "not found").otherwise(F.concat(((k % 400) / 10.0 - 3).cast("string"), F.lit("x")))
    return t.deals.select(
        "event_id",
        F.when(F.col("value_mil") >= 0, F.log1p("value_mil")).alias("log_value"),
        first_number(multiple).alias("tv_ebitda"),
        F.year("announce_date").cast("double").alias("announce_year"),
        X.normal_name(F.col("deal_type")).alias("deal_type"),
        X.normal_name(F.col("payment_type")).alias("payment_type"),
        X.market_suffix(target).alias("target_market"),
        X.market_suffix(acquirer).alias("acquirer_market"),
        X.present_flag(F.when(k % 3 == 0, "n.a.").otherwise(k.cast("string"))).alias("target_cusip"),
        X.present_flag(F.when(p % 6 == 0, "").otherwise(party)).alias("acquirer_cusip"),
    )


PRIORS_SQL = f"pr AS (SELECT b.label, count(t.label) AS n, (count(t.label) + 5 * max(base)) / (sum(count(t.label)) OVER () + 5 * 1e0) AS prior FROM {_STATES} LEFT JOIN {{training}} t ON t.label = b.label GROUP BY b.label)"
PARAMS = B.NBParams(prior_strength=5.0, shrinkage=0.25, likelihood_weight=0.8, prior_blend=0.1)


@query("nb_priors", f"WITH {PRIORS_SQL} SELECT label, n, prior FROM pr")
def nb_priors(t):
    return B.priors(t.training, "label", PARAMS)


NUM_SQL = f"""ln0 AS ({long_sql("label", "{training}", NUMERIC, "x")}),
gs AS (SELECT feature, greatest(var_samp(x), 1e-4) AS gv FROM ln0 WHERE x IS NOT NULL GROUP BY feature),
ns AS (SELECT label, l.feature, count(x) AS n, avg(x) AS mean, greatest(75e-2 * var_samp(x) + 25e-2 * max(gv), 1e-4) AS var FROM ln0 l JOIN gs ON gs.feature = l.feature WHERE x IS NOT NULL GROUP BY label, l.feature)"""


@query("nb_numeric_stats", f"WITH {NUM_SQL} SELECT label, feature, n, round(mean, 8) AS mean, round(var, 8) AS var FROM ns")
def nb_numeric_stats(t):
    s = B.numeric_stats(B.long_numeric(t.training, ["label"], NUMERIC), "label", PARAMS)
    return s.select("label", "feature", "n", F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"))


CAT_SQL = f"""lc AS ({long_sql("label", "{training}", CATEGORICAL, "v")}),
cc AS (SELECT label, feature, v, count(*) AS n FROM lc GROUP BY ALL), ct AS (SELECT label, feature, sum(n) AS total FROM cc GROUP BY ALL),
cw AS (SELECT feature, len(list_distinct(list(v) || ['__missing__', '__other__'])) AS words FROM lc GROUP BY feature)"""


@query("nb_categorical_counts", f"WITH {CAT_SQL} SELECT label, feature, v, n FROM cc")
def nb_categorical_counts(t):
    return B.categorical_counts(B.long_categorical(t.training, ["label"], CATEGORICAL), "label")


PREDICT_SQL = f"""{PRIORS_SQL}, {NUM_SQL}, {CAT_SQL},
q AS (SELECT * EXCLUDE (deal_type, label), CASE WHEN event_id % 10 = 0 THEN 'unseen' ELSE deal_type END AS deal_type, label AS actual FROM {{training}}),
qn AS (SELECT * FROM ({long_sql("event_id", "q", NUMERIC, "x")}) WHERE x IS NOT NULL), qc AS ({long_sql("event_id", "q", CATEGORICAL, "v")}),
li AS (SELECT event_id, label, -5e-1 * (ln(2 * 3.141592653589793e0 * var) + (x - mean) * (x - mean) / var) AS ll FROM qn JOIN ns ON ns.feature = qn.feature
  UNION ALL SELECT qc.event_id, ct.label, ln((coalesce(cc.n, 0) + 1e0) / (ct.total + 1e0 * cw.words)) FROM qc JOIN ct ON ct.feature = qc.feature JOIN cw ON cw.feature = qc.feature LEFT JOIN cc ON cc.label = ct.label AND cc.feature = qc.feature AND cc.v = qc.v),
sc AS (SELECT event_id, li.label, max(prior) AS prior, ln(max(prior)) + 8e-1 * sum(ll) AS s FROM li JOIN pr ON pr.label = li.label GROUP BY event_id, li.label),
ex AS (SELECT *, exp(s - max(s) OVER (PARTITION BY event_id)) AS e FROM sc),
po AS (SELECT event_id, label, 9e-1 * e / sum(e) OVER (PARTITION BY event_id) + 1e-1 * prior AS probability FROM ex)"""


def predicted(t, events=None, kept=None):
    """Probabilities of every event, or of those in a table of event_id; the fit is on all of them, and stored by kept if given."""
    rows = t.training.withColumn("deal_type", F.when(F.col("event_id") % 10 == 0, "unseen").otherwise(F.col("deal_type")))
    if events is not None:
        rows = rows.join(events, "event_id", "left_semi")
    return B.predict(t.training, rows.drop("label"), "event_id", "label", NUMERIC, CATEGORICAL, PARAMS, kept)


@query("nb_predict", f"WITH {PREDICT_SQL} SELECT event_id, label, round(probability, 9) AS probability FROM po")
def nb_predict(t):
    return predicted(t).select("event_id", "label", F.round("probability", 9).alias("probability"))


@query("brier_scores", f"WITH {PREDICT_SQL} SELECT q.actual, count(*) // 3 AS n, round(sum((probability - CASE WHEN po.label = actual THEN 1 ELSE 0 END) ** 2) / (count(*) / 3e0), 8) AS brier, round(avg(-ln(greatest(probability, 1e-12))) FILTER (po.label = actual), 8) AS nll FROM po JOIN q ON q.event_id = po.event_id GROUP BY q.actual")
def brier_scores(t):
    actual = t.training.select("event_id", F.col("label").alias("actual"))
    j = predicted(t).join(actual, "event_id")
    hit = F.col("label") == F.col("actual")
    return j.groupBy("actual").agg(
        F.floor(F.count(F.lit(1)) / 3).alias("n"), F.round(F.sum(B.brier(F.col("probability"), hit)) / (F.count(F.lit(1)) / 3.0), 8).alias("brier"), F.round(F.avg(F.when(hit, -F.ln(F.greatest("probability", F.lit(1e-12))))), 8).alias("nll")
    )


@query(
    "class_metrics",
    f"""WITH {PREDICT_SQL}, w AS (SELECT event_id, label FROM (SELECT event_id, label, row_number() OVER (PARTITION BY event_id ORDER BY round(probability, 9) DESC, label) AS r FROM po) WHERE r = 1),
j AS (SELECT w.label AS predicted, q.actual FROM w JOIN q ON q.event_id = w.event_id)
SELECT b.label, count(*) FILTER (actual = b.label AND predicted = b.label) AS tp, count(*) FILTER (predicted = b.label) AS called, count(*) FILTER (actual = b.label) AS truth,
  count(*) FILTER (actual = b.label AND predicted = b.label) * 1e0 / nullif(count(*) FILTER (predicted = b.label), 0) AS prec, count(*) FILTER (actual = b.label AND predicted = b.label) * 1e0 / nullif(count(*) FILTER (actual = b.label), 0) AS recall FROM j, {_STATES} GROUP BY b.label""",
)
def class_metrics(t):
    best = predicted(t).groupBy("event_id").agg(F.min(F.struct((-F.round("probability", 9)).alias("p"), "label"))["label"].alias("predicted"))
    j = best.join(t.training.select("event_id", F.col("label").alias("actual")), "event_id")
    rows = j.select(F.inline(F.array(*[F.struct(F.lit(s).alias("label"), (F.col("actual") == s).alias("a"), (F.col("predicted") == s).alias("p")) for s in B.STATES])))
    g = rows.groupBy("label").agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if("p").alias("called"), F.count_if("a").alias("truth"))
    return g.select("*", (F.col("tp") / F.nullif(F.col("called"), F.lit(0))).alias("prec"), (F.col("tp") / F.nullif(F.col("truth"), F.lit(0))).alias("recall"))


@query(
    "nb_expanding",
    """WITH s AS (SELECT unnest(range((SELECT min(year) FROM {training}), (SELECT max(year) FROM {training}) + 1)) AS year)
SELECT CAST(s.year AS INT) AS year, b.label, count(t.log_value) AS n, round(avg(t.log_value), 8) AS mean, CASE WHEN count(t.log_value) > 1 THEN round(var_samp(t.log_value), 8) END AS var
FROM s CROSS JOIN (VALUES ('completed'), ('terminated'), ('withdrawn')) b(label) LEFT JOIN {training} t ON t.label = b.label AND t.year < s.year GROUP BY ALL""",
)
def nb_expanding(t):
    d = B.expanding_numeric(t.training, "label", "year", "log_value", 5.0)
    return d.select("year", "label", "n", F.round("mean", 8).alias("mean"), F.round("var", 8).alias("var"))


_POWERS = (0.0, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)


@query(
    "decision_power",
    f"""WITH {PREDICT_SQL}, k AS (SELECT unnest([0e0, 25e-2, 5e-1, 6e-1, 7e-1, 8e-1, 9e-1, 1e0]) AS power),
w AS (SELECT power, event_id, label FROM (SELECT power, event_id, po.label, row_number() OVER (PARTITION BY power, event_id ORDER BY round(probability / pow(prior, power), 9) DESC, po.label) AS r FROM po JOIN pr ON pr.label = po.label, k) WHERE r = 1)
SELECT power, avg(recall) AS balanced_accuracy, avg(f1) AS macro_f1 FROM (SELECT power, b.label, coalesce(count(*) FILTER (actual = b.label AND w.label = b.label) * 1e0 / nullif(count(*) FILTER (actual = b.label), 0), 0e0) AS recall,
  coalesce(2e0 * count(*) FILTER (actual = b.label AND w.label = b.label) / nullif(count(*) FILTER (actual = b.label) + count(*) FILTER (w.label = b.label), 0), 0e0) AS f1 FROM w JOIN q ON q.event_id = w.event_id, {_STATES} GROUP BY power, b.label) GROUP BY power""",
)
def decision_power(t):
    prior = B.priors(t.training, "label", PARAMS).select("label", "prior")
    scored = predicted(t).join(F.broadcast(prior), "label").withColumn("power", F.explode(F.array(*[F.lit(x) for x in _POWERS])))
    value = F.round(F.col("probability") / F.pow("prior", F.col("power")), 9)
    best = scored.groupBy("power", "event_id").agg(F.min(F.struct((-value).alias("v"), "label"))["label"].alias("predicted"))
    j = best.join(t.training.select("event_id", F.col("label").alias("actual")), "event_id")
    rows = j.select("power", F.inline(F.array(*[F.struct(F.lit(s).alias("label"), (F.col("actual") == s).alias("a"), (F.col("predicted") == s).alias("p")) for s in B.STATES])))
    g = rows.groupBy("power", "label").agg(F.count_if(F.col("a") & F.col("p")).alias("tp"), F.count_if("p").alias("called"), F.count_if("a").alias("truth"))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    return g.groupBy("power").agg(F.avg(ratio(F.col("tp"), F.col("truth"))).alias("balanced_accuracy"), F.avg(ratio(2 * F.col("tp"), F.col("truth") + F.col("called"))).alias("macro_f1"))


@query(
    "outcome_probabilities",
    f"""WITH {PREDICT_SQL} SELECT event_id, round(max(probability) FILTER (label = 'completed'), 9) AS p_completed, round(max(probability) FILTER (label = 'terminated'), 9) AS p_terminated, round(max(probability) FILTER (label = 'withdrawn'), 9) AS p_withdrawn,
  'naive_bayes' AS outcome_probability_source, (SELECT count(*) FROM {{training}}) AS outcome_train_n FROM po GROUP BY event_id""",
)
def outcome_probabilities(t, events=None, kept=None):
    one = lambda s: F.round(F.max(F.when(F.col("label") == s, F.col("probability"))), 9).alias(f"p_{s}")
    n = t.training.agg(F.count(F.lit(1)).alias("outcome_train_n"))
    return predicted(t, events, kept).groupBy("event_id").agg(*[one(s) for s in B.STATES]).withColumn("outcome_probability_source", F.lit("naive_bayes")).crossJoin(n)
