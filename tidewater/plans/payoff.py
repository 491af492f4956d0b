"""Queries of payoffs, probabilities and terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import asof as A
from ..operators import holders as H
from ..operators import payoff as P
from .panel import mc_ready
from .registry import query

_STOCK = "ratio * acq_price"
_FILLS = f"""f AS (SELECT *, {_STOCK} AS stock, greatest(1e-6, least(1 - 1e-6, f_cash)) AS fc FROM {{deals}} WHERE ratio_type = 'fixed' AND f_cash IS NOT NULL AND pi_cash IS NOT NULL),
g AS (SELECT *, least(1e0, pi_cash / fc) AS cf, least(1e0, (1 - pi_cash) / (1 - fc)) AS sf, pi_cash * cash + (1 - pi_cash) * stock AS blended FROM f),
h AS (SELECT *, cf * cash + (1 - cf) * stock AS cash_holder, sf * stock + (1 - sf) * cash AS stock_holder FROM g)"""


@query("prorate", f"WITH {_FILLS} SELECT event_id, cash_holder, stock_holder, blended, greatest(cash_holder, stock_holder) AS optimal FROM h")
def prorate(t):
    d = mc_ready(t.deals)
    return d.select("event_id", *[c.alias(k) for k, c in P.prorate(F.col("f_cash"), F.col("pi_cash"), F.col("cash"), F.col("ratio") * F.col("acq_price")).items()])


@query(
    "realized_edge",
    f"""WITH {_FILLS} SELECT event_id, blended, greatest(cash_holder, stock_holder) AS optimal, greatest(cash_holder, stock_holder) - blended AS edge,
  (greatest(cash_holder, stock_holder) - blended) / nullif(blended, 0e0) * 100 AS edge_pct FROM h WHERE abs(cash - stock) / greatest(least(abs(cash), abs(stock)), 1e-9) <= 5e-1""",
)
def realized_edge_query(t):
    return realized_edge(t.deals)


def realized_edge(deals):
    """What the better election was worth over the blend, at the demand that came, for deals whose terms do not lie too far apart."""
    stock = F.col("ratio") * F.col("acq_price")
    d = mc_ready(deals).where(P.term_gap(F.col("cash"), stock) <= 0.5)
    d = d.select("event_id", *[c.alias(k) for k, c in P.prorate(F.col("f_cash"), F.col("pi_cash"), F.col("cash"), stock).items()])
    edge = F.col("optimal") - F.col("blended")
    return d.select("event_id", "blended", "optimal", edge.alias("edge"), (edge / F.nullif(F.col("blended"), F.lit(0.0)) * 100).alias("edge_pct"))


@query(
    "state_probs",
    """WITH l AS (SELECT *, p_completed IS NULL AND p_terminated IS NULL AND p_withdrawn IS NULL AND p_break IS NOT NULL AS legacy FROM {odds}),
c AS (SELECT event_id, greatest(0e0, least(1e0, coalesce(CASE WHEN legacy THEN 1 - least(1e0, p_break) ELSE p_completed END, 0e0))) AS a,
  greatest(0e0, least(1e0, coalesce(CASE WHEN legacy THEN p_break ELSE p_terminated END, 0e0))) AS b, greatest(0e0, least(1e0, coalesce(CASE WHEN legacy THEN 0e0 ELSE p_withdrawn END, 0e0))) AS w FROM l)
SELECT event_id, CASE WHEN a + b + w > 0 THEN a / (a + b + w) ELSE 1e0 END AS completed, CASE WHEN a + b + w > 0 THEN b / (a + b + w) ELSE 0e0 END AS terminated, CASE WHEN a + b + w > 0 THEN w / (a + b + w) ELSE 0e0 END AS withdrawn FROM c""",
)
def state_probs(t):
    made = P.state_probabilities(F.col("p_completed"), F.col("p_terminated"), F.col("p_withdrawn"), F.col("p_break"))
    return t.odds.select("event_id", *[c.alias(k) for k, c in made.items()])


@query(
    "prob_resolution",
    """WITH k AS (SELECT event_id, CASE WHEN p_completed IS NOT NULL THEN least(1e0, p_completed) END AS a, CASE WHEN p_terminated IS NOT NULL THEN least(1e0, p_terminated) END AS b, CASE WHEN p_withdrawn IS NOT NULL THEN least(1e0, p_withdrawn) END AS w,
  CASE WHEN p_break IS NOT NULL THEN least(1e0, p_break) END AS k FROM {odds}),
r AS (SELECT *, greatest(0e0, 1 - coalesce(a, 0e0) - coalesce(b, 0e0) - coalesce(w, 0e0)) AS rest, CASE WHEN a IS NULL THEN 88e-2 ELSE 0e0 END + CASE WHEN b IS NULL THEN 7e-2 ELSE 0e0 END + CASE WHEN w IS NULL THEN 5e-2 ELSE 0e0 END AS base FROM k),
p AS (SELECT *, coalesce(a, rest * 88e-2 / base) AS pa, coalesce(b, rest * 7e-2 / base) AS pb, coalesce(w, rest * 5e-2 / base) AS pw FROM r)
SELECT event_id, CASE WHEN a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL THEN CASE WHEN a + b + w > 0 THEN a / (a + b + w) ELSE 1e0 END WHEN k IS NOT NULL THEN 1 - k WHEN coalesce(a, b, w) IS NOT NULL THEN CASE WHEN pa + pb + pw > 0 THEN pa / (pa + pb + pw) ELSE 1e0 END ELSE 88e-2 END AS p_completed,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL THEN CASE WHEN a + b + w > 0 THEN b / (a + b + w) ELSE 0e0 END WHEN k IS NOT NULL THEN k * 65e-2 WHEN coalesce(a, b, w) IS NOT NULL THEN CASE WHEN pa + pb + pw > 0 THEN pb / (pa + pb + pw) ELSE 0e0 END ELSE 7e-2 END AS p_terminated,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL THEN CASE WHEN a + b + w > 0 THEN w / (a + b + w) ELSE 0e0 END WHEN k IS NOT NULL THEN k * 35e-2 WHEN coalesce(a, b, w) IS NOT NULL THEN CASE WHEN pa + pb + pw > 0 THEN pw / (pa + pb + pw) ELSE 0e0 END ELSE 5e-2 END AS p_withdrawn,
  CASE WHEN a IS NOT NULL AND b IS NOT NULL AND w IS NOT NULL THEN 'event_explicit_three_state' WHEN k IS NOT NULL THEN 'event_aggregate_break_split' WHEN coalesce(a, b, w) IS NOT NULL THEN 'event_partial_three_state_plus_defaults' ELSE 'default_scenario_no_event_probabilities' END AS source FROM p""",
)
def prob_resolution(t):
    s = P.resolved_probabilities(F.col("p_completed"), F.col("p_terminated"), F.col("p_withdrawn"), F.col("p_break"), P.OutcomeDefaults(), "event")
    return t.odds.select("event_id", F.inline(F.array(s)))


@query(
    "break_values",
    """WITH m AS (SELECT event_id, cash AS m, CASE WHEN event_id % 4 <> 0 THEN cash * (6e-1 + (event_id % 40) / 64e0) END AS r FROM {deals}),
l AS (SELECT *, CASE WHEN r IS NULL THEN 0e0 ELSE greatest(m - r, 0e0) END AS fall FROM m)
SELECT event_id, m - greatest(fall, 25e-2 * m) AS terminated_value, m - greatest(fall, 35e-2 * m) AS withdrawn_value, 5e-1 * m + 3e-1 * (m - greatest(fall, 25e-2 * m)) + 2e-1 * (m - greatest(fall, 35e-2 * m)) AS expected_value FROM l""",
)
def break_values(t):
    m, r = F.col("cash"), F.when(F.col("event_id") % 4 != 0, F.col("cash") * (0.6 + (F.col("event_id") % 40) / 64.0))
    terminated, withdrawn = P.break_values(m, r, P.BreakLosses())
    return t.deals.select("event_id", terminated.alias("terminated_value"), withdrawn.alias("withdrawn_value"), (0.5 * m + 0.3 * terminated + 0.2 * withdrawn).alias("expected_value"))


@query(
    "outcome_overlay",
    """SELECT event_id, CASE WHEN (event_id % 64) / 64e0 < 5e-1 THEN cash WHEN (event_id % 64) / 64e0 < 75e-2 THEN cash * 75e-2 ELSE cash * 65e-2 END AS value FROM {deals}""",
)
def outcome_overlay(t):
    u = (F.col("event_id") % 64) / 64.0
    return t.deals.select("event_id", P.overlay(u, F.lit(0.5), F.lit(0.25), F.col("cash"), F.col("cash") * 0.75, F.col("cash") * 0.65).alias("value"))


@query(
    "deal_terms",
    """WITH x AS (SELECT event_id, deal_status, cash, ratio, acq_price, CASE WHEN event_id % 3 = 0 AND pi_cash IS NOT NULL THEN pi_cash END AS cap, CASE WHEN event_id % 3 = 1 AND pi_cash IS NOT NULL THEN 1 - pi_cash END AS scap, f_cash, event_id % 4 AS k FROM {deals})
SELECT event_id, coalesce(cap, 1 - scap, 5e-1) AS pi_cash, CASE WHEN cap IS NOT NULL THEN 'cash_cap' WHEN scap IS NOT NULL THEN 'stock_cap' ELSE 'default_half' END AS pi_cash_source, ratio * acq_price AS stock_val, cash - ratio * acq_price AS spread,
  CASE WHEN k <> 3 THEN deal_status ELSE '' END AS deal_outcome_label, CASE WHEN k <> 3 THEN 'export' ELSE 'unrecognised' END AS deal_outcome_source, k <> 3 AND deal_status IN ('terminated', 'withdrawn') AS broke FROM x""",
)
def deal_terms(t):
    k = F.col("event_id") % 3
    d = t.deals.withColumns({"cap": F.when(k == 0, F.col("pi_cash")), "scap": F.when(k == 1, 1 - F.col("pi_cash")), "raw": F.when(F.col("event_id") % 4 != 3, F.col("deal_status")).otherwise("pending")})
    label = X.exact_status(F.col("raw"))
    return d.select(
        "event_id",
        F.coalesce("cap", 1 - F.col("scap"), F.lit(0.5)).alias("pi_cash"),
        F.when(F.col("cap").isNotNull(), "cash_cap").when(F.col("scap").isNotNull(), "stock_cap").otherwise("default_half").alias("pi_cash_source"),
        (F.col("ratio") * F.col("acq_price")).alias("stock_val"),
        (F.col("cash") - F.col("ratio") * F.col("acq_price")).alias("spread"),
        label.alias("deal_outcome_label"),
        F.when(label != "", "export").otherwise("unrecognised").alias("deal_outcome_source"),
        label.isin("terminated", "withdrawn").alias("broke"),
    )


@query(
    "deadline_spread",
    r"""WITH e AS (SELECT event_id, announce_date AS deadline, '$' || CAST(event_id % 60 AS VARCHAR) || '.5 per share' AS cash_text, CASE WHEN event_id % 5 = 0 THEN 'VWAP based' ELSE '0.' || CAST(1 + event_id % 9 AS VARCHAR) || ' shares' END AS ratio_text FROM {spans}),
p AS (SELECT e.*, coalesce((SELECT max_by(price, price_date) FROM {prices} p WHERE p.event_id = e.event_id AND side = 'acquirer' AND price_date <= deadline),
  (SELECT price FROM {prices} p WHERE p.event_id = e.event_id AND side = 'acquirer' ORDER BY abs(price_date - deadline), price_date LIMIT 1)) AS acq FROM e),
v AS (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'floating' ELSE 'fixed' END AS ratio_type, CASE WHEN event_id % 60 = 0 THEN NULL ELSE CAST(event_id % 60 AS DOUBLE) + 5e-1 END AS cash_val, CASE WHEN event_id % 5 <> 0 THEN CAST('0.' || CAST(1 + event_id % 9 AS VARCHAR) AS DOUBLE) END AS ratio FROM p)
SELECT event_id, deadline, acq AS acq_price, ratio_type, cash_val, ratio, ratio * acq AS stock_val, cash_val - ratio * acq AS spread FROM v""",
)
def deadline_spread(t):
    d = t.spans.select(
        "event_id",
        F.col("announce_date").alias("deadline"),
        F.concat(F.lit("$"), (F.col("event_id") % 60).cast("string"), F.lit(".5 per share")).alias("cash_text"),
        F.when(F.col("event_id") % 5 == 0, "VWAP based").otherwise(F.concat(F.lit("0."), (1 + F.col("event_id") % 9).cast("string"), F.lit(" shares"))).alias("ratio_text"),
    )
    quotes = t.prices.where("side = 'acquirer'").select("event_id", "price_date", "price")
    d = A.asof(d, quotes, ["event_id"], "deadline", "price_date", ["price"], "nearest").withColumnRenamed("price", "acq_price")
    kind = X.ratio_type(F.col("ratio_text"))
    d = d.withColumns({"ratio_type": kind, "cash_val": N.bounded_number(F.col("cash_text"), 1, 2000), "ratio": F.when(kind == "fixed", N.bounded_number(F.col("ratio_text"), 0.02, 5))})
    stock = F.col("ratio") * F.col("acq_price")
    return d.select("event_id", "deadline", "acq_price", "ratio_type", "cash_val", "ratio", stock.alias("stock_val"), (F.col("cash_val") - stock).alias("spread"))


@query("fill_rates", "SELECT event_id, CASE WHEN pi_cash IS NOT NULL THEN CASE WHEN f_cash <= 1e-12 THEN 1e0 ELSE least(1e0, pi_cash / f_cash) END END AS cash_fill, CASE WHEN pi_cash IS NOT NULL THEN CASE WHEN 1 - f_cash <= 1e-12 THEN 1e0 ELSE least(1e0, (1 - pi_cash) / (1 - f_cash)) END END AS stock_fill FROM {deals} WHERE f_cash IS NOT NULL")
def fill_rates(t):
    f, pi = F.col("f_cash"), F.col("pi_cash")
    cash, stock = P.fill_rates(f, 1 - f, pi, 1 - pi)
    return t.deals.where(f.isNotNull()).select("event_id", cash.alias("cash_fill"), stock.alias("stock_fill"))


VOTES_SQL = """v0 AS (SELECT *, least({q}, 1 - passive) AS rat0 FROM {{holders}}),
v1 AS (SELECT *, greatest(0e0, 1 - passive - rat0) AS irr0, CASE WHEN cash < target_price AND stock < target_price THEN 'exit' WHEN stock >= cash THEN 'stock' ELSE 'cash' END AS action, CASE default_rule WHEN 'cash' THEN 1e0 WHEN 'stock' THEN 0e0 ELSE 5e-1 END AS dflt FROM v0),
v2 AS (SELECT *, CASE WHEN action = 'exit' AND passive + irr0 > 1e-12 THEN passive + rat0 * passive / (passive + irr0) ELSE passive END AS pas,
  CASE WHEN action = 'exit' THEN CASE WHEN passive + irr0 > 1e-12 THEN irr0 + rat0 * irr0 / (passive + irr0) ELSE 1e0 END ELSE irr0 END AS irr, CASE WHEN action = 'exit' THEN 0e0 ELSE rat0 END AS rat FROM v1),
v3 AS (SELECT *, irr * {p} + pas * dflt + CASE WHEN action = 'cash' THEN rat ELSE 0e0 END AS cd, irr * (1 - {p}) + pas * (1 - dflt) + CASE WHEN action = 'stock' THEN rat ELSE 0e0 END AS sd FROM v2)"""


@query("predict_votes", "WITH " + VOTES_SQL.format(p="5e-1", q="3e-1").replace("{{", "{").replace("}}", "}") + " SELECT event_id, action, rat AS rational, irr AS irrational, pas AS passive, cd / (cd + sd) AS cash_demand, sd / (cd + sd) AS stock_demand FROM v3")
def predict_votes(t):
    s = P.predicted_votes(F.lit(0.5), F.lit(0.3), F.col("passive"), F.col("default_rule"), F.col("cash"), F.col("stock"), F.col("target_price"))
    return H.panel(t.deals).select("event_id", F.inline(F.array(s)))


@query(
    "quality_guard",
    """WITH r AS (SELECT event_id, cash * pi_cash + ratio * acq_price * (1 - pi_cash) AS blended, cash, ratio * acq_price AS stock, cash * (7e-1 + (event_id % 32) / 64e0) AS m FROM {deals} WHERE pi_cash IS NOT NULL)
SELECT event_id, blended / m - 1 AS arb_return, abs(cash - stock) / greatest(least(abs(cash), abs(stock)), 1e-9) AS gap,
  CASE WHEN abs(blended / m - 1) > 3e-1 OR abs(cash - stock) / greatest(least(abs(cash), abs(stock)), 1e-9) > 5e-1 THEN 'REVIEW' ELSE 'OK' END AS guard FROM r""",
)
def quality_guard(t):
    stock = F.col("ratio") * F.col("acq_price")
    market = F.col("cash") * (0.7 + (F.col("event_id") % 32) / 64.0)
    arb = (F.col("cash") * F.col("pi_cash") + stock * (1 - F.col("pi_cash"))) / market - 1
    gap = P.term_gap(F.col("cash"), stock)
    return t.deals.where("pi_cash is not null").select("event_id", arb.alias("arb_return"), gap.alias("gap"), F.when((F.abs(arb) > 0.3) | (gap > 0.5), "REVIEW").otherwise("OK").alias("guard"))


@query(
    "realized_return",
    f"""WITH m AS (SELECT *, cash * 9e-1 AS m, {_STOCK} AS stock FROM {{deals}} WHERE pi_cash IS NOT NULL),
g AS (SELECT *, greatest(1e-6, least(1 - 1e-6, f_cash)) AS fc FROM m),
h AS (SELECT *, CASE WHEN f_cash IS NOT NULL THEN greatest(least(1e0, pi_cash / fc) * cash + (1 - least(1e0, pi_cash / fc)) * stock, least(1e0, (1 - pi_cash) / (1 - fc)) * stock + (1 - least(1e0, (1 - pi_cash) / (1 - fc))) * cash) END AS optimal FROM g)
SELECT event_id, CASE WHEN deal_status = 'terminated' THEN -25e-2 WHEN deal_status = 'withdrawn' THEN -35e-2 WHEN optimal IS NOT NULL THEN optimal / m - 1 END AS realized,
  CASE WHEN deal_status = 'terminated' THEN 'terminated_break' WHEN deal_status = 'withdrawn' THEN 'withdrawn_break' WHEN optimal IS NOT NULL THEN 'completed_actual_demand' ELSE 'missing' END AS source FROM h""",
)
def realized_return(t):
    m = F.col("cash") * 0.9
    best = P.prorate(F.col("f_cash"), F.col("pi_cash"), F.col("cash"), F.col("ratio") * F.col("acq_price"))["optimal"]
    best = F.when(F.col("f_cash").isNotNull(), best)
    terminated, withdrawn = P.break_values(F.lit(1.0), F.lit(None).cast("double"), P.BreakLosses())
    status = F.col("deal_status")
    return t.deals.where("pi_cash is not null").select(
        "event_id",
        F.when(status == "terminated", terminated - 1).when(status == "withdrawn", withdrawn - 1).when(best.isNotNull(), best / m - 1).alias("realized"),
        F.when(status == "terminated", "terminated_break").when(status == "withdrawn", "withdrawn_break").when(best.isNotNull(), "completed_actual_demand").otherwise("missing").alias("source"),
    )


@query(
    "elect_hedge",
    f"""WITH d AS (SELECT event_id, cash, {_STOCK} AS stock, pi_cash, ratio FROM {{deals}} WHERE ratio_type = 'fixed' AND pi_cash IS NOT NULL), x AS (SELECT event_id, cash, stock, pi_cash, ratio, (k + 5e-1) / 16e0 AS f FROM d, (SELECT unnest(range(16)) AS k)),
e AS (SELECT *, least(1e0, pi_cash / f) AS cf, least(1e0, (1 - pi_cash) / (1 - f)) AS sf FROM x),
a AS (SELECT event_id, pi_cash, ratio, avg(cf * cash + (1 - cf) * stock) AS e_cash, avg(sf * stock + (1 - sf) * cash) AS e_stock, avg(1 - cf) AS s_cash, avg(sf) AS s_stock FROM e GROUP BY ALL)
SELECT event_id, CASE WHEN e_cash >= e_stock THEN 'CASH' ELSE 'STOCK' END AS elect, greatest(e_cash, e_stock) AS value, ratio * CASE WHEN e_cash >= e_stock THEN s_cash ELSE s_stock END AS hedge, ratio * (1 - pi_cash) AS reverse_hedge FROM a""",
)
def elect_hedge(t):
    """Expected payoffs over a midpoint quadrature of uniform demand, exact in both engines."""
    d = mc_ready(t.in_order.deals, with_demand=False).withColumn("stock", F.col("ratio") * F.col("acq_price"))
    d = d.select("event_id", "cash", "stock", "pi_cash", "ratio", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k")).withColumn("f", (F.col("k") + 0.5) / 16.0)
    pi, f = F.col("pi_cash"), F.col("f")
    made = P.prorate(f, pi, F.col("cash"), F.col("stock"))
    cf, sf = F.least(F.lit(1.0), pi / f), F.least(F.lit(1.0), (1 - pi) / (1 - f))
    a = d.groupBy("event_id", "pi_cash", "ratio").agg(F.avg(made["cash_holder"]).alias("e_cash"), F.avg(made["stock_holder"]).alias("e_stock"), F.avg(1 - cf).alias("s_cash"), F.avg(sf).alias("s_stock"))
    cash = F.col("e_cash") >= F.col("e_stock")
    return a.select(
        "event_id", F.when(cash, "CASH").otherwise("STOCK").alias("elect"), F.greatest("e_cash", "e_stock").alias("value"), (F.col("ratio") * F.when(cash, F.col("s_cash")).otherwise(F.col("s_stock"))).alias("hedge"), (F.col("ratio") * (1 - F.col("pi_cash"))).alias("reverse_hedge")
    )
