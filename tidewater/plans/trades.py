"""Queries of the trades that a deal offers: on draws of the fitted demand, and, for an oracle, on even draws."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capacity as C
from ..operators import estimators as E
from ..operators import holders as H
from ..operators import payoff as P
from ..operators import trades as T
from ..operators.cuts import cut, dealt
from ..operators.gates import GateConfig
from . import capacity, payoff  # noqa: F401 - their SQL is part of the oracles here
from .outcome import outcome_probabilities
from .registry import SQL, query

CFG, GATES = C.CapacityConfig(), GateConfig()
DRAWS, EVEN = T.Draws(), T.Draws(n=16, even=True)
#: Deals in a task: each costs some milliseconds of draws, or some tens of microseconds of even ones.
DEALS, EVEN_DEALS = 256, 1 << 14


def offered(t) -> DataFrame:
    """Each deal with an entry price: its terms, its outcome probabilities (the model's where its table has the deal, here every third; else those of the deal's own row, else the
    defaults), and what is left of it where it breaks."""
    states = ("p_completed", "p_terminated", "p_withdrawn")
    model = outcome_probabilities(t, kept=cut).where(F.col("event_id") % 3 == 0).select("event_id", *[F.col(c).alias(f"m{c}") for c in states])
    own = P.resolved_probabilities(*(F.col(c) for c in (*states, "p_break")), P.OutcomeDefaults(), "event")
    odds = t.odds.select("event_id", F.inline(F.array(own))).join(model, "event_id", "left")
    source = F.when(F.col("mp_completed").isNotNull(), "external_outcome_probabilities_explicit_three_state").otherwise(F.col("source"))
    odds = odds.select("event_id", *[F.coalesce(f"m{c}", c).alias(c) for c in states], source.alias("outcome_probability_source"))
    terminated, withdrawn = P.break_values(F.col("entry"), F.col("recovery"), P.BreakLosses())
    return t.quotes.join(odds, "event_id").withColumns({"terminated_value": terminated, "withdrawn_value": withdrawn})


def frame(t) -> DataFrame:
    """offered() with the leave-one-out fit of each deal's demand, the rolling holder fit, and what its capacity follows from."""
    fits = E.beta_leave_one_out(t.deals.select("event_id", "deal_type", "f_cash"), ["deal_type"], "f_cash").select("event_id", "a", "b")
    holders = H.rolling_fit(H.panel(t.deals), CFG).select("event_id", "p_hat", "q_hat", "fit_n")
    supply = t.capacity.select("event_id", "shares", F.col("adv").alias("daily"), "dollar_adv", "passive", "default_rule")
    d = offered(t).join(fits, "event_id").join(holders, "event_id").join(supply, "event_id")
    inputs = C.inputs(F.col("shares"), F.col("daily"), F.col("dollar_adv"), F.col("entry"), F.col("passive"), F.col("q_hat"), F.col("p_hat"), CFG)
    votes = P.predicted_votes(F.col("p_hat"), F.col("q_hat"), F.col("passive"), F.col("default_rule"), F.col("cash"), F.col("stock"), F.col("entry"))
    d = d.withColumns({**inputs, "holder_cash_demand": votes["cash_demand"], "holder_action": votes["action"]})
    d = d.withColumn("holder_source", F.when(F.col("fit_n") > 0, "rolling_structural_fit").otherwise("rolling_structural_default"))
    keep = ["event_id", "party", "announce_date", "cash", "ratio", "pi_cash", "stock", "deadline_stock", "entry", "entry_acq", "recovery", "outcome", "f_cash", "a", "b", "p_completed", "p_terminated", "p_withdrawn", "outcome_probability_source"]
    keep += ["p_hat", "q_hat", "fit_n", "holder_source", "holder_cash_demand", "holder_action", "shares", "default_rule", "adv", "adv_pct", "passive_share", "active_share", "positive_share", "noisy_share", "noisy_cash", "terminated_value", "withdrawn_value"]
    return d.select(*keep)


def priced(t, draws: T.Draws) -> DataFrame:
    """frame() with both trades' summaries, the decision and the flows behind it."""
    rows = EVEN_DEALS if draws.even else DEALS
    d = T.priced(dealt(frame(t), "event_id", rows), draws)
    demand = F.lit(0.5) if draws.even else F.col("a") / (F.col("a") + F.col("b"))
    # kept here, so that draws are made once and the plan of what follows stays small; and dealt again, as its files would go into few tasks
    return T.flows(dealt(T.realized(T.decided(d.withColumn("demand_mean", demand), GATES)), "event_id", rows), CFG)


def blotter_of(t, draws: T.Draws) -> DataFrame:
    d = priced(t, draws).withColumn("sized", F.col("signal") == "ENTER")
    return T.booked(T.sized(d, draws, CFG.size_points, GATES), CFG)


INNER = ("a", "b", "pools", "lenders", "buyers", "short", "sized", "raw_q", "raw_binding", "reverse_q", "reverse_binding", "fail_reason", "break_even", "proof_reason", *(f"{p}_{s}" for p in T.PREFIXES for s in T.SIZE_STATS))


@query("blotter")
def blotter(t, draws=DRAWS):
    """One row for each deal that can be priced: both trades on the same draws, the one taken, its gates, hedge and capacity, and what came of it; those with the greatest
    expected return first. Random draws have no SQL; blotter_even is the same on even ones."""
    # a sort reads its rows twice, and sizes are found once
    return cut(blotter_of(t, draws).drop(*INNER)).orderBy(F.col("e_return").desc(), "event_id")


#: frame() in SQL, on the oracles of its parts.
_FRAME = f"""
om AS ({SQL['outcome_probabilities']}),
oe AS ({SQL['prob_resolution']}),
oo AS (
  SELECT oe.event_id, coalesce(om.p_completed, oe.p_completed) AS p_completed, coalesce(om.p_terminated, oe.p_terminated) AS p_terminated, coalesce(om.p_withdrawn, oe.p_withdrawn) AS p_withdrawn
  FROM oe LEFT JOIN om ON om.event_id = oe.event_id AND om.event_id % 3 = 0),
hh AS ({{holder_fit}}),
fr AS (
  SELECT q.*, oo.p_completed, oo.p_terminated, oo.p_withdrawn, hh.p_hat, hh.q_hat, hh.fit_n, c.shares, c.passive, c.default_rule,
    CASE WHEN c.adv > 0 THEN c.adv ELSE c.dollar_adv / q.entry END AS adv, greatest(0e0, 1 - c.passive) AS active, q.pi_cash * q.cash + (1 - q.pi_cash) * q.stock AS blend,
    q.entry - greatest(coalesce(greatest(q.entry - q.recovery, 0e0), 0e0), 25e-2 * q.entry) AS tv, q.entry - greatest(coalesce(greatest(q.entry - q.recovery, 0e0), 0e0), 35e-2 * q.entry) AS wv
  FROM {{quotes}} q JOIN oo ON oo.event_id = q.event_id JOIN hh ON hh.event_id = q.event_id JOIN {{capacity}} c ON c.event_id = q.event_id),
dr AS (SELECT (k + 5e-1) / 16e0 AS f, (k + 1) * 0.6180339887498949e0 - floor((k + 1) * 0.6180339887498949e0) AS u FROM range(16) r(k)),
"""

#: Both trades on even draws, and the decision.
_DECIDED = """
pd AS (
  SELECT fr.event_id, f, u, least(1e0, pi_cash / f) * cash + (1 - least(1e0, pi_cash / f)) * stock AS vc, least(1e0, (1 - pi_cash) / (1 - f)) * stock + (1 - least(1e0, (1 - pi_cash) / (1 - f))) * cash AS vs,
    1 - least(1e0, pi_cash / f) AS sc, least(1e0, (1 - pi_cash) / (1 - f)) AS ss FROM fr, dr),
el AS (SELECT event_id, avg(vc) AS cash_mean, avg(vs) AS stock_mean, avg(sc) AS sc, avg(ss) AS ss FROM pd GROUP BY event_id),
rt AS (
  SELECT pd.event_id,
    (CASE WHEN u < p_completed THEN CASE WHEN round(cash_mean, 9) >= round(stock_mean, 9) THEN vc ELSE vs END WHEN u < p_completed + p_terminated THEN tv ELSE wv END - entry) / entry AS l,
    (entry - CASE WHEN u < p_completed THEN blend WHEN u < p_completed + p_terminated THEN tv ELSE wv END) / entry AS r
  FROM pd JOIN fr ON fr.event_id = pd.event_id JOIN el ON el.event_id = pd.event_id),
qt AS (SELECT event_id, quantile_cont(l, 5e-2) AS lq, quantile_cont(r, 5e-2) AS rq FROM rt GROUP BY event_id),
st AS (
  SELECT rt.event_id, avg(l) AS lm, max(lq) AS lp, avg(l) FILTER (l <= lq) AS lc, avg(CASE WHEN l < 0 THEN 1e0 ELSE 0e0 END) AS ll,
    avg(r) AS rm, max(rq) AS rp, avg(r) FILTER (r <= rq) AS rc, avg(CASE WHEN r < 0 THEN 1e0 ELSE 0e0 END) AS rl
  FROM rt JOIN qt ON qt.event_id = rt.event_id GROUP BY rt.event_id),
g0 AS (
  SELECT fr.*, st.* EXCLUDE (event_id), cash_mean, stock_mean, CASE WHEN round(cash_mean, 9) >= round(stock_mean, 9) THEN 'CASH' ELSE 'STOCK' END AS elect, greatest(cash_mean, stock_mean) AS v,
    ratio * CASE WHEN round(cash_mean, 9) >= round(stock_mean, 9) THEN sc ELSE ss END AS lh, ratio * (1 - pi_cash) AS rh,
    greatest(abs(cash - stock) / greatest(least(abs(cash), abs(stock)), 1e-9), abs(cash - deadline_stock) / greatest(least(abs(cash), abs(deadline_stock)), 1e-9)) AS gap
  FROM fr JOIN st ON st.event_id = fr.event_id JOIN el ON el.event_id = fr.event_id),
g1 AS (
  SELECT *, (v - entry) / entry AS arb, (entry - blend) / entry AS rcr, {gate(lm, lp, ll)} AS lgate, {gate(rm, rp, rl)} AS rgate, round(rm, 9) > round(lm, 9) AS rbetter FROM g0),
g2 AS (
  SELECT *, CASE WHEN round(gap, 9) > 5e-1 OR round(greatest(abs(arb), abs(rcr)), 9) > 3e-1 THEN 'REVIEW'
    WHEN rgate = 'risk_adjusted_return_positive' AND (lgate <> 'risk_adjusted_return_positive' OR rbetter) THEN 'REVERSE' WHEN lgate = 'risk_adjusted_return_positive' THEN 'ENTER'
    WHEN 'p05_below_floor' IN (lgate, rgate) THEN 'PASS_P05' WHEN 'loss_probability_above_ceiling' IN (lgate, rgate) THEN 'PASS_LOSS_PROB' ELSE 'PASS' END AS signal FROM g1),
g3 AS (SELECT *, CASE WHEN signal IN ('ENTER', 'REVERSE') THEN signal = 'REVERSE' ELSE rbetter END AS short FROM g2),
"""

#: Pools, caps and the sizes of a grid.
_SIZES = """
p0 AS (
  SELECT *, adv / shares AS adv_pct, least(active, q_hat) AS positive, greatest(0e0, active - least(active, q_hat)) AS noisy, adv / shares * 10 * 2e-1 AS adv_cap, CASE WHEN elect = 'CASH' THEN 1e0 ELSE 0e0 END AS own,
    CASE WHEN default_rule = 'cash' THEN 1e0 WHEN default_rule = 'stock' THEN 0e0 ELSE greatest(0e0, least(1e0, pi_cash)) END AS pcash,
    CASE WHEN lm >= 3e-2 THEN 0e0 WHEN lm >= 0 THEN greatest(0e0, 2e-2 * (1 - lm / 3e-2)) ELSE 2e-2 + (85e-2 - 2e-2) * least(1e0, -lm / 3e-2) END AS sell FROM {base}),
p1 AS (SELECT *, greatest(0e0, least(noisy, adv_cap * 5e-1)) AS c1, positive * sell AS c2, passive * 1e-2 AS c3 FROM p0),
p2 AS (
  SELECT *, CASE WHEN lm < 0 THEN [c2, c1, c3] ELSE [c1, c2, c3] END AS caps, CASE WHEN lm < 0 THEN [own, p_hat, pcash] ELSE [p_hat, own, pcash] END AS cashes,
    CASE WHEN lm < 0 THEN ['positive_holders', 'noisy_sellers', 'passive_inactive'] ELSE ['noisy_sellers', 'positive_holders', 'passive_inactive'] END AS who, least(c1 + c2 + c3, adv_cap, 5e-2) AS raw_q,
    CASE WHEN c1 + c2 + c3 = least(c1 + c2 + c3, adv_cap, 5e-2) THEN 'source_supply' WHEN adv_cap = least(c1 + c2 + c3, adv_cap, 5e-2) THEN 'adv_participation' ELSE 'position_limit' END AS raw_binding FROM p1),
z0 AS (SELECT event_id, k, raw_q / 51 + k * ((raw_q - raw_q / 51) / 50) AS q, caps, cashes, own FROM p2, range(51) r(k) WHERE {wanted} AND raw_q > 0),
z1 AS (SELECT *, least(q, caps[1]) AS t1, least(greatest(q - caps[1], 0e0), caps[2]) AS t2 FROM z0),
z2 AS (SELECT *, least(greatest(q - t1 - t2, 0e0), caps[3]) AS t3 FROM z1),
z3 AS (SELECT event_id, k, q, own, (t1 * cashes[1] + t2 * cashes[2] + t3 * cashes[3]) / nullif(t1 + t2 + t3, 0e0) AS seller, greatest(0e0, q - (t1 + t2 + t3)) AS unfilled FROM z2),
z4 AS (SELECT *, q * (own - coalesce(seller, own)) AS shift FROM z3),
y0 AS (
  SELECT z4.event_id, k, list_transform(range(16), lambda i: greatest(1e-6, least(1 - 1e-6, (i + 5e-1) / 16e0 + shift))) AS xs, own = 1 AS by_cash, pi_cash, cash, stock, entry, p_completed, p_terminated, tv, wv
  FROM z4 JOIN fr ON fr.event_id = z4.event_id),
y1 AS (SELECT event_id, k, list_avg(xs) AS impacted, {returns} AS rs FROM y0),
y2 AS (SELECT event_id, k, impacted, list_avg(rs) AS mean, {fifth} AS p05, len(list_filter(rs, lambda r: r < 0)) / 16e0 AS loss FROM y1),
y3 AS (
  SELECT z4.*, impacted, mean, p05, loss, CASE WHEN seller IS NULL OR unfilled > 1e-9 THEN 'source_allocation_unfilled' ELSE {gate(mean, p05, loss)} END AS reason FROM z4 JOIN y2 ON y2.event_id = z4.event_id AND y2.k = z4.k),
mx AS (
  SELECT event_id, max(k) FILTER (reason = 'risk_adjusted_return_positive') AS km, max_by(reason, k) FILTER (reason <> 'risk_adjusted_return_positive') AS fail_reason FROM y3 GROUP BY event_id),
op AS (SELECT event_id, k AS ko FROM (SELECT event_id, k, row_number() OVER (PARTITION BY event_id ORDER BY round(q * mean, 12) DESC, k) AS n FROM y3 WHERE reason = 'risk_adjusted_return_positive') WHERE n = 1),
sz AS (
  SELECT p2.event_id, fail_reason, m.q AS max_q, m.mean AS max_mean, m.p05 AS max_p05, m.loss AS max_loss, m.shift AS max_shift, m.impacted AS max_impacted, m.seller AS max_seller,
    o.q AS optimal_q, o.mean AS optimal_mean, o.p05 AS optimal_p05, o.loss AS optimal_loss, o.shift AS optimal_shift, o.impacted AS optimal_impacted, o.seller AS optimal_seller
  FROM p2 LEFT JOIN mx ON mx.event_id = p2.event_id LEFT JOIN op ON op.event_id = p2.event_id
  LEFT JOIN y3 m ON m.event_id = p2.event_id AND m.k = mx.km LEFT JOIN y3 o ON o.event_id = p2.event_id AND o.k = op.ko),
"""

#: The gates along sizes bought from holders who elect at random.
_PROOF = """
w0 AS (
  SELECT p2.event_id, k, k / 2e2 AS q, list_transform(range(16), lambda i: greatest(1e-6, least(1 - 1e-6, (i + 5e-1) / 16e0 + k / 2e2 * (own - 5e-1)))) AS xs, own = 1 AS by_cash, pi_cash, cash, stock, entry, p_completed, p_terminated, tv, wv
  FROM p2, range(201) r(k) WHERE {wanted} AND raw_q > 0),
w1 AS (SELECT event_id, k, q, {returns} AS rs FROM w0),
w2 AS (SELECT event_id, k, q, list_avg(rs) AS mean, {fifth} AS p05, len(list_filter(rs, lambda r: r < 0)) / 16e0 AS loss FROM w1),
w3 AS (SELECT event_id, k, q, {gate(mean, p05, loss)} AS reason FROM w2),
pf AS (SELECT event_id, min(q) FILTER (reason <> 'risk_adjusted_return_positive') AS break_even, min_by(reason, k) FILTER (reason <> 'risk_adjusted_return_positive') AS proof_reason FROM w3 GROUP BY event_id),
"""


def _gate(mean: str, p05: str, loss: str) -> str:
    ok = f"round({mean}, 9) > 5e-3 AND round({p05}, 9) >= -25e-2 AND {loss} <= 5e-1"
    return f"CASE WHEN {ok} THEN 'risk_adjusted_return_positive' WHEN round({mean}, 9) <= 5e-3 THEN 'risk_adjusted_return_below_hurdle' WHEN round({p05}, 9) < -25e-2 THEN 'p05_below_floor' ELSE 'loss_probability_above_ceiling' END"


#: The returns of a row's 16 draws as a list, from the moved demands xs; and a list's fifth percentile.
_RETURNS = """list_transform(xs, lambda x, i: (CASE WHEN i * 0.6180339887498949e0 - floor(i * 0.6180339887498949e0) < p_completed
    THEN CASE WHEN by_cash THEN least(1e0, pi_cash / x) * (cash - stock) + stock ELSE least(1e0, (1 - pi_cash) / (1 - x)) * (stock - cash) + cash END
    WHEN i * 0.6180339887498949e0 - floor(i * 0.6180339887498949e0) < p_completed + p_terminated THEN tv ELSE wv END - entry) / entry)"""
_FIFTH = "list_sort(rs)[1] + 75e-2 * (list_sort(rs)[2] - list_sort(rs)[1])"


def _sql(parts: str, select: str, base: str, wanted: str) -> str:
    # braces around derived tables are the registry's; the rest is filled in here
    made = re.sub(r"\{gate\((\w+), (\w+), (\w+)\)\}", lambda m: _gate(*m.groups()), parts).replace("{base}", base).replace("{wanted}", wanted).replace("{holder_fit}", SQL["holder_rolling_fit"])
    made = made.replace("{returns}", _RETURNS).replace("{fifth}", _FIFTH)
    return "WITH " + made.strip().rstrip(",") + "\n" + select


@query(
    "trade_decision_even",
    _sql(
        _FRAME + _DECIDED,
        """SELECT event_id, elect, signal, CASE signal WHEN 'REVIEW' THEN CASE WHEN round(gap, 9) > 5e-1 THEN 'implausible_cash_vs_stock_term_gap' ELSE 'abs_completion_or_election_return_above_30pct' END
    WHEN 'ENTER' THEN lgate WHEN 'REVERSE' THEN rgate WHEN 'PASS_P05' THEN 'best_candidate_p05_below_floor' WHEN 'PASS_LOSS_PROB' THEN 'best_candidate_loss_probability_above_ceiling' ELSE 'both_directions_below_hurdle' END AS signal_reason,
  CASE WHEN short THEN 'LONG_ACQUIRER' ELSE 'SHORT_ACQUIRER' END AS hedge_side, round(CASE WHEN short THEN rh ELSE lh END, 9) AS hedge_ratio, round(arb, 9) AS arb_return, round(rcr, 9) AS reverse_completion_return,
  round(lm, 9) AS long_mean, round(lp, 9) AS long_p05, round(lc, 9) AS long_cvar05, ll AS long_loss, round(rm, 9) AS reverse_mean, round(rp, 9) AS reverse_p05, round(rc, 9) AS reverse_cvar05, rl AS reverse_loss,
  round(CASE WHEN short THEN rm ELSE lm END, 9) AS e_return, round(CASE WHEN short THEN blend ELSE v END, 9) AS fair_value, round(entry * CASE WHEN short THEN 1 - rm ELSE 1 + lm END, 9) AS risk_adjusted_value,
  round(CASE signal WHEN 'ENTER' THEN greatest(0e0, least(3e0, round(lm, 9) / greatest(-round(lc, 9), -round(lp, 9), 1e-3))) WHEN 'REVERSE' THEN greatest(0e0, least(3e0, round(rm, 9) / greatest(-round(rc, 9), -round(rp, 9), 1e-3))) ELSE 0e0 END, 6) AS size,
  CASE WHEN outcome IN ('terminated', 'withdrawn') THEN 'deal_outcome_label' WHEN f_cash IS NOT NULL THEN 'realized_f_cash' WHEN outcome = 'completed' THEN 'completed_status_no_realized_f_cash' ELSE 'missing_realized_outcome' END AS realized_source,
  round(CASE WHEN outcome = 'terminated' THEN (tv - entry) / entry * CASE WHEN short THEN -1 ELSE 1 END WHEN outcome = 'withdrawn' THEN (wv - entry) / entry * CASE WHEN short THEN -1 ELSE 1 END
    WHEN short THEN CASE WHEN outcome = 'completed' OR f_cash IS NOT NULL THEN rcr END
    WHEN f_cash IS NOT NULL THEN (CASE WHEN elect = 'CASH' THEN least(1e0, pi_cash / greatest(1e-6, least(1 - 1e-6, f_cash))) * (cash - stock) + stock ELSE least(1e0, (1 - pi_cash) / (1 - greatest(1e-6, least(1 - 1e-6, f_cash)))) * (stock - cash) + cash END - entry) / entry END, 9) AS realized_return
FROM g3""",
        "g3",
        "",
    ),
)
def trade_decision_even(t):
    """Both trades of each deal on the same draws, and the one taken. Even draws know nothing of fits, holders or supply, and are drawn where the terms are joined: only the
    deals, which are read many times, are kept on disk."""
    t = t.replaced(deals=cut(t.deals))
    terms = ["event_id", "cash", "ratio", "pi_cash", "stock", "deadline_stock", "entry", "outcome", "f_cash", "p_completed", "p_terminated", "terminated_value", "withdrawn_value"]
    d = T.realized(T.decided(T.priced(offered(t).select(*terms), EVEN), GATES)).withColumnsRenamed({"long_loss_probability": "long_loss", "reverse_loss_probability": "reverse_loss"})
    nine = {"hedge_ratio", "arb_return", "reverse_completion_return", "long_mean", "long_p05", "long_cvar05", "reverse_mean", "reverse_p05", "reverse_cvar05", "e_return", "fair_value", "risk_adjusted_value", "realized_return"}
    plain = ["event_id", "elect", "signal", "signal_reason", "hedge_side", "long_loss", "reverse_loss", "realized_source"]
    return d.select(*plain, *[F.round(c, 9).alias(c) for c in sorted(nine)], F.round("size", 6).alias("size"))


_GRID = """SELECT sz.event_id, round(p2.raw_q, 12) AS raw_q, raw_binding, fail_reason, round(max_q, 11) AS max_q, round(max_mean, 11) AS max_mean, round(max_p05, 11) AS max_p05, max_loss AS max_loss_probability, round(max_shift, 11) AS max_shift, round(max_impacted, 11) AS max_impacted_demand,
  round(max_seller, 11) AS max_seller_cash_prob, round(optimal_q, 11) AS optimal_q, round(optimal_mean, 11) AS optimal_mean, round(optimal_p05, 11) AS optimal_p05, optimal_loss AS optimal_loss_probability, round(optimal_shift, 11) AS optimal_shift, round(optimal_impacted, 11) AS optimal_impacted_demand,
  round(optimal_seller, 11) AS optimal_seller_cash_prob FROM sz JOIN p2 ON p2.event_id = sz.event_id"""


def grid_of(t, draws: T.Draws) -> DataFrame:
    """The largest and the most profitable size of every deal, whatever its signal."""
    d = T.sized(priced(t, draws).withColumn("sized", F.lit(True)), draws, CFG.size_points, GATES, proof=False)
    return d.select("event_id", "raw_q", "raw_binding", "fail_reason", *[f"{p}_{s}" for p in T.PREFIXES for s in T.SIZE_STATS])


@query("capacity_grid")
def capacity_grid(t, draws=DRAWS):
    """For each deal 51 sizes up to what flows allow, each on the deal's own draws with demand moved by its vote: the largest and the most profitable that pass the gate, and the
    gate that the last failing one hits. Random draws have no SQL; capacity_grid_even is the same on even ones."""
    return grid_of(t, draws)


@query("capacity_grid_even", _sql(_FRAME + _DECIDED + _SIZES, _GRID, "g3", "true"))
def capacity_grid_even(t):
    d = grid_of(t, EVEN)
    plain = ("event_id", "raw_binding", "fail_reason", "max_loss_probability", "optimal_loss_probability")
    return d.select(*[F.col(c) if c in plain else F.round(c, 12 if c == "raw_q" else 11).alias(c) for c in d.columns])


def proof_of(t, draws: T.Draws) -> DataFrame:
    d = T.sized(priced(t, draws).withColumn("sized", F.lit(True)), draws, CFG.size_points, GATES, best=False)
    return d.where("raw_q > 0").select("event_id", F.col("break_even").isNotNull().alias("can_eliminate"), "break_even", "proof_reason")


@query("self_impact_proof")
def self_impact_proof(t, draws=DRAWS):
    """The least of 201 shares of the company at which a position bought from holders who elect at random no longer passes, and the gate it hits."""
    return proof_of(t, draws)


@query("self_impact_proof_even", _sql(_FRAME + _DECIDED + _SIZES + _PROOF, "SELECT event_id, break_even IS NOT NULL AS can_eliminate, break_even, proof_reason FROM pf", "g3", "true"))
def self_impact_proof_even(t):
    return proof_of(t, EVEN)


def _book_sql() -> str:
    """The capacity of the trade taken, on sizes, proof and flows."""
    sides = """
b0 AS (
  SELECT p2.*, sz.* EXCLUDE (event_id), pf.break_even, pf.proof_reason, passive * 2e-1 AS l1, noisy * 1e-1 AS l2, least(noisy, adv_cap * 5e-1) AS buyers, (tv - entry) / entry AS tr, (wv - entry) / entry AS wr
  FROM p2 JOIN sz ON sz.event_id = p2.event_id LEFT JOIN pf ON pf.event_id = p2.event_id),
b1 AS (SELECT *, greatest(0e0, least(l1 + l2, adv_cap, 5e-2)) AS most FROM b0),
b2 AS (
  SELECT *, least(most, buyers) AS rq, CASE WHEN buyers < most THEN 'noisy_buyer_demand' WHEN l1 + l2 = least(l1 + l2, adv_cap, 5e-2) THEN 'source_supply' WHEN adv_cap = least(l1 + l2, adv_cap, 5e-2) THEN 'adv_participation' ELSE 'position_limit' END AS rbinding FROM b1),
b3 AS (SELECT *, least(rq, l1) AS t1, least(greatest(rq - l1, 0e0), l2) AS t2 FROM b2),
b4 AS (SELECT *, (t1 * pcash + t2 * p_hat) / nullif(t1 + t2, 0e0) AS lender, CASE WHEN rq > 0 THEN rq END AS lq FROM b3),
b5 AS (
  SELECT *, signal = 'ENTER' AS en, signal = 'REVERSE' AS re, max_q IS NOT NULL AS found, rq * (p_hat - lender) AS rshift,
    CASE WHEN max_q < raw_q * (1 - 1e-6) THEN 'self_impact_' || coalesce(fail_reason, 'gate') ELSE raw_binding END AS max_name,
    CASE outcome WHEN 'terminated' THEN tr WHEN 'withdrawn' THEN wr END AS ended, greatest(1e-6, least(1 - 1e-6, f_cash)) AS fx,
    greatest(1e-6, least(1 - 1e-6, f_cash + max_q * (own - max_seller))) AS max_fx, greatest(1e-6, least(1 - 1e-6, f_cash + optimal_q * (own - optimal_seller))) AS optimal_fx FROM b4),
"""
    value = "(CASE WHEN elect = 'CASH' THEN least(1e0, pi_cash / {x}) * (cash - stock) + stock ELSE least(1e0, (1 - pi_cash) / (1 - {x})) * (stock - cash) + cash END - entry) / entry"
    reverse_real = "CASE WHEN ended IS NOT NULL THEN -ended WHEN outcome = 'completed' OR f_cash IS NOT NULL THEN rcr END"
    columns = []
    for p in T.PREFIXES:
        q, mean = f"CASE WHEN en THEN {p}_q WHEN re THEN lq END", f"CASE WHEN en THEN {p}_mean WHEN re AND rq > 0 THEN rm END"
        base = f"CASE WHEN en THEN coalesce(ended, CASE WHEN f_cash IS NOT NULL THEN {value.format(x='fx')} END) WHEN re THEN {reverse_real} END"
        moved = f"CASE WHEN en THEN coalesce(ended, CASE WHEN f_cash IS NOT NULL AND {p}_q IS NOT NULL THEN {value.format(x=f'{p}_fx')} END) WHEN re THEN {reverse_real} END"
        name = "max_name" if p == "max" else "CASE WHEN abs(optimal_q - max_q) < 1e-12 THEN max_name ELSE 'profit_optimal_before_max' END"
        shift, impacted = f"CASE WHEN en THEN {p}_shift WHEN re AND rq > 0 THEN rshift END", f"CASE WHEN en THEN {p}_impacted WHEN re AND rq > 0 THEN 5e-1 + rshift END"
        found = {
            "q": q, "notional": f"{q} * shares * entry", "e_return": mean, "expected_pnl": f"{q} * shares * entry * {mean}", "demand_shift": shift, "impacted_demand": impacted,
            "baseline_realized_return": base, "self_impact_realized_return": moved, "self_impact_realized_pnl": f"{q} * shares * entry * {moved}",
        }
        columns.append(f"CASE WHEN en AND found THEN {name} WHEN re AND rq > 0 THEN rbinding END AS capacity_{p}_binding")
        digits = {"notional": 5, "expected_pnl": 5, "self_impact_realized_pnl": 5}
        columns += [f"round({v}, {digits.get(k, 11)}) AS capacity_{p}_{k}" for k, v in found.items()]
    status = "CASE WHEN en THEN CASE WHEN found THEN 'ok' WHEN raw_q > 0 THEN 'zero_capacity_after_self_impact' ELSE 'ok' END WHEN re THEN 'ok' ELSE 'not_evaluated' END"
    note = """CASE WHEN en AND raw_q > 0 THEN CASE WHEN break_even IS NOT NULL THEN 'pure_noisy_counterparty_self_impact_hits_' || proof_reason ELSE 'not_within_100pct_target_shares_under_current_terms_and_gates' END
  WHEN re AND rq > 0 THEN 'not_possible_for_reverse_under_fixed_pool_passive_blended_settlement' END"""
    select = f"""SELECT event_id, signal, {status} AS capacity_status, CASE WHEN en THEN raw_binding WHEN re THEN rbinding END AS capacity_raw_max_binding, round(CASE WHEN en THEN raw_q WHEN re THEN rq END, 9) AS capacity_raw_max_q,
  {', '.join(columns)},
  coalesce(en AND raw_q > 0 AND break_even IS NOT NULL, false) AS self_impact_can_eliminate, CASE WHEN en AND raw_q > 0 THEN break_even END AS self_impact_break_even_q, {note} AS self_impact_note FROM b5"""
    return _sql(_FRAME + _DECIDED + _SIZES + _PROOF + sides, select, "g3", "signal = 'ENTER'")


@query("blotter_even", _book_sql())
def blotter_even(t):
    """The capacity columns of the blotter on even draws."""
    d = blotter_of(t, EVEN)
    money = ("notional", "expected_pnl", "self_impact_realized_pnl")
    nine = ("q", "e_return", "demand_shift", "impacted_demand", "baseline_realized_return", "self_impact_realized_return")
    made = [F.round(f"capacity_{p}_{x}", 5 if x in money else 11).alias(f"capacity_{p}_{x}") for p in T.PREFIXES for x in (*nine, *money)]
    plain = ["event_id", "signal", "capacity_status", "capacity_raw_max_binding", "self_impact_can_eliminate", "self_impact_break_even_q", "self_impact_note", *[f"capacity_{p}_binding" for p in T.PREFIXES]]
    return d.select(*plain, F.round("capacity_raw_max_q", 9).alias("capacity_raw_max_q"), *made)
