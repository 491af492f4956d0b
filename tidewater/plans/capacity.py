"""Queries of capacity and of the holder model."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import capacity as C
from ..operators import holders as H
from .registry import query

CFG = C.CapacityConfig()

INPUTS_SQL = """i0 AS (SELECT *, CASE WHEN adv > 0 THEN adv ELSE dollar_adv / entry_price END AS volume, greatest(0e0, 1 - passive) AS active FROM {capacity}),
i1 AS (SELECT *, volume / shares AS adv_pct, CASE WHEN holder_positive IS NOT NULL THEN least(active, holder_positive) ELSE active * 35e-2 END AS positive, coalesce(holder_cash_prob, 5e-1) AS noisy_cash FROM i0),
i2 AS (SELECT *, greatest(0e0, active - positive) AS noisy, adv_pct * 10 * 2e-1 AS adv_cap, CASE WHEN default_rule = 'cash' THEN 1e0 WHEN default_rule = 'stock' THEN 0e0 ELSE greatest(0e0, least(1e0, pi_cash)) END AS passive_cash,
  CASE WHEN edge_return >= 3e-2 THEN 0e0 WHEN edge_return >= 0 THEN greatest(0e0, 2e-2 * (1 - edge_return / 3e-2)) ELSE 2e-2 + (85e-2 - 2e-2) * least(1e0, -edge_return / 3e-2) END AS sell FROM i1),
i3 AS (SELECT *, least(noisy, adv_cap * 5e-1) AS c_noisy, positive * sell AS c_pos, passive * 1e-2 AS c_pas, CASE WHEN elect = 'CASH' THEN 1e0 ELSE 0e0 END AS own_cash FROM i2),
i4 AS (SELECT *, c_noisy + c_pos + c_pas AS source FROM i3),
i5 AS (SELECT *, least(source, adv_cap, 5e-2) AS own FROM i4)"""


def _with_inputs(t):
    d = t.capacity
    made = C.inputs(F.col("shares"), F.col("adv"), F.col("dollar_adv"), F.col("entry_price"), F.col("passive"), F.col("holder_positive"), F.col("holder_cash_prob"), CFG)
    return d.select("*", *[c.alias(f"in_{k}") for k, c in made.items()])


def capacity_frame(t):
    """Capacity inputs under their own names, with the cap of the daily volume and the pools of sellers."""
    d = _with_inputs(t)
    d = d.select("event_id", "edge_return", "elect", "default_rule", "pi_cash", *[F.col(c).alias(c.removeprefix("in_")) for c in d.columns if c.startswith("in_")])
    d = d.withColumn("adv_cap", F.col("adv_pct") * CFG.build_days * CFG.adv_participation)
    return d.withColumn("pools", C.long_pools(F.col("adv_cap"), F.col("edge_return"), F.col("elect"), F.col("default_rule"), F.col("pi_cash"), CFG))


@query("capacity_inputs", f"WITH {INPUTS_SQL} SELECT event_id, volume AS adv, adv_pct, passive AS passive_share, active AS active_share, positive AS positive_share, noisy AS noisy_share, noisy_cash, CASE WHEN holder_positive IS NOT NULL THEN 'rolling_structural_fit' ELSE 'static_positive_holder_share_of_active' END AS holder_source FROM i2")
def capacity_inputs(t):
    return capacity_frame(t).select("event_id", "adv", "adv_pct", "passive_share", "active_share", "positive_share", "noisy_share", "noisy_cash", "holder_source")


@query("sell_rate", f"WITH {INPUTS_SQL} SELECT event_id, sell AS rate FROM i2")
def sell_rate(t):
    return t.capacity.select("event_id", C.sell_rate(F.col("edge_return"), CFG).alias("rate"))


@query("binding_constraint", f"WITH {INPUTS_SQL} SELECT event_id, greatest(0e0, own) AS max_ownership, CASE WHEN source = own THEN 'source_supply' WHEN adv_cap = own THEN 'adv_participation' ELSE 'position_limit' END AS binding_constraint FROM i5")
def binding_constraint(t):
    d = capacity_frame(t).withColumn("source", C.pool_total(F.col("pools")))
    most, name = C.binding(F.col("source"), F.col("adv_cap"), F.lit(CFG.position_limit))
    return d.select("event_id", most.alias("max_ownership"), name.alias("binding_constraint"))


@query(
    "waterfall",
    f"""WITH {INPUTS_SQL},
w AS (SELECT event_id, 3e-2 AS q, CASE WHEN edge_return < 0 THEN [c_pos, c_noisy, c_pas] ELSE [c_noisy, c_pos, c_pas] END AS caps, CASE WHEN edge_return < 0 THEN [own_cash, noisy_cash, passive_cash] ELSE [noisy_cash, own_cash, passive_cash] END AS cash FROM i4),
k AS (SELECT event_id, q, cash, [least(q, caps[1]), greatest(0e0, least(q - caps[1], caps[2])), greatest(0e0, least(q - caps[1] - caps[2], caps[3]))] AS take FROM w)
SELECT event_id, (take[1] * cash[1] + take[2] * cash[2] + take[3] * cash[3]) / nullif(take[1] + take[2] + take[3], 0e0) AS cash_prob, round(greatest(0e0, q - (take[1] + take[2] + take[3])), 11) AS unfilled FROM k""",
)
def waterfall(t):
    d = capacity_frame(t).select("event_id", F.inline(F.array(C.allocate(F.col("pools"), F.lit(0.03)))))
    return d.select("event_id", "cash_prob", F.round("unfilled", 11).alias("unfilled"))


@query(
    "waterfall_mix",
    f"""WITH {INPUTS_SQL},
w AS (SELECT event_id, greatest(0e0, own) AS q, CASE WHEN edge_return < 0 THEN [c_pos, c_noisy, c_pas] ELSE [c_noisy, c_pos, c_pas] END AS caps, CASE WHEN edge_return < 0 THEN ['positive_holders', 'noisy_sellers', 'passive_inactive'] ELSE ['noisy_sellers', 'positive_holders', 'passive_inactive'] END AS names FROM i5),
k AS (SELECT event_id, q, names, [least(q, caps[1]), greatest(0e0, least(q - caps[1], caps[2])), greatest(0e0, least(q - caps[1] - caps[2], caps[3]))] AS take FROM w)
SELECT event_id, CASE WHEN q > 0 THEN array_to_string(list_filter([CASE WHEN take[1] > 0 THEN names[1] || ':' || printf('%.2f', take[1] / q) END, CASE WHEN take[2] > 0 THEN names[2] || ':' || printf('%.2f', take[2] / q) END, CASE WHEN take[3] > 0 THEN names[3] || ':' || printf('%.2f', take[3] / q) END], lambda x: x IS NOT NULL), '|') ELSE '' END AS source_mix FROM k""",
)
def waterfall_mix(t):
    """The text of the sources taken from, in order, at the ownership that the constraint allows."""
    d = capacity_frame(t).withColumn("most", C.binding(C.pool_total(F.col("pools")), F.col("adv_cap"), F.lit(CFG.position_limit))[0])
    return d.select("event_id", F.inline(F.array(C.allocate(F.col("pools"), F.col("most"))))).select("event_id", "source_mix")


@query(
    "reverse_flow",
    f"""WITH {INPUTS_SQL},
b AS (SELECT *, passive * 2e-1 AS l1, noisy * 1e-1 AS l2, least(noisy, adv_cap * 5e-1) AS buyer FROM i2), m AS (SELECT *, greatest(0e0, least(l1 + l2, adv_cap, 5e-2)) AS most FROM b),
n AS (SELECT *, least(most, buyer) AS own FROM m), a AS (SELECT *, least(own, l1) AS t1, greatest(0e0, least(own - l1, l2)) AS t2 FROM n)
SELECT event_id, own AS max_ownership, CASE WHEN buyer < most THEN 'noisy_buyer_demand' WHEN l1 + l2 = least(l1 + l2, adv_cap, 5e-2) THEN 'source_supply' WHEN adv_cap = least(l1 + l2, adv_cap, 5e-2) THEN 'adv_participation' ELSE 'position_limit' END AS binding_constraint,
  CASE WHEN own > 0 AND t1 + t2 > 0 THEN (t1 * passive_cash + t2 * noisy_cash) / (t1 + t2) END AS lender_cash_prob, CASE WHEN own > 0 AND t1 + t2 > 0 THEN own * (noisy_cash - (t1 * passive_cash + t2 * noisy_cash) / (t1 + t2)) END AS election_cash_shift FROM a""",
)
def reverse_flow(t):
    d = capacity_frame(t).withColumn("lenders", C.lending_pools(F.col("default_rule"), F.col("pi_cash"), CFG))
    most, name = C.binding(C.pool_total(F.col("lenders")), F.col("adv_cap"), F.lit(CFG.position_limit))
    buyer = F.least(F.col("noisy_share"), F.col("adv_cap") * CFG.noisy_buy)
    d = d.withColumns({"most": most, "name": name, "buyer": buyer}).withColumn("own", F.least("most", "buyer"))
    d = d.select("event_id", "own", "noisy_cash", F.when(F.col("buyer") < F.col("most"), "noisy_buyer_demand").otherwise(F.col("name")).alias("binding_constraint"), F.inline(F.array(C.allocate(F.col("lenders"), F.col("own")))))
    return d.select("event_id", F.col("own").alias("max_ownership"), "binding_constraint", F.col("cash_prob").alias("lender_cash_prob"), (F.col("own") * (F.col("noisy_cash") - F.col("cash_prob"))).alias("election_cash_shift"))


@query(
    "own_vote_impact",
    """WITH v AS (SELECT event_id, pi_cash AS cd, CASE WHEN shares > 0 AND entry_price > 0 THEN greatest(0e0, least(25e-2, 1e5 / entry_price / shares)) ELSE 0e0 END AS own, elect FROM {capacity})
SELECT event_id, own AS own_share, CASE WHEN elect = 'CASH' THEN cd * (1 - own) + own ELSE cd * (1 - own) END AS cash_demand FROM v""",
)
def own_vote_impact(t):
    own = C.own_vote_share(F.lit(1e5), F.col("entry_price"), F.col("shares"))
    return t.capacity.select("event_id", own.alias("own_share"), C.with_own_vote(F.col("pi_cash"), own, F.lower("elect")).alias("cash_demand"))


#: The rolling fit over a panel.
HOLDER_FIT_SQL = """WITH o AS (SELECT *, count(f_cash) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lab, f_cash AS y FROM PANEL),
g AS (SELECT o.*, ip / 1e1 AS p, iq / 1e1 AS q FROM o, (SELECT unnest(range(11)) AS ip) a, (SELECT unnest(range(11)) AS iq) b),
v0 AS (SELECT *, least(q, 1 - passive) AS rat0 FROM g),
v1 AS (SELECT *, greatest(0e0, 1 - passive - rat0) AS irr0, CASE WHEN cash < target_price AND stock < target_price THEN 'exit' WHEN stock >= cash THEN 'stock' ELSE 'cash' END AS action, CASE default_rule WHEN 'cash' THEN 1e0 WHEN 'stock' THEN 0e0 ELSE 5e-1 END AS dflt FROM v0),
v2 AS (SELECT *, CASE WHEN action = 'exit' AND passive + irr0 > 1e-12 THEN passive + rat0 * passive / (passive + irr0) ELSE passive END AS pas,
  CASE WHEN action = 'exit' THEN CASE WHEN passive + irr0 > 1e-12 THEN irr0 + rat0 * irr0 / (passive + irr0) ELSE 1e0 END ELSE irr0 END AS irr, CASE WHEN action = 'exit' THEN 0e0 ELSE rat0 END AS rat FROM v1),
v3 AS (SELECT *, irr * p + pas * dflt + CASE WHEN action = 'cash' THEN rat ELSE 0e0 END AS cd, irr * (1 - p) + pas * (1 - dflt) + CASE WHEN action = 'stock' THEN rat ELSE 0e0 END AS sd FROM v2),
e AS (SELECT event_id, pos, lab, p, q, y, weight * (y - cd / (cd + sd)) * (y - cd / (cd + sd)) AS err FROM v3),
s AS (SELECT event_id, pos, lab, p, q, sum(err) OVER w AS sse, count(err) OVER w AS n FROM e WINDOW w AS (PARTITION BY p, q ORDER BY lab RANGE BETWEEN 50 PRECEDING AND 1 PRECEDING)),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(sse, 12), p, q) AS k FROM s)
SELECT event_id, CASE WHEN n >= 10 THEN p ELSE 5e-1 END AS p_hat, CASE WHEN n >= 10 THEN q ELSE 3e-1 END AS q_hat, CASE WHEN n >= 10 THEN n ELSE 0 END AS fit_n, CASE WHEN n >= 10 THEN round(sse, 9) END AS sse FROM r WHERE k = 1"""


@query("holder_rolling_fit", HOLDER_FIT_SQL.replace("PANEL", "{holders}"))
def holder_rolling_fit(t):
    return H.rolling_fit(H.panel(t.deals), CFG)


@query(
    "net_alpha",
    """WITH d AS (SELECT event_id, cash, ratio * acq_price AS stock, cash * 95e-2 AS m, (event_id % 20) / 1e4 AS half, (event_id % 90) AS days FROM {deals})
SELECT event_id, (stock - m) / m AS gross, 2 * (5e-4 + half) + 3e-3 * days / 365 AS costs, (stock - m) / m - (2 * (5e-4 + half) + 3e-3 * days / 365) AS net FROM d""",
)
def net_alpha(t):
    m = F.col("cash") * 0.95
    gross = (F.col("ratio") * F.col("acq_price") - m) / m
    costs = 2 * (0.0005 + (F.col("event_id") % 20) / 1e4) + 0.003 * (F.col("event_id") % 90) / 365
    return t.deals.select("event_id", gross.alias("gross"), costs.alias("costs"), (gross - costs).alias("net"))


@query("panel_order", "SELECT event_id, row_number() OVER (PARTITION BY party % 7 ORDER BY CASE WHEN event_id % 9 <> 0 THEN announce_date END NULLS LAST, event_id) AS n FROM {deals}")
def panel_order(t):
    d = F.when(F.col("event_id") % 9 != 0, F.col("announce_date"))
    return t.deals.select("event_id", F.row_number().over(Window.partitionBy(F.col("party") % 7).orderBy(d.asc_nulls_last(), "event_id")).cast("long").alias("n"))
