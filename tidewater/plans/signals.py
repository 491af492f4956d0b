"""Queries of gates, signals and their summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import gates as G
from .registry import query

CFG = G.GateConfig()
STATS_SQL = """s0 AS (SELECT event_id, ((event_id * 7) % 128 - 30) / 1024e0 AS mean, -((event_id * 13) % 96) / 256e0 AS p05, (event_id % 80) / 128e0 AS loss, event_id % 17 = 0 AS review, ((event_id * 5) % 90 - 40) / 1024e0 AS rmean, -((event_id * 11) % 80) / 256e0 AS rp05, (event_id % 70) / 128e0 AS rloss FROM {deals})"""


def stats(t):
    k = F.col("event_id")
    return t.deals.select(
        "event_id", (((k * 7) % 128 - 30) / 1024.0).alias("mean"), (-((k * 13) % 96) / 256.0).alias("p05"), ((k % 80) / 128.0).alias("loss"), (k % 17 == 0).alias("review"),
        (((k * 5) % 90 - 40) / 1024.0).alias("rmean"), (-((k * 11) % 80) / 256.0).alias("rp05"), ((k % 70) / 128.0).alias("rloss"),
    )


_OK = "(mean > 5e-3 AND p05 >= -25e-2 AND loss <= 5e-1)"


@query(
    "risk_gate",
    f"""WITH {STATS_SQL} SELECT event_id, {_OK} AS ok, CASE WHEN {_OK} THEN greatest(0e0, least(3e0, mean / greatest(-p05 * 125e-2, -p05, 1e-3))) ELSE 0e0 END AS size,
  CASE WHEN {_OK} THEN 'risk_adjusted_return_positive' WHEN mean <= 5e-3 THEN 'risk_adjusted_return_below_hurdle' WHEN p05 < -25e-2 THEN 'p05_below_floor' ELSE 'loss_probability_above_ceiling' END AS reason FROM s0""",
)
def risk_gate(t):
    return stats(t).select("event_id", F.inline(F.array(G.risk_gate(F.col("mean"), F.col("p05"), F.col("p05") * 1.25, F.col("loss"), CFG))))


SIGNAL_SQL = f"""{STATS_SQL}, s1 AS (SELECT *, {_OK} AS lok, (rmean > 5e-3 AND rp05 >= -25e-2 AND rloss <= 5e-1) AS rok FROM s0),
sg AS (SELECT event_id, mean, rmean, CASE WHEN review THEN 'REVIEW' WHEN rok AND (NOT lok OR rmean > mean) THEN 'REVERSE' WHEN lok THEN 'ENTER' WHEN mean > 5e-3 AND p05 < -25e-2 THEN 'PASS_P05' WHEN mean > 5e-3 AND loss > 5e-1 THEN 'PASS_LOSS_PROB' ELSE 'PASS' END AS signal FROM s1)"""


def signals(t):
    d = stats(t)
    lok = G.risk_gate(F.col("mean"), F.col("p05"), F.col("p05"), F.col("loss"), CFG)["ok"]
    rok = G.risk_gate(F.col("rmean"), F.col("rp05"), F.col("rp05"), F.col("rloss"), CFG)["ok"]
    return d.withColumn("signal", G.signal(F.col("review"), lok, F.col("mean"), F.col("p05"), F.col("loss"), rok, F.col("rmean"), CFG))


@query("signal_tree", f"WITH {SIGNAL_SQL} SELECT event_id, signal FROM sg")
def signal_tree(t):
    return signals(t).select("event_id", "signal")


@query("signal_clean_view", f"WITH {SIGNAL_SQL} SELECT event_id AS \"Event\", signal AS \"Signal\", round(mean * 100, 4) AS \"Expected return, pct\" FROM sg WHERE signal IN ('ENTER', 'REVERSE')")
def signal_clean_view(t):
    return signals(t).where(F.col("signal").isin("ENTER", "REVERSE")).select(F.col("event_id").alias("Event"), F.col("signal").alias("Signal"), F.round(F.col("mean") * 100, 4).alias("Expected return, pct"))


@query("top_notional", "SELECT event_id, notional FROM {trades} ORDER BY notional DESC, event_id LIMIT 20")
def top_notional(t):
    """The 20 largest trades: a report."""
    return t.trades.select("event_id", "notional").orderBy(F.col("notional").desc(), "event_id").limit(20)


@query(
    "self_impact_pnl",
    """WITH d AS (SELECT event_id, cash, ratio * acq_price AS stock, pi_cash, least(5e-2, (event_id % 64) / 1024e0) AS q, CASE WHEN event_id % 2 = 0 THEN 1e0 ELSE 0e0 END AS own, 5e-1 AS seller, f_cash, cash * 95e-2 AS m FROM {deals} WHERE f_cash IS NOT NULL AND pi_cash IS NOT NULL),
f AS (SELECT *, greatest(1e-6, least(1 - 1e-6, greatest(0e0, least(1e0, f_cash + q * (own - seller))))) AS ff FROM d),
p AS (SELECT *, CASE WHEN own = 1 THEN least(1e0, pi_cash / ff) * cash + (1 - least(1e0, pi_cash / ff)) * stock ELSE least(1e0, (1 - pi_cash) / (1 - ff)) * stock + (1 - least(1e0, (1 - pi_cash) / (1 - ff))) * cash END AS value FROM f)
SELECT event_id, ff AS impacted_share, value / m - 1 AS realized_return, q * 1e6 * (value - m) AS pnl FROM p""",
)
def self_impact_pnl(t):
    from ..operators import payoff as P

    k = F.col("event_id")
    q, own = F.least(F.lit(0.05), (k % 64) / 1024.0), F.when(k % 2 == 0, 1.0).otherwise(0.0)
    f = F.greatest(F.lit(P.CLIP), F.least(F.lit(1 - P.CLIP), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("f_cash") + q * (own - 0.5)))))
    d = t.deals.where("f_cash IS NOT NULL AND pi_cash IS NOT NULL").withColumns({"ff": f, "q": q, "own": own, "m": F.col("cash") * 0.95})
    made = P.prorate(F.col("ff"), F.col("pi_cash"), F.col("cash"), F.col("ratio") * F.col("acq_price"))
    d = d.withColumn("value", F.when(F.col("own") == 1, made["cash_holder"]).otherwise(made["stock_holder"]))
    return d.select("event_id", F.col("ff").alias("impacted_share"), (F.col("value") / F.col("m") - 1).alias("realized_return"), (F.col("q") * 1e6 * (F.col("value") - F.col("m"))).alias("pnl"))


@query(
    "strategy_summary",
    """SELECT count(*) AS priced, count(*) FILTER (signal = 'ENTER') AS enter, count(*) FILTER (signal = 'REVERSE') AS reverse, count(*) FILTER (signal = 'REVIEW') AS review, count(*) FILTER (starts_with(signal, 'PASS')) AS passed,
  sum(notional) FILTER (signal IN ('ENTER', 'REVERSE')) AS notional, count(realized_return) AS "realized.covered", round(avg(realized_return), 9) AS "realized.mean", round(corr(expected_return, realized_return), 8) AS "realized.correlation" FROM {trades}""",
)
def strategy_summary(t):
    """The nested summary, flattened to dotted names."""
    s, r = F.col("signal"), F.col("realized_return")
    one = t.trades.agg(
        F.count(F.lit(1)).alias("priced"),
        F.count_if(s == "ENTER").alias("enter"),
        F.count_if(s == "REVERSE").alias("reverse"),
        F.count_if(s == "REVIEW").alias("review"),
        F.count_if(s.startswith("PASS")).alias("passed"),
        F.sum(F.when(s.isin("ENTER", "REVERSE"), F.col("notional"))).alias("notional"),
        F.struct(F.count(r).alias("covered"), F.round(F.avg(r), 9).alias("mean"), F.round(F.corr(F.when(r.isNotNull(), F.col("expected_return")), r), 8).alias("correlation")).alias("realized"),
    )
    return flattened(one)


def flattened(df, sep: str = "."):
    """Nested structs as columns with dotted names."""
    from pyspark.sql import types as T

    def walk(fields, path):
        for f in fields:
            here = [*path, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from walk(f.dataType.fields, here)
            else:
                yield F.col(".".join(f"`{x}`" for x in here)).alias(sep.join(here))

    return df.select(*walk(df.schema.fields, []))
