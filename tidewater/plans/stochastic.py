"""Queries of sampled and of exact return distributions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators as E
from ..operators import sampling as S
from ..operators.cuts import cut
from .outcome import outcome_probabilities
from .panel import mc_ready
from .registry import query

DRAWS = 20_000


def fitted(t):
    """Each deal with the terms of its payoff, the leave-one-out fit of its demand and the outcome model's probabilities."""
    # read three times; its orders and lines are joined and summed once
    d = cut(mc_ready(t.deals).select("event_id", "deal_type", "f_cash", "cash", F.expr("ratio * acq_price").alias("stock"), "pi_cash", F.expr("cash * 95e-2").alias("m")))
    j = E.beta_leave_one_out(d, ["deal_type"], "f_cash").select("event_id", "a", "b", "cash", "stock", "pi_cash", "m")
    j = j.join(outcome_probabilities(t, d.select("event_id")).select("event_id", "p_completed", "p_terminated"), "event_id", "left")
    # few bytes but much work: by a fixed count, which is not coalesced
    return j.repartition(4 * t.spark.sparkContext.defaultParallelism, "event_id")


@query("mc_summary")
def mc_summary(t, n=DRAWS):
    return S.deal_summaries(fitted(t), n, 11)


@query("portfolio_mc")
def portfolio_mc(t, n=DRAWS):
    """Equal-weight means of all deals along each draw, and their summary."""
    paths = cut(S.mean_paths_inverted(fitted(t), n, 11))  # the summary reads them twice; they are drawn once
    return S.summary(paths.withColumn("book", F.lit("all")), ["book"], "r")


@query(
    "cvar_summary",
    """WITH q AS (SELECT deal_type, quantile_cont(x, 5e-2) AS p05, quantile_cont(x, 5e-1) AS p50, quantile_cont(x, 95e-2) AS p95, avg(x) AS mean, avg(CASE WHEN x < 0 THEN 1e0 ELSE 0e0 END) AS loss FROM (SELECT deal_type, acq_price * ratio / cash - 1 AS x FROM {deals}) GROUP BY deal_type)
SELECT q.deal_type, round(max(mean), 9) AS mean, round(max(p05), 9) AS p05, round(max(p50), 9) AS p50, round(max(p95), 9) AS p95, max(loss) AS loss_probability, round(avg(x), 9) AS cvar05 FROM q JOIN (SELECT deal_type, acq_price * ratio / cash - 1 AS x FROM {deals}) d ON d.deal_type = q.deal_type AND x <= p05 GROUP BY q.deal_type""",
)
def cvar_summary(t):
    """The empirical sample itself, which SQL can follow exactly."""
    s = S.summary(t.deals.select("deal_type", F.expr("acq_price * ratio / cash - 1").alias("x")), ["deal_type"], "x")
    return s.select("deal_type", *[F.round(c, 9).alias(c) for c in ("mean", "p05", "p50", "p95", "cvar05")], "loss_probability")


@query("conditioned_demand")
def conditioned_demand(t, n=DRAWS):
    """Demand given each deal's spread, with the slope's uncertainty: mean, percentiles and tail of the draws."""
    d = mc_ready(t.deals).withColumn("spread", F.expr("cash - ratio * acq_price"))
    slopes = E.logit_slope(d, ["deal_type"], "f_cash", "spread").select("deal_type", "intercept", "slope", "se_slope")
    fits = E.beta_leave_one_out(d.select("event_id", "deal_type", "f_cash", "spread"), ["deal_type"], "f_cash").join(F.broadcast(slopes), "deal_type", "left")  # a row for each type of deal
    return S.demand_summaries(fits.repartition(4 * t.spark.sparkContext.defaultParallelism, "event_id"), n, 13)
