"""Queries of price history and strategy returns."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators.running import running
from ..operators import history as H
from .registry import query

_SIDES_SQL = "d0 AS (SELECT event_id, price_date, max(price) FILTER (side = 'target') AS tp0, max(price) FILTER (side = 'acquirer') AS ap0 FROM {prices} GROUP BY ALL), d1 AS (SELECT event_id, price_date, last_value(tp0 IGNORE NULLS) OVER w AS tp, last_value(ap0 IGNORE NULLS) OVER w AS ap FROM d0 WINDOW w AS (PARTITION BY event_id ORDER BY price_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
PATH_SQL = f"""{_SIDES_SQL},
tr AS (SELECT event_id, announce_date + 3 AS start, CASE WHEN event_id % 13 = 0 THEN announce_date + 3 WHEN event_id % 6 <> 0 THEN close_date END AS stop, 25e-2 + (event_id % 5) / 8e0 AS hedge, CASE WHEN event_id % 3 = 1 THEN -1e0 ELSE 1e0 END AS sgn, CASE WHEN event_id % 4 <> 0 THEN (event_id % 11 - 4) / 1e2 END AS total,
  CASE WHEN event_id % 7 <> 0 THEN 1e3 * (1 + event_id % 19) ELSE 0e0 END AS notional FROM {{spans}}),
d2 AS (SELECT d1.event_id, price_date, total, sgn * (tp - hedge * ap) AS v FROM d1 JOIN tr ON tr.event_id = d1.event_id WHERE price_date >= start AND (stop IS NULL OR price_date <= stop) AND tp IS NOT NULL AND ap IS NOT NULL),
d3 AS (SELECT *, coalesce((v - lag(v) OVER (PARTITION BY event_id ORDER BY price_date)) / 1e2, 0e0) AS r, count(*) OVER (PARTITION BY event_id) AS days, row_number() OVER (PARTITION BY event_id ORDER BY price_date) AS nth FROM d2),
pa AS (SELECT event_id, price_date AS date, CASE WHEN nth = days AND total IS NOT NULL THEN r + total - sum(r) OVER (PARTITION BY event_id) ELSE r END AS daily_return FROM d3 WHERE days >= 2)"""


def trades(t):
    k = F.col("event_id")
    return t.spans.select(
        "event_id",
        F.date_add("announce_date", 3).alias("start"),
        F.when(k % 13 == 0, F.date_add("announce_date", 3)).when(k % 6 != 0, F.col("close_date")).alias("stop"),
        F.lit(100.0).alias("entry"),
        (0.25 + (k % 5) / 8.0).alias("hedge"),
        F.when(k % 3 == 1, -1.0).otherwise(1.0).alias("sign"),
        F.when(k % 4 != 0, (k % 11 - 4) / 100.0).alias("total"),
        F.when(k % 7 != 0, 1000.0 * (1 + k % 19)).otherwise(0.0).alias("notional"),
    )


def path(t):
    return H.hedged_path(t.prices, trades(t).drop("notional"))


def paid_path(t):
    return path(t).join(trades(t).select("event_id", "notional"), "event_id")


@query("ffill_path", f"WITH {_SIDES_SQL} SELECT event_id, price_date, tp AS target_price, ap AS acquirer_price FROM d1")
def ffill_path(t):
    return H.both_sides(t.prices)


@query("hedge_path", f"WITH {PATH_SQL} SELECT event_id, date, round(daily_return, 9) + 0e0 AS daily_return FROM pa")
def hedge_path(t):
    return path(t).select("event_id", "date", (F.round("daily_return", 9) + 0.0).alias("daily_return"))


@query("hedge_skipped", f"WITH {PATH_SQL} SELECT event_id, 'fewer_than_two_days' AS reason FROM tr WHERE event_id NOT IN (SELECT event_id FROM pa)")
def hedge_skipped(t):
    return H.skipped_trades(path(t), trades(t))


@query("settlement_reconcile", f"WITH {PATH_SQL} SELECT tr.event_id, tr.total, round(sum(daily_return), 9) + 0e0 AS path_sum, round(sum(daily_return) - tr.total, 9) + 0e0 AS gap FROM pa JOIN tr ON tr.event_id = pa.event_id WHERE tr.total IS NOT NULL GROUP BY tr.event_id, tr.total")
def settlement_reconcile(t):
    j = path(t).join(trades(t).select("event_id", "total").where("total is not null"), "event_id").groupBy("event_id", "total").agg(F.sum("daily_return").alias("s"))
    return j.select("event_id", "total", (F.round("s", 9) + 0.0).alias("path_sum"), (F.round(F.col("s") - F.col("total"), 9) + 0.0).alias("gap"))


PORT_SQL = f"""{PATH_SQL}, pp AS (SELECT pa.*, tr.notional FROM pa JOIN tr ON tr.event_id = pa.event_id),
po AS (SELECT date, count(*) AS active_trade_count, count(*) FILTER (notional > 0) AS active_capacity_trade_count, coalesce(sum(notional) FILTER (notional > 0), 0e0) AS active_notional, round(avg(daily_return), 9) AS equal_weight_return,
  round(sum(notional * daily_return) FILTER (notional > 0) / nullif(sum(notional) FILTER (notional > 0), 0e0), 9) AS capacity_weighted_return FROM pp GROUP BY date)"""


def daily(t):
    p = H.portfolio(paid_path(t), ["date"])
    return p.withColumns({c: F.round(c, 9) for c in ("equal_weight_return", "capacity_weighted_return")})


@query("portfolio_daily", f"WITH {PORT_SQL} SELECT * FROM po")
def portfolio_daily(t):
    return daily(t)


@query(
    "portfolio_scopes",
    f"WITH {PORT_SQL}, sc AS (SELECT 'all_tradable' AS scope, * FROM pp UNION ALL SELECT 'completion_only', * FROM pp WHERE event_id % 4 <> 0) SELECT scope, date, count(*) AS active_trade_count, round(avg(daily_return), 9) AS equal_weight_return FROM sc GROUP BY ALL",
)
def portfolio_scopes(t):
    p = paid_path(t)
    both = p.withColumn("scope", F.explode(F.when(F.col("event_id") % 4 != 0, F.array(F.lit("all_tradable"), F.lit("completion_only"))).otherwise(F.array(F.lit("all_tradable")))))
    return both.groupBy("scope", "date").agg(F.count(F.lit(1)).alias("active_trade_count"), F.round(F.avg("daily_return"), 9).alias("equal_weight_return"))


@query(
    "bday_calendar",
    f"""WITH {PORT_SQL}, c AS (SELECT CAST(unnest(generate_series((SELECT min(date) FROM po), (SELECT max(date) FROM po), INTERVAL 1 DAY)) AS DATE) AS date)
SELECT c.date, coalesce(active_trade_count, 0) AS active_trade_count, coalesce(equal_weight_return, 0e0) AS equal_weight_return FROM c LEFT JOIN po ON po.date = c.date WHERE isodow(c.date) <= 5""",
)
def bday_calendar(t):
    return H.business_days(daily(t), ["active_trade_count", "equal_weight_return"])


@query("drawdown", f"WITH {PATH_SQL}, c AS (SELECT event_id, date, sum(daily_return) OVER (PARTITION BY event_id ORDER BY date) AS s FROM pa) SELECT event_id, date, round(s, 8) + 0e0 AS cumulative, round(max(s) OVER (PARTITION BY event_id ORDER BY date), 8) + 0e0 AS peak, round(s - max(s) OVER (PARTITION BY event_id ORDER BY date), 8) + 0e0 AS drawdown FROM c")
def drawdown(t):
    d = H.running(path(t), ["event_id"], ["date"], "daily_return")
    return d.select("event_id", "date", *[(F.round(c, 8) + 0.0).alias(c) for c in ("cumulative", "peak", "drawdown")])


@query(
    "annualized_stats",
    f"""WITH {PORT_SQL} SELECT count(*) AS day_count, round(avg(r), 8) AS mean_daily, round(stddev_samp(r) * sqrt(252), 8) AS annual_vol, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe,
  round(avg(r) / sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)) * sqrt(252), 6) AS sortino, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS positive_rate FROM (SELECT equal_weight_return AS r FROM po)""",
)
def annualized_stats(t):
    a = daily(t).agg(*[c.alias(k) for k, c in H.annualised(F.col("equal_weight_return")).items()])
    return a.withColumns({k: F.round(k, n) for k, n in (("mean_daily", 8), ("annual_vol", 8), ("sharpe", 6), ("sortino", 6))})


@query(
    "risk_block",
    """SELECT signal, count(r) AS n, round(avg(r), 9) AS mean, round(median(r), 9) AS median, round(stddev_samp(r), 9) AS std, min(r) AS least, max(r) AS most, count(*) FILTER (r < 0) AS negatives, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS hit_rate,
  round(avg(r) / stddev_samp(r), 6) AS mean_over_std, round(avg(r) / nullif(sqrt(avg(CASE WHEN r < 0 THEN r * r ELSE 0 END)), 0e0), 6) AS sortino FROM (SELECT signal, realized_return AS r FROM {trades} WHERE realized_return IS NOT NULL) GROUP BY signal""",
)
def risk_block(t):
    g = t.in_order.trades.where("realized_return is not null").groupBy("signal").agg(*[c.alias(k) for k, c in H.risk_block(F.col("realized_return")).items()])
    return g.withColumns({k: F.round(k, n) for k, n in (("mean", 9), ("median", 9), ("std", 9), ("mean_over_std", 6), ("sortino", 6))})


@query("ex_largest", "SELECT signal, count(*) AS n, round(avg(realized_return), 9) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY signal ORDER BY realized_return DESC, event_id) AS r FROM {trades} WHERE realized_return IS NOT NULL) WHERE r > 1 GROUP BY signal")
def ex_largest(t):
    w = Window.partitionBy("signal").orderBy(F.col("realized_return").desc(), "event_id")
    d = t.trades.where("realized_return is not null").withColumn("r", F.row_number().over(w)).where("r > 1")
    return d.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("realized_return"), 9).alias("mean"))


@query(
    "event_curve",
    f"""WITH {PORT_SQL}, e AS (SELECT event_id, max(date) AS close_date, min_by(notional, date) AS notional, sum(daily_return) AS r FROM pp GROUP BY event_id)
SELECT row_number() OVER (ORDER BY close_date, event_id) AS event_number, event_id, close_date, notional, round(r, 9) + 0e0 AS event_return, round(sum(r) OVER (ORDER BY close_date, event_id), 8) + 0e0 AS cumulative FROM e""",
)
def event_curve(t):
    e = paid_path(t).groupBy("event_id").agg(F.max("date").alias("close_date"), F.min_by("notional", "date").alias("notional"), F.sum("daily_return").alias("r"))
    e = running(e, [F.col("close_date"), F.col("event_id")], {"before": "r"})
    return e.select((F.col("nth") + 1).cast("long").alias("event_number"), "event_id", "close_date", "notional", (F.round("r", 9) + 0.0).alias("event_return"), (F.round(F.col("before") + F.col("r"), 8) + 0.0).alias("cumulative"))


@query(
    "adv20",
    """SELECT event_id, side, price_date, adv20, adv60, rows_seen FROM (SELECT p.event_id, p.side, p.price_date, round(avg(volume) OVER a, 9) AS adv20, round(avg(volume) OVER b, 9) AS adv60, count(*) OVER (PARTITION BY p.event_id, p.side ORDER BY price_date) AS rows_seen,
  row_number() OVER (PARTITION BY p.event_id, p.side ORDER BY price_date DESC) AS r FROM {prices} p JOIN {spans} s ON s.event_id = p.event_id WHERE price_date <= close_date
  WINDOW a AS (PARTITION BY p.event_id, p.side ORDER BY price_date ROWS 19 PRECEDING), b AS (PARTITION BY p.event_id, p.side ORDER BY price_date ROWS 59 PRECEDING)) WHERE r = 1""",
)
def adv20(t):
    w = Window.partitionBy("event_id", "side").orderBy("price_date")
    d = t.prices.join(t.spans.select("event_id", "close_date"), "event_id").where("price_date <= close_date")
    d = d.withColumns({"adv20": F.round(F.avg("volume").over(w.rowsBetween(-19, 0)), 9), "adv60": F.round(F.avg("volume").over(w.rowsBetween(-59, 0)), 9), "rows_seen": F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return A.best_row(d, ["event_id", "side"], [F.col("price_date").desc()]).select("event_id", "side", "price_date", "adv20", "adv60", "rows_seen")


@query("ratio_trailing20", "SELECT event_id, side, price_date, volume * 1e0 / nullif(volume + 3, 0) AS ratio, round(avg(volume * 1e0 / nullif(volume + 3, 0)) OVER (PARTITION BY event_id, side ORDER BY price_date ROWS 19 PRECEDING), 9) AS ratio_20d FROM {prices}")
def ratio_trailing20(t):
    w = Window.partitionBy("event_id", "side").orderBy("price_date").rowsBetween(-19, 0)
    d = t.prices.withColumn("ratio", F.col("volume") / F.nullif(F.col("volume") + 3, F.lit(0)))
    return d.select("event_id", "side", "price_date", "ratio", F.round(F.avg("ratio").over(w), 9).alias("ratio_20d"))


@query("active_notional", f"WITH {PORT_SQL} SELECT event_id, date, notional, sum(notional) OVER (PARTITION BY date) AS day_notional, round(notional / nullif(sum(notional) OVER (PARTITION BY date), 0e0), 9) AS share FROM pp")
def active_notional(t):
    """A day's trades may be many, so they meet in no one task: sums by day, a row each, go to the trades."""
    path = paid_path(t).select("event_id", "date", "notional")
    days = path.groupBy("date").agg(F.sum("notional").alias("day_notional"))
    return path.join(F.broadcast(days), "date").select("event_id", "date", "notional", "day_notional", F.round(F.col("notional") / F.nullif(F.col("day_notional"), F.lit(0.0)), 9).alias("share"))
