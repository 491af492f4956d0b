"""Daily paths of hedged trades, portfolios and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAYS = 252


def both_sides(prices: DataFrame, a: str = "target", b: str = "acquirer") -> DataFrame:
    """One row for each event and day with both sides' prices, a side's last one carried forward over days without."""
    one = lambda s: F.max(F.when(F.col("side") == s, F.col("price"))).alias(f"{s}_price")
    days = prices.where(F.col("side").isin(a, b)).groupBy("event_id", "price_date").agg(one(a), one(b))
    so_far = Window.partitionBy("event_id").orderBy("price_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return days.withColumns({f"{s}_price": F.last(f"{s}_price", ignorenulls=True).over(so_far) for s in (a, b)})


def hedged_path(prices: DataFrame, trades: DataFrame) -> DataFrame:
    """Daily returns of trades (event_id, start, stop, entry, hedge, sign, total; total null: not settled): the change of the target less the
    hedge's, over the entry price; carried prices first, then the days from start to stop. On the last day of a settled trade what is missing
    to its total is added. Trades with fewer than two days are left out; skipped_trades lists them."""
    own = Window.partitionBy("event_id").orderBy("price_date")
    days = both_sides(prices).join(trades, "event_id").where((F.col("price_date") >= F.col("start")) & (F.col("stop").isNull() | (F.col("price_date") <= F.col("stop"))) & F.col("target_price").isNotNull() & F.col("acquirer_price").isNotNull())
    value = F.col("sign") * (F.col("target_price") - F.col("hedge") * F.col("acquirer_price"))
    days = days.withColumn("_v", value).withColumns({"r": F.coalesce((F.col("_v") - F.lag("_v").over(own)) / F.col("entry"), F.lit(0.0)), "days": F.count(F.lit(1)).over(Window.partitionBy("event_id")), "nth": F.row_number().over(own)})
    gap = F.col("total") - F.sum("r").over(Window.partitionBy("event_id"))
    settled = F.when((F.col("nth") == F.col("days")) & F.col("total").isNotNull(), F.col("r") + gap).otherwise(F.col("r"))
    return days.where("days >= 2").select("event_id", F.col("price_date").alias("date"), settled.alias("daily_return"))


def skipped_trades(path: DataFrame, trades: DataFrame) -> DataFrame:
    return trades.join(path.select("event_id").distinct(), "event_id", "left_anti").select("event_id", F.lit("fewer_than_two_days").alias("reason"))


def portfolio(path: DataFrame, by: list[str]) -> DataFrame:
    """Per day: trades, those with a notional, their notional, the equal and the notional-weighted mean return. path: date, daily_return, notional."""
    paid = F.col("notional") > 0
    money = F.sum(F.when(paid, F.col("notional")))
    return path.groupBy(*by).agg(
        F.count(F.lit(1)).alias("active_trade_count"),
        F.count_if(paid).alias("active_capacity_trade_count"),
        F.coalesce(money, F.lit(0.0)).alias("active_notional"),
        F.avg("daily_return").alias("equal_weight_return"),
        (F.sum(F.when(paid, F.col("notional") * F.col("daily_return"))) / F.nullif(money, F.lit(0.0))).alias("capacity_weighted_return"),
    )


def business_days(daily: DataFrame, values: list[str]) -> DataFrame:
    """Every weekday from the first to the last date, 0 where nothing is; dates on weekends are left out."""
    span = daily.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date")).where(F.weekday("date") < 5)
    return days.join(daily.select("date", *values), "date", "left").na.fill(0, values)


def running(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Adds cumulative, peak (the first value at the start, not 0) and drawdown."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("cumulative", F.sum(value).over(w))
    return d.withColumn("peak", F.max("cumulative").over(w)).withColumn("drawdown", F.col("cumulative") - F.col("peak"))


def annualised(r: Column) -> dict[str, Column]:
    """Aggregates of daily returns: the downside deviation is the root of the mean of squares below 0 over all days."""
    down = F.sqrt(F.avg(F.when(r < 0, r * r).when(r.isNotNull(), 0.0)))
    return {
        "day_count": F.count(r),
        "mean_daily": F.avg(r),
        "annual_vol": F.stddev_samp(r) * F.sqrt(F.lit(float(DAYS))),
        "sharpe": F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(DAYS))),
        "sortino": F.avg(r) / F.nullif(down, F.lit(0.0)) * F.sqrt(F.lit(float(DAYS))),
        "positive_rate": F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)),
    }


def risk_block(r: Column) -> dict[str, Column]:
    """Aggregates of one cohort's returns; Sortino is null without a loss."""
    down = F.sqrt(F.avg(F.when(r < 0, r * r).when(r.isNotNull(), 0.0)))
    return {
        "n": F.count(r),
        "mean": F.avg(r),
        "median": F.median(r),
        "std": F.stddev_samp(r),
        "least": F.min(r),
        "most": F.max(r),
        "negatives": F.count_if(r < 0),
        "hit_rate": F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)),
        "mean_over_std": F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)),
        "sortino": F.avg(r) / F.nullif(down, F.lit(0.0)),
    }
