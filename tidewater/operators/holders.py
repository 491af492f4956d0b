"""The holder model: a grid of two parameters fitted to the elections before each event, in windows instead of refits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .capacity import CapacityConfig
from .cuts import cut
from .payoff import EPS


def labelled_before(df: DataFrame, label: str, order: str) -> DataFrame:
    """How many labelled events come before each: counts by block of order, then within the block, so that no task counts them all."""
    width = 1024
    block = F.floor(F.col(order) / width)
    sums = df.groupBy(block.alias("_b")).agg(F.count(label).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.count(label).over(Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_b", block).join(before, "_b").withColumn("labelled", F.col("_before") + within).drop("_b", "_before")


def panel(deals: DataFrame) -> DataFrame:
    """The holder panel of all deals with a known cash pool, as the derived table holders has it of the first ones; pos counts by date, then within
    the date, so that no task counts them all."""
    d = deals.where("pi_cash IS NOT NULL")
    sums = d.groupBy("announce_date").agg(F.count(F.lit(1)).alias("_n"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(F.col("announce_date").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("announce_date").orderBy("event_id"))
    d = d.withColumn("_within", within).alias("d").join(before.alias("b"), F.col("d.announce_date").eqNullSafe(F.col("b.announce_date"))).select("d.*", "_before")
    return d.withColumn("pos", F.col("_before") + F.col("_within")).drop("_before", "_within").selectExpr(
        "*",
        "(party % 32) / 64D AS passive",
        "CASE WHEN payment_type LIKE '1%' THEN 'cash' WHEN payment_type LIKE '2%' THEN 'stock' ELSE 'mixed' END AS default_rule",
        "ratio * acq_price AS stock",
        "cash * (0.9D + (event_id % 13) / 64D) AS target_price",
        "CASE WHEN event_id % 2 = 0 THEN 0.65D ELSE 1D END AS weight",
    )


def grid_errors(rows: pa.Table, cfg: CapacityConfig) -> np.ndarray:
    """The weighted squared error of predicted_votes() for each row at each point of the grid, by p and then q; NaN where a term is missing."""
    of = lambda c: rows[c].cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None]
    passive, cash, stock, target = (of(c) for c in ("passive", "cash", "stock", "target_price"))
    rule = rows["default_rule"].to_numpy(zero_copy_only=False)[:, None]
    steps = np.arange(cfg.grid) / float(cfg.grid - 1)
    p, q = np.repeat(steps, cfg.grid)[None, :], np.tile(steps, cfg.grid)[None, :]
    cash_gain, stock_gain = cash - target, stock - target
    leaves = (cash_gain < 0) & (stock_gain < 0)
    by_stock = ~leaves & (stock_gain >= cash_gain)
    by_cash = ~leaves & ~by_stock
    rational = np.maximum(0.0, np.minimum(q, 1 - passive))
    irrational = np.maximum(0.0, 1 - passive - rational)
    rest = passive + irrational
    with np.errstate(divide="ignore", invalid="ignore"):
        passive_now = np.where(leaves & (rest > EPS), passive + rational * passive / rest, passive)
        irrational_now = np.where(leaves, np.where(rest > EPS, irrational + rational * irrational / rest, 1.0), irrational)
        rational_now = np.where(leaves, 0.0, rational)
        by_default = np.where(rule == "cash", 1.0, np.where(rule == "stock", 0.0, 0.5))
        for_cash = irrational_now * p + passive_now * by_default + np.where(by_cash, rational_now, 0.0)
        total = for_cash + (irrational_now * (1 - p) + passive_now * (1 - by_default) + np.where(by_stock, rational_now, 0.0))
        miss = of("f_cash") - np.where(total > EPS, for_cash / total, for_cash)
    return of("weight") * miss * miss


def _block_fits(rows: pa.Table, block: int, own: int, cfg: CapacityConfig) -> pa.Table:
    """The fits of one block: for each count of labelled events in it the best point of the grid over the window before it."""
    at = rows["labelled"].to_numpy()
    low, high = own * block, min(int(at.max()) + 1, (own + 1) * block - 1)
    wanted, base = max(0, high - low + 1), low - cfg.rolling_events
    within = np.flatnonzero((at >= base) & (at < high))
    err = grid_errors(rows.take(pa.array(within)), cfg)
    known = ~np.isnan(err).any(axis=1)
    every = np.zeros((wanted + cfg.rolling_events, cfg.grid**2))
    one = np.zeros(len(every), np.int64)
    every[at[within][known] - base], one[at[within][known] - base] = err[known], 1
    # oldest first, each window on its own: no digits of one come from another's
    sse, n = np.zeros((wanted, every.shape[1])), np.zeros(wanted, np.int64)
    for k in range(cfg.rolling_events):
        sse += every[k : k + wanted]
        n += one[k : k + wanted]
    best = np.argmin(np.round(sse, 12), axis=1)
    return pa.table({"labelled": np.arange(low, low + wanted), "_p": best // cfg.grid, "_q": best % cfg.grid, "sse": sse[np.arange(wanted), best], "n": n})


def rolling_fit(panel: DataFrame, cfg: CapacityConfig, block: int = 512) -> DataFrame:
    """(event_id, p_hat, q_hat, fit_n, sse): for each event the point of the grid with the least weighted squared error over the last labelled
    events before it; of equal ones the smaller p, then q; the defaults where there are too few. panel: event_id, pos, f_cash (null: unlabelled),
    weight, passive, default_rule, cash, stock, target_price.

    Events with as many labelled ones before them share a fit, so there is one for each labelled event. Fits are made in blocks of so many, each
    with the labelled events before it that its first ones look back on; errors on the grid are arrays in a block's task and never rows.
    """
    terms = ["f_cash", "weight", "passive", "default_rule", "cash", "stock", "target_price"]
    counted = labelled_before(cut(panel.select("event_id", "pos", *terms)), "f_cash", "pos")
    reach = F.sequence(F.floor(F.col("labelled") / block), F.floor((F.col("labelled") + cfg.rolling_events) / block))
    dealt = counted.where("f_cash IS NOT NULL").select(F.col("labelled").cast("long").alias("labelled"), *terms, F.explode(reach).alias("_b"))

    def fits(key, table):
        return _block_fits(table, block, key[0].as_py(), cfg)

    best = dealt.groupBy("_b").applyInArrow(fits, "labelled long, _p long, _q long, sse double, n long")
    enough = F.coalesce(F.col("n"), F.lit(0)) >= cfg.least_events
    return counted.select("event_id", "labelled").join(best, "labelled", "left").select(
        "event_id",
        F.when(enough, F.col("_p") / float(cfg.grid - 1)).otherwise(cfg.default_p).alias("p_hat"),
        F.when(enough, F.col("_q") / float(cfg.grid - 1)).otherwise(cfg.default_q).alias("q_hat"),
        F.when(enough, F.col("n")).otherwise(0).alias("fit_n"),
        F.when(enough, F.round("sse", 9)).alias("sse"),
    )
