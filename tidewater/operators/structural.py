"""The structural trade model: both elections of a deal with their costs and break scenarios, the choice and its gates, and what came of it; draws of it;
and its outcome model over the rows before each event."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .naive_bayes import MISSING, STATES
from .payoff import fill_rates
from .sampling import sorted_beta
from .trades import GOLDEN, stats_ascending, with_atoms

CHOICES = ("cash", "stock")


@dataclass(frozen=True)
class TradeConfig:
    notional: float = 1e6
    cost_bps: float = 5.0
    borrow_bps: float = 50.0
    terminated_loss: float = 0.25
    withdrawn_loss: float = 0.35
    least_alpha: float = 0.0
    least_p05: float = -math.inf
    most_loss_probability: float = 1.0
    hedge: str = "conversion_expected"
    concentration: float = 75.0
    least_alpha_beta: float = 0.25
    seed: int = 1729


def hedge_ratio(stock_fraction: Column, cfg: TradeConfig) -> Column:
    """Acquirer shares to be short for a target share."""
    if cfg.hedge == "conversion_expected":
        return F.greatest(F.lit(0.0), stock_fraction * F.coalesce("ratio", F.lit(0.0)))
    if cfg.hedge == "dollar_neutral":
        return F.when(F.col("entry_acq") > 0, F.greatest(F.lit(0.0), F.col("entry") / F.col("entry_acq"))).otherwise(0.0)
    return F.lit(0.0)


def total_cost(stock_fraction: Column, cfg: TradeConfig) -> Column:
    """Trading on both legs, half a spread of the target, a whole one of the short, and borrowing over the holding days."""
    short = hedge_ratio(stock_fraction, cfg) * F.col("entry_acq")
    fixed = F.col("entry") * (cfg.cost_bps / 1e4) + short * (cfg.cost_bps / 1e4)
    spreads = F.coalesce(0.5 * F.col("entry") * F.col("target_spread"), F.lit(0.0)) + F.coalesce(short * F.col("acq_spread"), F.lit(0.0))
    return fixed + spreads + short * (cfg.borrow_bps / 1e4) * F.col("days") / 365.0


def break_alpha(stock_fraction: Column, loss: float, cfg: TradeConfig) -> Column:
    return F.col("entry") * (1 - loss) - F.col("entry") - total_cost(stock_fraction, cfg)


def elections(df: DataFrame, cfg: TradeConfig, demand: str = "cash_demand", own: str = "own_share") -> DataFrame:
    """df with, for both choices, CHOICE_with_own (the demand of cash, own vote included), _cash_fill, _stock_fill, _cash_part, _stock_part, _gross, _cost, _net, _terminated, _withdrawn
    and _adjusted: the net alpha over the three outcomes. df: event_id, cash, stock, ratio, entry, entry_acq, cash_cap, stock_cap, cash_demand, own_share,
    target_spread, acq_spread, days, p_completed, p_terminated, p_withdrawn."""
    for c in CHOICES:
        cash = F.col(demand) * (1 - F.col(own)) + (F.col(own) if c == "cash" else 0.0)
        cash_fill, stock_fill = fill_rates(F.col(f"{c}_with_own"), 1 - F.col(f"{c}_with_own"), F.col("cash_cap"), F.col("stock_cap"))
        df = df.withColumn(f"{c}_with_own", cash).withColumns({f"{c}_cash_fill": cash_fill, f"{c}_stock_fill": stock_fill})
        part = F.col(f"{c}_{c}_fill")
        df = df.withColumns({f"{c}_cash_part": part if c == "cash" else 1 - part, f"{c}_stock_part": 1 - part if c == "cash" else part})
        stock_part = F.coalesce(F.col(f"{c}_stock_part"), F.lit(0.0))
        gross = F.col(f"{c}_cash_part") * F.col("cash") + F.col(f"{c}_stock_part") * F.col("stock") - F.col("entry")
        df = df.withColumns({f"{c}_gross": gross, f"{c}_cost": total_cost(stock_part, cfg), f"{c}_terminated": break_alpha(stock_part, cfg.terminated_loss, cfg), f"{c}_withdrawn": break_alpha(stock_part, cfg.withdrawn_loss, cfg)})
        net = F.col(f"{c}_gross") - F.col(f"{c}_cost")
        df = df.withColumn(f"{c}_net", net)
        df = df.withColumn(f"{c}_adjusted", F.col("p_completed") * net + F.col("p_terminated") * F.col(f"{c}_terminated") + F.col("p_withdrawn") * F.col(f"{c}_withdrawn"))
    return df


def decide(df: DataFrame, cfg: TradeConfig) -> DataFrame:
    """elections() with choice, value, signal and reason. A choice is worth its mean over draws where df has CHOICE_mean, else its adjusted alpha; of equal ones
    cash. Then the gates, in order: both offers lose uncapped, too little value, too low a fifth percentile, too likely a loss (CHOICE_p05, CHOICE_loss)."""
    low = F.lit(-math.inf)
    value = {c: F.coalesce(F.col(f"{c}_mean"), F.col(f"{c}_adjusted")) if f"{c}_mean" in df.columns else F.col(f"{c}_adjusted") for c in CHOICES}
    cash = F.coalesce(value["cash"], low) >= F.coalesce(value["stock"], low)
    pick = lambda name: F.when(cash, F.col(f"cash_{name}")).otherwise(F.col(f"stock_{name}")) if f"cash_{name}" in df.columns else F.lit(None).cast("double")
    df = df.withColumns({"choice": F.when(cash, "cash").otherwise("stock"), "value": F.when(cash, value["cash"]).otherwise(value["stock"]), "p05": pick("p05"), "loss": pick("loss")})
    nine = lambda c: F.round(c, 9)  # noqa: E731 - a broken state's loss may be the floor itself
    reason = (
        F.when((F.col("cash") < F.col("entry")) & (F.col("stock") < F.col("entry")), "both_uncapped_evs_negative_rational_exit")
        .when(F.col("value").isNull() | (nine("value") < cfg.least_alpha), "risk_adjusted_alpha_below_threshold")
        .when(nine("p05") < cfg.least_p05, "mc_p05_alpha_below_threshold")
        .when(F.col("loss") > cfg.most_loss_probability, "mc_loss_probability_above_threshold")
        .otherwise("risk_adjusted_alpha_positive")
    )
    df = df.withColumn("reason", reason)
    return df.withColumn("signal", F.when(F.col("reason") == "risk_adjusted_alpha_positive", F.concat(F.lit("trade_"), F.col("choice"), F.lit("_election"))).otherwise("no_trade"))


def judged(df: DataFrame, cfg: TradeConfig) -> DataFrame:
    """decide() with what came of it: pnl of the executed and of the better election, from the observed demand (observed, null: the predicted one stands in and the
    result is a proxy) or from the break that happened (outcome), and the flags of missed and of losing trades."""
    broke = F.coalesce("outcome", F.lit("")).isin("terminated", "withdrawn")
    labelled = broke | F.col("observed").isNotNull()
    trades = F.col("signal") != "no_trade"
    demand, own = F.coalesce("observed", "cash_demand"), F.when(trades, F.col("own_share")).otherwise(0.0)
    shares = cfg.notional / F.col("entry")
    for c in CHOICES:
        cash = demand * (1 - own) + (own if c == "cash" else 0.0)
        cash_fill, stock_fill = fill_rates(cash, 1 - cash, F.col("cash_cap"), F.col("stock_cap"))
        cash_part = cash_fill if c == "cash" else 1 - stock_fill
        stock_part = F.coalesce(F.col(f"{c}_stock_part"), F.lit(0.0))
        short = shares * hedge_ratio(stock_part, cfg) if cfg.hedge != "dollar_neutral" else cfg.notional / F.col("entry_acq")
        close = shares * cash_part * F.col("cash") + shares * (1 - cash_part) * F.col("ratio") * F.col("exit_acq") - cfg.notional + short * (F.col("entry_acq") - F.col("exit_acq")) - shares * F.col(f"{c}_cost")
        ended = F.when(F.col("outcome") == "terminated", F.col(f"{c}_terminated")).otherwise(F.col(f"{c}_withdrawn"))
        df = df.withColumn(f"{c}_pnl", F.when(broke, shares * ended).otherwise(close))
    low = F.lit(-math.inf)
    best = F.greatest(F.coalesce("cash_pnl", low), F.coalesce("stock_pnl", low))
    best = F.when(best > low, best)
    done = F.when(trades, F.when(F.col("choice") == "cash", F.col("cash_pnl")).otherwise(F.col("stock_pnl")))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return df.withColumns({
        "labelled": labelled, "best_pnl": best, "executed_pnl": done,
        "missed": flag(labelled & ~trades & (best > 0)), "lost": flag(labelled & trades & (done < 0)),
        "proxy_missed": flag(~labelled & ~trades & (best > 0)), "proxy_lost": flag(~labelled & trades & (done < 0)),
    })


def backtest_summary(df: DataFrame) -> DataFrame:
    """One row of judged()."""
    trades, pnl = F.col("signal") != "no_trade", F.when(F.col("labelled"), F.col("executed_pnl"))
    return df.agg(
        F.count(F.lit(1)).alias("events"), F.count_if(trades).alias("trades"), F.count_if(F.col("labelled")).alias("labelled"), F.sum(pnl).alias("realized_pnl"), F.avg(pnl).alias("mean_pnl"),
        F.avg(F.when(pnl.isNotNull(), (pnl > 0).cast("double"))).alias("hit_rate"), F.count_if("missed").alias("missed"), F.count_if("lost").alias("lost"), F.count_if("proxy_missed").alias("proxy_missed"), F.count_if("proxy_lost").alias("proxy_lost"),
    )


def stable_seed(seed: int, *parts: object) -> int:
    return int.from_bytes(hashlib.sha256("|".join(map(str, (seed, *parts))).encode()).digest()[:8], "big")


#: What a choice's draws leave: of net alpha, of gross alpha and the cash fill where the deal completes.
DRAWN = ("mean", "p05", "p50", "p95", "cvar05", "loss", "gross_mean", "cash_fill_mean")


def demand_draws(mean: float, event_id: object, choice: str, cfg: TradeConfig, draws: int, even: bool) -> tuple[np.ndarray, np.ndarray]:
    """Uniforms for the outcome, and demand around a mean: of a Beta, from a generator seeded by event and choice; or, even, mid-points of an interval with the Beta's
    mean and variance, kept from 0 and 1, which SQL can follow."""
    if even:
        k = np.arange(draws)
        wide = math.sqrt(3 * mean * (1 - mean) / (cfg.concentration + 1))
        return (k + 1) * GOLDEN % 1, np.clip(mean + wide * (2 * (k + 0.5) / draws - 1), 1e-6, 1 - 1e-6)
    rng = np.random.default_rng(stable_seed(cfg.seed, event_id, choice))
    a, b = (max(cfg.least_alpha_beta, m * cfg.concentration) for m in (mean, 1 - mean))
    return rng.random(draws), rng.beta(a, b, draws)


def drawn_choice(x: dict, choice: str, cfg: TradeConfig, draws: int, even: bool) -> list[float | None]:
    """DRAWN of one deal's choice; none where a term is missing."""
    if any(x[k] is None for k in ("cash", "stock", "entry", "cash_cap", "stock_cap", "cash_demand")):
        return [None] * len(DRAWN)
    u, f = demand_draws(x["cash_demand"], x["event_id"], choice, cfg, draws, even)
    f = f * (1 - x["own_share"]) + (x["own_share"] if choice == "cash" else 0.0)
    cash_fill, stock_fill = np.minimum(1, x["cash_cap"] / np.maximum(f, 1e-12)), np.minimum(1, x["stock_cap"] / np.maximum(1 - f, 1e-12))
    stock_part = 1 - cash_fill if choice == "cash" else stock_fill
    gross = (1 - stock_part) * x["cash"] + stock_part * x["stock"] - x["entry"]
    ratio = {"conversion_expected": np.maximum(0, stock_part * (x["ratio"] or 0.0)), "dollar_neutral": x["entry"] / x["entry_acq"] if x["entry_acq"] else 0.0}.get(cfg.hedge, 0.0)
    short = ratio * x["entry_acq"]
    cost = (x["entry"] + short) * cfg.cost_bps / 1e4 + 0.5 * x["entry"] * (x["target_spread"] or 0.0) + short * (x["acq_spread"] or 0.0) + short * cfg.borrow_bps / 1e4 * x["days"] / 365
    broken = x["p_terminated"] + x["p_withdrawn"]
    net = np.where(u < x["p_terminated"], x[f"{choice}_terminated"], np.where(u < broken, x[f"{choice}_withdrawn"], gross - cost))
    done = u >= broken
    p05, p50, p95 = np.quantile(net, (0.05, 0.5, 0.95))
    return [net.mean(), p05, p50, p95, net[net <= p05].mean(), (net < 0).mean(), gross[done].mean() if done.any() else None, cash_fill[done].mean() if done.any() else None]


def drawn_ascending(x: dict, choice: str, cfg: TradeConfig, draws: int) -> list[float | None]:
    """drawn_choice() of random draws in order: demand is drawn only where the deal completes, as nothing else reads it, and ascending; the part paid in stock rises along
    demand and net alpha is a line in that part, so nothing is sorted."""
    if any(x[k] is None for k in ("cash", "stock", "entry", "cash_cap", "stock_cap", "cash_demand")):
        return [None] * len(DRAWN)
    rng = np.random.default_rng(stable_seed(cfg.seed, x["event_id"], choice))
    u = rng.random(draws)
    terminated, broken = (int(np.count_nonzero(u < p)) for p in (x["p_terminated"], x["p_terminated"] + x["p_withdrawn"]))
    a, b = (max(cfg.least_alpha_beta, m * cfg.concentration) for m in (x["cash_demand"], 1 - x["cash_demand"]))
    f = sorted_beta(a, b, draws - broken, rng) * (1 - x["own_share"]) + (x["own_share"] if choice == "cash" else 0.0)
    cash_fill = np.minimum(1, x["cash_cap"] / np.maximum(f, 1e-12))
    part = 1 - cash_fill if choice == "cash" else np.minimum(1, x["stock_cap"] / np.maximum(1 - f, 1e-12))
    gross = lambda y: (1 - y) * x["cash"] + y * x["stock"] - x["entry"]
    # a line in the part paid in stock
    fixed, slope = x["entry"] * cfg.cost_bps / 1e4 + 0.5 * x["entry"] * (x["target_spread"] or 0.0), x["stock"] - x["cash"]
    if cfg.hedge != "none" and x["entry_acq"] is not None:
        by_short = x["entry_acq"] * (cfg.cost_bps / 1e4 + (x["acq_spread"] or 0.0) + cfg.borrow_bps / 1e4 * x["days"] / 365)
        if cfg.hedge == "conversion_expected":
            slope -= max(0.0, x["ratio"] or 0.0) * by_short
        elif x["entry_acq"]:
            fixed += x["entry"] / x["entry_acq"] * by_short
    net = part * slope + (x["cash"] - x["entry"] - fixed)
    net = with_atoms(net[::-1] if slope < 0 else net, [(x[f"{choice}_terminated"], terminated), (x[f"{choice}_withdrawn"], broken - terminated)])
    return [*stats_ascending(net), gross(float(part.mean())) if len(f) else None, float(cash_fill.mean()) if len(f) else None]


#: Even draws are few, so deals go through arrays so many at a time.
TOGETHER = 4096


def drawn_together(x: dict[str, np.ndarray], choice: str, cfg: TradeConfig, draws: int) -> list[np.ndarray]:
    """drawn_choice() of many deals on even draws, whose uniforms are the same for each deal; x: a column of rows for each name, NaN for null."""
    k = np.arange(draws)
    u, mean = (k + 1) * GOLDEN % 1, x["cash_demand"]
    missing = np.isnan(sum(x[c] for c in ("cash", "stock", "entry", "cash_cap", "stock_cap", "cash_demand")))[:, 0]
    none0 = lambda c: np.nan_to_num(x[c], nan=0.0)
    with np.errstate(invalid="ignore", divide="ignore"):
        wide = np.sqrt(3 * mean * (1 - mean) / (cfg.concentration + 1))
        f = np.clip(mean + wide * (2 * (k + 0.5) / draws - 1), 1e-6, 1 - 1e-6)
        f = f * (1 - x["own_share"]) + (x["own_share"] if choice == "cash" else 0.0)
        cash_fill, stock_fill = np.minimum(1, x["cash_cap"] / np.maximum(f, 1e-12)), np.minimum(1, x["stock_cap"] / np.maximum(1 - f, 1e-12))
        stock_part = 1 - cash_fill if choice == "cash" else stock_fill
        gross = (1 - stock_part) * x["cash"] + stock_part * x["stock"] - x["entry"]
        if cfg.hedge == "conversion_expected":
            ratio = np.maximum(0, stock_part * none0("ratio"))
        else:
            ratio = np.where(none0("entry_acq") != 0, x["entry"] / x["entry_acq"], 0.0) if cfg.hedge == "dollar_neutral" else 0.0
        short = ratio * x["entry_acq"]
        cost = (x["entry"] + short) * cfg.cost_bps / 1e4 + 0.5 * x["entry"] * none0("target_spread") + short * none0("acq_spread") + short * cfg.borrow_bps / 1e4 * x["days"] / 365
        broken = x["p_terminated"] + x["p_withdrawn"]
        net = np.where(u < x["p_terminated"], x[f"{choice}_terminated"], np.where(u < broken, x[f"{choice}_withdrawn"], gross - cost))
        done = u >= broken
        n_done = done.sum(-1)
        p05, p50, p95 = np.quantile(net, (0.05, 0.5, 0.95), axis=-1)
        tail = net <= p05[:, None]
        completed = [np.where(n_done > 0, np.where(done, v, 0.0).sum(-1) / n_done, np.nan) for v in (gross, cash_fill)]
        found = [net.mean(-1), p05, p50, p95, np.where(tail, net, 0.0).sum(-1) / tail.sum(-1), (net < 0).mean(-1), *completed]
    return [np.where(missing, np.nan, v) for v in found]


def simulated(df: DataFrame, cfg: TradeConfig, draws: int = 20_000, even: bool = False) -> DataFrame:
    """df, as elections() gives it, with CHOICE_DRAWN for both choices: net alphas of draws of the outcome and, where the deal completes, of the demand."""
    need = ["event_id", "cash", "stock", "ratio", "entry", "entry_acq", "cash_cap", "stock_cap", "cash_demand", "own_share", "target_spread", "acq_spread", "days", "p_terminated", "p_withdrawn", *[f"{c}_{x}" for c in CHOICES for x in ("terminated", "withdrawn")]]
    schema = T.StructType([*df.schema.fields, *(T.StructField(f"{c}_{x}", T.DoubleType()) for c in CHOICES for x in DRAWN)])

    def together(batch: pa.RecordBatch) -> list[np.ndarray]:
        x = {k: batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for k in need[1:]}
        return [v for c in CHOICES for v in drawn_together(x, c, cfg, draws)]

    def run(batches):
        for batch in batches:
            if even:
                for i in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(i, TOGETHER)
                    yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(v, pa.float64(), from_pandas=True) for v in together(part))], names=schema.names)
                continue
            rows = [dict(zip(need, v, strict=True)) for v in zip(*(batch.column(k).to_pylist() for k in need), strict=True)]
            made = [[v for c in CHOICES for v in drawn_ascending(x, c, cfg, draws)] for x in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array([m[k] for m in made], pa.float64()) for k in range(2 * len(DRAWN))]], names=schema.names)

    return df.mapInArrow(run, schema)


def _window_scores(rows: pa.Table, numeric: Sequence[str], categorical: Sequence[str], window: int, alpha: float, base: Sequence[float], own: int) -> pa.Table:
    """One block: each of its own events' fit_n and states' scores. Sums over what came before a place are arrays over all features; a window's are the difference of two."""
    labelled = rows["labelled"].to_numpy()
    state = np.array([STATES.index(x) if x in STATES else -1 for x in rows["label"].to_pylist()])
    order = np.flatnonzero(state >= 0)
    order = order[np.argsort(labelled[order], kind="stable")]
    asked = np.flatnonzero(rows["_own"].to_numpy() == own)
    low, high = (np.searchsorted(labelled[order], labelled[asked] - d) for d in (window, 0))
    hot = np.eye(len(STATES))[state[order]]
    upto = lambda values: np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    within = lambda values: (s := upto(values))[high] - s[low]
    n = within(hot)
    total = n.sum(axis=1)
    priors = (n + alpha * np.asarray(base)) / (total + alpha * len(STATES))[:, None]
    score = np.log(np.maximum(priors / priors.sum(axis=1, keepdims=True), 1e-12))
    x = np.stack([rows[k].to_numpy(zero_copy_only=False).astype(float) for k in numeric], axis=1) if numeric else np.zeros((len(labelled), 0))
    # about a value of the block, so that squares lose no digits
    centre = np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in x.T])
    known, x = np.isfinite(x), np.nan_to_num(x - centre, nan=0.0)
    part = hot[:, :, None] * known[order][:, None, :]
    count, first, second = (within(part * (x[order] ** e)[:, None, :]) for e in range(3))
    every = [v.sum(axis=1, keepdims=True) for v in (count, first, second)]
    with np.errstate(divide="ignore", invalid="ignore"):
        moments = [(s / c, np.maximum((q - s * s / c) / np.maximum(c - 1, 1), 1e-4)) for c, s, q in ((count, first, second), every)]
    own_enough, some = count >= 2, every[0] > 0
    mean = np.where(own_enough, moments[0][0], np.where(some, moments[1][0], -centre))
    var = np.where(own_enough, moments[0][1], np.where(some, moments[1][1], 1.0))
    at = x[asked][:, None, :]
    score = score + (-0.5 * (np.log(2 * math.pi * var) + (at - mean) ** 2 / var) * known[asked][:, None, :]).sum(axis=2)
    for k in categorical:
        codes = rows[k].combine_chunks().dictionary_encode()
        names, codes = codes.dictionary.to_pylist(), codes.indices.to_numpy()
        met = within(hot[:, :, None] * np.eye(len(names))[codes[order]][:, None, :])
        words = (met.sum(axis=1) > 0).sum(axis=1)
        if MISSING not in names:
            words = words + 1
        else:
            words = words + (met.sum(axis=1)[:, names.index(MISSING)] == 0)
        mine = met[np.arange(len(asked)), :, codes[asked]]
        score = score + np.log((mine + alpha) / (n + alpha * words[:, None]))
    return pa.table({"event_id": rows["event_id"].take(pa.array(asked)), "fit_n": pa.array(total.astype(np.int64)), **{f"s{i}": pa.array(score[:, i]) for i in range(len(STATES))}})


def rolling_outcomes(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], window: int = 250, least: int = 25, alpha: float = 1.0, defaults: tuple[float, ...] = (0.90, 0.07, 0.03), block: int = 1024) -> DataFrame:
    """(event_id, p_STATE, fit_n, source): Naive Bayes probabilities of each event from the last `window` labelled events before it; the defaults where there are
    fewer than `least`. rows: event_id, labelled (how many labelled events come before), label (null: none), numeric features (null: left out of the score), categorical ones.

    No fit is made twice: sums over blocks of `block` labelled events, each with those that its first ones look back on, stand in for one on each window. A
    state's own mean and variance count from two values on, else all states' do; of a category never seen only alpha does.
    """
    base = [d / sum(defaults) for d in defaults]
    known = F.when(F.col("label").isin(*STATES), F.col("label"))
    slim = rows.select("event_id", F.col("labelled").cast("long").alias("labelled"), known.alias("label"), *[F.col(k).cast("double").alias(k) for k in numeric], *[F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(MISSING)).alias(k) for k in categorical])
    own = F.floor(F.col("labelled") / block)
    # labelled events go to the next block as well, if it looks back on them
    carried = F.when(F.col("label").isNotNull() & (F.pmod("labelled", F.lit(block)) >= block - window), F.array(own, own + 1)).otherwise(F.array(own))
    dealt = slim.withColumns({"_own": own, "_b": F.explode(carried)})
    kind = dict(rows.dtypes)["event_id"]

    def scores(key, table):
        return _window_scores(table, numeric, categorical, window, alpha, base, key[0].as_py())

    d = dealt.groupBy("_b").applyInArrow(scores, f"event_id {kind}, fit_n long, s0 double, s1 double, s2 double")
    top = F.greatest("s0", "s1", "s2")
    d = d.select("event_id", "fit_n", *[F.exp(F.col(f"s{i}") - top).alias(f"e{i}") for i in range(3)])
    whole, enough = F.col("e0") + F.col("e1") + F.col("e2"), F.col("fit_n") >= least
    p = [F.when(enough, F.col(f"e{i}") / whole).otherwise(base[i]).alias(f"p_{s}") for i, s in enumerate(STATES)]
    return d.select("event_id", *p, "fit_n", F.when(enough, "rolling_naive_bayes").otherwise("default_probabilities_insufficient_history").alias("source"))
