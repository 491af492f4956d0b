"""Payoffs of cash-or-stock elections, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import clamp

#: Demand is kept this far from 0 and 1.
CLIP = 1e-6
EPS = 1e-12


@dataclass(frozen=True)
class OutcomeDefaults:
    completed: float = 0.88
    terminated: float = 0.07
    withdrawn: float = 0.05
    withdrawn_share_of_break: float = 0.35


@dataclass(frozen=True)
class BreakLosses:
    terminated: float = 0.25
    withdrawn: float = 0.35


def prorate(f_cash: Column, pi_cash: Column, cash: Column, stock: Column) -> dict[str, Column]:
    """What a holder gets per share who elects cash, who elects stock, the pool's blend and the better of the first two. Each side is filled up to
    its pool, and the rest is paid in the other kind."""
    f = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), f_cash))
    cash_fill = F.least(F.lit(1.0), pi_cash / f)
    stock_fill = F.least(F.lit(1.0), (1 - pi_cash) / (1 - f))
    cash_holder = cash_fill * cash + (1 - cash_fill) * stock
    stock_holder = stock_fill * stock + (1 - stock_fill) * cash
    return {"cash_holder": cash_holder, "stock_holder": stock_holder, "blended": pi_cash * cash + (1 - pi_cash) * stock, "optimal": F.greatest(cash_holder, stock_holder)}


def state_probabilities(completed: Column, terminated: Column, withdrawn: Column, p_break: Column) -> dict[str, Column]:
    """Three states that add up to 1: a break probability alone goes to terminated; missing is 0; nothing at all is completed."""
    legacy = completed.isNull() & terminated.isNull() & withdrawn.isNull() & p_break.isNotNull()
    parts = [F.when(legacy, 1 - clamp(p_break)).otherwise(completed), F.when(legacy, clamp(p_break)).otherwise(terminated), F.when(legacy, F.lit(0.0)).otherwise(withdrawn)]
    parts = [F.coalesce(clamp(x), F.lit(0.0)) for x in parts]
    total = parts[0] + parts[1] + parts[2]
    return {k: F.when(total > 0, x / total).otherwise(F.lit(float(k == "completed"))) for k, x in zip(("completed", "terminated", "withdrawn"), parts, strict=True)}


def resolved_probabilities(completed: Column, terminated: Column, withdrawn: Column, p_break: Column, defaults: OutcomeDefaults, prefix: str) -> Column:
    """struct(p_completed, p_terminated, p_withdrawn, source): all three explicit; else a break split; else those known, what is left dealt by the
    defaults; else the defaults."""
    base = {"completed": defaults.completed, "terminated": defaults.terminated, "withdrawn": defaults.withdrawn}
    total = sum(base.values())
    base = {k: v / total for k, v in base.items()}
    known = {k: clamp(c) for k, c in zip(base, (completed, terminated, withdrawn), strict=True)}
    broken, share = clamp(p_break), defaults.withdrawn_share_of_break
    zero = F.lit(0.0)
    left = F.greatest(zero, 1 - sum((F.coalesce(c, zero) for c in known.values()), zero))
    open_base = sum((F.when(c.isNull(), base[k]).otherwise(0.0) for k, c in known.items()), zero)
    partial = {k: F.coalesce(c, left * base[k] / open_base) for k, c in known.items()}

    def normal(parts: dict[str, Column], source: str) -> Column:
        clipped = {k: F.coalesce(clamp(c), zero) for k, c in parts.items()}
        s = sum(clipped.values(), zero)
        return F.struct(*[F.when(s > 0, c / s).otherwise(float(k == "completed")).alias(f"p_{k}") for k, c in clipped.items()], F.lit(source).alias("source"))

    every = completed.isNotNull() & terminated.isNotNull() & withdrawn.isNotNull()
    some = completed.isNotNull() | terminated.isNotNull() | withdrawn.isNotNull()
    split = F.struct((1 - broken).alias("p_completed"), (broken * (1 - share)).alias("p_terminated"), (broken * share).alias("p_withdrawn"), F.lit(f"{prefix}_aggregate_break_split").alias("source"))
    fixed = F.struct(*[F.lit(base[k]).alias(f"p_{k}") for k in base], F.lit("default_scenario_no_event_probabilities").alias("source"))
    return (
        F.when(every, normal(known, f"{prefix}_explicit_three_state"))
        .when(p_break.isNotNull(), split)
        .when(some, normal(partial, f"{prefix}_partial_three_state_plus_defaults"))
        .otherwise(fixed)
    )


def break_values(market: Column, recovery: Column, losses: BreakLosses) -> tuple[Column, Column]:
    """Values after termination and withdrawal: the greater of the loss to the recovery price and a share of the market price."""
    fall = F.coalesce(F.greatest(market - recovery, F.lit(0.0)), F.lit(0.0))
    fall = F.when(recovery.isNull(), F.lit(0.0)).otherwise(fall)
    return market - F.greatest(fall, losses.terminated * market), market - F.greatest(fall, losses.withdrawn * market)


def overlay(u: Column, p_completed: Column, p_terminated: Column, value: Column, terminated: Column, withdrawn: Column) -> Column:
    return F.when(u < p_completed, value).when(u < p_completed + p_terminated, terminated).otherwise(withdrawn)


def fill_rates(cash_demand: Column, stock_demand: Column, cash_cap: Column, stock_cap: Column) -> tuple[Column, Column]:
    both = cash_cap.isNotNull() & stock_cap.isNotNull()
    one = lambda demand, cap: F.when(both, F.when(demand <= EPS, 1.0).otherwise(F.least(F.lit(1.0), cap / demand)))
    return one(cash_demand, cash_cap), one(stock_demand, stock_cap)


def predicted_votes(p: Column, q: Column, passive: Column, rule: Column, cash_value: Column, stock_value: Column, target_price: Column) -> Column:
    """struct(action, rational, irrational, passive, cash_demand, stock_demand): passive holders follow the default rule, rational ones (at most q)
    the better offer, the others cash with probability p; if both offers lose, the rational ones leave in favour of the rest."""
    cash_gain, stock_gain = cash_value - target_price, stock_value - target_price
    action = F.when((cash_gain < 0) & (stock_gain < 0), "exit").when(stock_gain >= cash_gain, "stock").otherwise("cash")
    rational = F.greatest(F.lit(0.0), F.least(q, 1 - passive))
    irrational = F.greatest(F.lit(0.0), 1 - passive - rational)
    rest = passive + irrational
    leaves = action == "exit"
    passive_now = F.when(leaves & (rest > EPS), passive + rational * passive / rest).otherwise(passive)
    irrational_now = F.when(leaves, F.when(rest > EPS, irrational + rational * irrational / rest).otherwise(1.0)).otherwise(irrational)
    rational_now = F.when(leaves, 0.0).otherwise(rational)
    by_default = F.when(rule == "cash", 1.0).when(rule == "stock", 0.0).otherwise(0.5)
    cash = irrational_now * p + passive_now * by_default + F.when(action == "cash", rational_now).otherwise(0.0)
    stock = irrational_now * (1 - p) + passive_now * (1 - by_default) + F.when(action == "stock", rational_now).otherwise(0.0)
    total = cash + stock
    return F.struct(
        action.alias("action"),
        rational_now.alias("rational"),
        irrational_now.alias("irrational"),
        passive_now.alias("passive"),
        F.when(total > EPS, cash / total).otherwise(cash).alias("cash_demand"),
        F.when(total > EPS, stock / total).otherwise(stock).alias("stock_demand"),
    )


def term_gap(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.least(F.abs(a), F.abs(b)), F.lit(1e-9))
