"""How much of a position can be built, and from whom, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numbers import bounded_share, hundredths
from ..functions.text import default_rule_probability


@dataclass(frozen=True)
class CapacityConfig:
    build_days: float = 10.0
    adv_participation: float = 0.20
    position_limit: float = 0.05
    positive_share_of_active: float = 0.35
    noisy_sell: float = 0.50
    noisy_buy: float = 0.50
    noisy_cash_prob: float = 0.50
    sell_least: float = 0.02
    sell_most: float = 0.85
    sell_width: float = 0.03
    no_sell_edge: float = 0.03
    passive_sell: float = 0.01
    passive_lend: float = 0.20
    noisy_lend: float = 0.10
    rolling_events: int = 50
    least_events: int = 10
    grid: int = 11
    default_p: float = 0.50
    default_q: float = 0.30
    size_points: int = 51


def inputs(shares: Column, adv: Column, dollar_adv: Column, entry: Column, passive: Column, holder_positive: Column, holder_cash: Column, cfg: CapacityConfig) -> dict[str, Column]:
    """Daily volume as a share of shares out, and the passive, positive and noisy parts of the holders."""
    volume = F.when((adv > 0), adv).when(dollar_adv.isNotNull() & (entry > 0), dollar_adv / entry).otherwise(adv)
    p = F.coalesce(bounded_share(passive), F.lit(0.0))
    active = F.greatest(F.lit(0.0), 1 - p)
    rolled = bounded_share(holder_positive)
    positive = F.when(rolled.isNotNull(), F.least(active, rolled)).otherwise(active * cfg.positive_share_of_active)
    return {
        "adv": volume,
        "adv_pct": F.when(shares > 0, volume / shares),
        "passive_share": p,
        "active_share": active,
        "positive_share": positive,
        "noisy_share": F.greatest(F.lit(0.0), active - positive),
        "noisy_cash": F.coalesce(bounded_share(holder_cash), F.lit(cfg.noisy_cash_prob)),
        "holder_source": F.when(rolled.isNotNull(), "rolling_structural_fit").otherwise("static_positive_holder_share_of_active"),
    }


def sell_rate(edge: Column, cfg: CapacityConfig) -> Column:
    """What positive holders sell: nothing from the no-sell edge on, little above 0, more the further below."""
    e = F.coalesce(edge, F.lit(0.0))
    stress = F.least(F.lit(1.0), -e / cfg.sell_width)
    return F.when(e >= cfg.no_sell_edge, 0.0).when(e >= 0, F.greatest(F.lit(0.0), cfg.sell_least * (1 - e / cfg.no_sell_edge))).otherwise(cfg.sell_least + (cfg.sell_most - cfg.sell_least) * stress)


def pool(name: str, cap: Column, cash: Column) -> Column:
    return F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0.0), cap).alias("cap"), cash.alias("cash"))


def long_pools(adv_cap: Column, edge: Column, elect: Column, rule: Column, pi_cash: Column, c: CapacityConfig) -> Column:
    """Who sells, in order: noisy, positive and passive holders; with a negative edge the positive ones first. Reads the columns of inputs()."""
    noisy = pool("noisy_sellers", F.least(F.col("noisy_share"), adv_cap * c.noisy_sell), F.col("noisy_cash"))
    positive = pool("positive_holders", F.col("positive_share") * sell_rate(edge, c), F.when(F.upper(elect) == "CASH", 1.0).otherwise(0.0))
    passive = pool("passive_inactive", F.col("passive_share") * c.passive_sell, default_rule_probability(rule, pi_cash))
    return F.when(edge < 0, F.array(positive, noisy, passive)).otherwise(F.array(noisy, positive, passive))


def lending_pools(rule: Column, pi_cash: Column, c: CapacityConfig) -> Column:
    return F.array(pool("passive_inactive_lenders", F.col("passive_share") * c.passive_lend, default_rule_probability(rule, pi_cash)), pool("noisy_inactive_lenders", F.col("noisy_share") * c.noisy_lend, F.col("noisy_cash")))


def pool_total(pools: Column) -> Column:
    return F.aggregate(pools, F.lit(0.0), lambda a, x: a + x["cap"])


def binding(source: Column, adv_cap: Column, limit: Column) -> tuple[Column, Column]:
    """The least of three caps and its name; of equal ones the first."""
    least = F.least(source, adv_cap, limit)
    name = F.when(source == least, "source_supply").when(adv_cap == least, "adv_participation").otherwise("position_limit")
    return F.greatest(F.lit(0.0), least), name


def allocate(pools: Column, ownership: Column) -> Column:
    """struct(cash_prob, source_mix, unfilled): takes from each pool in order until the ownership is filled."""
    q = F.greatest(F.lit(0.0), F.coalesce(ownership, F.lit(0.0)))
    none = F.array().cast("array<struct<name:string,take:double,cash:double>>")
    start = F.struct(q.alias("left"), none.alias("taken"))
    # what is left falls by each whole cap, below 0 once one is not used up
    step = lambda a, x: F.struct(
        (a["left"] - x["cap"]).alias("left"),
        F.concat(a["taken"], F.array(F.struct(x["name"].alias("name"), F.least(F.greatest(F.lit(0.0), a["left"]), x["cap"]).alias("take"), x["cash"].alias("cash")))).alias("taken"),
    )
    walked = F.aggregate(pools, start, step)
    used = F.filter(walked["taken"], lambda x: x["take"] > 0)
    total = F.aggregate(used, F.lit(0.0), lambda a, x: a + x["take"])
    cash = F.aggregate(used, F.lit(0.0), lambda a, x: a + x["take"] * x["cash"])
    return F.struct(
        F.when((q > 0) & (total > 0), cash / total).alias("cash_prob"),
        F.when(q > 0, F.array_join(F.transform(used, lambda x: F.concat(x["name"], F.lit(":"), hundredths(x["take"] / q))), "|")).otherwise("").alias("source_mix"),
        F.when(q > 0, F.greatest(F.lit(0.0), q - total)).otherwise(0.0).alias("unfilled"),
    )


def own_vote_share(notional: Column, price: Column, shares: Column) -> Column:
    return F.when((shares > 0) & (price > 0), F.greatest(F.lit(0.0), F.least(F.lit(0.25), notional / price / shares))).otherwise(0.0)


def with_own_vote(cash_demand: Column, own: Column, choice: Column) -> Column:
    """Cash demand after an own vote of a share `own` for a choice."""
    cash = cash_demand * (1 - own) + F.when(choice == "cash", own).otherwise(0.0)
    stock = (1 - cash_demand) * (1 - own) + F.when(choice == "cash", 0.0).otherwise(own)
    return F.when(cash + stock > 1e-12, cash / (cash + stock)).otherwise(cash)


def from_signals(settings: dict) -> CapacityConfig:
    """The capacity settings among those of a signal run, under its names; a grid has five points at least."""
    named = {f.name for f in fields(CapacityConfig)}
    found = {k.removeprefix("capacity_"): v for k, v in settings.items() if k.removeprefix("capacity_") in named}
    if "size_points" in found:
        found["size_points"] = max(5, int(found["size_points"]))
    return CapacityConfig(**found)
