"""Risk gates and the signal's decision tree."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class GateConfig:
    metric: str = "mean"
    hurdle: float = 0.005
    least_p05: float = -0.25
    most_loss_probability: float = 0.50
    most_return: float = 0.30
    most_gap: float = 0.50


def risk_gate(mean: Column, p05: Column, cvar05: Column, loss_probability: Column, cfg: GateConfig) -> Column:
    """struct(ok, size, reason): the hurdle is named before the floor, the floor before the ceiling."""
    decision = {"mean": mean, "p05": p05, "cvar05": cvar05}[cfg.metric]
    ok = (decision > cfg.hurdle) & (p05 >= cfg.least_p05) & (loss_probability <= cfg.most_loss_probability)
    size = F.greatest(F.lit(0.0), F.least(F.lit(3.0), mean / F.greatest(-cvar05, -p05, F.lit(1e-3))))
    reason = (
        F.when(ok, "risk_adjusted_return_positive").when(decision <= cfg.hurdle, "risk_adjusted_return_below_hurdle").when(p05 < cfg.least_p05, "p05_below_floor").otherwise("loss_probability_above_ceiling")
    )
    return F.struct(ok.alias("ok"), F.when(ok, size).otherwise(0.0).alias("size"), reason.alias("reason"))


def signal(review: Column, long_ok: Column, long_decision: Column, long_p05: Column, long_loss: Column, reverse_ok: Column, reverse_decision: Column, cfg: GateConfig) -> Column:
    """REVIEW, then REVERSE where it passes and is better or the long side fails, ENTER, and the reasons to pass."""
    reverse = reverse_ok & (~long_ok | (reverse_decision > long_decision))
    return (
        F.when(review, "REVIEW")
        .when(reverse, "REVERSE")
        .when(long_ok, "ENTER")
        .when((long_decision > cfg.hurdle) & (long_p05 < cfg.least_p05), "PASS_P05")
        .when((long_decision > cfg.hurdle) & (long_loss > cfg.most_loss_probability), "PASS_LOSS_PROB")
        .otherwise("PASS")
    )
