"""Naive Bayes as tables of sufficient statistics: fits, expanding folds and scores are joins and sums."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATES = ("completed", "terminated", "withdrawn")
#: Sentinels of the vocabulary: a missing value and one not seen in training.
MISSING, OTHER = "__missing__", "__other__"


@dataclass(frozen=True)
class NBParams:
    alpha: float = 1.0
    prior_strength: float = 0.0
    shrinkage: float = 0.0
    likelihood_weight: float = 1.0
    prior_blend: float = 0.0
    defaults: tuple[float, float, float] = (0.88, 0.07, 0.05)


def priors(rows: DataFrame, label: str, p: NBParams) -> DataFrame:
    """(label, n, prior) for every state: counts plus prior_strength times the defaults."""
    total = sum(p.defaults)
    base = rows.sparkSession.createDataFrame([(s, d / total) for s, d in zip(STATES, p.defaults, strict=True)], f"{label} string, base double")
    counts = rows.where(F.col(label).isin(*STATES)).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    j = base.join(counts, label, "left").na.fill(0, ["n"])
    whole = Window.partitionBy()
    weight = F.col("n") + p.prior_strength * F.col("base")
    return j.select(label, "n", weight.alias("w")).select(label, "n", (F.col("w") / F.sum("w").over(whole)).alias("prior"))


def long_numeric(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(features), "feature", "x").where("x is not null")


def long_categorical(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    return rows.unpivot(list(keys), list(features), "feature", "v").withColumn("v", F.coalesce(F.nullif(F.col("v"), F.lit("")), F.lit(MISSING)))


def numeric_stats(long: DataFrame, label: str, p: NBParams) -> DataFrame:
    """(label, feature, n, mean, var): a state's own from two values on, its variance drawn to the whole's; else the whole's; at least 1e-4."""
    own = long.groupBy(label, "feature").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_samp("x").alias("var"))
    every = long.groupBy("feature").agg(F.avg("x").alias("g_mean"), F.greatest(F.when(F.count("x") > 1, F.var_samp("x")).otherwise(1.0), F.lit(1e-4)).alias("g_var"))
    states = long.sparkSession.createDataFrame([(s,) for s in STATES], f"{label} string")
    j = every.crossJoin(states).join(own, [label, "feature"], "left").na.fill(0, ["n"])  # three rows for each feature
    enough = F.col("n") >= 2
    var = (1 - p.shrinkage) * F.col("var") + p.shrinkage * F.col("g_var")
    return j.select(label, "feature", "n", F.when(enough, F.col("mean")).otherwise(F.col("g_mean")).alias("mean"), F.when(enough, F.greatest(var, F.lit(1e-4))).otherwise(F.col("g_var")).alias("var"))


def categorical_counts(long: DataFrame, label: str) -> DataFrame:
    return long.groupBy(label, "feature", "v").agg(F.count(F.lit(1)).alias("n"))


def gaussian(x: Column, mean: Column, var: Column) -> Column:
    return -0.5 * (F.ln(2 * math.pi * var) + (x - mean) * (x - mean) / var)


def predict(train: DataFrame, rows: DataFrame, key: str, label: str, numeric: Sequence[str], categorical: Sequence[str], p: NBParams, kept: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(key, label, probability): log prior plus the weighted sum of log likelihoods, then a softmax that takes the greatest off first.

    With kept (as cut()) the fit is stored before rows are scored, so Spark knows how small its tables are and moves no features of rows to meet them."""
    pri = priors(train, label, p)
    num = numeric_stats(long_numeric(train, [label], numeric), label, p)
    long_train = long_categorical(train, [label], categorical)
    counts = categorical_counts(long_train, label)
    if kept:
        pri, num, counts = kept(pri), kept(num), kept(counts)
        long_train = counts
    totals = counts.groupBy(label, "feature").agg(F.sum("n").alias("total"))
    # the vocabulary with both sentinels
    vocab = long_train.select("feature", "v").unionByName(long_train.select("feature", F.lit(MISSING).alias("v"))).unionByName(long_train.select("feature", F.lit(OTHER).alias("v"))).distinct()
    sizes = vocab.groupBy("feature").agg(F.count(F.lit(1)).alias("words"))
    on_num = long_numeric(rows, [key], numeric).join(num, "feature").select(key, label, gaussian(F.col("x"), F.col("mean"), F.col("var")).alias("ll"))
    seen = long_categorical(rows, [key], categorical).join(vocab.withColumn("known", F.lit(True)), ["feature", "v"], "left").withColumn("v", F.when(F.col("known"), F.col("v")).otherwise(OTHER)).drop("known")
    on_cat = (
        seen.join(sizes, "feature")
        .crossJoin(F.broadcast(pri.select(label)))  # three states
        .join(totals, [label, "feature"], "left")
        .join(counts, [label, "feature", "v"], "left")
        .select(key, label, F.ln((F.coalesce("n", F.lit(0)) + p.alpha) / (F.coalesce("total", F.lit(0)) + p.alpha * F.greatest(F.lit(1), F.col("words")))).alias("ll"))
    )
    wide = on_num.unionByName(on_cat).groupBy(key).agg(*[F.sum(F.when(F.col(label) == s, F.col("ll"))).alias(f"_l{i}") for i, s in enumerate(STATES)])
    prior = pri.agg(*[F.max(F.when(F.col(label) == s, F.col("prior"))).alias(f"_p{i}") for i, s in enumerate(STATES)])
    return softmax(wide.crossJoin(F.broadcast(prior)), key, label, p.likelihood_weight, p.prior_blend)  # one row of priors


def softmax(wide: DataFrame, key: str, label: str, weight: float, blend: float) -> DataFrame:
    """(key, label, probability) from the states' log likelihoods _l and priors _p side by side."""
    n = range(len(STATES))
    s = wide.select(key, *[F.col(f"_p{i}") for i in n], *[(F.ln(F.greatest(F.col(f"_p{i}"), F.lit(1e-12))) + weight * F.coalesce(F.col(f"_l{i}"), F.lit(0.0))).alias(f"_s{i}") for i in n])
    top = F.greatest(*[F.col(f"_s{i}") for i in n])
    e = s.select(key, *[F.col(f"_p{i}") for i in n], *[F.exp(F.col(f"_s{i}") - top).alias(f"_e{i}") for i in n])
    whole = sum((F.col(f"_e{i}") for i in n[1:]), F.col("_e0"))
    parts = [F.struct(F.lit(x).alias(label), ((1 - blend) * F.col(f"_e{i}") / whole + blend * F.col(f"_p{i}")).alias("probability")) for i, x in enumerate(STATES)]
    return e.select(key, F.inline(F.array(*parts)))


def expanding_numeric(rows: DataFrame, label: str, year: str, feature: str, centre: float) -> DataFrame:
    """(year, label, n, mean, var) of all earlier years, for every year from the first to the last: one sum by year, then a running window."""
    d = F.col(feature) - centre
    by_year = rows.groupBy(year, label).agg(F.count(feature).alias("c"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    span = rows.agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    spine = span.select(F.explode(F.sequence("lo", "hi")).alias(year)).crossJoin(rows.sparkSession.createDataFrame([(x,) for x in STATES], f"{label} string"))
    full = spine.join(by_year, [year, label], "left").na.fill(0)
    before = Window.partitionBy(label).orderBy(year).rowsBetween(Window.unboundedPreceding, -1)
    r = full.select(year, label, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(a) for c, a in (("c", "n"), ("s", "s1"), ("q", "s2"))])
    n = F.col("n")
    return r.select(year, label, "n", F.when(n > 0, F.col("s1") / n + centre).alias("mean"), F.when(n > 1, (F.col("s2") - F.col("s1") * F.col("s1") / n) / (n - 1)).alias("var"))


def brier(probability: Column, hit: Column) -> Column:
    e = probability - hit.cast("double")
    return e * e
