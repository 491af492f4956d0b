"""Pivots, first values, top rows and summaries of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_value(c: Column, order: Column) -> Column:
    """An aggregate: the first value that is not null, in order."""
    return F.min_by(c, F.when(c.isNotNull(), order))


def pivot_first(df: DataFrame, key: str, field: str, value: str, order: str, fields: Sequence[str]) -> DataFrame:
    """Attribute rows to columns, each the first value that is not null; keys without any value are left out."""
    own = [F.min_by(value, F.when((F.col(field) == f) & F.col(value).isNotNull(), F.col(order))).alias(f) for f in fields]
    return df.where(F.col(field).isin(*fields)).groupBy(key).agg(*own).where(F.coalesce(*fields).isNotNull())


def first_rows(df: DataFrame, key: str, order: Column) -> DataFrame:
    """Per column the first value of each key that is not null."""
    return df.groupBy(key).agg(*[first_value(F.col(c), order).alias(c) for c in df.columns if c != key])


def category_mix(df: DataFrame, by: Sequence[str], category: str, values: Sequence[str], amount: str) -> DataFrame:
    """Sums and counts by category as columns, 0 where there is none."""
    aggs = []
    for v in values:
        hit = F.col(category) == v
        aggs += [F.coalesce(F.sum(F.when(hit, F.col(amount))), F.lit(0.0)).alias(f"{v.lower()}_{amount}"), F.count(F.when(hit, 1)).alias(f"{v.lower()}_count")]
    return df.groupBy(*by).agg(*aggs)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, filled, pct): how many rows have a value, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("_all"), *[F.count(c).alias(c) for c in columns])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("filled"), F.col("_all").alias("_all")) for c in columns]))
    return one.select(rows).select("column_name", "filled", (F.col("filled") / F.nullif(F.col("_all"), F.lit(0)) * 100).alias("pct"))


def quartile_edges(df: DataFrame, column: str) -> Column:
    return F.percentile(column, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def bucket(x: Column, edges: Column) -> Column:
    """0 to 3 by three edges, an edge belonging to the bucket below it; null stays."""
    return F.when(x.isNotNull(), F.aggregate(edges, F.lit(0), lambda a, e: a + F.when(x > e, 1).otherwise(0)))


def head_and_tail(df: DataFrame, by: Sequence[str], order: Sequence[Column], reverse: Sequence[Column], n: int) -> DataFrame:
    """At most n rows of each group: the earliest half and the latest rest."""
    up, down = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by).orderBy(*reverse)
    return df.withColumns({"_up": F.row_number().over(up), "_down": F.row_number().over(down)}).where((F.col("_up") <= n // 2) | (F.col("_down") <= n - n // 2)).drop("_up", "_down")


def reserved_top(df: DataFrame, by: Sequence[str], reserved: Column, score: Sequence[Column], reserve: int, n: int) -> DataFrame:
    """The n best rows of each group, with up to `reserve` reserved ones among them."""
    kind = Window.partitionBy(*by, "_reserved").orderBy(*score)
    df = df.withColumn("_reserved", reserved)
    df = df.withColumn("_first", F.col("_reserved") & (F.row_number().over(kind) <= reserve))
    rank = Window.partitionBy(*by).orderBy(F.col("_first").desc(), *score)
    return df.withColumn("_n", F.row_number().over(rank)).where(F.col("_n") <= n).drop("_n", "_first", "_reserved")


def finite(c: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def weighted_return_pct(pnl: Column, notional: Column) -> Column:
    """Sum of P&L over sum of notional, in percent, over rows with both and a positive notional."""
    ok = pnl.isNotNull() & (notional > 0)
    return F.sum(F.when(ok, pnl)) / F.nullif(F.sum(F.when(ok, notional)), F.lit(0.0)) * 100


def row_sum(columns: Sequence[str]) -> Column:
    """The sum of a row's columns, nulls left out; null where all are."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(F.col(c), F.lit(0.0))
    return F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), total)
