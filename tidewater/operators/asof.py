"""Joins on time, as windows over both sides in one order, and on validity windows: one shuffle on the key, no range join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, time: str, values: Sequence[str], how: str = "backward") -> DataFrame:
    """left with the values of right's row nearest in time: backward (last on or before `at`), forward (first on or after), nearest (backward, else
    the first after). Rows of right with a null time or first value do not count; rows of left with a null key or `at` find none. Every row of left stays,
    repeated ones too. Of rows at the same time the one with the greater values counts, forward the one with the smaller ones.

    Both sides go one after the other along (key, time), and each row of left takes the last value that it has passed: one shuffle, and rows as
    many as both sides have, however long a key's history is.
    """
    own = left.columns
    found = right.where(F.col(time).isNotNull() & F.col(values[0]).isNotNull())
    asked = left.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(on)], F.col(at).alias("at"), F.struct(*own).alias("row"), F.lit(None).cast(found.select(F.struct(*values)).schema[0].dataType).alias("v"))
    rows = asked.unionByName(found.select(*[F.col(c).alias(f"k_{i}") for i, c in enumerate(on)], F.col(time).alias("at"), F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.struct(*values).alias("v")))
    key = [f"k_{i}" for i in range(len(on))]
    quote = F.col("v").isNotNull().cast("int")
    # at the same time quotes come before the rows that ask, going on or going back
    past = Window.partitionBy(*key).orderBy(F.col("at"), quote.desc(), F.col("v").asc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = Window.partitionBy(*key).orderBy(F.col("at").desc(), quote.desc(), F.col("v").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before, after = F.last("v", ignorenulls=True).over(past), F.last("v", ignorenulls=True).over(ahead)
    hit = {"backward": before, "forward": after, "nearest": F.coalesce(before, after)}[how]
    known = F.col("at").isNotNull()
    for k in key:
        known = known & F.col(k).isNotNull()
    matched = rows.withColumn("hit", F.when(known, hit)).where("row is not null")
    return matched.select(*[F.col("row")[c].alias(c) for c in own], *[F.col("hit")[v].alias(v) for v in values])


def best_row(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def valid_name(left: DataFrame, names: DataFrame, on: str, at: str, start: str, end: str, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """left joined to the name whose window holds `at`, else to the one that ends last."""
    inside = F.coalesce((F.col(start) <= F.col(at)) & (F.col(at) <= F.col(end)), F.lit(False))
    joined = left.join(names, on).withColumn("in_window", inside)
    return best_row(joined, by, [F.col("in_window").desc(), F.col(end).desc_nulls_last(), *order])


def best_window(left: DataFrame, names: DataFrame, on: str, at: str, start: str, end: str, tie: str, values: Sequence[str]) -> DataFrame:
    """left with the values of the name of its key whose window holds `at`, of several (or where none does) of the one that ends last, then of the least tie; a name without a whole
    window comes after all others. A row without a name of its key goes.

    No pair is made: of the windows that have begun by `at` the one that ends last holds it if any does, so names become the best one by each start, and left looks up one of those.
    """
    best = [F.col(end).alias("_end"), (-F.col(tie)).alias("_tie"), *values]
    known = F.col(start).isNotNull() & F.col(end).isNotNull()
    begun = names.where(known).groupBy(on, start).agg(F.max(F.struct(*best)).alias("_best"))
    upto = Window.partitionBy(on).orderBy(start).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = asof(left, begun.withColumn("_best", F.max("_best").over(upto)), [on], at, start, ["_best"])
    last = names.groupBy(on).agg(F.max(F.struct(known.alias("_known"), *best)).alias("_last"))
    inside = F.coalesce(F.col(at) <= F.col("_best._end"), F.lit(False))
    joined = found.join(last, on)
    return joined.select(*left.columns, *[F.when(inside, F.col("_best")[v]).otherwise(F.col("_last")[v]).alias(v) for v in values])


def override(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df without the rows whose keys are in changes, and those of changes instead."""
    return df.join(changes.select(*keys).distinct(), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def left_new_columns(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """A left join that brings only the columns which left does not have yet."""
    fresh = [c for c in right.columns if c in on or c not in left.columns]
    return left.join(right.select(*fresh), list(on), "left")
