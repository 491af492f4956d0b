"""Sums along a whole table in an order, without one task that holds it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut


def running(table: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """table with nth (how many rows come before each) and, for each name of sums, the sum of its column over those rows.

    Ranges of the order are dealt to as many tasks as there are shuffle partitions and kept; their totals, a row for each range, are summed by one, and within a
    range a window adds the rest.
    """
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(table.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_of_nth"), *[F.sum(c).alias(f"_of_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, so this side may be broadcast
    offsets = totals.select("_range", *[F.coalesce(F.sum(f"_of_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in ("nth", *sums)])
    own = Window.partitionBy("_range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    return dealt.join(F.broadcast(offsets), "_range").select(
        *table.columns,
        (F.row_number().over(own) - 1 + F.col("_before_nth")).alias("nth"),
        *[(F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"_before_{k}")).alias(k) for k, c in sums.items()],
    )
