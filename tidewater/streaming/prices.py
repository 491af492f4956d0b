"""An optional extension, not needed for batch results: daily prices as a stream, kept to one row for each event, side and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def daily_prices(spark: SparkSession, folder: str, delay: str = "2 days") -> DataFrame:
    """Volume and dollar volume by event, side and day from files that drop into a folder; rows later than `delay` are left out."""
    raw = spark.readStream.schema(EVENTS).parquet(folder)
    side = F.when(F.col("event_type").isin("view", "click", "error"), "target").otherwise("acquirer")
    return (
        raw.withWatermark("ts", delay)
        .groupBy(F.window("ts", "1 day").alias("w"), F.col("user_id").alias("event_id"), side.alias("side"))
        .agg(F.count(F.lit(1)).alias("volume"), F.sum("value").alias("dollar_volume"))
        .select("event_id", "side", F.to_date("w.start").alias("price_date"), "volume", "dollar_volume")
    )
