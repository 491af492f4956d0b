"""Prices of a deal's sides mended: gaps filled from the security that the side's identifier named at the time, and sides of a wrong security replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cusip

GAP, OVERRIDE = "cusip_permno_fix", "_permno_override"


def security_at(events: DataFrame, links: DataFrame) -> DataFrame:
    """(event_id, announce_date, permno): the security that each event's identifier stood for on the day of its announcement; where none did, the one that held it last; of
    several the smallest number. Identifiers are compared by their first eight letters and digits. events: event_id, announce_date, cusip; links: permno, cusip8, from_date, to_date."""
    found = events.select("event_id", "announce_date", cusip(F.col("cusip"), 8).alias("cusip8")).where("cusip8 <> ''").join(links, "cusip8")
    valid = F.col("announce_date").between(F.col("from_date"), F.col("to_date"))
    order = [F.coalesce(valid, F.lit(False)).desc(), F.when(~valid, F.col("to_date")).desc_nulls_last(), F.col("permno")]
    best = found.withColumn("_n", F.row_number().over(Window.partitionBy("event_id").orderBy(*order)))
    return best.where("_n = 1").select("event_id", "announce_date", "permno")


def repair_plan(prices: DataFrame, events: DataFrame, links: DataFrame, overrides: DataFrame) -> DataFrame:
    """(event_id, announce_date, side, permno, replace): one line for each side to be fetched: events with prices but none of the acquirer, whose identifier names a security; and
    overrides (event_id, side, permno) of events with prices, which go first where both ask for a side."""
    known = prices.groupBy("event_id").agg(F.max(F.when(F.col("side") == "acquirer", 1).otherwise(0)).alias("has"))
    gaps = security_at(events.join(known.where("has = 0").select("event_id"), "event_id"), links).select("event_id", "announce_date", F.lit("acquirer").alias("side"), "permno", F.lit(False).alias("replace"))
    named = overrides.groupBy("event_id", "side").agg(F.min("permno").alias("permno")).join(events.select("event_id", "announce_date"), "event_id").join(known.select("event_id"), "event_id")
    named = named.select("event_id", "announce_date", "side", "permno", F.lit(True).alias("replace"))
    return named.unionByName(gaps.join(named, ["event_id", "side"], "left_anti"))


def repaired(prices: DataFrame, events: DataFrame, links: DataFrame, securities: DataFrame, overrides: DataFrame, before: int = 30, after: int = 400) -> DataFrame:
    """prices (event_id, side, price_date, price, volume, permno, symbol_source) with the plan carried out: the securities' prices (permno, price_date, price, volume) from `before`
    days before the announcement to `after` days after it come in; what an override replaces goes, but only if there are prices in its place.

    Done twice it changes nothing: a gap once filled is no gap, and an override replaces its own rows by the same ones.
    """
    plan = repair_plan(prices, events, links, overrides)
    asked = plan.withColumnsRenamed({"permno": "wanted"})
    inside = F.col("price_date").between(F.date_sub("announce_date", before), F.date_add("announce_date", after))
    source = F.when(F.col("replace"), F.concat("side", F.lit(OVERRIDE))).otherwise(GAP)
    added = asked.join(securities, F.col("wanted") == F.col("permno")).where(inside).select("event_id", "side", "price_date", "price", "volume", "permno", source.alias("symbol_source"), "replace")
    gone = added.where("replace").select("event_id", "side").distinct()
    return prices.join(gone, ["event_id", "side"], "left_anti").select(*prices.columns).unionByName(added.drop("replace").select(*prices.columns))
