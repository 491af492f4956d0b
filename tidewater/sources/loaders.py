"""Loaders of the tables that stages exchange: what a table must hold is asserted, keys and labels are added, repeated keys resolved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from .files import MissingInput, _exists, optional, string_csv


class MissingColumns(ValueError):
    """An input without columns that it must have."""


def require(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    if lack := [c for c in columns if c not in df.columns]:
        raise MissingColumns(f"{what} has no column {', '.join(lack)}")
    return df


def match_key(announce: Column, target: Column, acquirer: Column) -> Column:
    """The key by which deals of two tables are the same: the day and both names, normalised."""
    return F.concat_ws("|", F.date_format(F.try_to_date(announce), "yyyyMMdd"), X.normal_name(target), X.normal_name(acquirer))


def deal_export(spark: SparkSession, path: str) -> DataFrame:
    """The deal export, all columns as text, with row_idx (order within the file), match_key and outcome_label."""
    if not _exists(spark, path):
        raise MissingInput(f"{path} is needed for the outcome model")
    df = require(string_csv(spark, path), ("Announce Date", "Target Name", "Acquirer Name", "Deal Status"), path)
    # ids rise with the place in a file and with its parts; the file is read in order
    return df.select("*", F.monotonically_increasing_id().alias("row_idx"), match_key(F.col("Announce Date"), F.col("Target Name"), F.col("Acquirer Name")).alias("match_key"), X.exact_status(F.col("Deal Status")).alias("outcome_label"))


def event_frame(spark: SparkSession, path: str) -> DataFrame:
    """One row for each event, the first of the file, with match_key; deal_status and payment_type are empty where the table lacks them."""
    df = require(string_csv(spark, path), ("event_id", "Announce Date", "Target Name", "Acquirer Name"), path)
    for c in ("deal_status", "payment_type"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    kept = ("event_id", "Announce Date", "Target Name", "Acquirer Name", "deal_status", "payment_type")
    first = df.select(*kept, F.monotonically_increasing_id().alias("row_idx")).groupBy("event_id").agg(F.min_by(F.struct(*kept[1:]), "row_idx").alias("r"), F.min("row_idx").alias("row_idx"))
    return first.select("event_id", "r.*", "row_idx").withColumn("match_key", match_key(F.col("Announce Date"), F.col("Target Name"), F.col("Acquirer Name")))


def probability_table(spark: SparkSession, path: str | None) -> DataFrame:
    """Outcome probabilities by event: none without a path, an error where the path leads nowhere or the table has no event_id."""
    schema = "event_id string, p_completed double, p_terminated double, p_withdrawn double, p_break double"
    if not path:
        return spark.createDataFrame([], schema)
    if not _exists(spark, path):
        raise MissingInput(f"no outcome probabilities at {path}")
    df = require(string_csv(spark, path), ("event_id",), path)
    names = {"p_completed": ("p_completed", "deal_completed_probability"), "p_terminated": ("p_terminated", "deal_terminated_probability"), "p_withdrawn": ("p_withdrawn", "deal_withdrawn_probability"), "p_break": ("p_break", "deal_break_probability")}
    first = lambda options: F.coalesce(*[F.col(c).try_cast("double") for c in options if c in df.columns], F.lit(None).cast("double"))
    return df.select(X.clean(F.col("event_id")).alias("event_id"), *[first(v).alias(k) for k, v in names.items()])


def ticker_table(spark: SparkSession, path: str, least_score: float) -> DataFrame:
    """(cik, ticker) of matched rows that score enough and have a ticker; of a company's rows the last counts."""
    df = optional(spark, path, "cik string, ticker string, matched string, score double").withColumn("row_idx", F.monotonically_increasing_id())
    ok = df.where(X.truthy(F.col("matched")) & (F.col("score") >= least_score) & (X.clean(F.col("ticker")) != ""))
    return ok.groupBy(F.lpad(F.regexp_replace("cik", "[^0-9]", ""), 10, "0").alias("cik")).agg(F.max_by(X.ticker(F.col("ticker")), "row_idx").alias("ticker"))


def cik_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(target_key, cik10): ids set by hand, by the target's normalised name, ten digits wide; rows without an id are left out."""
    df = optional(spark, path, "target_name string, cik string, note string").withColumn("row_idx", F.monotonically_increasing_id())
    digits = F.regexp_replace("cik", "[^0-9]", "")
    ok = df.where(F.coalesce(digits, F.lit("")) != "")
    return ok.groupBy(X.normal_name(F.col("target_name")).alias("target_key")).agg(F.max_by(F.lpad(digits, 10, "0"), "row_idx").alias("cik10"))


def company_tickers(spark: SparkSession, path: str) -> DataFrame:
    """(cik10, ticker, title) from a JSON list of objects or a map of them by number."""
    one = "struct<cik_str:long,ticker:string,title:string>"
    raw = spark.read.text(path, wholetext=True)
    listed = F.ltrim("value").startswith("[")
    rows = F.when(listed, F.from_json("value", f"array<{one}>")).otherwise(F.map_values(F.from_json("value", f"map<string,{one}>")))
    return raw.select(F.explode(rows).alias("r")).where("r.cik_str is not null").select(F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik10"), "r.ticker", "r.title")


def name_history(spark: SparkSession, path: str) -> DataFrame:
    """The dump of securities' names with the windows in which they hold; an open window ends on the last day of time."""
    from .files import SCHEMAS

    df = optional(spark, path, SCHEMAS["name_history"])
    return df.withColumn("nameenddt", F.coalesce("nameenddt", F.to_date(F.lit("9999-12-31"))))
