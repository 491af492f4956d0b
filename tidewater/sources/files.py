"""File sources and sinks: CSV, JSON lines, nested JSON, JDBC options; one schema for each table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of the tables that stages exchange.
SCHEMAS = {
    "deal_export": "row_idx long, announce_date date, target_name string, acquirer_name string, payment_type string, deal_type string, deal_status string, announced_value_mil double, tv_ebitda double, target_ticker string, acquirer_ticker string, target_cusip string, acquirer_cusip string",
    "extraction_long": "event_id string, target_name string, acquirer_name string, field_name string, value string, basis string, timing_bucket string, source_doc_ids string, source_form_types string, source_filing_dates string, evidence_quotes string, confidence string, notes string, parse_error boolean, raw_text string, row_idx long",
    "price_daily": "event_id string, side string, announce_date date, price_date date, price double, open_price double, bid double, ask double, bidlo double, askhi double, volume double, ret double, shares_outstanding double, row_idx long",
    "target_close_dates": "target_cusip string, target_cusip8 string, close_date string, source string",
    "normalized_labels": "event_id string, pct_elected_cash double, pct_elected_stock double, pct_received_cash double, cash_proration_factor double, aggregate_cash_usd double, shares_base double, disclosure_type string, basis string, notes string",
    "holdings": "event_id string, side string, holder_name string, holder_category string, shares double, market_value double, ownership_percent double, report_date date",
    "name_history": "permno string, ticker string, comnam string, ncusip string, cusip string, namedt date, nameenddt date",
    "field_spec": "field_name string, required boolean, description string, timing_bucket string, release_timing string, document_keys array<string>, preferred_forms array<string>, keywords array<string>",
}


class MissingInput(FileNotFoundError):
    """A required input that is not there; says what it is for."""


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def required_csv(spark: SparkSession, path: str, schema: str, purpose: str) -> DataFrame:
    """A CSV table by schema. Values that do not fit their type are null; NaN becomes null."""
    if not _exists(spark, path):
        raise MissingInput(f"{path} is needed for {purpose}")
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", True).csv(path)
    doubles = {f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.withColumns(doubles) if doubles else df


def string_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; empty fields are empty strings, leading zeros stay."""
    df = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "\u0000").option("emptyValue", "").csv(path)
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])


def optional(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """The table, or an empty one of the same schema where it is absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).format(fmt).load(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def field_specs(spark: SparkSession, path: str) -> DataFrame:
    """{"fields": {name: spec}} or a bare map of specs, to one row for each field."""
    spec = "struct<required:boolean,description:string,timing_bucket:string,release_timing:string,document_keys:array<string>,preferred_forms:array<string>,keywords:array<string>>"
    raw = spark.read.text(path, wholetext=True)
    specs = F.coalesce(F.from_json("value", f"struct<fields:map<string,{spec}>>")["fields"], F.from_json("value", f"map<string,{spec}>"))
    return raw.select(F.explode(specs).alias("field_name", "spec")).select("field_name", "spec.*")


def jdbc_prices(spark: SparkSession, url: str, table: str, permnos: Sequence[int], start: str, end: str, chunk: int = 500, **options: str) -> DataFrame:
    """Daily prices from a database: a partition, with a connection of its own, for each chunk of securities and year; the filters go down with the query."""
    years = range(int(start[:4]), int(end[:4]) + 1)
    parts = [sorted(permnos)[i : i + chunk] for i in range(0, len(permnos), chunk)]
    predicates = [
        f"permno IN ({', '.join(str(int(p)) for p in part)}) AND date BETWEEN DATE '{max(start, f'{y}-01-01')}' AND DATE '{min(end, f'{y}-12-31')}'"
        for part in parts
        for y in years
    ]
    return spark.read.jdbc(url, table, predicates=predicates or ["1 = 0"], properties=options)


def schema_report(spark: SparkSession, inputs: dict[str, tuple[str, set[str]]], fmt: str = "csv") -> DataFrame:
    """(table_name, status, missing) for inputs given as name -> (path, columns): MISSING, INVALID or OK. Only schemas are read."""
    rows = []
    for name, (path, need) in inputs.items():
        if not _exists(spark, path):
            rows.append((name, "MISSING", ""))
            continue
        lack = sorted(need - set(spark.read.format(fmt).option("header", True).load(path).columns))
        rows.append((name, "INVALID" if lack else "OK", ",".join(lack)))
    return spark.createDataFrame(rows, "table_name string, status string, missing string")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """An export with a header in each of its files; one_file is for small tables that people open."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def split_sink(df: DataFrame, condition, path: str) -> None:
    """The whole table, and beside it the rows that need review."""
    df.write.mode("overwrite").parquet(f"{path}/all")
    df.where(condition).write.mode("overwrite").parquet(f"{path}/needs_review")
