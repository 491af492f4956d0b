"""Label normalisation: what is asked for each event, and the answers merged back field by field, checked against a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean
from .groups import pivot_first

#: What an answer may say of a disclosure and of its basis.
DISCLOSURES = ("elected_pct", "elected_shares_derived", "received_or_allocated", "dollars_only", "proration_factor_only", "oversubscribed_qualitative", "not_disclosed")
BASES = ("direct", "derived", "not_found")
MISSING = ("", "nan", "none", "null", "not disclosed", "not found", "n/a")
#: Numbers of an answer with the range that they must lie in (null: none).
NUMBERS = {"pct_elected_cash": (0.0, 100.0), "pct_elected_stock": (0.0, 100.0), "pct_received_cash": (0.0, 100.0), "cash_proration_factor": (0.0, 1.0), "aggregate_cash_usd": (0.0, None), "shares_base": (0.0, None)}
TEXTS = ("disclosure_type", "basis", "notes")


def requests(extraction: DataFrame, labels: Sequence[str], context: Sequence[str]) -> DataFrame:
    """(event_id, fields, payload) for each event with a value in one of the label fields: the first values of labels and context as columns, and as JSON. Missing tokens are null.
    extraction: event_id, field_name, value, row_idx."""
    fields = [*labels, *context]
    wide = pivot_first(extraction, "event_id", "field_name", "value", "row_idx", fields)
    wide = wide.select("event_id", *[F.nullif(clean(F.col(f), MISSING), F.lit("")).alias(f) for f in fields])
    raw = F.struct(*[F.col(f).alias(f) for f in fields])
    payload = F.to_json(F.struct(F.lit("normalize_election_results").alias("task"), F.col("event_id").cast("string").alias("event_id"), raw.alias("raw_disclosure")), {"ignoreNullFields": "false"})
    return wide.where(F.coalesce(*labels).isNotNull()).withColumn("payload", payload)


def braces(c: Column) -> Column:
    """What is from the first brace to the last."""
    start = F.instr(c, "{")
    return F.when(start > 0, F.substr(c, start, F.length(c) - F.instr(F.reverse(c), "}") + 2 - start))


def merged(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """(event_id, NUMBERS, TEXTS, status) for each answer (event_id, response) and for each event asked without one.

    An answer counts whole or not at all: `ok`; `parse_error` without a JSON object; `bad_FIELD` where a number is none or out of its range, or a word is not one of those
    allowed (the first such field); `not_requested`; `no_answer`. Of several answers to an event the first usable one by its text counts.
    """
    read = F.from_json(braces(F.col("response")), "map<string,string>")
    got = answers.select("event_id", "response", read.alias("_read"))
    faults, columns = [], {}
    for name, (low, high) in NUMBERS.items():
        raw = F.nullif(F.trim(F.col("_read")[name]), F.lit("null"))
        value = raw.try_cast("double")
        inside = (value >= low) & (value <= high) if high is not None else value >= low
        faults.append(F.when(raw.isNotNull() & ~F.coalesce(inside, F.lit(False)), f"bad_{name}"))
        columns[name] = value
    for name in TEXTS:
        raw = F.nullif(F.trim(F.col("_read")[name]), F.lit("null"))
        allowed = {"disclosure_type": DISCLOSURES, "basis": BASES}.get(name)
        if allowed:
            faults.append(F.when(raw.isNotNull() & ~raw.isin(*allowed), f"bad_{name}"))
        columns[name] = raw
    known = asked.select("event_id", F.lit(True).alias("_asked"))
    d = got.join(known, "event_id", "full")
    status = F.when(F.col("_asked").isNull(), "not_requested").when(F.col("response").isNull(), "no_answer").when(F.col("_read").isNull() | (F.size("_read") == 0), "parse_error").otherwise(F.coalesce(*faults, F.lit("ok")))
    d = d.withColumn("status", status)
    ok = F.col("status") == "ok"
    d = d.select("event_id", "response", *[F.when(ok, c).alias(k) for k, c in columns.items()], "status")
    keep = [c for c in d.columns if c not in ("event_id", "response")]
    best = d.groupBy("event_id").agg(F.min_by(F.struct(*keep), F.struct(F.col("status") != "ok", F.coalesce("response", F.lit("")))).alias("best"))
    return best.select("event_id", "best.*")
