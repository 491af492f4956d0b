"""From an index of filings to evidence: which documents count for an event, what their texts say, and the payload that a reader is given."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filings as L
from .asof import best_row


@dataclass(frozen=True)
class FilingConfig:
    forms: tuple[str, ...] = ("8-K", "S-4", "DEFM14A", "EX-99.1")
    before: int = 60
    after: int = 400
    head: int = 6
    tail: int = 4
    keywords: tuple[str, ...] = ("the", "and", "of")
    core: tuple[str, ...] = ("and",)
    documents: int = 5
    snippet_before: int = 40
    snippet_after: int = 80
    snippets: int = 2


def selected(docs: DataFrame, events: DataFrame, cfg: FilingConfig) -> DataFrame:
    """The documents of each event that have a wanted form (amendments count as their form) and were filed in the window around its announcement; of a side with more
    than head + tail of them, the first head and the last tail by date. docs: event_id, doc_id, side, form, filing_date; events: event_id, announce_date."""
    form = F.regexp_replace(F.upper(F.trim("form")), "/A$", "")
    days = F.datediff("filing_date", "announce_date")
    d = docs.join(events.select("event_id", "announce_date"), "event_id").where(form.isin(*cfg.forms) & days.between(-cfg.before, cfg.after))
    first = best_row(d.select("event_id", "side", "doc_id", "filing_date"), ["event_id", "side"], [F.col("filing_date"), F.col("doc_id")], cfg.head)
    last = best_row(d.select("event_id", "side", "doc_id", "filing_date"), ["event_id", "side"], [F.col("filing_date").desc(), F.col("doc_id").desc()], cfg.tail)
    return d.join(first.unionByName(last).select("event_id", "doc_id").distinct(), ["event_id", "doc_id"], "left_semi")


def evidence(docs: DataFrame, text: Column, cfg: FilingConfig) -> DataFrame:
    """docs with score (keywords and the form's bonus) and snippets of their text, those without any keyword left out."""
    lower = F.lower(text)
    hits = L.keyword_score(lower, cfg.keywords, cfg.core)
    d = docs.withColumns({"hits": hits, "score": hits + L.form_bonus(F.col("form"), cfg.forms), "snippets": L.snippets(lower, cfg.keywords, cfg.snippet_before, cfg.snippet_after, cfg.snippets)})
    return d.where("hits > 0")


def payloads(found: DataFrame, fields: DataFrame, requested: Sequence[str], cfg: FilingConfig) -> DataFrame:
    """(event_id, payload, documents, tokens): for each event one JSON text with the fields asked for, what is known of them, and its best documents with their
    snippets. found: event_id, doc_id, side, form, filing_date, score, snippets; fields: event_id, field_name, value."""
    best = best_row(found, ["event_id"], [F.col("score").desc(), F.col("filing_date"), F.col("doc_id")], cfg.documents)
    docs = best.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "filing_date", "doc_id", "form", "side", "snippets"))).alias("d"))
    docs = docs.select("event_id", F.transform("d", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["form"].alias("form"), x["side"].alias("side"), x["filing_date"].cast("string").alias("filing_date"), x["snippets"].alias("snippets"))).alias("documents"))
    known = fields.where(F.col("field_name").isin(*requested) & F.col("value").isNotNull()).groupBy("event_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field_name", "value")))).alias("evidence"))
    j = docs.join(known, "event_id", "full")
    body = F.to_json(F.struct("event_id", F.array(*[F.lit(x) for x in requested]).alias("requested"), F.coalesce("evidence", F.create_map().cast("map<string,string>")).alias("evidence"), F.coalesce("documents", F.array().cast(docs.schema["documents"].dataType)).alias("documents")))
    return j.select("event_id", body.alias("payload"), F.coalesce(F.size("documents"), F.lit(0)).alias("documents"), F.ceil(F.length(body) / 3).alias("tokens"))
