"""Queries of filing texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import asof as A
from ..operators import filing_pipeline as R
from ..operators import filings as L
from .registry import query

WORDS, CORE = ("the", "and", "is", "which", "une"), ("and", "une")
_LOWER = "lower(text)"


def _count(w):
    return f"CAST((length({_LOWER}) - length(replace({_LOWER}, '{w}', ''))) / {len(w)} AS INT)"


@query("keyword_score", "SELECT doc_id, " + " + ".join(f"{_count(w)} * {4 if w in CORE else 1}" for w in WORDS) + " AS score FROM {filings}")
def keyword_score(t):
    return t.filings.select("doc_id", L.keyword_score(F.lower("text"), WORDS, CORE).alias("score"))


def _snip(w):
    at = f"instr({_LOWER}, '{w}')"
    return f"CASE WHEN {at} > 0 THEN trim(substr({_LOWER}, greatest(1, {at} - 30), {at} + {len(w)} + 30 - greatest(1, {at} - 30))) END"


@query("snippets", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(_snip(w) for w in WORDS) + "], lambda x: x IS NOT NULL)[1:3], ' ||| ') AS snippets FROM {filings}")
def snippets(t):
    return t.filings.select("doc_id", L.snippets(F.lower("text"), WORDS, 30, 30, 3).alias("snippets"))


PHRASES, FORMS = ("and the", "the", "of"), ("8-K", "S-4")
_FORM_BONUS = "CASE WHEN upper(form) IN ('8-K', 'S-4') THEN 12 WHEN regexp_replace(upper(form), '/A$', '') IN ('8-K', 'S-4') THEN 9 WHEN starts_with(upper(form), 'EX-99') THEN 8 ELSE 0 END"
_FIELD = "len(regexp_extract_all(lower(text), '\\band[^a-z0-9]+the\\b')) * 4 + len(regexp_extract_all(lower(text), '\\bthe\\b')) + len(regexp_extract_all(lower(text), '\\bof\\b'))"


def ascii_text():
    """Letters beyond ASCII become spaces: engines differ on word boundaries next to them."""
    return F.regexp_replace(F.lower("text"), "[^\\x00-\\x7F]", " ")


_ASCII = r"regexp_replace(lower(text), '[^\x00-\x7F]', ' ', 'g')"


@query("field_score", f"WITH s AS (SELECT doc_id, form, {_FIELD.replace('lower(text)', _ASCII)} AS hits FROM {{filings}}) SELECT doc_id, CASE WHEN hits > 0 THEN hits + {_FORM_BONUS} ELSE 0 END AS score, {_FORM_BONUS} AS form_bonus FROM s")
def field_score(t):
    bonus = L.form_bonus(F.col("form"), FORMS)
    return t.filings.select("doc_id", L.field_score(ascii_text(), PHRASES, bonus).cast("long").alias("score"), bonus.alias("form_bonus"))


@query(
    "proximity_bonus",
    """WITH c AS (SELECT event_id, max(filing_date) - 200 AS close_date FROM {filings} GROUP BY event_id)
SELECT doc_id, CAST(filing_date - close_date AS INT) AS days, CASE WHEN abs(filing_date - close_date) <= 45 THEN 25 WHEN abs(filing_date - close_date) <= 120 THEN 10 WHEN abs(filing_date - close_date) <= 270 THEN 3 ELSE 0 END AS bonus
FROM {filings} f JOIN c ON c.event_id = f.event_id WHERE form <> '8-K' OR filing_date - close_date >= -30""",
)
def proximity_bonus(t):
    """Label evidence from more than 30 days before the close goes; the nearer the rest, the more it counts."""
    close = t.filings.groupBy("event_id").agg(F.date_sub(F.max("filing_date"), 200).alias("close_date"))
    days = F.datediff("filing_date", "close_date")
    j = t.filings.join(close, "event_id").where((F.col("form") != "8-K") | (days >= -30))
    return j.select("doc_id", days.alias("days"), L.proximity_bonus(days).alias("bonus"))


@query(
    "topk_evidence",
    f"""WITH s AS (SELECT event_id, doc_id, form, filing_date, form IN ('8-K', 'EX-99.1') AS label, {_count("and")} AS score FROM {{filings}})
SELECT event_id, doc_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id, label ORDER BY score DESC, CASE WHEN label THEN -(filing_date - DATE '2000-01-01') ELSE filing_date - DATE '2000-01-01' END, doc_id) AS r FROM s) WHERE r <= 3""",
)
def topk_evidence(t):
    """The three best rows of each kind: of equal scores the latest for labels, the earliest for terms."""
    d = t.filings.select("event_id", "doc_id", "filing_date", F.col("form").isin("8-K", "EX-99.1").alias("label"), L.occurrences(F.lower("text"), "and").alias("score"))
    day = F.datediff("filing_date", F.lit("2000-01-01").cast("date"))
    best = A.best_row(d, ["event_id", "label"], [F.col("score").desc(), F.when(F.col("label"), -day).otherwise(day), F.col("doc_id")], 3)
    return best.select("event_id", "doc_id", "label", "score")


@query(
    "doc_select",
    f"""WITH s AS (SELECT event_id, side, form, {_count("and")} AS score, filing_date FROM {{filings}} WHERE form <> 'DEFM14A')
SELECT event_id, side, sum(score) AS total, max(score) AS most, array_to_string(list_sort(list_distinct(list(form))), ';') AS forms, count(*) AS docs FROM s GROUP BY event_id, side""",
)
def doc_select(t):
    d = t.filings.where("form <> 'DEFM14A'").select("event_id", "side", "form", L.occurrences(F.lower("text"), "and").alias("score"))
    return d.groupBy("event_id", "side").agg(F.sum("score").alias("total"), F.max("score").alias("most"), F.array_join(F.array_sort(F.collect_set("form")), ";").alias("forms"), F.count(F.lit(1)).alias("docs"))


PIPE = R.FilingConfig()
_BASE = "regexp_replace(upper(trim(form)), '/A$', '')"
_HITS = " + ".join(f"CAST((length(lower(text)) - length(replace(lower(text), '{w}', ''))) / {len(w)} AS INT) * {4 if w in PIPE.core else 1}" for w in PIPE.keywords)
_BONUS = f"CASE WHEN upper(form) IN {PIPE.forms} THEN 12 WHEN {_BASE} IN {PIPE.forms} THEN 9 WHEN starts_with(upper(form), 'EX-99') THEN 8 ELSE 0 END"
_SNIP = ", ".join(f"CASE WHEN instr(lower(text), '{w}') > 0 THEN trim(substr(lower(text), greatest(1, instr(lower(text), '{w}') - 40), instr(lower(text), '{w}') + {len(w)} + 80 - greatest(1, instr(lower(text), '{w}') - 40)), ' ') END" for w in PIPE.keywords)
PIPE_SQL = f"""ev AS (SELECT event_id, min(filing_date) + 30 AS announce_date FROM {{filings}} GROUP BY event_id),
pd AS (SELECT f.*, f.filing_date - announce_date AS days FROM {{filings}} f JOIN ev ON ev.event_id = f.event_id WHERE {_BASE} IN {PIPE.forms} AND f.filing_date - announce_date BETWEEN -60 AND 400),
ps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id, side ORDER BY filing_date, doc_id) AS a, row_number() OVER (PARTITION BY event_id, side ORDER BY filing_date DESC, doc_id DESC) AS z FROM pd) WHERE a <= 6 OR z <= 4),
pe AS (SELECT event_id, doc_id, side, form, filing_date, {_HITS} AS hits, {_HITS} + {_BONUS} AS score, array_to_string(list_slice(list_filter([{_SNIP}], lambda x: x IS NOT NULL), 1, 2), ' ||| ') AS snippets FROM ps WHERE {_HITS} > 0)"""


def _evidence(t):
    events = t.filings.groupBy("event_id").agg(F.date_add(F.min("filing_date"), 30).alias("announce_date"))
    return R.evidence(R.selected(t.filings, events, PIPE), F.col("text"), PIPE)


@query("filing_pipeline", f"WITH {PIPE_SQL} SELECT event_id, doc_id, score, md5(snippets) AS snippets FROM pe")
def filing_pipeline(t):
    """From the index of filings to scored evidence: forms and dates, the first and last documents of a side, keywords, snippets."""
    return _evidence(t).select("event_id", "doc_id", "score", F.md5(F.col("snippets").cast("binary")).alias("snippets"))


_FIELDS = ("click", "purchase", "view")


@query(
    "payload_build",
    f"""WITH {PIPE_SQL}, pk AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, filing_date, doc_id) AS r FROM pe),
pv AS (SELECT 'src' || CAST(event_id % 20 AS VARCHAR) AS event_id, field_name, min_by(value, row_idx) AS value FROM {{extraction}} WHERE value IS NOT NULL AND field_name IN {_FIELDS} GROUP BY ALL),
ek AS (SELECT event_id, count(*) AS fields FROM pv GROUP BY event_id), dk AS (SELECT event_id, count(*) AS documents, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY score DESC, filing_date, doc_id) AS ids FROM pk WHERE r <= 5 GROUP BY event_id)
SELECT coalesce(dk.event_id, ek.event_id) AS event_id, coalesce(documents, 0) AS documents, coalesce(ids, '') AS ids, coalesce(fields, 0) AS fields FROM dk FULL JOIN ek ON ek.event_id = dk.event_id""",
)
def payload_build(t):
    """One nested JSON payload for each event: the fields asked for, what is known of them, and its best documents with their snippets. Read back here
    for what it holds."""
    made = payloads(t)
    back = F.from_json("payload", "struct<evidence:map<string,string>,documents:array<struct<doc_id:long>>>")
    d = made.select("event_id", F.col("documents").cast("long").alias("documents"), back.alias("b"))
    return d.select("event_id", "documents", F.array_join(F.transform("b.documents.doc_id", lambda x: x.cast("string")), ",").alias("ids"), F.size("b.evidence").cast("long").alias("fields"))


def payloads(t):
    event = F.concat(F.lit("src"), (F.col("event_id") % 20).cast("string"))
    fields = t.extraction.where("value is not null").groupBy(event.alias("event_id"), "field_name").agg(F.min_by("value", "row_idx").alias("value"))
    return R.payloads(_evidence(t), fields, _FIELDS, PIPE)
