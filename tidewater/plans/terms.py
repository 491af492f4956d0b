"""Queries of terms out of prose, of addresses and names of filings, and of how values are shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .registry import query

_NOTE = "CONCAT(coalesce(raw, ''), '; subject to proration, cash at ', CAST(id % 130 AS STRING), '.5%', CASE WHEN id % 3 = 0 THEN ', stock election 0.' || CAST(id % 97 AS STRING) WHEN id % 3 = 1 THEN ' and stock at will' ELSE '' END)"
_CLEAN = "CASE WHEN lower(trim({0})) IN ('', 'nan', 'none', 'null', 'not_found', 'not applicable', 'n/a') THEN '' ELSE trim({0}) END"


def _factor(option: str) -> str:
    n = len(option)
    starts = f"list_transform(range(1, len(string_split(t, '{option}'))), lambda i: length(array_to_string(list_slice(string_split(t, '{option}'), 1, i), '{option}')))"
    windows = f"list_filter(list_transform({starts}, lambda s: substr(t, greatest(0, s - 120) + 1, s + {n} + 180 - greatest(0, s - 120))), lambda w: contains(w, 'prorat') OR contains(w, 'election'))"
    value = r"coalesce(TRY_CAST(regexp_extract(w, '([0-9]+(?:\.[0-9]+)?)\s*%', 1) AS DOUBLE) / 100, TRY_CAST(regexp_extract(w, '\b(0\.[0-9]+)\b', 1) AS DOUBLE))"
    picked = f"list_filter(list_transform(CASE WHEN len({windows}) > 0 THEN {windows} WHEN contains(t, '{option}') THEN [t] ELSE [] END, lambda w: {value}), lambda x: x IS NOT NULL)[1]"
    return f"(SELECT CASE WHEN x IS NOT NULL THEN greatest(0e0, least(1e0, CASE WHEN x > 1 AND x <= 100 THEN x / 100 ELSE x END)) END FROM (SELECT {picked} AS x))"


@query("proration_factor", f"WITH p AS (SELECT id, lower({_CLEAN.format(_NOTE)}) AS t FROM {{prose}}) SELECT id, {_factor('cash')} AS cash_fill, {_factor('stock')} AS stock_fill FROM p")
def proration_factor(t):
    """Fills of both options out of windows of prose around their mention."""
    d = t.prose.withColumn("note", F.expr(_NOTE))
    return d.select("id", N.proration_factor(F.col("note"), "cash").alias("cash_fill"), N.proration_factor(F.col("note"), "stock").alias("stock_fill"))


_PLAIN = "lower(replace(CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', 'nan', 'none', 'null', 'not_found', 'not applicable', 'n/a') THEN '' ELSE trim(raw) END, ',', ''))"


@query(
    "cap_fraction",
    rf"""WITH p AS (SELECT id, {_PLAIN} AS t, CASE WHEN id % 9 <> 0 THEN 5e5 * (id % 5) END AS so FROM {{prose}}),
v AS (SELECT id, t, so, TRY_CAST(regexp_extract(t, '([0-9]+(?:\.[0-9]+)?)\s*%', 1) AS DOUBLE) AS pct, TRY_CAST(regexp_extract(t, '\b([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\b', 1) AS DOUBLE) AS a,
  TRY_CAST(regexp_extract(t, '\b([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\b', 2) AS DOUBLE) AS b, TRY_CAST(regexp_extract(t, '\b(0\.[0-9]+)\b', 1) AS DOUBLE) AS dec, TRY_CAST(regexp_extract(t, '(-?[0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS whole FROM p)
SELECT id, coalesce(pct / 100, a / nullif(b, 0e0), dec, CASE WHEN whole > 1 AND whole <= 100 AND (contains(t, 'percent') OR contains(t, 'pct')) THEN whole / 100 END,
  CASE WHEN regexp_matches(t, 'one-half|one half|half of|fifty percent') THEN 5e-1 END, CASE WHEN so > 0 AND whole > 100 THEN greatest(0e0, least(1e0, CASE WHEN whole / so > 1 AND whole / so <= 100 THEN whole / so / 100 ELSE whole / so END)) END) AS cap FROM v""",
)
def cap_fraction(t):
    out = F.when(F.col("id") % 9 != 0, 5e5 * (F.col("id") % 5))
    return t.prose.select("id", N.cap_fraction(F.col("raw"), out).alias("cap"))


_KINDS = "CASE id % 7 WHEN 0 THEN 'Cash or  Stock' WHEN 1 THEN 'cash and stock' WHEN 2 THEN raw WHEN 3 THEN 'stock, some cash' WHEN 4 THEN 'Mixed' WHEN 5 THEN repeat('long text ', 12) ELSE 'n/a' END"


@query(
    "category_normalize",
    rf"""WITH p AS (SELECT id, {_KINDS} AS c FROM {{prose}}), v AS (SELECT id, regexp_replace(lower(CASE WHEN c IS NULL OR lower(trim(c)) IN ('', 'nan', 'none', 'null', 'not_found', 'not applicable', 'n/a') THEN '' ELSE trim(c) END), '\s+', ' ', 'g') AS t FROM p)
SELECT id, CASE WHEN t = '' THEN '__missing__' WHEN contains(t, 'cash or stock') THEN 'cash_or_stock' WHEN contains(t, 'cash and stock') THEN 'cash_and_stock' WHEN contains(t, 'cash') AND NOT contains(t, 'stock') THEN 'cash'
  WHEN contains(t, 'stock') AND NOT contains(t, 'cash') THEN 'stock' WHEN contains(t, 'mixed') OR (contains(t, 'cash') AND contains(t, 'stock')) THEN 'mixed' ELSE substr(t, 1, 80) END AS category FROM v""",
)
def category_normalize(t):
    return t.prose.select("id", X.category(F.expr(_KINDS)).alias("category"))


@query("date_window", "SELECT event_id, announce_date - 30 AS start_date, announce_date + 400 AS end_date FROM {deals}")
def date_window(t):
    a, b = N.date_window(F.col("announce_date"), 30, 400)
    return t.deals.select("event_id", a.alias("start_date"), b.alias("end_date"))


@query("nested_path", "SELECT event_id, deal_type, CAST(value_mil > 100 AS VARCHAR) AS large, CASE WHEN event_id % 2 = 0 THEN '{\"unit\":\"mil\"}' END AS rest FROM {deals}")
def nested_path(t):
    """Values at paths of a record's JSON."""
    value = F.struct(F.col("deal_type").alias("kind"), (F.col("value_mil") > 100).alias("large"), F.when(F.col("event_id") % 2 == 0, F.struct(F.lit("mil").alias("unit"))).alias("rest"))
    d = t.deals.select("event_id", F.to_json(F.struct(F.struct(value.alias("value")).alias("deal"))).alias("raw"))
    at = lambda x: X.path_value(F.col("raw"), "deal", "value", x)
    return d.select("event_id", at("kind").alias("deal_type"), at("large").alias("large"), at("rest").alias("rest"))


_ACC = "lpad(CAST(doc_id AS VARCHAR), 10, '0') || '-20-' || lpad(CAST(doc_id % 1000 AS VARCHAR), 6, '0')"


@query(
    "filing_urls",
    f"""WITH a AS (SELECT doc_id, 'https://archive.example/data/' || CAST(doc_id AS VARCHAR) || '/' || replace({_ACC}, '-', '') || '/' AS b, {_ACC} AS acc FROM documents)
SELECT doc_id, b AS base_url, b || 'main.htm' AS primary_url, b || acc || '.txt' AS complete_txt_url, b || 'index.json' AS index_json_url FROM a""",
)
def filing_urls(t):
    acc = F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit("-20-"), F.lpad((F.col("doc_id") % 1000).cast("string"), 6, "0"))
    made = X.filing_urls("https://archive.example/data", F.col("doc_id"), acc, F.lit("main.htm"))
    return t.documents.select("doc_id", *[c.alias(k) for k, c in made.items()])


@query(
    "name_candidates",
    """WITH h AS (SELECT n_name AS query_name, c.c_name || '  ' || CASE WHEN c.c_custkey % 3 = 0 THEN '' ELSE '(T' || CAST(c.c_custkey % 40 AS VARCHAR) || ')  ' END || CASE WHEN c.c_custkey % 5 = 0 THEN '(no id)' ELSE '(CIK ' || lpad(CAST(c.c_custkey % 200 AS VARCHAR), 10, '0') || ')' END AS shown, c.c_custkey AS pos
  FROM customer c JOIN nation ON n_nationkey = c_nationkey),
p AS (SELECT query_name, pos, regexp_extract(shown, '\\(CIK ([0-9]{10})\\)', 1) AS cik10, trim(string_split(shown, '  (')[1]) AS name, regexp_extract(shown, '\\(([A-Z][A-Z0-9.-]{0,6})\\)\\s*\\(CIK', 1) AS ticker FROM h)
SELECT query_name, cik10, min_by(name, pos) AS name, min_by(ticker, pos) AS ticker, count(*) AS freq FROM p WHERE cik10 <> '' GROUP BY query_name, cik10""".replace("\\\\", "\\"),
)
def name_candidates(t):
    """Ids out of the display names of search hits: how often each occurs, with the name and ticker that it has first."""
    key = F.col("c_custkey")
    tick = F.when(key % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("(T"), (key % 40).cast("string"), F.lit(")  ")))
    cik = F.when(key % 5 == 0, F.lit("(no id)")).otherwise(F.concat(F.lit("(CIK "), F.lpad((key % 200).cast("string"), 10, "0"), F.lit(")")))
    hits = t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("n_name").alias("query_name"), F.concat("c_name", F.lit("  "), tick, cik).alias("shown"), key.alias("pos"))
    parts = hits.select("query_name", "pos", *[c.alias(k) for k, c in X.display_name_parts(F.col("shown")).items()]).where("cik10 is not null")
    return parts.groupBy("query_name", "cik10").agg(F.min_by("name", "pos").alias("name"), F.min_by("ticker", "pos").alias("ticker"), F.count(F.lit(1)).alias("freq"))


@query("display_values", "SELECT event_id, CASE WHEN f_cash IS NULL THEN 'n/a' ELSE '$' || format('{{:,}}', CAST(round_even(value_mil * 1e3, 0) AS BIGINT)) END AS money, CASE WHEN f_cash IS NULL THEN 'n/a' ELSE printf('%.2f%%', pi_cash * 1e2) END AS percent FROM {deals} WHERE value_mil * 1e3 - floor(value_mil * 1e3) NOT BETWEEN 49e-2 AND 51e-2 AND (pi_cash * 1e4 - floor(pi_cash * 1e4) NOT BETWEEN 49e-2 AND 51e-2 OR pi_cash IS NULL)".replace("'{{:,}}'", "'{:,}'"))
def display_values(t):
    """Values as people read them; rows half way between two of them are left to the rounding of neither side."""
    half = lambda x: ~(x - F.floor(x)).between(0.49, 0.51)
    d = t.deals.where(half(F.col("value_mil") * 1e3) & (half(F.col("pi_cash") * 1e4) | F.col("pi_cash").isNull()))
    known = F.col("f_cash").isNotNull()
    return d.select("event_id", N.display_money(F.when(known, F.col("value_mil") * 1e3)).alias("money"), N.display_percent(F.when(known, F.col("pi_cash") * 1e2)).alias("percent"))


@query("number_or_null", "SELECT event_id, TRY_CAST(substr(payment_type, 1, 1) AS DOUBLE) AS grade, CAST(NULL AS DOUBLE) AS absent, 0e0 AS filled FROM {deals}")
def number_or_null(t):
    """Columns that a table may lack."""
    d = t.deals.withColumn("grade", F.substring("payment_type", 1, 1))
    return d.select("event_id", N.number_or_null(d.columns, "grade").alias("grade"), N.number_or_null(d.columns, "spread").alias("absent"), N.number_or_null(d.columns, "shares", 0.0).alias("filled"))


@query("max_events", "SELECT event_id, announce_date FROM (SELECT event_id, announce_date, row_number() OVER (ORDER BY announce_date, event_id) AS r FROM {deals}) WHERE r <= 250")
def max_events(t):
    """The first events in order, as many as a run is limited to."""
    return t.deals.select("event_id", "announce_date").orderBy("announce_date", "event_id").limit(250)
