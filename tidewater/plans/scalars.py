"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from .registry import query

_CLEAN = "CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', 'nan', 'none', 'null', 'not_found', 'not applicable', 'n/a') THEN '' ELSE trim(raw) END"
_PLAIN = f"replace({_CLEAN}, ',', '')"


@query("clean_str", f"SELECT id, {_CLEAN} AS cleaned, CASE WHEN raw IS NULL OR lower(trim(raw)) IN ('', 'nan', 'none', 'null') THEN '' ELSE trim(raw) END AS cleaned_adapter FROM {{prose}}")
def clean_str(t):
    return t.prose.select("id", X.clean(F.col("raw")).alias("cleaned"), X.clean(F.col("raw"), X.MISSING_ADAPTER).alias("cleaned_adapter"))


@query("first_number", f"SELECT id, TRY_CAST(regexp_extract({_PLAIN}, '(-?[0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) AS x FROM {{prose}}")
def first_number(t):
    return t.prose.select("id", N.first_number(F.col("raw")).alias("x"))


@query(
    "bounded_number",
    r"""SELECT id, list_filter(list_transform(regexp_extract_all(replace(raw, ',', ''), '([0-9]+\.?[0-9]*)', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x BETWEEN 1 AND 2000)[1] AS cash_value,
  list_filter(list_transform(regexp_extract_all(replace(raw, ',', ''), '([0-9]+\.?[0-9]*)', 1), lambda x: TRY_CAST(x AS DOUBLE)), lambda x: x BETWEEN 2e-2 AND 5)[1] AS ratio FROM {prose}""",
)
def bounded_number(t):
    return t.prose.select("id", N.bounded_number(F.col("raw"), 1, 2000).alias("cash_value"), N.bounded_number(F.col("raw"), 0.02, 5).alias("ratio"))


@query(
    "percent_parse",
    r"""WITH p AS (SELECT id, replace(raw, ',', '') AS t FROM {prose}),
v AS (SELECT id, TRY_CAST(regexp_extract(t, '([0-9]+\.?[0-9]*)\s*%', 1) AS DOUBLE) AS pct, TRY_CAST(regexp_extract(t, '(?:^|[^0-9.])(0?\.[0-9]+)', 1) AS DOUBLE) AS fr,
  TRY_CAST(regexp_extract(t, '([0-9]{1,3}(?:\.[0-9]+)?)\s*%', 1) AS DOUBLE) AS small FROM p)
SELECT id, CASE WHEN coalesce(pct, CASE WHEN fr BETWEEN 0 AND 1 THEN fr * 100 END) BETWEEN 0 AND 100 THEN coalesce(pct, CASE WHEN fr BETWEEN 0 AND 1 THEN fr * 100 END) END AS pct,
  CASE WHEN small BETWEEN 1 AND 99 THEN small / 100 END AS pct_fraction FROM v""",
)
def percent_parse(t):
    return t.prose.select("id", N.percent(F.col("raw")).alias("pct"), N.percent_fraction(F.replace(F.col("raw"), F.lit(","), F.lit(""))).alias("pct_fraction"))


@query(
    "fraction_ladder",
    rf"""WITH p AS (SELECT id, lower({_PLAIN}) AS t FROM {{prose}}),
v AS (SELECT id, t, TRY_CAST(regexp_extract(t, '([0-9]+(?:\.[0-9]+)?)\s*%', 1) AS DOUBLE) AS pct, TRY_CAST(regexp_extract(t, '\b([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\b', 1) AS DOUBLE) AS a,
  TRY_CAST(regexp_extract(t, '\b([0-9]+(?:\.[0-9]+)?)\s*/\s*([0-9]+(?:\.[0-9]+)?)\b', 2) AS DOUBLE) AS b, TRY_CAST(regexp_extract(t, '\b(0\.[0-9]+)\b', 1) AS DOUBLE) AS dec,
  TRY_CAST(regexp_extract(t, '(-?[0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE) AS whole FROM p)
SELECT id, coalesce(pct / 100, a / nullif(b, 0e0), dec, CASE WHEN whole > 1 AND whole <= 100 AND (contains(t, 'percent') OR contains(t, 'pct')) THEN whole / 100 END,
  CASE WHEN regexp_matches(t, 'one-half|one half|half of|fifty percent') THEN 5e-1 END) AS fraction,
  CASE WHEN contains(t, '%') THEN greatest(0e0, least(1e0, CASE WHEN whole / 100 > 1 AND whole / 100 <= 100 THEN whole / 10000 ELSE whole / 100 END)) WHEN whole BETWEEN 0 AND 1 THEN whole
    WHEN whole > 1 AND whole <= 100 AND regexp_matches(t, 'percent|pct|share') THEN whole / 100
    WHEN whole IS NOT NULL THEN greatest(0e0, least(1e0, CASE WHEN whole / 5e5 > 1 AND whole / 5e5 <= 100 THEN whole / 5e5 / 100 ELSE whole / 5e5 END)) END AS share FROM v""",
)
def fraction_ladder(t):
    return t.prose.select("id", N.fraction(F.col("raw")).alias("fraction"), N.share(F.col("raw"), F.lit(5e5)).alias("share"))


@query(
    "money_ratio_parse",
    rf"""WITH p AS (SELECT id, {_PLAIN} AS t FROM {{prose}})
SELECT id, coalesce(TRY_CAST(regexp_extract(t, '\$\s*([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE), TRY_CAST(regexp_extract(t, '(?i)\b([0-9]+(?:\.[0-9]+)?)\s*(?:dollars?|usd)\b', 1) AS DOUBLE)) AS money,
  coalesce(TRY_CAST(regexp_extract(lower(t), 'exchange ratio (?:of )?([0-9]+(?:\.[0-9]+)?)', 1) AS DOUBLE), TRY_CAST(regexp_extract(lower(t), '([0-9]+(?:\.[0-9]+)?)\s*(?:share|shares)\s+of', 1) AS DOUBLE),
    TRY_CAST(regexp_extract(lower(t), '\b([0-9]+(?:\.[0-9]+)?)\s*:\s*1\b', 1) AS DOUBLE), TRY_CAST(regexp_extract(lower(t), '\b([0-9]+(?:\.[0-9]+)?)\b', 1) AS DOUBLE)) AS exchange_ratio FROM p""",
)
def money_ratio_parse(t):
    return t.prose.select("id", N.money(F.col("raw")).alias("money"), N.exchange_ratio(F.col("raw")).alias("exchange_ratio"))


@query("ratio_type_flag", r"SELECT id, CASE WHEN raw IS NOT NULL AND regexp_matches(raw, '(?i)vwap|÷|floating|average (trading|closing|share) price|/\s*\w+\s*(10|5|20)[- ]day|collar') THEN 'floating' ELSE 'fixed' END AS ratio_type FROM {prose}")
def ratio_type_flag(t):
    return t.prose.select("id", X.ratio_type(F.col("raw")).alias("ratio_type"))


@query(
    "date_extract",
    r"""SELECT id, coalesce(CAST(try_strptime(nullif(regexp_extract(raw, '\b([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})\b', 1), ''), '%Y-%m-%d') AS DATE),
  CAST(try_strptime(nullif(regexp_extract(raw, '\b([0-9]{1,2}/[0-9]{1,2}/[0-9]{4})\b', 1), ''), '%m/%d/%Y') AS DATE),
  CAST(try_strptime(nullif(regexp_extract(raw, '\b((?:January|February|March|April|May|June|July|August|September|October|November|December) [0-9]{1,2}, [0-9]{4})\b', 1), ''), '%B %d, %Y') AS DATE)) AS d FROM {prose}""",
)
def date_extract(t):
    return t.prose.select("id", N.date_in(F.col("raw")).alias("d"))


@query(
    "quarter_lag",
    """SELECT event_id, CAST(year(announce_date - INTERVAL 3 MONTH) AS INT) AS year_1, CAST(quarter(announce_date - INTERVAL 3 MONTH) AS INT) AS quarter_1,
  CAST(year(date_trunc('quarter', announce_date) - INTERVAL 15 MONTH) AS INT) AS year_5, CAST(quarter(date_trunc('quarter', announce_date) - INTERVAL 15 MONTH) AS INT) AS quarter_5,
  CAST(greatest(1, announce_date - DATE '1998-01-01') AS INT) AS elapsed FROM {deals}""",
)
def quarter_lag(t):
    (y1, q1), (y5, q5) = N.quarter_before(F.col("announce_date"), 1), N.quarter_before(F.col("announce_date"), 5)
    return t.deals.select("event_id", y1.alias("year_1"), q1.alias("quarter_1"), y5.alias("year_5"), q5.alias("quarter_5"), N.elapsed_days(F.lit("1998-01-01").cast("date"), F.col("announce_date"), 30).alias("elapsed"))


_FILE = "substr(regexp_replace(regexp_replace(regexp_replace({0}, '[^A-Za-z0-9._ -]+', '_', 'g'), '\\s+', '_', 'g'), '^[._ -]+|[._ -]+$', '', 'g'), 1, 45)"


@query(
    "event_id_build",
    f"""WITH e AS (SELECT d.event_id, 'E' || lpad(CAST(d.event_id AS VARCHAR), CAST(greatest(6, length(CAST(d.event_id AS VARCHAR))) AS INT), '0') || '_' || strftime(announce_date, '%Y%m%d') || '_' || {_FILE.format("c_name || ' & Sons (Ltd)'")} || '__' || {_FILE.format("payment_type")} AS id
  FROM {{deals}} d JOIN customer ON c_custkey = party)
SELECT event_id, id, CAST(strptime(regexp_extract(id, '^E[0-9]+_([0-9]+)_', 1), '%Y%m%d') AS DATE) AS parsed FROM e""",
)
def event_id_build(t):
    key = F.col("event_id").cast("string")
    made = F.concat(F.lit("E"), F.lpad(key, F.greatest(F.lit(6), F.length(key)), F.lit("0")), F.lit("_"), F.date_format("announce_date", "yyyyMMdd"), F.lit("_"), X.file_name(F.concat("c_name", F.lit(" & Sons (Ltd)")), 45), F.lit("__"), X.file_name(F.col("payment_type"), 45))
    d = t.deals.join(t.customer, F.col("c_custkey") == F.col("party")).select("event_id", made.alias("id"))
    return d.withColumn("parsed", F.to_date(F.regexp_extract("id", "^E[0-9]+_([0-9]+)_", 1), "yyyyMMdd"))


@query(
    "name_normalize",
    r"""SELECT s_suppkey, trim(regexp_replace(lower(s_name || ' & Co. (Old) Holdings'), '[^a-z0-9]+', ' ', 'g')) AS plain,
  array_to_string(list_filter(regexp_split_to_array(regexp_replace(replace(regexp_replace(lower(s_name || ' & Co. (Old) Holdings'), '\([^)]*\)', ' ', 'g'), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), '\s+'),
    lambda x: x <> '' AND x NOT IN ('inc', 'incorporated', 'corp', 'corporation', 'co', 'company', 'ltd', 'limited', 'llc', 'lp', 'plc', 'holdings', 'holding', 'group', 'the')), ' ') AS company FROM supplier""",
)
def name_normalize(t):
    name = F.concat("s_name", F.lit(" & Co. (Old) Holdings"))
    return t.supplier.select("s_suppkey", X.normal_name(name).alias("plain"), X.company_name(name).alias("company"))


@query(
    "ticker_clean",
    r"""WITH p AS (SELECT p_partkey, upper(substr(p_name, 1, 4)) || CASE p_partkey % 4 WHEN 0 THEN ' US' WHEN 1 THEN '/A  US' WHEN 2 THEN '.B/C' ELSE '' END AS a, CAST(1436513 + p_partkey AS VARCHAR) || 'D US' AS b FROM part)
SELECT p_partkey, trim(CASE WHEN contains(x, '/') THEN replace(x, '.', '/') ELSE x END) AS ticker,
  CASE WHEN regexp_matches(y, '^[0-9]{4,}[A-Z]?$') THEN '' ELSE y END AS placeholder, CASE WHEN contains(trim(a), ' ') THEN regexp_extract(trim(a), '([^ ]+)$', 1) ELSE '__missing__' END AS suffix FROM (
  SELECT p_partkey, a, CASE WHEN contains(regexp_replace(a, '\s+', ' ', 'g'), ' ') THEN regexp_replace(regexp_replace(a, '\s+', ' ', 'g'), ' [^ ]{1,3}$', '') ELSE a END AS x, regexp_replace(b, ' [^ ]{1,3}$', '') AS y FROM p)""",
)
def ticker_clean(t):
    k = F.col("p_partkey") % 4
    a = F.concat(F.upper(F.substring("p_name", 1, 4)), F.when(k == 0, " US").when(k == 1, "/A  US").when(k == 2, ".B/C").otherwise(""))
    return t.part.select("p_partkey", X.ticker(a).alias("ticker"), X.ticker(F.concat((F.col("p_partkey") + 1436513).cast("string"), F.lit("D US"))).alias("placeholder"), X.market_suffix(a).alias("suffix"))


@query(
    "cusip_check_digit",
    r"""WITH p AS (SELECT permno, ncusip AS base, substr(upper(regexp_replace(comnam, '[^A-Za-z0-9]', '', 'g')), 1, 8) AS word FROM {names}),
d AS (SELECT permno, base, word, list_sum(list_transform(range(1, 9), lambda i: (((position(substr(base, i, 1) IN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#') - 1) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 10)
    + ((position(substr(base, i, 1) IN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#') - 1) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 10)) AS s,
  CASE WHEN length(word) = 8 THEN list_sum(list_transform(range(1, 9), lambda i: (((position(substr(word, i, 1) IN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#') - 1) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) // 10)
    + ((position(substr(word, i, 1) IN '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ*@#') - 1) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) % 10)) END AS w FROM p)
SELECT permno, base || CAST((10 - s % 10) % 10 AS VARCHAR) AS nine, CAST(CAST((10 - w % 10) % 10 AS BIGINT) AS VARCHAR) AS word_digit FROM d""",
)
def cusip_check_digit(t):
    word = F.substring(F.upper(F.regexp_replace("comnam", "[^A-Za-z0-9]", "")), 1, 8)
    return t.names.select("permno", X.to_cusip9(F.col("ncusip")).alias("nine"), F.when(F.length(word) == 8, X.cusip_check_digit(word)).alias("word_digit"))


@query(
    "cusip_equiv",
    """WITH p AS (SELECT p_partkey AS k, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS nine, CASE p_partkey % 6 WHEN 0 THEN lpad(CAST(p_partkey AS VARCHAR), 9, '0') WHEN 1 THEN substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 2)
  WHEN 2 THEN substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 1, 8) WHEN 3 THEN 'N.A.' WHEN 4 THEN '1.23E+08' ELSE substr(lpad(CAST(p_partkey AS VARCHAR), 9, '0'), 1, 8) || 'X' END AS raw FROM part)
SELECT k, CASE p.k % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'short_suspect' WHEN 2 THEN 'short_suspect' WHEN 3 THEN 'missing' WHEN 4 THEN 'malformed' ELSE 'ok' END AS kind, p.k % 6 IN (0, 1, 2, 5) AS same FROM p""",
)
def cusip_equiv(t):
    nine, k = F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.col("p_partkey") % 6
    raw = F.when(k == 0, nine).when(k == 1, F.substring(nine, 2, 8)).when(k == 2, F.substring(nine, 1, 8)).when(k == 3, "N.A.").when(k == 4, "1.23E+08").otherwise(F.concat(F.substring(nine, 1, 8), F.lit("X")))
    return t.part.select(F.col("p_partkey").alias("k"), X.cusip_class(raw).alias("kind"), X.cusip_equivalent(raw, nine).alias("same"))


@query("coalesce_alias", f"SELECT id, CASE WHEN {_CLEAN} <> '' THEN {_CLEAN} WHEN id % 3 <> 0 THEN 'alias ' || CAST(id AS VARCHAR) ELSE '' END AS v FROM {{prose}}")
def coalesce_alias(t):
    second = F.when(F.col("id") % 3 != 0, F.concat(F.lit("alias "), F.col("id").cast("string"))).otherwise("none")
    return t.prose.select("id", X.first_filled(F.col("raw"), second).alias("v"))


@query(
    "outcome_label",
    """WITH p AS (SELECT id, lower(coalesce(raw, '')) AS t FROM {prose})
SELECT id, CASE WHEN regexp_matches(t, 'withdraw|acquirer withdrew') THEN 'withdrawn' WHEN regexp_matches(t, 'terminated|termination|abandoned|cancelled|canceled') THEN 'terminated'
  WHEN regexp_matches(t, 'complete|closed|closing|consummated|effective time') THEN 'completed' ELSE '' END AS label, CASE WHEN t IN ('completed', 'terminated', 'withdrawn') THEN t ELSE '' END AS exact FROM p""",
)
def outcome_label(t):
    return t.prose.select("id", X.outcome_label(F.col("raw")).alias("label"), X.exact_status(F.col("raw")).alias("exact"))


@query(
    "default_rule",
    """WITH p AS (SELECT id, lower(coalesce(raw, '')) AS t, (id % 64) / 64e0 AS pi FROM {prose})
SELECT id, CASE WHEN contains(t, 'cash') AND NOT contains(t, 'stock') THEN 'cash' WHEN contains(t, 'stock') AND NOT contains(t, 'cash') THEN 'stock' ELSE 'mixed' END AS structural,
  CASE WHEN contains(t, 'mix') OR contains(t, 'blend') THEN 'mixed' WHEN contains(t, 'cash') AND NOT contains(t, 'stock') THEN 'cash' WHEN contains(t, 'stock') AND NOT contains(t, 'cash') THEN 'stock' END AS panel,
  CASE WHEN contains(t, 'cash') AND NOT contains(t, 'stock') THEN 1e0 WHEN contains(t, 'stock') AND NOT contains(t, 'cash') THEN 0e0 ELSE pi END AS probability FROM p""",
)
def default_rule(t):
    raw = F.col("raw")
    return t.prose.select("id", X.default_rule_structural(raw).alias("structural"), X.default_rule_panel(raw).alias("panel"), X.default_rule_probability(raw, (F.col("id") % 64) / 64.0).alias("probability"))


@query(
    "holder_category",
    r"""WITH p AS (SELECT s_suppkey, lower(CASE s_suppkey % 5 WHEN 0 THEN 'Vanguard ' WHEN 1 THEN 'BlackRock ' WHEN 2 THEN 'Citadel ' WHEN 3 THEN 'Index Fund-' ELSE 'Plain ' END || s_name) AS t FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_matches(t, '\b(etf|exchange traded|index fund|index trust|spdr|ishares|vanguard|first trust|proshares|direxion|global x|wisdomtree)\b') THEN 'etf_or_index_fund'
  WHEN regexp_matches(t, '\b(blackrock|state street|ssga|geode|northern trust|dimensional|franklin templeton|invesco)\b') THEN 'passive_manager'
  WHEN regexp_matches(t, '\b(elliott|third point|paulson|millennium|citadel|de shaw|two sigma|point72|cnc|glazer|magnetar|soros)\b') THEN 'hedge_or_event_driven' ELSE 'active_or_other_institution' END AS category,
  s_suppkey % 3 <> 0 AS flag FROM p""",
)
def holder_category(t):
    k = F.col("s_suppkey") % 5
    name = F.concat(F.when(k == 0, "Vanguard ").when(k == 1, "BlackRock ").when(k == 2, "Citadel ").when(k == 3, "Index Fund-").otherwise("Plain "), F.col("s_name"))
    flag = F.when(F.col("s_suppkey") % 3 == 0, "No").otherwise("Y")
    return t.supplier.select("s_suppkey", X.holder_category(name).alias("category"), X.truthy(flag).alias("flag"))


@query(
    "html_strip",
    r"""SELECT page_id, trim(regexp_replace(lower(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')), '[ \t\r\n]+', ' ', 'g')) AS text FROM pages""",
)
def html_strip(t):
    return t.pages.select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(
    "text_features",
    """SELECT event_id, sign(value_mil - 100) * ln(1 + abs(value_mil - 100)) AS signed_log, CASE WHEN deal_type LIKE 'A%' THEN 'missing' ELSE 'present' END AS flag,
  CASE WHEN lower(payment_type) LIKE '%urgent%' OR lower(payment_type) LIKE '%high%' THEN 'election' ELSE 'other' END AS menu FROM {deals}""",
)
def text_features(t):
    return t.deals.select(
        "event_id",
        N.signed_log(F.col("value_mil") - 100).alias("signed_log"),
        X.present_flag(F.when(F.col("deal_type").startswith("A"), "N/A").otherwise(F.col("deal_type"))).alias("flag"),
        F.when(X.contains_any(F.lower("payment_type"), ("urgent", "high")), "election").otherwise("other").alias("menu"),
    )
