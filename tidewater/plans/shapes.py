"""Queries of reshaping, top rows, nested data and plans of requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import groups as G
from .registry import query

FIELDS = ("cash_cap", "stock_cap", "exchange_ratio")


@query("side_unpivot", "SELECT event_id, 'target' AS side, deal_type AS name FROM {deals} WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'acquirer', payment_type FROM {deals} WHERE event_id % 3 <> 1")
def side_unpivot(t):
    sides = F.inline(F.array(F.struct(F.lit("target").alias("side"), F.col("deal_type").alias("name"), (F.col("event_id") % 3 != 0).alias("ok")), F.struct(F.lit("acquirer").alias("side"), F.col("payment_type").alias("name"), (F.col("event_id") % 3 != 1).alias("ok"))))
    return t.deals.select("event_id", sides).where("ok").drop("ok")


@query("write_back", "SELECT event_id, max(name) FILTER (side = 'target') AS target_name, max(name) FILTER (side = 'acquirer') AS acquirer_name FROM (SELECT event_id, 'target' AS side, deal_type AS name FROM {deals} WHERE event_id % 3 <> 0 UNION ALL SELECT event_id, 'acquirer', payment_type FROM {deals}) GROUP BY event_id")
def write_back(t):
    long = t.deals.where("event_id % 3 <> 0").select("event_id", F.lit("target").alias("side"), F.col("deal_type").alias("name")).unionByName(t.deals.select("event_id", F.lit("acquirer").alias("side"), F.col("payment_type").alias("name")))
    return long.groupBy("event_id").pivot("side", ["target", "acquirer"]).agg(F.max("name")).select("event_id", F.col("target").alias("target_name"), F.col("acquirer").alias("acquirer_name"))


@query(
    "coverage_matrix",
    """WITH f AS (SELECT unnest(['view', 'click', 'missing_field']) AS field_name), e AS (SELECT DISTINCT event_id FROM {extraction}),
b AS (SELECT event_id, field_name, count(*) AS n, min_by(value, row_idx) FILTER (value IS NOT NULL) AS best FROM {extraction} GROUP BY ALL)
SELECT e.event_id, f.field_name, coalesce(b.n, 0) AS evidence, b.best, CASE WHEN b.best IS NOT NULL THEN 'found' ELSE 'missing' END AS status FROM e CROSS JOIN f LEFT JOIN b ON b.event_id = e.event_id AND b.field_name = f.field_name""",
)
def coverage_matrix(t):
    # every event by a fixed list of fields
    pairs = t.extraction.select("event_id").distinct().withColumn("field_name", F.explode(F.array(*[F.lit(x) for x in ("view", "click", "missing_field")])))
    best = t.extraction.groupBy("event_id", "field_name").agg(F.count(F.lit(1)).alias("n"), G.first_value(F.col("value"), F.col("row_idx")).alias("best"))
    j = pairs.join(best, ["event_id", "field_name"], "left")
    return j.select("event_id", "field_name", F.coalesce("n", F.lit(0)).alias("evidence"), "best", F.when(F.col("best").isNotNull(), "found").otherwise("missing").alias("status"))


@query(
    "stratified_cap",
    "SELECT event_id, doc_id, filing_date FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY filing_date, doc_id) AS a, row_number() OVER (PARTITION BY event_id ORDER BY filing_date DESC, doc_id DESC) AS b FROM {filings}) WHERE a <= 5 OR b <= 6",
)
def stratified_cap(t):
    d = t.filings.select("event_id", "doc_id", "filing_date")
    return G.head_and_tail(d, ["event_id"], [F.col("filing_date"), F.col("doc_id")], [F.col("filing_date").desc(), F.col("doc_id").desc()], 11)


@query(
    "reserve_topk",
    """WITH s AS (SELECT event_id, doc_id, form = '8-K' AS label, (doc_id * 37) % 101 AS score FROM {filings}),
k AS (SELECT *, label AND row_number() OVER (PARTITION BY event_id, label ORDER BY score DESC, doc_id) <= 3 AS kept FROM s)
SELECT event_id, doc_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY kept DESC, score DESC, doc_id) AS r FROM k) WHERE r <= 10""",
)
def reserve_topk(t):
    d = t.filings.select("event_id", "doc_id", (F.col("form") == "8-K").alias("label"), ((F.col("doc_id") * 37) % 101).alias("score"))
    return G.reserved_top(d, ["event_id"], F.col("label"), [F.col("score").desc(), F.col("doc_id")], 3, 10)


@query(
    "json_fields_explode",
    """WITH r AS (SELECT event_id, row_idx, value FROM {extraction} WHERE field_name = 'view')
SELECT event_id, row_idx, 'cash_cap' AS field_name, value FROM r WHERE value IS NOT NULL UNION ALL SELECT event_id, row_idx, 'stock_cap', CAST(row_idx % 10 AS VARCHAR) FROM r""",
)
def json_fields_explode(t):
    """A record's JSON text, with prose around it, to one row for each field."""
    record = F.to_json(F.create_map(F.lit("cash_cap"), F.col("value"), F.lit("stock_cap"), (F.col("row_idx") % 10).cast("string")))
    raw = t.extraction.where("field_name = 'view'").select("event_id", "row_idx", F.concat(F.lit("Here is the result: "), record, F.lit(" end")).alias("raw"))
    return json_fields(raw, "raw", ["event_id", "row_idx"])


def salvaged(c):
    """What is from the first brace to the last."""
    start = F.instr(c, "{")
    return F.when(start > 0, F.substr(c, start, F.length(c) - F.instr(F.reverse(c), "}") + 2 - start))


def json_fields(df, raw: str, keys: list[str]):
    fields = F.from_json(salvaged(F.col(raw)), "map<string,string>")
    return df.select(*keys, F.explode(fields).alias("field_name", "value")).where("value is not null")


@query("columnar_json", "SELECT user_id, form, accession, pos FROM (SELECT user_id, list(event_type ORDER BY event_id) AS forms, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), LATERAL (SELECT unnest(forms) AS form, unnest(ids) AS accession, unnest(range(len(ids))) AS pos)")
def columnar_json(t):
    """Parallel arrays, as a filings index has them, to rows."""
    packed = t.events.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("r"))
    arrays = packed.select("user_id", F.col("r.event_type").alias("form"), F.col("r.event_id").alias("accession"))
    return arrays.select("user_id", F.posexplode(F.arrays_zip("form", "accession"))).select("user_id", "col.form", "col.accession", F.col("pos").cast("long").alias("pos"))


@query("request_plan", "SELECT event_id, kind, 'run-' || CAST(event_id AS VARCHAR) || '-' || kind AS request FROM {spans}, (VALUES ('prices'), ('holders'), ('short_volume')) k(kind)")
def request_plan(t):
    kinds = F.explode(F.array(*[F.lit(x) for x in ("prices", "holders", "short_volume")]))
    return t.spans.select("event_id", kinds.alias("kind")).select("event_id", "kind", F.concat_ws("-", F.lit("run"), F.col("event_id").cast("string"), F.col("kind")).alias("request"))


@query(
    "histogram_bins",
    "SELECT deal_type, CAST(least(9, floor(x * 10)) AS BIGINT) AS bin, count(*) AS n FROM (SELECT deal_type, pi_cash - 25e-2 AS x FROM {deals}) WHERE x >= 0 AND x <= 1 GROUP BY ALL",
)
def histogram_bins(t):
    x = F.col("pi_cash") - 0.25
    return t.in_order.deals.where(x.between(0, 1)).groupBy("deal_type", F.least(F.lit(9), F.floor(x * 10)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("union_superset", "SELECT event_id, deal_status, CAST(NULL AS DOUBLE) AS notional FROM {deals} UNION ALL SELECT event_id, NULL, notional FROM {trades}")
def union_superset(t):
    return t.deals.select("event_id", "deal_status").unionByName(t.trades.select("event_id", "notional"), allowMissingColumns=True)


@query("key_difference", "SELECT event_id FROM {deals} EXCEPT SELECT l_orderkey FROM lineitem")
def key_difference(t):
    return t.deals.select("event_id").subtract(t.lineitem.select(F.col("l_orderkey").alias("event_id")))
