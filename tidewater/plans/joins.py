"""Queries of joins: matching, as-of, validity windows, anti-joins and overrides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import asof as A
from .registry import query

_SIDE = "SELECT s.event_id, s.announce_date, s.close_date FROM {spans} s"


@query(
    "match_key_join",
    """WITH k AS (SELECT event_id, strftime(announce_date, '%Y%m%d') || '|' || lower(replace(payment_type, '-', ' ')) AS raw_key, deal_status, announce_date, payment_type, party FROM {deals}),
e AS (SELECT event_id, deal_status, strftime(announce_date, '%Y%m%d') || '|' || trim(regexp_replace(lower(payment_type), '[^a-z0-9]+', ' ', 'g')) || '|' || CAST(party AS VARCHAR) AS key FROM k),
x AS (SELECT key, min_by(deal_status, event_id) AS status FROM e WHERE event_id % 3 <> 0 GROUP BY key)
SELECT e.event_id, e.key, coalesce(x.status, e.deal_status) AS status, CASE WHEN x.key IS NOT NULL THEN 'export_match' ELSE 'event_frame' END AS match_source FROM e LEFT JOIN x ON e.key = x.key""",
)
def match_key_join(t):
    key = F.concat_ws("|", F.date_format("announce_date", "yyyyMMdd"), X.normal_name(F.col("payment_type")), F.col("party").cast("string"))
    events = t.deals.select("event_id", "deal_status", key.alias("key"))
    export = events.where("event_id % 3 <> 0").groupBy("key").agg(F.min_by("deal_status", "event_id").alias("found"), F.lit(True).alias("hit"))
    return events.join(export, "key", "left").select("event_id", "key", F.coalesce("found", "deal_status").alias("status"), F.when(F.col("hit"), "export_match").otherwise("event_frame").alias("match_source"))


def _spans_sides(t):
    return t.spans.crossJoin(t.spark.createDataFrame([("target",), ("acquirer",)], "side string"))


_SIDES = "(SELECT s.*, x.side FROM {spans} s, (VALUES ('target'), ('acquirer')) x(side))"


@query("asof_backward", f"SELECT s.event_id, s.side, s.close_date, (SELECT max_by(p.price, p.price_date) FROM {{prices}} p WHERE p.event_id = s.event_id AND p.side = s.side AND p.price_date <= s.close_date) AS price FROM {_SIDES} s")
def asof_backward(t):
    return A.asof(_spans_sides(t).select("event_id", "side", "close_date"), t.prices, ["event_id", "side"], "close_date", "price_date", ["price"])


@query(
    "asof_forward",
    f"SELECT s.event_id, s.side, s.announce_date + 5 AS entry_date, (SELECT min_by(p.price, p.price_date) FROM {{prices}} p WHERE p.event_id = s.event_id AND p.side = s.side AND p.price_date >= s.announce_date + 5) AS price FROM {_SIDES} s",
)
def asof_forward(t):
    left = _spans_sides(t).select("event_id", "side", F.date_add("announce_date", 5).alias("entry_date"))
    return A.asof(left, t.prices, ["event_id", "side"], "entry_date", "price_date", ["price"], "forward")


@query(
    "asof_nearest",
    f"""SELECT s.event_id, s.side, s.announce_date, coalesce((SELECT max_by(p.price, p.price_date) FROM {{prices}} p WHERE p.event_id = s.event_id AND p.side = s.side AND p.price_date <= s.announce_date),
  (SELECT p.price FROM {{prices}} p WHERE p.event_id = s.event_id AND p.side = s.side ORDER BY abs(p.price_date - s.announce_date), p.price_date LIMIT 1)) AS price FROM {_SIDES} s""",
)
def asof_nearest(t):
    return A.asof(_spans_sides(t).select("event_id", "side", "announce_date"), t.prices, ["event_id", "side"], "announce_date", "price_date", ["price"], "nearest")


@query(
    "validity_join",
    """WITH o AS (SELECT l_orderkey, l_linenumber, l_partkey AS permno, CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_linenumber = 1 GROUP BY ALL),
n AS (SELECT permno, comnam, namedt, nameenddt FROM {names} UNION ALL SELECT permno, comnam || ' new', nameenddt + 1, nameenddt + 400 FROM {names})
SELECT l_orderkey, permno, d, comnam, in_window FROM (SELECT o.*, n.comnam, n.namedt <= d AND d <= n.nameenddt AS in_window,
  row_number() OVER (PARTITION BY l_orderkey, o.permno, d ORDER BY (n.namedt <= d AND d <= n.nameenddt) DESC, n.nameenddt DESC, comnam) AS r FROM o JOIN n USING (permno)) WHERE r = 1""",
)
def validity_join(t):
    left = t.lineitem.where("l_linenumber = 1").select("l_orderkey", F.col("l_partkey").alias("permno"), F.col("l_shipdate").cast("date").alias("d")).distinct()
    old = t.names.select("permno", "comnam", "namedt", "nameenddt")
    new = old.select("permno", F.concat("comnam", F.lit(" new")).alias("comnam"), F.date_add("nameenddt", 1).alias("namedt"), F.date_add("nameenddt", 400).alias("nameenddt"))
    return A.valid_name(left, old.unionByName(new), "permno", "d", "namedt", "nameenddt", [F.col("comnam")], ["l_orderkey", "permno", "d"]).select("l_orderkey", "permno", "d", "comnam", "in_window")


@query("latest_snapshot", "SELECT event_id, side, holder_name, report_date, sum(shares) AS shares FROM {holdings} h WHERE report_date = (SELECT max(report_date) FROM {holdings} m WHERE m.event_id = h.event_id AND m.side = h.side) GROUP BY ALL")
def latest_snapshot(t):
    latest = t.holdings.groupBy("event_id", "side").agg(F.max("report_date").alias("report_date"))
    return t.holdings.join(latest, ["event_id", "side", "report_date"]).groupBy("event_id", "side", "holder_name", "report_date").agg(F.sum("shares").alias("shares"))


@query("anti_missing_side", "SELECT DISTINCT t.event_id FROM {holdings} t WHERE t.side = 'F' AND NOT EXISTS (SELECT 1 FROM {holdings} a WHERE a.event_id = t.event_id AND a.side = 'O')")
def anti_missing_side(t):
    one = t.holdings.select("event_id", "side")
    return one.where("side = 'F'").select("event_id").distinct().join(one.where("side = 'O'").select("event_id"), "event_id", "left_anti")


@query("semi_selected", "SELECT doc_id, form FROM {filings} f WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1)")
def semi_selected(t):
    return t.filings.join(t.labels.where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "form")


@query(
    "override_replace",
    """SELECT event_id, side, price_date, price, 'vendor' AS source FROM {prices} WHERE NOT (event_id % 10 = 0 AND side = 'acquirer')
UNION ALL SELECT event_id, side, price_date, price * 2, 'patch' FROM {prices} WHERE event_id % 10 = 0 AND side = 'acquirer'""",
)
def override_replace(t):
    base = t.prices.select("event_id", "side", "price_date", "price", F.lit("vendor").alias("source"))
    patch = base.where("event_id % 10 = 0 AND side = 'acquirer'").withColumns({"price": F.col("price") * 2, "source": F.lit("patch")})
    return A.override(base, patch, ["event_id", "side"])


@query(
    "override_precedence",
    """SELECT p_partkey, coalesce(CASE WHEN p_partkey % 9 = 0 THEN 'OVR' || CAST(p_partkey AS VARCHAR) END, nullif(CASE WHEN p_partkey % 4 <> 0 THEN upper(substr(p_name, 1, 3)) ELSE '' END, ''), s.s_name, '') AS symbol,
  CASE WHEN p_partkey % 9 = 0 THEN 'override' WHEN p_partkey % 4 <> 0 THEN 'input' WHEN s.s_name IS NOT NULL THEN 'table' ELSE 'missing' END AS symbol_source FROM part LEFT JOIN supplier s ON s.s_suppkey = p_partkey""",
)
def override_precedence(t):
    part = t.part.select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.upper(F.substring("p_name", 1, 3))).alias("input"))
    overrides = t.part.where("p_partkey % 9 = 0").select("p_partkey", F.concat(F.lit("OVR"), F.col("p_partkey").cast("string")).alias("override"))
    table = t.supplier.select(F.col("s_suppkey").alias("p_partkey"), F.col("s_name").alias("table"))
    joined = part.join(overrides, "p_partkey", "left").join(table, "p_partkey", "left")
    source = F.when(F.col("override").isNotNull(), "override").when(F.col("input").isNotNull(), "input").when(F.col("table").isNotNull(), "table").otherwise("missing")
    return joined.select("p_partkey", F.coalesce("override", "input", "table", F.lit("")).alias("symbol"), source.alias("symbol_source"))


@query("panel_merge", "SELECT d.event_id, d.deal_status, d.f_cash, h.shares, h.market_value FROM {deals} d LEFT JOIN (SELECT event_id, sum(shares) AS shares, sum(market_value) AS market_value FROM {holdings} GROUP BY event_id) h ON h.event_id = d.event_id")
def panel_merge(t):
    left = t.deals.select("event_id", "deal_status", "f_cash")
    right = t.holdings.groupBy("event_id").agg(F.sum("shares").alias("shares"), F.sum("market_value").alias("market_value"), F.lit("other").alias("deal_status"))
    return A.left_new_columns(left, right, ["event_id"])


@query("hedge_path_join", "SELECT coalesce(a.event_id, b.event_id) AS event_id, coalesce(a.price_date, b.price_date) AS price_date, a.price AS target_price, b.price AS acquirer_price FROM (SELECT * FROM {prices} WHERE side = 'target') a FULL JOIN (SELECT * FROM {prices} WHERE side = 'acquirer') b ON a.event_id = b.event_id AND a.price_date = b.price_date")
def hedge_path_join(t):
    one = lambda side: t.prices.where(F.col("side") == side).select("event_id", "price_date", F.col("price").alias(f"{side}_price"))
    return one("target").join(one("acquirer"), ["event_id", "price_date"], "full")


@query("theta_prefix", "SELECT p_partkey, n_name FROM (SELECT p_partkey, n_name, row_number() OVER (PARTITION BY p_partkey ORDER BY n_nationkey) AS r FROM part JOIN nation ON contains(p_brand, '#' || substr(n_name, 8))) WHERE r = 1")
def theta_prefix(t):
    parts = t.part.select("p_partkey", F.col("p_brand").alias("s"))
    # nations are a fixed list of 25, so this side may be broadcast
    joined = parts.join(F.broadcast(t.nation.select("n_nationkey", "n_name")), F.contains("s", F.concat(F.lit("#"), F.substring("n_name", 8, 9))))
    return A.best_row(joined, ["p_partkey"], [F.col("n_nationkey")]).select("p_partkey", "n_name")
