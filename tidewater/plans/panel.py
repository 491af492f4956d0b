"""Queries of the event panel: pivots, mixes, derivations, coverage and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import asof as A
from ..operators import groups as G
from .registry import query

FIELDS = ("view", "click", "purchase", "signup", "error")


def _pivot_sql(fields):
    return ", ".join(f"min_by(value, row_idx) FILTER (field_name = '{f}' AND value IS NOT NULL) AS \"{f}\"" for f in fields)


@query("eav_pivot", f"SELECT * FROM (SELECT event_id, {_pivot_sql(FIELDS)} FROM {{extraction}} GROUP BY event_id) WHERE coalesce({', '.join(FIELDS)}) IS NOT NULL")
def eav_pivot(t):
    return G.pivot_first(t.extraction, "event_id", "field_name", "value", "row_idx", FIELDS)


@query("group_first_nonnull", "SELECT event_id, min_by(field_name, row_idx) AS field_name, min_by(value, row_idx) FILTER (value IS NOT NULL) AS value FROM {extraction} GROUP BY event_id")
def group_first_nonnull(t):
    return G.first_rows(t.extraction.select("event_id", "field_name", "value", "row_idx"), "event_id", F.col("row_idx")).drop("row_idx")


@query("close_dates", "SELECT substr(ncusip, 1, 6) AS cusip6, max(nameenddt) AS close_date, 'name_end' AS source FROM {names} WHERE permno % 11 <> 0 GROUP BY 1")
def close_dates(t):
    return t.names.where("permno % 11 <> 0").groupBy(F.substring("ncusip", 1, 6).alias("cusip6")).agg(F.max("nameenddt").alias("close_date"), F.first(F.lit("name_end")).alias("source"))


@query("estimated_close", "SELECT event_id, max(filing_date) FILTER (side = 'target') AS estimated_close, max(filing_date) AS last_filing FROM {filings} GROUP BY event_id")
def estimated_close(t):
    return t.filings.groupBy("event_id").agg(F.max(F.when(F.col("side") == "target", F.col("filing_date"))).alias("estimated_close"), F.max("filing_date").alias("last_filing"))


@query(
    "ownership_mix",
    "SELECT event_id, side, "
    + ", ".join(f"coalesce(sum(shares) FILTER (holder_category = '{c}'), 0e0) AS {c.lower()}_shares, count(*) FILTER (holder_category = '{c}') AS {c.lower()}_count" for c in "ANR")
    + " FROM {holdings} GROUP BY event_id, side",
)
def ownership_mix(t):
    return G.category_mix(t.holdings, ["event_id", "side"], "holder_category", ("A", "N", "R"), "shares")


@query("etf_totals", "SELECT event_id, side, count(*) AS holders, sum(shares) AS shares, sum(market_value) AS market_value, avg(shares) AS mean_shares, max(market_value) AS largest FROM {holdings} WHERE holder_category = 'N' GROUP BY event_id, side")
def etf_totals(t):
    return t.holdings.where("holder_category = 'N'").groupBy("event_id", "side").agg(
        F.count(F.lit(1)).alias("holders"), F.sum("shares").alias("shares"), F.sum("market_value").alias("market_value"), F.avg("shares").alias("mean_shares"), F.max("market_value").alias("largest")
    )


@query(
    "string_set_agg",
    """SELECT event_id, count(*) AS docs, count(*) FILTER (form = '8-K') AS core, max(filing_date) AS last_date, array_to_string(list_sort(list_distinct(list(form))), ';') AS forms,
  array_to_string(list_sort(list_distinct(flatten(list(string_split(form || ';' || side, ';'))))), ';') AS words FROM {filings} GROUP BY event_id""",
)
def string_set_agg(t):
    words = F.split(F.concat_ws(";", "form", "side"), ";")
    return t.filings.groupBy("event_id").agg(
        F.count(F.lit(1)).alias("docs"),
        F.count_if(F.col("form") == "8-K").alias("core"),
        F.max("filing_date").alias("last_date"),
        F.array_join(F.array_sort(F.collect_set("form")), ";").alias("forms"),
        # distinct before the shuffle, so a group holds the set only
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(words)))), ";").alias("words"),
    )


@query("value_counts", "SELECT deal_status, payment_type, count(*) AS n FROM {deals} GROUP BY ALL")
def value_counts(t):
    return t.deals.groupBy("deal_status", "payment_type").agg(F.count(F.lit(1)).alias("n"))


@query(
    "confusion_matrix",
    """WITH p AS (SELECT deal_status AS actual, CASE WHEN value_mil > 150 THEN 'completed' WHEN value_mil > 100 THEN 'terminated' ELSE 'withdrawn' END AS predicted FROM {deals})
SELECT l.actual, count(p.predicted) FILTER (predicted = 'completed') AS completed, count(p.predicted) FILTER (predicted = 'terminated') AS terminated, count(p.predicted) FILTER (predicted = 'withdrawn') AS withdrawn
FROM (VALUES ('completed'), ('terminated'), ('withdrawn')) l(actual) LEFT JOIN p ON p.actual = l.actual GROUP BY l.actual""",
)
def confusion_matrix(t):
    labels = ("completed", "terminated", "withdrawn")
    predicted = F.when(F.col("value_mil") > 150, labels[0]).when(F.col("value_mil") > 100, labels[1]).otherwise(labels[2])
    counts = t.deals.select(F.col("deal_status").alias("actual"), predicted.alias("predicted")).groupBy("actual").agg(*[F.count_if(F.col("predicted") == x).alias(x) for x in labels])
    return t.spark.createDataFrame([(x,) for x in labels], "actual string").join(counts, "actual", "left").na.fill(0)


@query("yearly_share", "SELECT year(announce_date) AS year, avg(f_cash) AS mean_share, count(f_cash) AS n FROM {deals} GROUP BY 1")
def yearly_share(t):
    return t.deals.groupBy(F.year("announce_date").cast("long").alias("year")).agg(F.avg("f_cash").alias("mean_share"), F.count("f_cash").alias("n"))


@query(
    "qcut_heatmap",
    """WITH e AS (SELECT quantile_cont(pi_cash, [25e-2, 5e-1, 75e-2]) AS a, quantile_cont(value_mil, [25e-2, 5e-1, 75e-2]) AS b FROM {deals}),
b AS (SELECT CASE WHEN pi_cash IS NOT NULL THEN len(list_filter(a, lambda x: pi_cash > x)) END AS row_bucket, CASE WHEN value_mil IS NOT NULL THEN len(list_filter(b, lambda x: value_mil > x)) END AS c, f_cash FROM {deals}, e)
SELECT CAST(row_bucket AS INT) AS row_bucket, avg(f_cash) FILTER (c = 0) AS q0, avg(f_cash) FILTER (c = 1) AS q1, avg(f_cash) FILTER (c = 2) AS q2, avg(f_cash) FILTER (c = 3) AS q3 FROM b WHERE row_bucket IS NOT NULL GROUP BY 1""",
)
def qcut_heatmap(t):
    d = t.deals.select("pi_cash", "value_mil", "f_cash")
    # one row of edges
    edges = d.agg(G.quartile_edges(d, "pi_cash").alias("a"), G.quartile_edges(d, "value_mil").alias("b"))
    cut = d.join(F.broadcast(edges)).select(G.bucket(F.col("pi_cash"), F.col("a")).alias("row_bucket"), G.bucket(F.col("value_mil"), F.col("b")).alias("c"), "f_cash").where("row_bucket is not null")
    return cut.groupBy("row_bucket").agg(*[F.avg(F.when(F.col("c") == k, F.col("f_cash"))).alias(f"q{k}") for k in range(4)])


@query(
    "side_performance",
    "SELECT signal, count(*) AS n, avg(expected_return) AS mean_expected, avg(realized_return) AS mean_realized, avg(CASE WHEN realized_return > 0 THEN 1e0 WHEN realized_return IS NOT NULL THEN 0e0 END) AS hit_rate FROM {trades} GROUP BY signal",
)
def side_performance(t):
    hit = F.when(F.col("realized_return") > 0, 1.0).when(F.col("realized_return").isNotNull(), 0.0)
    return t.trades.groupBy("signal").agg(F.count(F.lit(1)).alias("n"), F.avg("expected_return").alias("mean_expected"), F.avg("realized_return").alias("mean_realized"), F.avg(hit).alias("hit_rate"))


@query(
    "finite_stats",
    "SELECT signal, avg(realized_return) AS mean, median(realized_return) AS med, sum(realized_return) AS total, CASE WHEN count(realized_return) > 2 THEN corr(realized_return, expected_return) END AS rho FROM {trades} GROUP BY signal",
)
def finite_stats(t):
    x, y = G.finite(F.col("realized_return")), G.finite(F.col("expected_return"))
    return t.trades.groupBy("signal").agg(F.avg(x).alias("mean"), F.median(x).alias("med"), F.sum(x).alias("total"), F.when(F.count(x) > 2, F.corr(F.when(y.isNotNull(), x), F.when(x.isNotNull(), y))).alias("rho"))


@query("weighted_return", "SELECT signal, sum(notional * expected_return) FILTER (notional > 0) / nullif(sum(notional) FILTER (notional > 0), 0e0) * 100 AS pct FROM {trades} GROUP BY signal")
def weighted_return(t):
    return t.trades.groupBy("signal").agg(G.weighted_return_pct(F.col("notional") * F.col("expected_return"), F.col("notional")).alias("pct"))


@query(
    "capacity_block",
    """SELECT count(*) AS trades, sum(notional) AS notional, sum(notional * expected_return) AS pnl, median(notional) AS median_notional, median(expected_return) AS median_return,
  sum(notional * expected_return) / nullif(sum(notional), 0e0) * 100 AS weighted_pct FROM {trades} WHERE signal IN ('ENTER', 'REVERSE') AND notional > 0""",
)
def capacity_block(t):
    d = t.trades.where("signal IN ('ENTER', 'REVERSE') AND notional > 0")
    pnl = F.col("notional") * F.col("expected_return")
    return d.agg(
        F.count(F.lit(1)).alias("trades"), F.sum("notional").alias("notional"), F.sum(pnl).alias("pnl"), F.median("notional").alias("median_notional"), F.median("expected_return").alias("median_return"), G.weighted_return_pct(pnl, F.col("notional")).alias("weighted_pct")
    )


@query(
    "realized_block",
    """SELECT count(realized_return) AS covered, sum(notional * realized_return) AS pnl, sum(notional * realized_return) / nullif(sum(notional) FILTER (realized_return IS NOT NULL), 0e0) * 100 AS pct,
  avg(CASE WHEN realized_return > 0 THEN 1e0 WHEN realized_return IS NOT NULL THEN 0e0 END) AS hit_rate, count(*) FILTER (realized_return <= 0) AS wrong, corr(realized_return, expected_return) AS rho
FROM {trades} WHERE signal IN ('ENTER', 'REVERSE') AND notional > 0""",
)
def realized_block(t):
    r, n = F.col("realized_return"), F.col("notional")
    return t.in_order.trades.where("signal IN ('ENTER', 'REVERSE') AND notional > 0").agg(
        F.count(r).alias("covered"),
        F.sum(n * r).alias("pnl"),
        G.weighted_return_pct(n * r, n).alias("pct"),
        F.avg(F.when(r > 0, 1.0).when(r.isNotNull(), 0.0)).alias("hit_rate"),
        F.count_if(r <= 0).alias("wrong"),
        F.corr(r, F.when(r.isNotNull(), F.col("expected_return"))).alias("rho"),
    )


_COLS = ("pi_cash", "f_cash", "ratio", "acq_price", "deal_status")


@query("coverage_counts", " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, count({c}) * 1e0 / nullif(count(*), 0) * 100 AS pct FROM {{deals}}" for c in _COLS))
def coverage_counts(t):
    return G.coverage(t.deals, _COLS)


@query(
    "missing_inventory",
    "SELECT event_id, field, filled FROM (SELECT event_id, unnest(['pi_cash', 'f_cash', 'cash']) AS field, unnest([pi_cash IS NOT NULL, f_cash IS NOT NULL, cash IS NOT NULL]) AS filled FROM {deals}) UNION ALL SELECT * FROM (VALUES (CAST(-1 AS BIGINT), 'filings', false), (-1, 'short_interest', false))",
)
def missing_inventory(t):
    d = t.deals.groupBy("event_id").agg(*[F.max(F.col(c).isNotNull()).alias(c) for c in ("pi_cash", "f_cash", "cash")])
    fixed = t.spark.createDataFrame([(-1, "filings", False), (-1, "short_interest", False)], "event_id long, field string, filled boolean")
    return d.unpivot("event_id", ["pi_cash", "f_cash", "cash"], "field", "filled").unionByName(fixed)


@query(
    "tier_counts",
    "SELECT CASE WHEN score >= 95 THEN 'high' WHEN score >= 88 THEN 'medium' ELSE 'low' END AS tier, count(*) AS n, min(score) AS least FROM (SELECT 80e0 + p_partkey % 21 AS score FROM part) GROUP BY 1",
)
def tier_counts(t):
    score = F.lit(80.0) + F.col("p_partkey") % 21
    return t.part.select(score.alias("score")).groupBy(F.when(F.col("score") >= 95, "high").when(F.col("score") >= 88, "medium").otherwise("low").alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))


@query(
    "market_enrich",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, -l_extendedprice AS prc, l_quantity AS vol, l_extendedprice * (1 - l_discount) AS bid, l_extendedprice * CASE WHEN l_linenumber % 3 = 0 THEN 9e-1 ELSE 101e-2 END AS ask,
  l_extendedprice * 98e-2 AS bidlo, l_extendedprice * 103e-2 AS askhi, l_quantity * 3 AS shrout FROM lineitem),
s AS (SELECT *, CASE WHEN ask - bid <= 0 THEN askhi - bidlo ELSE ask - bid END AS spread FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(prc) AS price, abs(prc) * vol AS dollar_volume, abs(prc) * shrout * 1e3 AS market_cap, spread, spread / CASE WHEN (ask + bid) / 2 > 0 THEN (ask + bid) / 2 END AS spread_pct FROM s""",
)
def market_enrich_query(t):
    x = F.col("l_extendedprice")
    raw = t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (-x).alias("prc"), F.col("l_quantity").alias("vol"), (x * (1 - F.col("l_discount"))).alias("bid"),
        (x * F.when(F.col("l_linenumber") % 3 == 0, 0.9).otherwise(1.01)).alias("ask"), (x * 0.98).alias("bidlo"), (x * 1.03).alias("askhi"), (F.col("l_quantity") * 3).alias("shrout"),
    )
    return market_enrich(raw).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "dollar_volume", "market_cap", "spread", "spread_pct")


def market_enrich(df, share_multiplier: float = 1000.0):
    """Prices without their sign, shares in units, and the spread: ask less bid, or high less low where that is not positive."""
    quoted = F.abs("ask") - F.abs("bid")
    middle = (F.abs("ask") + F.abs("bid")) / 2
    return df.withColumns({
        "price": F.abs("prc"),
        "dollar_volume": F.abs("prc") * F.col("vol"),
        "market_cap": F.abs("prc") * F.col("shrout") * share_multiplier,
        "spread": F.when(quoted <= 0, F.abs("askhi") - F.abs("bidlo")).otherwise(quoted),
    }).withColumn("spread_pct", F.col("spread") / F.when(middle > 0, middle))


@query(
    "panel_derive",
    """WITH p AS (SELECT event_id, f_cash, pi_cash, cash, ratio * acq_price AS stock, (party % 32) / 64e0 AS passive, CASE WHEN payment_type LIKE '1%' THEN 1e0 WHEN payment_type LIKE '2%' THEN 0e0 ELSE 5e-1 END AS dflt FROM {deals}),
q AS (SELECT *, cash - stock AS spread, coalesce(f_cash > pi_cash, false) AS oversubscribed, passive * dflt AS passive_cash, 1 - passive AS active FROM p)
SELECT event_id, spread, oversubscribed, passive_cash, CASE WHEN active >= 1e-3 AND f_cash IS NOT NULL THEN greatest(0e0, least(1e0, (f_cash - passive_cash) / active)) END AS active_rate FROM q""",
)
def panel_derive(t):
    rule = F.when(F.col("payment_type").startswith("1"), 1.0).when(F.col("payment_type").startswith("2"), 0.0).otherwise(0.5)
    passive = (F.col("party") % 32) / 64.0
    active = 1 - passive
    return t.in_order.deals.select(
        "event_id",
        (F.col("cash") - F.col("ratio") * F.col("acq_price")).alias("spread"),
        F.coalesce(F.col("f_cash") > F.col("pi_cash"), F.lit(False)).alias("oversubscribed"),
        (passive * rule).alias("passive_cash"),
        F.when(active >= 1e-3, N.clamp((F.col("f_cash") - passive * rule) / active)).alias("active_rate"),
    )


@query(
    "label_quality",
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 4 = 0 THEN f_cash END AS c, CASE WHEN event_id % 4 = 1 THEN 1 - f_cash END AS s, pi_cash AS cap, CASE WHEN event_id % 4 = 2 THEN f_cash END AS final, CASE WHEN event_id % 4 = 3 THEN f_cash END AS prelim FROM {deals})
SELECT event_id, coalesce(c, 1 - s, CASE WHEN cap / nullif(coalesce(final, prelim), 0e0) IS NOT NULL THEN greatest(0e0, least(1e0, cap / nullif(coalesce(final, prelim), 0e0))) END) AS share,
  CASE WHEN c IS NOT NULL THEN 'direct_realized_cash_election_demand' WHEN s IS NOT NULL THEN 'direct_realized_stock_election_demand' WHEN cap / nullif(final, 0e0) IS NOT NULL THEN 'final_proration_results_backed_out_from_cap'
    WHEN cap / nullif(prelim, 0e0) IS NOT NULL THEN 'preliminary_proration_results_backed_out_from_cap' ELSE '' END AS source,
  CASE WHEN c IS NOT NULL OR s IS NOT NULL THEN 1e0 WHEN cap / nullif(final, 0e0) IS NOT NULL THEN 65e-2 WHEN cap / nullif(prelim, 0e0) IS NOT NULL THEN 45e-2 ELSE 0e0 END AS weight FROM p""",
)
def label_quality(t):
    k, f = F.col("event_id") % 4, F.col("f_cash")
    d = t.deals.select("event_id", F.col("pi_cash").alias("cap"), F.when(k == 0, f).alias("c"), F.when(k == 1, 1 - f).alias("s"), F.when(k == 2, f).alias("final"), F.when(k == 3, f).alias("prelim"))
    return d.select("event_id", F.inline(F.array(realized_share(F.col("c"), F.col("s"), F.col("cap"), F.col("final"), F.col("prelim")))))


def realized_share(cash, stock, cap, final_fill, preliminary_fill):
    """(share, source, weight): cash as reported, else what stock leaves, else the cap over the fill of the final or the preliminary proration."""
    backed = lambda fill: N.once(cap / F.nullif(fill, F.lit(0.0)), N.clamp)
    as_struct = lambda v, source, w: N.once(v, lambda x: F.when(x.isNotNull(), F.struct(x.alias("share"), F.lit(source).alias("source"), F.lit(w).alias("weight"))))
    return F.coalesce(
        as_struct(cash, "direct_realized_cash_election_demand", 1.0),
        as_struct(1 - stock, "direct_realized_stock_election_demand", 1.0),
        as_struct(backed(final_fill), "final_proration_results_backed_out_from_cap", 0.65),
        as_struct(backed(preliminary_fill), "preliminary_proration_results_backed_out_from_cap", 0.45),
        F.struct(F.lit(None).cast("double").alias("share"), F.lit("").alias("source"), F.lit(0.0).alias("weight")),
    )


@query(
    "contract_spread",
    """WITH p AS (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN cash END AS c, CASE WHEN event_id % 5 <> 0 THEN ratio * acq_price END AS s, event_id % 3 = 0 AS menu, CASE WHEN event_id % 7 <> 0 THEN cash * 9e-1 ELSE 0e0 END AS tp FROM {deals}),
v AS (SELECT *, CASE WHEN menu THEN greatest(c, s) WHEN c IS NOT NULL OR s IS NOT NULL THEN coalesce(c, 0e0) + coalesce(s, 0e0) END AS value FROM p)
SELECT event_id, value, value - tp AS spread, (value - tp) / nullif(tp, 0e0) AS spread_pct FROM v""",
)
def contract_spread(t):
    k = F.col("event_id")
    d = t.deals.select("event_id", F.when(k % 4 != 0, F.col("cash")).alias("c"), F.when(k % 5 != 0, F.col("ratio") * F.col("acq_price")).alias("s"), (k % 3 == 0).alias("menu"), F.when(k % 7 != 0, F.col("cash") * 0.9).otherwise(0.0).alias("tp"))
    value = F.when(F.col("menu"), F.greatest("c", "s")).when(F.col("c").isNotNull() | F.col("s").isNotNull(), F.coalesce("c", F.lit(0.0)) + F.coalesce("s", F.lit(0.0)))
    return d.withColumn("value", value).select("event_id", "value", (F.col("value") - F.col("tp")).alias("spread"), ((F.col("value") - F.col("tp")) / F.nullif(F.col("tp"), F.lit(0.0))).alias("spread_pct"))


@query(
    "date_inference",
    """WITH d AS (SELECT event_id, close_date, announce_date FROM {spans}), f AS (SELECT event_id, side, price_date FROM {prices})
SELECT d.event_id, coalesce((SELECT max(price_date) FROM f WHERE f.event_id = d.event_id AND side = 'target' AND price_date <= d.close_date), d.announce_date) AS entry_date,
  coalesce((SELECT min(price_date) FROM f WHERE f.event_id = d.event_id AND side = 'acquirer' AND price_date > d.close_date), (SELECT min(price_date) FROM f WHERE f.event_id = d.event_id AND side = 'target' AND price_date > d.close_date)) AS exit_date FROM d""",
)
def date_inference(t):
    one = lambda side: F.collect_set(F.when(F.col("side") == side, F.col("price_date")))
    dates = t.prices.groupBy("event_id").agg(one("target").alias("target"), one("acquirer").alias("acquirer"))
    later = lambda c: F.array_min(F.filter(c, lambda x: x > F.col("close_date")))
    entry = F.coalesce(F.array_max(F.filter("target", lambda x: x <= F.col("close_date"))), F.col("announce_date"))
    return t.spans.join(dates, "event_id", "left").select("event_id", entry.alias("entry_date"), F.coalesce(later("acquirer"), later("target")).alias("exit_date"))


@query("mc_ready_deals", "SELECT event_id, cash, ratio, acq_price, f_cash, pi_cash FROM {deals} WHERE cash IS NOT NULL AND ratio IS NOT NULL AND acq_price IS NOT NULL AND f_cash IS NOT NULL AND pi_cash IS NOT NULL AND ratio_type = 'fixed'")
def mc_ready_deals(t):
    return mc_ready(t.deals).select("event_id", "cash", "ratio", "acq_price", "f_cash", "pi_cash")


def mc_ready(deals, with_demand: bool = True):
    need = ["cash", "ratio", "acq_price", "pi_cash"] + ["f_cash"] * with_demand
    return deals.na.drop(subset=need).where("ratio_type = 'fixed'")


@query("market_snapshot", "SELECT event_id, side, price_date, price, announce_date FROM (SELECT p.*, s.announce_date, row_number() OVER (PARTITION BY p.event_id, side ORDER BY price_date DESC) AS r FROM {prices} p JOIN {spans} s ON s.event_id = p.event_id WHERE price_date <= s.announce_date + 3) WHERE r = 1")
def market_snapshot(t):
    d = t.prices.join(t.spans, "event_id").where(F.col("price_date") <= F.date_add("announce_date", 3))
    return A.best_row(d, ["event_id", "side"], [F.col("price_date").desc()]).select("event_id", "side", "price_date", "price", "announce_date")


_NEED = {"orders": ("o_orderkey", "o_custkey", "o_orderstatus"), "events": ("event_id", "ts", "user_id"), "lineitem": ("l_orderkey", "l_tax"), "part": ("p_partkey", "p_name", "p_rank"), "filing_index": ("doc_id",)}


@query(
    "preflight_schema",
    "WITH n AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{c}')" for t, cs in _NEED.items() for c in cs) + """) n(table_name, col)),
c AS (SELECT n.table_name, n.col, x.column_name IS NOT NULL AS there, t.table_name IS NOT NULL AS found FROM n LEFT JOIN information_schema.columns x ON x.table_name = n.table_name AND x.column_name = n.col LEFT JOIN information_schema.tables t ON t.table_name = n.table_name)
SELECT table_name, CASE WHEN NOT bool_or(found) THEN 'MISSING' WHEN bool_and(there) THEN 'OK' ELSE 'INVALID' END AS status, CASE WHEN bool_or(found) THEN coalesce(string_agg(CASE WHEN NOT there THEN col END, ',' ORDER BY col), '') ELSE '' END AS missing FROM c GROUP BY table_name""",
)
def preflight_schema(t):
    """Name, status and missing columns of each input that the stages need."""
    from ..sources.files import schema_report

    return schema_report(t.spark, {name: (f"{t.sf_dir}/{name}.parquet", set(columns)) for name, columns in _NEED.items()}, "parquet")


@query("bounded_range_filter", "SELECT event_id, announce_date, value_mil FROM {deals} WHERE deal_status IN ('completed', 'withdrawn') AND announce_date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND f_cash > 0 AND f_cash < 1")
def bounded_range_filter(t):
    d = t.deals.where(F.col("deal_status").isin("completed", "withdrawn") & F.col("announce_date").between("1996-01-01", "1999-12-31"))
    return d.where("f_cash > 0 AND f_cash < 1").select("event_id", "announce_date", "value_mil")
