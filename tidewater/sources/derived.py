"""Domain tables derived from the raw ones. Their SQL reads alike in Spark and in DuckDB, so each is stated once."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RAW = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations")

DERIVED = {
    # election deals, one for each order
    "deals": """
SELECT o.o_orderkey AS event_id, CAST(o.o_orderdate AS DATE) AS announce_date, o.o_custkey AS party,
  CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'terminated' ELSE 'withdrawn' END AS deal_status,
  c.c_mktsegment AS deal_type, o.o_orderpriority AS payment_type, o.o_totalprice / 1000 AS value_mil,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 'floating' ELSE 'fixed' END AS ratio_type,
  1e1 + o.o_totalprice / 16384e0 AS cash, 5e-1 + (o.o_orderkey % 50) / 64e0 AS ratio,
  (1e1 + o.o_totalprice / 16384e0) / (5e-1 + (o.o_orderkey % 50) / 64e0) * (75e-2 + (o.o_custkey % 41) / 64e0) AS acq_price,
  l.pi_cash, CASE WHEN o.o_orderstatus = 'F' THEN l.f_cash END AS f_cash
FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey
LEFT JOIN (SELECT l_orderkey, 25e-2 + 5e0 * AVG(l_discount) AS pi_cash, AVG(l_tax) / 8e-2 AS f_cash FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    # two-sided daily prices, one series for each user
    "prices": """
SELECT user_id AS event_id, side, price_date, MAX(CASE WHEN rn = 1 THEN price END) AS price,
  SUM(price) AS dollar_volume, CAST(COUNT(*) AS BIGINT) AS volume
FROM (SELECT user_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'target' ELSE 'acquirer' END AS side,
        CAST(ts AS DATE) AS price_date, value AS price,
        ROW_NUMBER() OVER (PARTITION BY user_id, CASE WHEN event_type IN ('view', 'click', 'error') THEN 'target' ELSE 'acquirer' END,
                           CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM {events}) x
GROUP BY user_id, side, price_date""",
    # one event for each user, with dates that fall before, in and after its prices
    "spans": """
SELECT user_id AS event_id, CAST(MIN(ts) AS DATE) + CAST(user_id % 9 AS INT) - 3 AS announce_date,
  CAST(MIN(ts) AS DATE) + CAST(15 + user_id % 21 AS INT) AS close_date FROM {events} GROUP BY user_id""",
    # prices as a vendor sent them: some events lack the acquirer's, some have another company's
    "vendor_prices": """
SELECT event_id, side, price_date, price, volume, CAST(NULL AS BIGINT) AS permno, 'vendor' AS symbol_source FROM {prices} WHERE NOT (side = 'acquirer' AND event_id % 5 = 0)""",
    # which company the acquirer's identifier names for each event, and when the deal was announced
    "acquirers": """
SELECT event_id, announce_date, CONCAT(' ', LPAD(CAST((event_id * 7) % 350 AS STRING), 6, '0'), '-10') AS cusip FROM {spans}""",
    # which security an identifier stood for, and when; identifiers are given out again
    "links": """
SELECT p_partkey AS permno, CONCAT(LPAD(CAST(p_partkey % 300 AS STRING), 6, '0'), '10') AS cusip8, DATE '2023-12-01' + CAST(p_size AS INT) AS from_date, DATE '2023-12-01' + CAST(p_size + 10 + p_partkey % 40 AS INT) AS to_date FROM {part}""",
    # daily prices of securities
    "securities": """
SELECT l_partkey AS permno, DATE '2023-12-20' + CAST(l_orderkey % 60 AS INT) AS price_date, MAX(ABS(l_extendedprice / l_quantity)) AS price, CAST(COUNT(*) AS BIGINT) AS volume FROM {lineitem} GROUP BY l_partkey, l_orderkey % 60""",
    # sides whose security was found to be another one
    "price_overrides": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'acquirer' ELSE 'target' END AS side, (event_id * 13) % 900 AS permno FROM {spans} WHERE event_id % 17 = 3""",
    # what came back for each request to normalise labels, some of it unusable
    "answers": """
SELECT CASE WHEN event_id % 11 = 4 THEN event_id + 1000000 ELSE event_id END AS event_id,
  CASE event_id % 11 WHEN 1 THEN 'no result could be found' WHEN 2 THEN CONCAT(CHR(123), '"pct_elected_cash": "forty", "disclosure_type": "elected_pct"', CHR(125)) WHEN 3 THEN CONCAT(CHR(123), '"pct_elected_cash": 40, "disclosure_type": "guess"', CHR(125))
    ELSE CONCAT('Result: ', CHR(123), '"pct_elected_cash": ', CAST(event_id % 130 AS STRING), ', "cash_proration_factor": ', CASE WHEN event_id % 3 = 0 THEN '0.75' ELSE 'null' END,
      ', "shares_base": ', CAST(event_id * 1000 AS STRING), ', "disclosure_type": "', CASE WHEN event_id % 2 = 0 THEN 'elected_pct' ELSE 'elected_shares_derived' END, '", "basis": "', CASE WHEN event_id % 2 = 0 THEN 'direct' ELSE 'derived' END, '", "notes": "n', CAST(event_id AS STRING), '"', CHR(125), ' done') END AS response
FROM {spans}""",
    # attribute-value rows, nulls among them
    "extraction": """
SELECT user_id AS event_id, event_type AS field_name,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CONCAT('$', CAST(CAST(FLOOR(value) AS BIGINT) AS STRING), ' or ',
    CAST(event_id % 100 AS STRING), '% of ', CAST(event_id AS STRING), ' shares') END AS value,
  event_id AS row_idx FROM {events}""",
    # prose of every kind that the parsers meet
    "prose": """
SELECT event_id AS id, CASE event_id % 18
  WHEN 0 THEN CONCAT('$', CAST(event_id % 997 AS STRING), '.25 or ', CAST(event_id % 100 AS STRING), '% of ', CAST(event_id AS STRING), ' shares')
  WHEN 1 THEN 'NOT_FOUND'
  WHEN 2 THEN CONCAT('exchange ratio of ', CAST(event_id % 7 AS STRING), '.', CAST(event_id % 10 AS STRING), ' shares of stock')
  WHEN 3 THEN CONCAT(CAST(event_id % 9 AS STRING), '/', CAST(1 + event_id % 7 AS STRING))
  WHEN 4 THEN 'One-half of the consideration'
  WHEN 5 THEN CONCAT('0.', CAST(event_id % 97 AS STRING))
  WHEN 6 THEN CONCAT(CAST(event_id % 150 AS STRING), ' percent')
  WHEN 7 THEN NULL
  WHEN 8 THEN CONCAT('  ', CAST(event_id AS STRING), ' USD ')
  WHEN 9 THEN 'Cash election is the default'
  WHEN 10 THEN CONCAT('Terminated on 2020-0', CAST(1 + event_id % 9 AS STRING), '-1', CAST(event_id % 10 AS STRING), '; later withdrawn')
  WHEN 11 THEN CONCAT('Deal completed March ', CAST(1 + event_id % 28 AS STRING), ', 2021')
  WHEN 12 THEN 'VWAP-based ratio with collar'
  WHEN 13 THEN CONCAT(CAST(event_id % 300 AS STRING), '.', CAST(event_id % 10 AS STRING), ' : 1 ratio')
  WHEN 14 THEN 'mixed blend of cash and stock'
  WHEN 15 THEN CONCAT('1,', CAST(100 + event_id % 900 AS STRING), ',000 shares elected cash, representing ', CAST(event_id % 120 AS STRING), '.5%')
  WHEN 16 THEN CONCAT('agreement was terminated ', CAST(1 + event_id % 12 AS STRING), '/', CAST(1 + event_id % 28 AS STRING), '/2019')
  ELSE ' n/a ' END AS raw FROM {events}""",
    # holdings by holder category
    "holdings": """
SELECT l.l_orderkey AS event_id, l.l_linestatus AS side, l.l_returnflag AS holder_category, s.s_name AS holder_name,
  l.l_quantity AS shares, l.l_extendedprice AS market_value, CAST(l.l_shipdate AS DATE) AS report_date
FROM {lineitem} l JOIN {supplier} s ON s.s_suppkey = l.l_suppkey""",
    # names of securities with the windows in which they hold
    "names": """
SELECT p_partkey AS permno, p_name AS comnam, CONCAT(LPAD(CAST(p_partkey AS STRING), 6, '0'), '10') AS ncusip,
  DATE '1995-01-01' + CAST(p_size * 10 AS INT) AS namedt, DATE '1998-01-01' + CAST(p_size * 20 AS INT) AS nameenddt FROM {part}""",
    # filing documents; keywords are words that occur
    "filings": """
SELECT doc_id, source AS event_id, CASE doc_id % 4 WHEN 0 THEN '8-K' WHEN 1 THEN 'S-4/A' WHEN 2 THEN 'DEFM14A' ELSE 'EX-99.1' END AS form,
  CASE doc_id % 3 WHEN 0 THEN 'target' ELSE 'acquirer' END AS side,
  DATE '2020-01-01' + CAST(doc_id % 720 AS INT) AS filing_date, text FROM {documents}""",
    # what both sides of each deal cost when a trade begins: the target after the announcement (none for some), before the deal, and the acquirer
    "quotes": """
SELECT d.*, ratio * entry_acq AS stock, ratio * acq_price AS deadline_stock, CASE WHEN event_id % 11 <> 0 THEN entry * (7e-1 + (event_id % 31) / 64e0) END AS recovery,
  CASE WHEN event_id % 4 <> 3 THEN deal_status END AS outcome
FROM (SELECT d.*, acq_price * (1e0 + (event_id % 13 - 6) / 256e0) AS entry_acq,
    CASE WHEN event_id % 29 <> 0 THEN (pi_cash * cash + (1 - pi_cash) * ratio * acq_price) * (85e-2 + (event_id % 41) / 128e0) * CASE WHEN event_id % 19 = 0 THEN 7e-1 ELSE 1e0 END END AS entry
  FROM {deals} d WHERE pi_cash IS NOT NULL AND ratio_type = 'fixed') d WHERE entry IS NOT NULL""",
    # the holder panel: deals with a known cash pool, in order of announcement
    "holders": """
SELECT d.*, CAST(ROW_NUMBER() OVER (ORDER BY announce_date, event_id) AS BIGINT) AS pos, (party % 32) / 64e0 AS passive,
  CASE WHEN payment_type LIKE '1%' THEN 'cash' WHEN payment_type LIKE '2%' THEN 'stock' ELSE 'mixed' END AS default_rule,
  ratio * acq_price AS stock, cash * (9e-1 + (event_id % 13) / 64e0) AS target_price,
  CASE WHEN event_id % 2 = 0 THEN 65e-2 ELSE 1e0 END AS weight
FROM {deals} d WHERE pi_cash IS NOT NULL""",
    # training rows of the outcome model, with its nine features
    "training": """
SELECT event_id, deal_status AS label, CAST(EXTRACT(YEAR FROM announce_date) AS INT) AS year, CAST(EXTRACT(YEAR FROM announce_date) AS DOUBLE) AS announce_year, LN(1e0 + value_mil) AS log_value,
  CASE WHEN event_id % 5 <> 0 THEN (party % 60) / 4e0 - 3e0 + (event_id % 7) / 8e0 END AS tv_ebitda, LOWER(deal_type) AS deal_type, LOWER(payment_type) AS payment_type,
  CASE party % 7 WHEN 0 THEN '' WHEN 1 THEN 'ln' WHEN 2 THEN 'cn' ELSE 'us' END AS target_market, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN 'jp' WHEN 2 THEN 'ln' ELSE 'us' END AS acquirer_market,
  CASE WHEN event_id % 3 = 0 THEN 'missing' ELSE 'present' END AS target_cusip, CASE WHEN party % 6 = 0 THEN 'missing' ELSE 'present' END AS acquirer_cusip FROM {deals}""",
    # what was disclosed of each deal's elections: the demand itself, or prose of a final or of a preliminary proration
    "disclosed": """
SELECT event_id, announce_date, party, deal_status, deal_type, payment_type, value_mil, ratio_type, cash, ratio, acq_price, pi_cash, CASE WHEN event_id % 3 = 0 THEN f_cash END AS reported,
  CASE WHEN event_id % 3 = 1 AND f_cash > 0 THEN CONCAT('Subject to proration, holders who made cash elections received cash for ', CAST(CAST(FLOOR(1e2 * LEAST(1e0, pi_cash / f_cash) + 37e-2) AS INT) AS STRING), '% of their shares') END AS final_results,
  CASE WHEN event_id % 3 = 2 AND f_cash > 0 THEN CONCAT('Preliminary results: a cash proration factor of 0.', LPAD(CAST(CAST(FLOOR(99e0 * LEAST(1e0, pi_cash / f_cash) + 37e-2) AS INT) AS STRING), 2, '0')) END AS preliminary_results
FROM {deals} WHERE pi_cash IS NOT NULL""",
    # the raw fields that the structural outcome model reads, beside what was disclosed
    "traits": """
SELECT d.*, CASE WHEN event_id % 13 <> 0 THEN deal_status END AS label, CASE WHEN event_id % 5 <> 0 THEN (party % 60) / 4e0 - 3e0 + (event_id % 7) / 8e0 END AS tv_ebitda, cash * (9e-1 + (event_id % 13) / 64e0) AS quoted_target,
  cash * 95e-2 AS entry_target, acq_price * (1e0 + (event_id % 13 - 6) / 256e0) AS entry_acquirer, cash - ratio * acq_price AS deal_spread, (cash - ratio * acq_price) / cash AS deal_spread_pct,
  CASE WHEN event_id % 8 <> 0 THEN 1e2 * (1 + event_id % 53) END AS target_adv, 1e4 * (1 + event_id % 31) AS target_dollar_adv, CASE WHEN event_id % 4 <> 0 THEN 2e-3 + (event_id % 7) / 1e4 END AS target_quote_spread_pct,
  1e5 * (1 + event_id % 97) * cash AS target_market_cap, 1e5 * (1 + event_id % 97) AS target_shares, 1e3 * (1 + party % 71) AS acquirer_adv, CASE WHEN event_id % 5 <> 0 THEN 1e-3 + (party % 5) / 1e4 END AS acquirer_quote_spread_pct,
  (event_id % 33) / 64e0 AS short_ratio, (party % 33) / 64e0 AS short_ratio_20, (party % 32) / 64e0 AS passive_percent, (party % 16) / 64e0 AS etf_percent, CASE WHEN event_id % 3 = 1 THEN 1 - pi_cash END AS stock_cap_fraction,
  CASE event_id % 5 WHEN 0 THEN 'Cash or Stock' WHEN 1 THEN ' Cash and  stock' WHEN 2 THEN 'Stock' WHEN 3 THEN NULL ELSE 'Cash' END AS payment_raw, CASE party % 4 WHEN 0 THEN 'n/a' WHEN 1 THEN 'mixed' ELSE 'cash' END AS payment_text,
  CASE event_id % 6 WHEN 0 THEN 'Mixed consideration' WHEN 1 THEN '' ELSE 'stock' END AS other_rule
FROM {disclosed} d""",
    # three-state probabilities, some of them missing
    "odds": """
SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN (event_id % 90) / 64e0 END AS p_completed, CASE WHEN event_id % 3 = 0 THEN (event_id % 13) / 64e0 END AS p_terminated,
  CASE WHEN event_id % 3 = 0 OR event_id % 11 = 0 THEN (event_id % 7) / 64e0 END AS p_withdrawn, CASE WHEN event_id % 4 = 1 THEN (event_id % 70) / 64e0 END AS p_break FROM {deals}""",
    # trades with their expected and realised returns
    "trades": """
SELECT event_id, announce_date, CASE WHEN event_id % 3 = 0 THEN 'ENTER' WHEN event_id % 3 = 1 THEN 'REVERSE' WHEN event_id % 2 = 0 THEN 'REVIEW' ELSE 'PASS_P05' END AS signal,
  CASE WHEN event_id % 7 <> 0 THEN value_mil * 1e3 ELSE 0e0 END AS notional, (acq_price * ratio / cash - 1e0) / 1e1 AS expected_return,
  CASE WHEN f_cash IS NOT NULL THEN (f_cash - 5e-1) / 1e1 END AS realized_return, deal_status FROM {deals} WHERE pi_cash IS NOT NULL""",
    # capacity inputs of each event
    "capacity": """
SELECT event_id, cash, pi_cash, (party % 32) / 64e0 AS passive, CASE WHEN event_id % 6 <> 0 THEN (event_id % 40) / 64e0 END AS holder_positive,
  CASE WHEN event_id % 6 <> 0 THEN (event_id % 11) / 1e1 END AS holder_cash_prob, 1e5 * (1 + event_id % 97) AS shares,
  CASE WHEN event_id % 8 <> 0 THEN 1e2 * (1 + event_id % 53) END AS adv, 1e4 * (1 + event_id % 31) AS dollar_adv, cash * 95e-2 AS entry_price,
  ((event_id % 41) - 20) / 512e0 AS edge_return, CASE WHEN event_id % 2 = 0 THEN 'CASH' ELSE 'STOCK' END AS elect,
  CASE WHEN payment_type LIKE '1%' THEN 'cash' WHEN payment_type LIKE '2%' THEN 'stock' ELSE 'mixed' END AS default_rule FROM {deals} WHERE pi_cash IS NOT NULL""",
}


def _named(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z]\w*)\}", sql)))


def _order(names: list[str], done: list[str]) -> list[str]:
    for x in names:
        if x in DERIVED and x not in done:
            _order(_named(DERIVED[x]), done)
            done.append(x)
    return done


def ctes(sql: str) -> str:
    """SQL for DuckDB: the derived tables named in {braces} become common table expressions before it."""
    plain = lambda s: re.sub(r"\{([a-z]\w*)\}", r"\1", s)
    needed = _order(_named(sql), [])
    body = plain(sql).strip()
    if not needed:
        return body
    head = ",\n".join(f"{x} AS ({plain(DERIVED[x])})" for x in needed)
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(start):
            return f"{start}{head},\n{body[len(start):]}"
    return f"WITH {head}\n{body}"


def averaged_in_order(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """A row for each key with the averages of columns, which are added in the order of rows in df's files, and of files by name: an average of that one row is the same.

    Windows add row by row where sums of parts, as groups have them, would be joined as tasks end.
    """
    place = ["_row"] if len(df.inputFiles()) < 2 else ["_file", "_row"]
    at = {"_file": F.col("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    w = Window.partitionBy(key).orderBy(*place)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = df.select(key, *columns, *[at[c].alias(c) for c in place])
    return d.select(key, *[F.avg(c).over(whole).alias(c) for c in columns], F.row_number().over(w).alias("_n")).where("_n = 1").drop("_n")


class Tables:
    """Raw and derived tables of a folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in RAW:
            found = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        elif name in DERIVED:
            found = self.spark.sql(DERIVED[name], **{x: getattr(self, x) for x in _named(DERIVED[name])})
        else:
            raise AttributeError(name)
        self.__dict__[name] = found
        return found

    def replaced(self, **tables: DataFrame) -> Tables:
        """These tables with others in the place of some; derived ones follow."""
        other = Tables(self.spark, self.sf_dir)
        other.__dict__.update(tables)
        return other

    @cached_property
    def in_order(self) -> Tables:
        """The same with an order's averages added in the order in which the table's rows lie, as one thread that reads them adds. The last bits of an average
        follow that order, and where such averages are compared, ranked or put in bins they decide; else they would follow how files are split among tasks."""
        return self.replaced(lineitem=averaged_in_order(self.lineitem, "l_orderkey", ["l_discount", "l_tax"]))

    @cached_property
    def names_of_tables(self) -> tuple[str, ...]:
        return RAW
