"""Prices mended once and for all, and answers that count whole or not at all."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewater.operators import labels as L
from tidewater.operators import price_repair as R
from tidewater.plans import repairs
from tidewater.sources.derived import Tables


def test_a_second_repair_changes_nothing(spark, small):
    t = Tables(spark, small)
    once = R.repaired(t.vendor_prices, t.acquirers, t.links, t.securities, t.price_overrides).cache()
    twice = R.repaired(once, t.acquirers, t.links, t.securities, t.price_overrides)
    assert sorted(map(tuple, once.collect()), key=str) == sorted(map(tuple, twice.collect()), key=str)
    kinds = {r.symbol_source for r in once.select("symbol_source").distinct().collect()}
    assert "vendor" in kinds and len(kinds) >= 2


def test_repair_by_hand(spark):
    day = lambda n: dt.date(2024, 1, n)
    prices = spark.createDataFrame(
        [(1, "target", day(2), 10.0, 5, None, "vendor"), (2, "target", day(2), 11.0, 5, None, "vendor"), (2, "acquirer", day(2), 99.0, 5, None, "vendor"), (3, "target", day(2), 12.0, 5, None, "vendor"), (4, "target", day(2), 1.0, 1, None, "vendor"), (4, "acquirer", day(2), 2.0, 1, None, "vendor")],
        "event_id long, side string, price_date date, price double, volume long, permno long, symbol_source string",
    )
    events = spark.createDataFrame([(1, day(10), "ab-12 3456xx"), (2, day(10), "AB123456"), (3, day(10), "ZZ000000"), (4, day(10), None), (9, day(10), "AB123456")], "event_id long, announce_date date, cusip string")
    links = spark.createDataFrame([(70, "AB123456", day(1), day(5)), (71, "AB123456", day(9), day(20)), (72, "AB123456", day(10), day(11)), (80, "ZZ000000", day(1), day(3)), (81, "ZZ000000", day(1), day(4))], "permno long, cusip8 string, from_date date, to_date date")
    securities = spark.createDataFrame([(71, day(3), 7.0, 1), (71, day(30), 8.0, 1), (71, dt.date(2022, 1, 1), 6.0, 1), (81, day(4), 5.0, 1), (55, day(6), 4.0, 1)], "permno long, price_date date, price double, volume long")
    overrides = spark.createDataFrame([(2, "acquirer", 55), (4, "acquirer", 1000), (9, "target", 55)], "event_id long, side string, permno long")
    plan = {(r.event_id, r.side): (r.permno, r.replace) for r in R.repair_plan(prices, events, links, overrides).collect()}
    assert plan == {(1, "acquirer"): (71, False), (3, "acquirer"): (81, False), (2, "acquirer"): (55, True), (4, "acquirer"): (1000, True)}
    got = {(r.event_id, r.side, r.price_date.day): (r.price, r.symbol_source) for r in R.repaired(prices, events, links, securities, overrides).collect()}
    assert got[1, "acquirer", 3] == (7.0, "cusip_permno_fix") and got[1, "acquirer", 30] == (8.0, "cusip_permno_fix") and got[3, "acquirer", 4][0] == 5.0
    assert got[2, "acquirer", 6] == (4.0, "acquirer_permno_override") and (2, "acquirer", 2) not in got
    # an override without prices replaces nothing, and an event without prices gets none
    assert got[4, "acquirer", 2] == (2.0, "vendor") and not [k for k in got if k[0] == 9] and len(got) == 9
    assert R.repaired(prices.limit(0), events, links, securities, overrides).count() == 0


def test_requests_hold_what_is_asked(spark, small):
    t = Tables(spark, small)
    for r in L.requests(t.extraction, repairs.LABELS, repairs.CONTEXT).collect():
        payload = json.loads(r.payload)
        assert payload["event_id"] == str(r.event_id) and payload["raw_disclosure"] == {k: r[k] for k in (*repairs.LABELS, *repairs.CONTEXT)} and (r.purchase or r.click)
    rows = spark.createDataFrame([(1, "purchase", " Not Found ", 1), (1, "purchase", "40%", 2), (2, "view", "x", 1), (3, "click", "n/a", 1)], "event_id long, field_name string, value string, row_idx long")
    assert [(r.event_id, r.purchase) for r in L.requests(rows, ("purchase", "click"), ("view",)).collect()] == []
    assert [(r.event_id, r.purchase) for r in L.requests(rows.where("row_idx = 2"), ("purchase", "click"), ("view",)).collect()] == [(1, "40%")]


def test_answers_by_hand(spark):
    asked = spark.createDataFrame([(i,) for i in range(1, 12)], "event_id long")
    texts = {
        1: 'sure: {"pct_elected_cash": 41.5, "basis": "direct", "disclosure_type": "elected_pct", "notes": "a"} ok',
        2: "none",
        3: '{"pct_elected_cash": 140}',
        4: '{"cash_proration_factor": -0.1}',
        5: '{"pct_elected_cash": null, "aggregate_cash_usd": 1e9}',
        6: '{"disclosure_type": "perhaps"}',
        7: '{"pct_elected_cash": "forty", "basis": "wrong"}',
        8: '{"pct_elected_cash": 40, ',
        9: "{}",
        99: '{"pct_elected_cash": 1}',
    }
    answers = spark.createDataFrame([*texts.items(), (10, "broken"), (10, '{"pct_elected_cash": 7}')], "event_id long, response string")
    got = {r.event_id: r for r in L.merged(asked, answers).collect()}
    want = {1: "ok", 2: "parse_error", 3: "bad_pct_elected_cash", 4: "bad_cash_proration_factor", 5: "ok", 6: "bad_disclosure_type", 7: "bad_pct_elected_cash", 8: "parse_error", 9: "parse_error", 10: "ok", 11: "no_answer", 99: "not_requested"}
    assert {k: r.status for k, r in got.items()} == want
    assert (got[1].pct_elected_cash, got[1].basis, got[1].notes) == (41.5, "direct", "a") and got[5].aggregate_cash_usd == 1e9 and got[5].pct_elected_cash is None
    assert got[10].pct_elected_cash == 7 and all(got[k][c] is None for k in got if want[k] != "ok" for c in (*L.NUMBERS, *L.TEXTS))
    assert L.merged(asked.limit(0), answers.limit(0)).count() == 0 and L.merged(asked, answers.where(F.lit(False))).where("status = 'no_answer'").count() == 11
