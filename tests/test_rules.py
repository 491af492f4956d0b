"""Cases worked by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.functions import numbers as N
from tidewater.functions import text as X
from tidewater.operators import asof, capacity, estimators, gates, groups, history, identity, naive_bayes, payoff, sampling


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lits(spark, values, kind):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def got(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_prorate_fills_each_side_up_to_its_pool(spark):
    cases = [(0.5, 0.5, 10.0, 9.0), (0.8, 0.5, 9.25, 9.0)]
    for f, cash_fill_price, cash, blended in cases:
        made = payoff.prorate(F.lit(f), F.lit(0.5), F.lit(10.0), F.lit(8.0))
        r = one(spark, **made)
        assert r.cash_holder == pytest.approx(cash) and r.blended == pytest.approx(blended) and r.optimal == pytest.approx(max(cash, r.stock_holder))
    for f in (0.0, 1.0):
        assert math.isfinite(one(spark, **payoff.prorate(F.lit(f), F.lit(0.5), F.lit(10.0), F.lit(8.0))).optimal)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1), st.floats(1, 99), st.floats(1, 99)), min_size=20, max_size=20))
def test_prorate_conserves_the_pool(spark, rows):
    df = spark.createDataFrame(rows, "f double, p double, c double, s double")
    made = payoff.prorate(F.col("f"), F.col("p"), F.col("c"), F.col("s"))
    f = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("f")))
    out = df.select((f * made["cash_holder"] + (1 - f) * made["stock_holder"]).alias("mix"), made["blended"].alias("b"), made["optimal"].alias("o"))
    for r in out.collect():
        assert r.mix == pytest.approx(r.b, abs=1e-9) and r.o >= r.b - 1e-9


def test_parsers(spark):
    df = lits(spark, ["108,054,170 shares at $40.85", "100%", "0.5%", "50 %", "1/2", "One-half of it", None, "150%"], "string")
    x = F.col("x")
    assert got(df, N.bounded_number(x, 1, 2000))[0] == 40.85
    assert got(df, N.percent_fraction(x))[1:4] == [None, None, 0.5]
    assert got(df, N.fraction(x))[4:7] == [0.5, 0.5, None]
    assert got(df, N.share(x))[7] == pytest.approx(0.015)
    long = lits(spark, ["108,054,170 shares elected cash, representing 40.85% of the 264,507,424 outstanding"], "string")
    assert got(long, N.percent(x)) == [40.85]


def test_words_in_order_of_precedence(spark):
    df = lits(spark, ["terminated; later withdrawn", "deal closed", "n/a", None], "string")
    assert got(df, X.outcome_label(F.col("x"))) == ["withdrawn", "completed", "", ""]
    rules = lits(spark, ["cash and stock mix", "", None, "cash"], "string")
    assert got(rules, X.default_rule_panel(F.col("x"))) == ["mixed", None, None, "cash"]
    assert got(rules, X.default_rule_structural(F.col("x"))) == ["mixed", "mixed", "mixed", "cash"]
    assert got(rules, X.default_rule_probability(F.col("x"), F.lit(0.4))) == [0.4, 0.4, 0.4, 1.0]


def test_identifiers(spark):
    assert got(lits(spark, ["03783310", "bad!"], "string"), X.to_cusip9(F.col("x")))[0] == "037833100"
    same = spark.createDataFrame([(0, "84670108", "084670108"), (1, "84670108", "184670109")], "i int, a string, b string")
    assert got(same, X.cusip_equivalent(F.col("a"), F.col("b"))) == [True, False]
    assert got(lits(spark, ["VMW US", "1436513D US", "BRK/A US"], "string"), X.ticker(F.col("x"))) == ["VMW", "", "BRK/A"]


def test_quarters(spark):
    y, q = N.quarter_before(F.lit("2020-02-10").cast("date"), 1)
    assert tuple(one(spark, y=y, q=q)) == (2019, 4)


def test_first_value_that_is_not_null(spark):
    df = spark.createDataFrame([(1, "a", None, 0), (1, "a", "x", 1), (1, "a", "y", 2)], "e int, f string, v string, i int")
    assert groups.pivot_first(df, "e", "f", "v", "i", ["a", "b"]).collect() == [(1, "x", None)]


def test_asof_takes_the_day_itself_and_else_the_nearest(spark):
    p = spark.createDataFrame([(1, "2020-01-05", 5.0), (1, "2020-01-08", 8.0)], "k int, d string, v double").withColumn("d", F.col("d").cast("date"))
    left = spark.createDataFrame([(1, "2020-01-05"), (1, "2020-01-01"), (2, "2020-01-01")], "k int, at string").withColumn("at", F.col("at").cast("date"))
    find = lambda how: {(r.k, str(r.at)): r.v for r in asof.asof(left, p, ["k"], "at", "d", ["v"], how).collect()}
    assert find("backward") == {(1, "2020-01-05"): 5.0, (1, "2020-01-01"): None, (2, "2020-01-01"): None}
    assert find("nearest")[1, "2020-01-01"] == 5.0
    assert find("forward")[1, "2020-01-01"] == 5.0


def test_beta_fit_falls_back(spark):
    few = spark.createDataFrame([("a", x) for x in (0.2, 0.3, 0.4, 0.5)] + [("b", 0.4)] * 6, "g string, x double")
    fits = {r.g: (r.a, r.b) for r in estimators.beta_fit(few, ["g"], "x").collect()}
    assert fits["a"] == (1.0, 1.0) and fits["b"] == pytest.approx((8.0, 12.0))


def test_leave_one_out_equals_deletion(spark):
    xs = [0.1, 0.25, 0.3, 0.55, 0.6, 0.9, 0.95]
    made = estimators.beta_leave_one_out(spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "g string, i int, x double"), ["g"], "x").orderBy("i").collect()
    for i, r in enumerate(made):
        rest = np.delete(np.array(xs), i)
        m, v = rest.mean(), rest.var(ddof=1)
        assert (r.a, r.b) == pytest.approx((m * (m * (1 - m) / v - 1), (1 - m) * (m * (1 - m) / v - 1)))


def test_beta_cdf_and_kolmogorov(spark):
    import math

    cdf = lambda x, a, b: estimators.beta_cdf(*(F.lit(v).cast("double") for v in (x, a, b)))
    # for whole numbers the function is a sum of binomial terms
    terms = lambda x, a, b: sum(math.comb(a + b - 1, j) * x**j * (1 - x) ** (a + b - 1 - j) for j in range(a, a + b))
    points = [(0.3, 1, 1), (0.5, 2, 2), (0.2, 2, 3), (0.9, 7, 3), (0.01, 1, 12), (0.6, 40, 30), (0.999, 2, 5)]
    got = one(spark, **{f"p{i}": cdf(*v) for i, v in enumerate(points)}, low=cdf(0, 2, 3), high=cdf(1.5, 2, 3), none=cdf(None, 2, 3))
    assert [got[f"p{i}"] for i in range(len(points))] == pytest.approx([terms(*v) for v in points], rel=1e-11) and (got.low, got.high, got.none) == (0, 1, None)
    assert one(spark, g=estimators.log_gamma(F.lit(0.25))).g == pytest.approx(math.lgamma(0.25), rel=1e-12) and one(spark, p=cdf(0.5, 0.5, 0.5)).p == pytest.approx(0.5)
    ks = one(spark, a=estimators.kolmogorov_p(F.lit(0.01), F.lit(100)), b=estimators.kolmogorov_p(F.lit(0.5), F.lit(100)), c=estimators.kolmogorov_p(F.lit(0.0043), F.lit(100_000)))
    # 1.36 is the limiting distribution's five-percent point
    assert ks.a == 1.0 and ks.b < 1e-6 and ks.c == pytest.approx(0.0494, abs=2e-3)


def test_state_probabilities(spark):
    none = F.lit(None).cast("double")
    assert tuple(one(spark, **payoff.state_probabilities(none, none, none, F.lit(0.2)))) == pytest.approx((0.8, 0.2, 0))
    assert tuple(one(spark, **payoff.state_probabilities(none, none, none, none))) == (1, 0, 0)
    s = one(spark, s=payoff.resolved_probabilities(F.lit(0.9), none, none, none, payoff.OutcomeDefaults(), "event")).s
    assert (s.p_terminated, s.p_withdrawn) == pytest.approx((0.1 * 7 / 12, 0.1 * 5 / 12)) and s.source.endswith("plus_defaults")


def test_gate(spark):
    g = lambda *a: one(spark, g=gates.risk_gate(*map(F.lit, a), gates.GateConfig())).g
    assert tuple(g(0.006, -0.1, -0.2, 0.3)) == (True, pytest.approx(0.03), "risk_adjusted_return_positive")
    assert g(0.001, -0.9, -0.9, 0.9).reason == "risk_adjusted_return_below_hurdle"


def test_capacity(spark):
    pools = F.array(*[capacity.pool(n, F.lit(c), F.lit(0.5)) for n, c in (("a", 0.01), ("b", 0.02), ("c", 0.03))])
    a = one(spark, a=capacity.allocate(pools, F.lit(0.025))).a
    assert a.source_mix == "a:0.40|b:0.60" and a.unfilled == 0 and a.cash_prob == pytest.approx(0.5)
    least, name = capacity.binding(F.lit(0.02), F.lit(0.02), F.lit(0.05))
    assert tuple(one(spark, a=least, b=name)) == (0.02, "source_supply")
    rates = [one(spark, r=capacity.sell_rate(F.lit(e), capacity.CapacityConfig())).r for e in (0.03, 0.0, -0.03)]
    assert rates == pytest.approx([0, 0.02, 0.85])


def test_daily_statistics(spark):
    r = [0.01, -0.005, 0.002, 0.0]
    df = spark.createDataFrame([(x,) for x in r], "r double")
    s = df.agg(*[c.alias(k) for k, c in history.annualised(F.col("r")).items()]).first()
    assert s.day_count == 4 and s.sharpe == pytest.approx(np.mean(r) / np.std(r, ddof=1) * math.sqrt(252))
    assert s.sortino == pytest.approx(np.mean(r) / math.sqrt(np.mean(np.minimum(r, 0) ** 2)) * math.sqrt(252))
    b = spark.createDataFrame([(3.0,), (1.0,), (2.0,)], "r double").agg(*[c.alias(k) for k, c in history.risk_block(F.col("r")).items()]).first()
    assert b.negatives == 0 and b.sortino is None and b.mean_over_std == pytest.approx(2.0)


def test_drawdown_starts_from_the_first_value(spark):
    df = spark.createDataFrame([(1, 1, -0.02), (1, 2, 0.01)], "e int, d int, r double")
    assert history.running(df, ["e"], ["d"], "r").agg(F.min("drawdown")).first()[0] == 0


def test_calendar_leaves_weekends_out(spark):
    df = spark.createDataFrame([("2024-01-05", 1.0), ("2024-01-06", 9.0), ("2024-01-08", 2.0)], "date string, r double").withColumn("date", F.col("date").cast("date"))
    assert [x.r for x in history.business_days(df, ["r"]).orderBy("date").collect()] == [1.0, 2.0]


def test_naive_bayes_needs_no_label_and_adds_up(spark):
    rows = [(i, ("completed", "terminated", "withdrawn")[i % 3], float(i % 7), "ab"[i % 2]) for i in range(40)]
    train = spark.createDataFrame(rows, "id int, label string, x double, c string")
    ask = spark.createDataFrame([(0, 3.0, "never seen"), (1, None, None)], "id int, x double, c string")
    made = naive_bayes.predict(train, ask, "id", "label", ["x"], ["c"], naive_bayes.NBParams()).collect()
    for i in (0, 1):
        p = [r.probability for r in made if r.id == i]
        assert len(p) == 3 and all(0 <= x <= 1 for x in p) and sum(p) == pytest.approx(1, abs=1e-12)


def test_sampler_depends_on_the_event_alone(spark):
    fits = spark.createDataFrame([(i, 2.0, 3.0) for i in range(6)], "event_id long, a double, b double")
    first = sorted(map(tuple, sampling.beta_draws(fits, 50, 1).collect()))
    again = sorted(map(tuple, sampling.beta_draws(fits.repartition(5), 50, 1).collect()))
    assert first == again and np.mean([r[2] for r in first]) == pytest.approx(0.4, abs=0.05)


def test_name_scores(spark):
    df = spark.createDataFrame([("acme", "acme"), ("acme", "acme tools"), ("acme tools", "acme works"), ("x", "y")], "a string, b string")
    assert [r[0] for r in df.select(identity.token_score(F.col("a"), F.col("b"))).collect()] == [100, 95, 87.5, 0]


def test_capacity_settings_of_a_signal_run():
    from tidewater.operators import capacity

    c = capacity.from_signals({"capacity_build_days": 5.0, "capacity_size_points": 2, "grid": 21, "hurdle": 0.1, "rolling_events": 30})
    assert (c.build_days, c.size_points, c.grid, c.rolling_events, c.position_limit) == (5.0, 5, 21, 30, 0.05)


def test_lists_and_names_of_files(spark):
    from tidewater.functions import text as X

    got = spark.createDataFrame([('["a", "b"]',), ('"x"',), ("[bad",), ("7",), (None,), ("n/a",), ("[]",)], "c string").select(X.json_list(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [["a", "b"], ["x"], ["[bad"], ["7"], [], [], []]
    names = ["Doc.HTM", "x.txt", "x-index.htm", "y_lab.xml", "z.pdf", "FilingSummary.xml", None]
    assert [r.v for r in spark.createDataFrame([(n,) for n in names], "c string").select(X.is_document(F.col("c")).alias("v")).collect()] == [True, True, False, False, False, False, False]


def test_shares_print_as_in_c(spark):
    middles = [(2 * k + 1) / 200 for k in range(100)]
    values = [x for m in middles for x in (m, math.nextafter(m, 0), math.nextafter(m, 1))] + [k / 100 for k in range(101)] + [k / 7919 for k in range(7920)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", N.hundredths(F.col("v")).alias("s")).collect()
    assert [r.s for r in got if r.s != f"{r.v:.2f}"] == []


def test_pools_leave_what_their_caps_leave(spark):
    C, caps, q = capacity, (0.1, 0.2, 0.5), 0.7
    pools = F.array(*[C.pool(f"p{k}", F.lit(c), F.lit(k / 2)) for k, c in enumerate(caps)])
    got = spark.range(1).select(F.inline(F.array(C.allocate(pools, F.lit(q))))).first()
    takes = (caps[0], caps[1], q - caps[0] - caps[1])
    assert got.source_mix == "|".join(f"p{k}:{t / q:.2f}" for k, t in enumerate(takes)) and got.cash_prob == (takes[1] / 2 + takes[2]) / sum(takes)
    eighths = spark.range(1).select(F.inline(F.array(C.allocate(F.array(C.pool("a", F.lit(0.625), F.lit(0.0)), C.pool("b", F.lit(1.0), F.lit(0.0))), F.lit(1.0))))).first()
    assert eighths.source_mix == "a:0.62|b:0.38"
