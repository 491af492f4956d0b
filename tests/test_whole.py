"""Queries read all rows of their tables; operators on rows that are odd."""

import pytest
from pyspark.sql import functions as F

from tidewater.plans.catalogue import QUERIES
from tidewater.sources.derived import Tables


def events(df):
    return df.select("event_id").distinct().count()


@pytest.mark.parametrize("name", ["holder_rolling_fit", "predict_votes"])
def test_holders(spark, small, name):
    assert events(QUERIES[name](spark, small)) == Tables(spark, small).deals.where("pi_cash IS NOT NULL").count()


@pytest.mark.parametrize("block", [60, 100])
def test_rolling_fits_do_not_depend_on_blocks(spark, small, block):
    from tidewater.operators import holders
    from tidewater.plans.capacity import CFG

    panel = holders.panel(Tables(spark, small).deals).withColumn("f_cash", F.when(F.col("event_id") % 4 != 0, F.col("f_cash"))).limit(400)
    want = {r.event_id: tuple(r) for r in holders.rolling_fit(panel, CFG, 10**6).collect()}
    assert {r.event_id: tuple(r) for r in holders.rolling_fit(panel, CFG, block).collect()} == want and len(want) == 400


@pytest.mark.parametrize("name", ["nb_predict", "outcome_probabilities"])
def test_outcome_of_each_event(spark, small, name):
    assert events(QUERIES[name](spark, small)) == Tables(spark, small).training.count()


def test_outcome_scores_count_each_event(spark, small):
    n = Tables(spark, small).training.count()
    assert QUERIES["brier_scores"](spark, small).agg(F.sum("n")).first()[0] == n
    assert QUERIES["class_metrics"](spark, small).agg(F.sum("called")).first()[0] == n


def test_sizes_of_each_deal(spark, small):
    assert events(QUERIES["capacity_grid"](spark, small)) == Tables(spark, small).quotes.count()


def test_rows_without_an_event_in_common_stay(spark):
    from tidewater.operators.asof import asof

    left = spark.createDataFrame([("a", 3), ("a", 3), ("a", None), ("b", 1), (None, 2), ("a", 0), ("a", 9)], "k string, at int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 3, 30.0), ("a", 3, 31.0), ("a", 5, None), ("a", 7, 70.0), ("a", None, 1.0), (None, 2, 5.0)], "k string, t int, v double")
    got = {how: sorted(((r.k, r.at, r.v) for r in asof(left, right, ["k"], "at", "t", ["v"], how).collect()), key=str) for how in ("backward", "forward", "nearest")}
    assert got["backward"] == sorted([("a", 3, 31.0), ("a", 3, 31.0), ("a", None, None), ("b", 1, None), (None, 2, None), ("a", 0, None), ("a", 9, 70.0)], key=str)
    assert got["forward"] == sorted([("a", 3, 30.0), ("a", 3, 30.0), ("a", None, None), ("b", 1, None), (None, 2, None), ("a", 0, 10.0), ("a", 9, None)], key=str)
    assert got["nearest"] == sorted([("a", 3, 31.0), ("a", 3, 31.0), ("a", None, None), ("b", 1, None), (None, 2, None), ("a", 0, 10.0), ("a", 9, 70.0)], key=str)


def test_ids_of_seven_digits(spark):
    from tidewater.plans import scalars

    class Some:
        deals = spark.sql("SELECT 1234567L AS event_id, 1 AS party, DATE '2020-02-03' AS announce_date, 'x' AS payment_type")
        customer = spark.sql("SELECT 1 AS c_custkey, 'n' AS c_name")

    assert [r.id[:18] for r in scalars.event_id_build(Some).collect()] == ["E1234567_20200203_"]


def test_draws_of_each_deal(spark, small):
    """Few draws against the same as rows; by default, shares of losses in steps of 1 / 20,000."""
    from tidewater.operators import payoff, sampling
    from tidewater.plans import stochastic

    d = stochastic.fitted(Tables(spark, small)).where("event_id % 8 = 0")
    j = sampling.beta_draws(d, 256, 11).join(d.drop("a", "b"), "event_id")
    made = payoff.prorate(F.col("f"), F.col("pi_cash"), F.col("cash"), F.col("stock"))["optimal"]
    j = j.select("event_id", "draw_id", (payoff.overlay(F.col("u"), F.col("p_completed"), F.col("p_terminated"), made, F.col("m") * 0.75, F.col("m") * 0.65) / F.col("m") - 1).alias("r"))
    names = ["event_id", "mean", "p05", "p50", "p95", "loss_probability"]
    want = {r.event_id: r for r in sampling.summary(j, ["event_id"], "r").select(names).collect()}
    got = {r.event_id: r for r in sampling.deal_summaries(d, 256, 11).collect()}
    assert got and set(got) == set(want)
    for k, r in want.items():
        assert [got[k][x] for x in names] == pytest.approx(list(r), abs=1e-9) and got[k].cvar05 <= got[k].p05 + 1e-12
    paths = {r.draw_id: r.r for r in j.groupBy("draw_id").agg(F.avg("r").alias("r")).collect()}
    assert {r.draw_id: r.r for r in sampling.mean_paths(d.repartition(3), 256, 11).collect()} == pytest.approx(paths, abs=1e-12)
    losses = [r.loss_probability * 20_000 for r in QUERIES["mc_summary"](spark, small).collect()]
    assert losses == pytest.approx([round(x) for x in losses], abs=1e-6) and any(round(x) * 256 % 20_000 for x in losses)


def test_draws_of_elections_agree_with_their_terms(spark, small):
    """Without breaks and with demand that hardly varies, draws give the terms' own net alpha; with breaks only, the break's."""
    from tidewater.operators import structural
    from tidewater.plans import structural as plans

    d = plans.elections(Tables(spark, small)).where("event_id % 40 = 0")
    still = structural.TradeConfig(concentration=1e9)
    sure = d.withColumns({"p_terminated": F.lit(0.0), "p_withdrawn": F.lit(0.0)})
    got = {r.event_id: r for r in structural.simulated(sure, still, 200).collect()}
    rows = d.collect()
    assert len(got) == len(rows) > 20
    for r in rows:
        for c in ("cash", "stock"):
            assert got[r.event_id][f"{c}_mean"] == pytest.approx(r[f"{c}_net"], abs=1e-2) and got[r.event_id][f"{c}_cash_fill_mean"] == pytest.approx(r[f"{c}_cash_fill"], abs=1e-3)
    broken = d.withColumns({"p_terminated": F.lit(1.0), "p_withdrawn": F.lit(0.0)})
    for r in structural.simulated(broken, still, 50).collect():
        assert r.cash_mean == pytest.approx(r.cash_terminated) and r.cash_gross_mean is None
    a, b = (structural.simulated(d.repartition(n), structural.TradeConfig(), 100).orderBy("event_id").collect() for n in (1, 7))
    assert a == b


def test_draws_with_a_spread(spark):
    from tidewater.operators import sampling

    fits = spark.createDataFrame([(1, 2.0, 3.0, 0.2, 0.4, 0.0, 1.5), (2, 2.0, 3.0, 0.2, 0.4, 0.3, 1.5), (3, 2.0, 3.0, 0.2, 0.4, None, None)], "event_id long, a double, b double, intercept double, slope double, se_slope double, spread double")
    got = {r.event_id: r for r in sampling.demand_draws(fits, 20_000, 5).groupBy("event_id").agg(F.avg("f").alias("m"), F.var_samp("f").alias("v"), F.count("f").alias("n")).collect()}
    mu = 1 / (1 + 2.718281828459045 ** -(0.2 + 0.4 * 1.5))
    assert got[1].m == pytest.approx(mu, abs=0.01) and got[1].v == pytest.approx(mu * (1 - mu) / 6, rel=0.05) and got[1].n == 20_000
    assert got[2].m != pytest.approx(got[1].m, abs=1e-4)  # one slope for the event, drawn once
    assert got[3].m == pytest.approx(0.4, abs=0.01)  # no spread: as without it
    same = {r.event_id: r.f for r in sampling.demand_draws(fits, 1, 5, condition=False).collect()}
    assert same == {r.event_id: r.f for r in sampling.beta_draws(fits, 1, 5).collect()}


def test_nested_decisions_by_hand(spark, small):
    """The whole nested evaluation once more, with a fit for every fold."""
    import math
    from collections import Counter
    from statistics import mean, variance

    from tidewater.operators import tuning
    from tidewater.plans import tuning as plans

    states, base = ("completed", "terminated", "withdrawn"), (0.88, 0.07, 0.05)
    training = Tables(spark, small).training
    data = [r for r in training.collect() if r.event_id % 3 == 0]
    numbers, kinds = list(plans.FEATURES.numeric), list(plans.FEATURES.categorical)
    named = lambda v: v or "__missing__"

    def fit(train, p):
        alpha, strength, shrink, weight, blend = p
        n = Counter(r.label for r in train)
        prior = {s: (n[s] + strength * b) / (len(train) + strength) for s, b in zip(states, base)}
        num, cat = {}, {}
        for k in numbers:
            every = [r[k] for r in train if r[k] is not None]
            g = max(variance(every), 1e-4)
            for s in states:
                x = [r[k] for r in train if r.label == s and r[k] is not None]
                num[s, k] = (mean(x), max((1 - shrink) * variance(x) + shrink * g, 1e-4)) if len(x) > 1 else (mean(every), g)
        words = {k: {named(r[k]) for r in train} | {"__missing__", "__other__"} for k in kinds}
        for k in words:
            cat[k] = Counter((r.label, named(r[k])) for r in train)

        def score(r):
            s1 = {}
            for s in states:
                ll = sum(-0.5 * (math.log(2 * math.pi * v) + (r[k] - m) ** 2 / v) for k, (m, v) in ((k, num[s, k]) for k in numbers) if r[k] is not None)
                ll += sum(math.log((cat[k][s, named(r[k]) if named(r[k]) in words[k] else "__other__"] + alpha) / (n[s] + alpha * len(words[k]))) for k in words)
                s1[s] = math.log(max(prior[s], 1e-12)) + weight * ll
            top = max(s1.values())
            e = {s: math.exp(v - top) for s, v in s1.items()}
            return {s: (1 - blend) * e[s] / sum(e.values()) + blend * prior[s] for s in states}

        return score, prior

    years = sorted({r.year for r in data})
    before = {y: [r for r in data if r.year < y] for y in years}
    least = {y: min(Counter({s: 0 for s in states} | Counter(r.label for r in before[y])).values()) for y in years}
    error = {}
    for y in years:
        if least[y] >= 5:
            for p in tuning.GRID[::7]:
                score, _ = fit(before[y], p)
                error[y, p] = [sum((score(r)[s] - (r.label == s)) ** 2 for s in states) for r in data if r.year == y]
    f = plans.FEATURES
    df = spark.createDataFrame([r.asDict() for r in data], training.schema)
    models = tuning.cut(tuning.yearly_models(df, f))
    errors = tuning.cut(tuning.errors_by_year(df, models, f, tuning.GRID[::7]))
    got = {(r.year, r.alpha, r.strength, r.shrink, r.weight, r.blend): r.error for r in errors.where("least >= 5").collect()}
    assert got == pytest.approx({(y, *p): sum(e) for (y, p), e in error.items()})
    outer = [y for y in years if least[y] >= 10]
    chosen = {r.outer: tuple(r[n] for n in tuning.NAMES) for r in tuning.tuned(errors, spark.createDataFrame([(y,) for y in outer], "outer int"), 5).collect()}
    for y in outer:
        seen = [v for v in years if v < y and least[v] >= 5][-5:]
        rank = {p: (round(sum(sum(error[v, p]) for v in seen) / sum(len(error[v, p]) for v in seen), 10), -p[3], p[0], *p) for p in tuning.GRID[::7]} if seen else {tuning.UNTUNED: 0}
        assert chosen[y] == min(rank, key=rank.get)
    table = spark.createDataFrame([(y, *chosen[y]) for y in outer], "outer int, " + ", ".join(f"{n} double" for n in tuning.NAMES))
    power = {r.outer: r.power for r in tuning.decision_powers(df, models, f, errors, table, 5).collect()}
    for y in outer:
        seen = [v for v in years if v < y and least[v] >= 5][-5:]
        rows = []
        for v in seen:
            score, prior = fit(before[v], chosen[y])
            rows += [(r.label, score(r), prior) for r in data if r.year == v]
        best = (None, tuning.DEFAULT_POWER)
        for w in tuning.POWERS if rows else ():
            pred = [max(states, key=lambda s: round(p[s] / max(q[s] ** w, 1e-12), 12)) for _, p, q in rows]
            f1, recall = [], []
            for s in states:
                tp, fp, fn = (sum(1 for (a, _, _), b in zip(rows, pred) if c(a == s, b == s)) for c in (lambda a, b: a and b, lambda a, b: b and not a, lambda a, b: a and not b))
                recall.append(tp / (tp + fn) if tp + fn else 0)
                f1.append(2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0)
            key = (round(sum(f1) / 3, 10), round(sum(recall) / 3, 10), -w)
            if best[0] is None or key > best[0]:
                best = (key, w)
        assert power[y] == best[1]


def test_running_sums_over_ranges(spark):
    from tidewater.operators.running import running

    rows = [(i * 37 % 101 // 3, i, float(i % 7)) for i in range(101)]
    df = spark.createDataFrame(rows, "k int, i int, x double").repartition(5)
    got = {r.i: (r.nth, r.s) for r in running(df, [F.col("k"), F.col("i")], {"s": "x"}).collect()}
    at = sorted(rows)
    assert got == {r[1]: (n, sum(x[2] for x in at[:n])) for n, r in enumerate(at)}
    assert running(df.limit(0), [F.col("k")], {"s": "x"}).count() == 0
