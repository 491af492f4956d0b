"""Errors and decisions of the outcome model's candidates: summed where rows are scored, with odd rows among them."""

import math
from collections import Counter
from statistics import mean, variance

import pytest

from tidewater.operators import tuning as T

F2 = T.Features({"x": 1.0, "z": 0.0}, ("k",))
SCHEMA = "event_id long, label string, year int, x double, z double, k string"


def odd_rows():
    rows = []
    for i in range(180):
        label = (*T.STATES, "completed")[i % 4] if i % 31 else (None, "other")[i % 2]
        rows.append((i, label, None if i == 77 else 2000 + i // 40, None if i % 7 == 0 else (i * 37 % 101) / 25, None if i < 90 else (i * 13 % 17) / 4, (None, "", "a", "b", f"only{i // 40}")[i % 5]))
    return rows


def plain_errors(rows, candidates):
    """By the rule, with a fit for each year and candidate."""
    name, found = lambda v: v or "__missing__", {}
    for y in sorted({r[2] for r in rows if r[2]}):
        train = [r for r in rows if r[2] and r[2] < y and r[1] in T.STATES]
        n, words = Counter(r[1] for r in train), {name(r[5]) for r in train} | {"__missing__", "__other__"}
        for c in candidates:
            alpha, strength, shrink, weight, blend = c
            prior = [(n[s] + strength * d) / (len(train) + strength) for s, d in zip(T.STATES, T.DEFAULTS)]
            total = 0.0
            for r in (r for r in rows if r[2] == y):
                score = []
                for s, q in zip(T.STATES, prior):
                    ll = 0.0
                    for at in (3, 4):
                        own, every = ([t[at] for t in train if t[at] is not None and (t[1] == s or not one)] for one in (True, False))
                        g = max(variance(every), 1e-4) if len(every) > 1 else 1.0
                        m, v = (mean(own), max((1 - shrink) * variance(own) + shrink * g, 1e-4)) if len(own) > 1 else (mean(every), g) if every else (0.0, 1.0)
                        ll += 0.0 if r[at] is None else -0.5 * (math.log(2 * math.pi * v) + (r[at] - m) ** 2 / v)
                    word = name(r[5]) if name(r[5]) in words else "__other__"
                    ll += math.log((sum(t[1] == s and name(t[5]) == word for t in train) + alpha) / (n[s] + alpha * len(words)))
                    score.append(math.log(max(q, 1e-12)) + weight * ll)
                e = [math.exp(v - max(score)) for v in score]
                total += sum(((1 - blend) * v / sum(e) + blend * q - (r[1] == s)) ** 2 for s, v, q in zip(T.STATES, e, prior))
            found[y, c] = total
    return found


def test_errors_are_those_of_every_candidate_without_a_row_for_each(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    models = T.cut(T.yearly_models(df, F2))
    candidates = (*T.GRID[::9], *T.GRID[-4:], T.UNTUNED, (3.0, 2.0, 0.1, 0.3, 0.6))
    errors = T.errors_by_year(df, models, F2, candidates)
    assert "Generate" not in errors._jdf.queryExecution().executedPlan().toString()
    got = errors.collect()
    want = plain_errors(rows, candidates)
    assert {(r.year, tuple(r[n] for n in T.NAMES)): r.error for r in got} == pytest.approx(want)
    assert {r.year: r.n for r in got} == Counter(r[2] for r in rows if r[2])


def test_decisions_are_those_of_the_predictions(spark):
    """What nested_decisions counts where rows are scored, against the rows of the predictions."""
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    found = T.nested(df, F2, least=6)
    years = {r.outer for r in found.choices.collect()}
    assert len(years) >= 3
    own = found.choices.selectExpr("outer AS year", *T.NAMES, "power")
    from_counts = {r.year: tuple(r)[1:] for r in T.class_scores(found.taken.join(own, ["year", *T.NAMES, "power"]), ["year"], T.F.col("n")).collect()}
    from_rows = {r.year: tuple(r)[1:] for r in T.class_scores(found.predictions, ["year"]).collect()}
    assert set(from_rows) == years and from_counts == from_rows
    untuned = {r.year: r.e for r in found.predictions.groupBy("year").agg(T.F.sum(T.squared_error("untuned_p")).alias("e")).collect()}
    want = plain_errors(odd_rows(), [T.UNTUNED])
    assert untuned == pytest.approx({y: want[y, T.UNTUNED] for y in years})


def test_no_year_is_tuned_where_nothing_is_labelled(spark):
    df = spark.createDataFrame([(1, None, 2000, 1.0, None, "a"), (2, "completed", None, 1.0, 2.0, "b")], SCHEMA)
    found = T.nested(df, F2)
    assert found.choices.count() == 0 and found.taken.count() == 0 and found.predictions.count() == 0
