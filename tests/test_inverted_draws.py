"""Mean paths from one uniform for each draw: the law of the plain draws, cell by cell and over whole books."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.operators import sampling as S

# a, b, cash, stock, pi_cash, m, p_completed, p_terminated
DEALS = [
    (4.3, 4.4, 20.0, 24.0, 0.45, 19.0, 0.48, 0.49),
    (4.3, 4.4, 24.0, 20.0, 0.45, 19.0, 0.9, 0.05),
    (0.3, 0.7, 24.0, 20.0, 0.3, 19.0, 0.7, 0.2),
    (60.0, 15.0, 20.0, 30.0, 0.8, 19.0, 0.001, 0.5),
    (1.0, 1.0, 20.0, 30.0, 0.0, 19.0, 1.0, 0.0),
    (4.0, 4.0, 20.0, 30.0, 1.0, 19.0, 0.0, 1.0),
    (4.0, 4.0, 25.0, 25.0, 0.5, 19.0, 0.6, 0.0),
]


@pytest.mark.parametrize("x", DEALS)
def test_cells_give_the_return_of_each_uniform(x):
    words = np.random.default_rng(4).integers(0, 2**32, 300_001, dtype=np.uint32)
    deal = S.Inverted(x)
    got, u = deal.returns(words).copy(), (words + 0.5) / 2**32
    a, b, cash, stock, pi, m, done, ended = x
    f = np.clip(np.interp(np.minimum(u / max(done, 1e-12), 1), *S.beta_quantiles(a, b)), S.CLIP, 1 - S.CLIP)
    cash_fill, stock_fill = np.minimum(1, pi / f), np.minimum(1, (1 - pi) / (1 - f))
    best = np.maximum(cash_fill * cash + (1 - cash_fill) * stock, stock_fill * stock + (1 - stock_fill) * cash)
    want = np.where(u < done, best, np.where(u < done + ended, m * 0.75, m * 0.65)) / m - 1
    assert np.abs(got - want).max() < 2e-5
    assert ((got < -0.2) == (want < -0.2)).all()  # no draw lies between two outcomes


@pytest.mark.parametrize("x", DEALS)
def test_the_law_is_that_of_plain_draws(x):
    n = 200_000
    a, b, cash, stock, pi, m, done, ended = x
    got = np.sort(S.Inverted(x).returns(S.words_of(7, 11, n, np.random.PCG64(0))).copy())
    rng = np.random.default_rng(5)
    f, u = rng.beta(a, b, n), rng.random(n)
    want = np.sort(np.where(u < done, S._better(f, pi, cash, stock), np.where(u < done + ended, m * 0.75, m * 0.65)) / m - 1)
    at = np.unique(np.concatenate([got[:: n // 500], want[:: n // 500]])) + 1e-5
    assert np.abs(np.searchsorted(got, at) - np.searchsorted(want, at)).max() / n < 0.01
    assert abs(got.mean() - want.mean()) < 6 * want.std() / np.sqrt(n) + 1e-9


def test_words_are_the_event_s_own():
    source = np.random.PCG64(0)
    first = S.words_of(1, 11, 1001, source)
    other, salted = S.words_of(2, 11, 1001, source), S.words_of(1, 12, 1001, source)
    assert (S.words_of(1, 11, 1001, np.random.PCG64(9)) == first).all() and len(first) == 1001
    for x in (other, salted):
        assert abs(np.corrcoef(first, x)[0, 1]) < 0.15 and (first == x).sum() < 3


def test_paths_do_not_depend_on_order_or_partitions(spark):
    rows = [(i, *DEALS[i % len(DEALS)][:6], *((None, None) if i % 5 == 0 else DEALS[i % len(DEALS)][6:])) for i in range(70)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, cash double, stock double, pi_cash double, m double, p_completed double, p_terminated double")
    one, many = ({r.draw_id: r.r for r in S.mean_paths_inverted(d, 1003, 11).collect()} for d in (df.coalesce(1), df.orderBy(F.rand(3)).repartition(5)))
    assert sorted(one) == list(range(1003)) and one == pytest.approx(many, abs=1e-12)
    plain = np.array([r.r for r in S.mean_paths(df, 1003, 11).collect()])
    mine = np.array(list(one.values()))
    error = plain.std() / np.sqrt(1003)
    assert abs(mine.mean() - plain.mean()) < 6 * error and abs(mine.std() / plain.std() - 1) < 0.12
