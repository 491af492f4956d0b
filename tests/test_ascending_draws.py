"""Draws that come in order: their law, and what is read from their order against the plain rule over all of them."""

import math

import numpy as np
import pytest
from test_trades import deals

from tidewater.operators import sampling
from tidewater.operators import structural as S
from tidewater.operators import trades as T


@pytest.mark.parametrize(("a", "b"), [(4.3, 4.4), (0.3, 0.7), (0.25, 75.0), (60.0, 15.0)])
def test_ascending_draws_follow_their_beta(a, b):
    n = 200_000
    f, plain = sampling.sorted_beta(a, b, n, np.random.default_rng(1)), np.sort(np.random.default_rng(2).beta(a, b, n))
    assert (np.diff(f) >= 0).all() and f[0] >= 0 and f[-1] <= 1
    mean, sd = a / (a + b), math.sqrt(a * b / (a + b) ** 2 / (a + b + 1))
    assert abs(f.mean() - mean) < 5 * sd / math.sqrt(n) and abs(f.std() / sd - 1) < 0.02
    assert np.abs(np.searchsorted(plain, f) / n - np.arange(n) / n).max() < 2.5 / math.sqrt(n)


def test_a_deal_on_ascending_draws_is_the_deal_on_any():
    draws = T.Draws(n=3000)
    for x in deals(150):
        f, u = draws.of(x["event_id"], x["a"], x["b"])
        assert (np.diff(f) >= 0).all()
        got, want = dict(zip(T._PRICED, T.one_ascending(f, u, x), strict=True)), dict(zip(T._PRICED, T.one_deal(f, u, x), strict=True))
        # where both values are equal all completed returns tie with the percentile, but for their last digits
        assert all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want if x["cash"] != x["stock"] or "cvar" not in k), (x, got, want)


def test_sums_for_many_sizes_equal_those_one_by_one():
    shifts = np.concatenate([np.linspace(-0.9, 0.9, 37), [0.0]])
    for x in deals(60):
        sizes = T.Sizes(*T.Draws(n=5000).of(x["event_id"], x["a"], x["b"]), x)
        assert np.allclose(sizes._filled_many(shifts), [sizes._filled(d) for d in shifts.tolist()], rtol=1e-12, atol=1e-9)


@pytest.mark.parametrize("hedge", ["conversion_expected", "dollar_neutral", "none"])
@pytest.mark.parametrize("choice", S.CHOICES)
def test_an_election_on_ascending_draws_is_the_election_on_the_same_in_any_order(monkeypatch, hedge, choice):
    cfg, n, rng = S.TradeConfig(hedge=hedge), 4000, np.random.default_rng(9)
    for k in range(80):
        x = {"event_id": k, "cash": rng.uniform(10, 60), "stock": rng.uniform(10, 60), "ratio": None if k % 7 == 0 else rng.uniform(0.5, 2), "entry": rng.uniform(10, 60), "entry_acq": rng.uniform(10, 60)}
        x |= {"cash_cap": rng.uniform(0.2, 0.8), "stock_cap": rng.uniform(0.2, 0.8), "cash_demand": float(rng.choice([0, 1, rng.random()])), "own_share": rng.uniform(0, 0.25), "days": 30 + k % 60}
        x |= {"target_spread": None if k % 5 == 0 else 0.002, "acq_spread": None if k % 3 == 0 else 0.001, "p_terminated": 1.0 if k % 13 == 0 else 0.1, "p_withdrawn": 0.0 if k % 13 == 0 else 0.05}
        x |= {f"{choice}_terminated": -0.25 * x["entry"] - 1, f"{choice}_withdrawn": -0.35 * x["entry"] - 1}

        def same(mean, event_id, c, cfg, draws, even):
            own = np.random.default_rng(S.stable_seed(cfg.seed, event_id, c))
            u = own.random(draws)
            done, f = u >= x["p_terminated"] + x["p_withdrawn"], np.full(draws, 0.5)
            f[done] = own.permutation(sampling.sorted_beta(*(max(cfg.least_alpha_beta, m * cfg.concentration) for m in (mean, 1 - mean)), int(done.sum()), own))
            return u, f

        monkeypatch.setattr(S, "demand_draws", same)
        got, want = S.drawn_ascending(x, choice, cfg, n), S.drawn_choice(x, choice, cfg, n, False)
        assert all(p is q is None or math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9) for p, q in zip(got, want, strict=True)), (x, got, want)
    assert S.drawn_ascending(x | {"cash": None}, choice, cfg, n) == [None] * len(S.DRAWN)
