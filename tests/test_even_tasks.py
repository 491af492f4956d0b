"""Even draws cost little, so a task takes many deals of them."""

import pytest

from tidewater.plans import trades


@pytest.mark.parametrize(("draws", "least", "most"), [(trades.EVEN, 10_000, 100_000), (trades.DRAWS, 1, 1_000)])
def test_deals_in_a_task(monkeypatch, draws, least, most):
    seen = []

    def dealt(df, key, rows):
        seen.append(rows)
        raise InterruptedError

    monkeypatch.setattr(trades, "frame", lambda t: t)
    monkeypatch.setattr(trades, "dealt", dealt)
    with pytest.raises(InterruptedError):
        trades.priced(None, draws)
    assert least <= seen[0] <= most
