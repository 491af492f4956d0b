"""Even draws of the structural model go through arrays, and prose is read once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions.numbers import proration_factor
from tidewater.operators import structural as S
from tidewater.plans.panel import realized_share


@pytest.mark.parametrize("hedge", ["conversion_expected", "dollar_neutral", "none"])
def test_deals_together_are_deals_one_by_one(hedge):
    rng, rows = np.random.default_rng(3), []
    for i in range(120):
        x = {"event_id": i, "cash": rng.uniform(10, 60), "stock": rng.uniform(10, 60), "ratio": None if i % 7 == 0 else rng.uniform(0.5, 2), "entry": rng.uniform(10, 60), "entry_acq": rng.uniform(10, 60)}
        x |= {"cash_cap": None if i % 11 == 0 else rng.uniform(0.2, 0.8), "stock_cap": rng.uniform(0.2, 0.8), "cash_demand": float(rng.choice([0, 1, rng.random()])), "own_share": rng.uniform(0, 0.25)}
        x |= {"target_spread": None if i % 5 == 0 else 0.002, "acq_spread": None if i % 3 == 0 else 0.001, "days": 30 + i % 60, "p_terminated": 1.0 if i % 13 == 0 else 0.1, "p_withdrawn": 0.0 if i % 13 == 0 else 0.05}
        rows.append(x | {f"{c}_{k}": -share * x["entry"] - 1 for c in S.CHOICES for k, share in (("terminated", 0.25), ("withdrawn", 0.35))})
    cfg = S.TradeConfig(hedge=hedge)
    together = {k: np.array([np.nan if x[k] is None else x[k] for x in rows], float)[:, None] for k in rows[0] if k != "event_id"}
    for c in S.CHOICES:
        one = np.array([[np.nan if v is None else v for v in S.drawn_choice(x, c, cfg, 32, True)] for x in rows], float)
        np.testing.assert_allclose(np.array(S.drawn_together(together, c, cfg, 32)).T, one, rtol=0, atol=1e-10)


def test_prose_is_read_once(spark):
    fill = proration_factor(F.col("x"), "cash")
    assert fill._jc.toString().lower().count("regexp_extract") <= 2
    share = realized_share(F.col("a"), F.col("b"), F.col("cap"), fill, fill)
    assert share._jc.toString().lower().count("regexp_extract") <= 4
