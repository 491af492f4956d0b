"""Decisions on even draws store the deals once and little else; a stored fit is met where rows are, and changes no score."""

import os

import pytest

from tidewater.operators.cuts import cut, shared_folder
from tidewater.plans.catalogue import QUERIES
from tidewater.plans.outcome import predicted
from tidewater.sources.derived import Tables

DATA = "/root/testdata/sf0.01"


def _bytes(path):
    return sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(path) for f in files)


def test_what_is_stored(spark):
    folder = shared_folder(spark).removeprefix("file://")
    if ":" in folder:
        pytest.skip("the shared folder is not local")
    began = _bytes(folder)
    assert len(QUERIES["trade_decision_even"](spark, DATA).collect()) == 12200
    assert _bytes(folder) - began < sum(os.path.getsize(f"{DATA}/{t}.parquet") for t in ("orders", "lineitem", "customer"))


def test_stored_fit(spark, small):
    t = Tables(spark, small)
    rows = lambda d: {(r.event_id, r.label): round(r.probability, 9) for r in d.collect()}
    stored = predicted(t, kept=cut)
    assert rows(stored) == rows(predicted(t))
    # deals are joined from orders, customers and lines; no feature of theirs is shuffled to the fit
    assert "SortMergeJoin [feature" not in stored._jdf.queryExecution().executedPlan().toString()
