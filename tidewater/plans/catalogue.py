"""Every query of the library by name, with the SQL that a DuckDB oracle runs for it."""

from __future__ import annotations

from . import capacity, details, estimates, filings, history, identity, joins, outcome, panel, payoff, repairs, scalars, shapes, signals, stochastic, structural, terms, trades, tuning  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
