"""Stages of queries written as tables, with a ledger, so that a run that died goes on where it was; and the reports of a run."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .sources.exports import safely, write_manifest, write_markdown, write_summary
from .sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]

STAGES = {
    "check": ("preflight_schema",),
    "outcome": ("deadline_spread", "outcome_probabilities", "nested_oos"),
    "mc": ("deal_terms", "realized_edge", "mc_summary", "portfolio_mc", "pit_calibration"),
    "signal": ("blotter", "capacity_inputs", "binding_constraint", "hedge_path", "portfolio_daily", "strategy_summary"),
    "structural": ("rolling_outcomes", "choice_decision", "rolling_backtest"),
    "material": ("confusion_matrix", "brier_scores", "event_curve", "side_performance", "histogram_bins", "yearly_share", "label_quality"),
}
STAGES["fast"] = STAGES["outcome"] + STAGES["mc"] + STAGES["signal"] + STAGES["material"]
STAGES["all"] = STAGES["check"] + STAGES["fast"] + STAGES["structural"]

#: What each layer of a run is for.
LAYERS = [
    ("check", "inputs with the columns that are needed"),
    ("outcome", "probabilities of each deal's outcome, and what they score on years they have not seen"),
    ("mc", "payoffs of each deal over draws of demand and outcome"),
    ("signal", "the trade of each deal, its capacity, and the portfolio that the trades make"),
    ("structural", "decisions rolled along time, and their result"),
    ("material", "tables behind the charts"),
]
#: Tables of one row, for a summary of their own.
SUMMARIES = ("strategy_summary", "portfolio_mc", "pit_calibration", "rolling_backtest")
#: Sections of the report.
REPORT = ("strategy_summary", "nested_oos", "pit_calibration", "confusion_matrix", "side_performance", "rolling_backtest")


class Ledger:
    """What has been written, one small file for each table: the fingerprint of its input, where it is, its rows and how it went."""

    def __init__(self, spark: SparkSession, out: str):
        self.store, self.folder = Store(spark, out), f"{out}/_ledger"
        self.store.make_folder(self.folder)

    def read(self, name: str) -> dict:
        path = f"{self.folder}/{name}.json"
        return json.loads(self.store.read_text(path)) if self.store.exists(path) else {}

    def whole(self, name: str, fingerprint: str, path: str) -> bool:
        """Whether a table needs no other run: written to the end from the same input."""
        entry = self.read(name)
        return entry.get("status") == "ok" and entry.get("input") == fingerprint and self.store.exists(f"{path}/_SUCCESS")

    def write(self, name: str, **entry) -> None:
        self.store.write_text(f"{self.folder}/{name}.json", json.dumps({"name": name, **entry}, sort_keys=True))


def run_stage(spark: SparkSession, queries: Mapping[str, Query], names: tuple[str, ...], sf_dir: str, out: str) -> list[dict]:
    """Writes each query's rows to out/NAME and returns how each went: `ok`, `kept` (whole from an earlier run over the same input) or `error`, which the others do not wait for.

    A table is written anew unless the ledger says that it is whole; its entry comes after its last file, so a run killed at any point leaves no table
    that a later one would take for whole.
    """
    store = Store(spark, out)
    store.make_folder(out)
    ledger, fingerprint, done = Ledger(spark, out), Store(spark, sf_dir).fingerprint(sf_dir), []
    for name in dict.fromkeys(names):
        path = f"{out}/{name}"
        if ledger.whole(name, fingerprint, path):
            done.append({"layer": name, "status": "kept"})
            continue

        def write(name=name, path=path):
            ledger.write(name, status="started", input=fingerprint, path=path)
            queries[name](spark, sf_dir).write.mode("overwrite").parquet(path)
            ledger.write(name, status="ok", input=fingerprint, path=path, rows=spark.read.parquet(path).count())

        went = safely(spark, out, name, write)
        if went["status"] == "error":
            ledger.write(name, status="error", input=fingerprint, path=path, error=went["error"])
        done.append(went)
    return done


def write_reports(spark: SparkSession, names: tuple[str, ...], out: str) -> list[dict]:
    """Summaries, the report and the manifest of what a run has written; a part that fails is logged and the others go on."""
    ledger = Ledger(spark, out)
    there = [n for n in names if ledger.read(n).get("status") == "ok"]
    table = lambda n: spark.read.parquet(f"{out}/{n}")
    done = [safely(spark, out, f"summary of {n}", lambda n=n: write_summary(table(n), f"{out}/{n}.json")) for n in SUMMARIES if n in there]
    done.append(safely(spark, out, "report", lambda: write_markdown(spark, "Results", {n: table(n) for n in REPORT if n in there}, f"{out}/report.md")))
    done.append(safely(spark, out, "manifest", lambda: write_manifest(spark, out, LAYERS)))
    return done
