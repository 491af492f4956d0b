"""Tables swapped whole or not at all, and runs that go on where they died."""

import json

import pytest

from tidewater import runs
from tidewater.sources import store as S


def ids(spark, path):
    return sorted(r.id for r in spark.read.parquet(path).collect())


def test_a_table_is_swapped_and_kept(spark, tmp_path):
    path = str(tmp_path / "t")
    assert S.replace_table(spark.range(3), path) is None and ids(spark, path) == [0, 1, 2]
    old = S.replace_table(spark.read.parquet(path).where("id > 0"), path)  # reads the table that it replaces
    assert ids(spark, path) == [1, 2] and ids(spark, old) == [0, 1, 2] and old.endswith(".backup-000001")
    for n in range(6):
        S.replace_table(spark.range(n), path, keep=2)
    assert [b[-6:] for b in S.backups(spark, path)] == ["000006", "000007"] and ids(spark, path) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("step", [1, 2])
def test_a_failed_swap_leaves_the_old_table(spark, tmp_path, monkeypatch, step):
    path, seen = str(tmp_path / "t"), []
    S.replace_table(spark.range(3), path)
    rename = S.Store.rename

    def failing(self, source, target):
        seen.append(source)
        if len(seen) == step:
            raise OSError("lost")
        rename(self, source, target)

    monkeypatch.setattr(S.Store, "rename", failing)
    with pytest.raises(S.SwapFailed):
        S.replace_table(spark.range(9), path)
    monkeypatch.undo()
    assert ids(spark, path) == [0, 1, 2] and [n for n, _, _ in S.Store(spark, path).names(str(tmp_path)) if "new" in n] == []
    with pytest.raises(S.SwapFailed):
        S.replace_table(spark.range(3).selectExpr("id", "assert_true(id < 2) AS a"), path)
    assert ids(spark, path) == [0, 1, 2] and S.backups(spark, path) == []


def test_a_run_that_died_between_the_steps_is_put_right(spark, tmp_path):
    path = str(tmp_path / "t")
    S.replace_table(spark.range(3), path)
    s = S.Store(spark, path)
    s.rename(path, path + ".backup-000001")
    spark.range(8).write.parquet(path + ".new-1")
    assert S.recover(spark, path) and ids(spark, path) == [0, 1, 2] and not S.recover(spark, path)
    assert [n for n, _, _ in s.names(str(tmp_path))] == ["t"]


def test_a_stage_goes_on_where_it_died(spark, tmp_path):
    data, out, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(5).write.parquet(f"{data}/t.parquet")

    class Killed(BaseException):
        """Not an error that a stage logs: the end of the process."""

    def query(name, fail=None):
        def run(spark, sf_dir):
            calls.append(name)
            if fail and name not in [c for c in calls[:-1]]:
                raise fail
            return spark.read.parquet(f"{sf_dir}/t.parquet").selectExpr(f"id AS {name}", "'x' AS s")

        return run

    queries = {"a": query("a"), "b": query("b", ValueError("bad")), "c": query("c", Killed()), "strategy_summary": query("strategy_summary")}
    names = ("a", "b", "c", "strategy_summary")
    with pytest.raises(Killed):
        runs.run_stage(spark, queries, names, data, out)
    ledger = runs.Ledger(spark, out)
    assert [ledger.read(n).get("status") for n in names] == ["ok", "error", "started", None] and ledger.read("a")["rows"] == 5
    assert [w["status"] for w in runs.run_stage(spark, queries, names, data, out)] == ["kept", "ok", "ok", "ok"] and calls == ["a", "b", "c", "b", "c", "strategy_summary"]
    assert {w["status"] for w in runs.run_stage(spark, queries, names, data, out)} == {"kept"}
    # half a table is not taken for a whole one, and another input counts as new
    S.Store(spark, out).remove(f"{out}/a/_SUCCESS")
    assert [w["status"] for w in runs.run_stage(spark, queries, names, data, out)] == ["ok", "kept", "kept", "kept"]
    spark.range(2).write.mode("append").parquet(f"{data}/t.parquet")
    assert {w["status"] for w in runs.run_stage(spark, queries, names, data, out)} == {"ok"} and ledger.read("a")["rows"] == 7
    assert {w["status"] for w in runs.write_reports(spark, names, out)} == {"ok"}
    assert "## strategy_summary" in (tmp_path / "out/report.md").read_text() and json.loads((tmp_path / "out/errors.jsonl").read_text().splitlines()[0])["layer"] == "b"
    files = {f["file"]: f["suffix"] for f in json.loads((tmp_path / "out/manifest.json").read_text())["files"]}
    assert files["a"] == "table" and files["strategy_summary.json"] == "json" and "_ledger" not in files


def test_every_stage_names_queries(spark):
    from tidewater.plans.catalogue import QUERIES

    assert {n for names in runs.STAGES.values() for n in names} <= set(QUERIES) and set(runs.REPORT) | set(runs.SUMMARIES) <= set(runs.STAGES["all"])
