"""Averages that are compared, ranked or put in bins add in the order of a table's rows, however its files are split among tasks."""

import os

import pytest

from tidewater.sources.derived import Tables, averaged_in_order

duckdb = pytest.importorskip("duckdb")

from tidewater.plans.catalogue import QUERIES, SQL  # noqa: E402

FROM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def apart(tmp_path_factory):
    """sf0.01 with lineitem's rows, as they lie, in seven files: an order's rows are in several."""
    folder = tmp_path_factory.mktemp("apart")
    for name in os.listdir(FROM):
        if name != "lineitem.parquet":
            os.symlink(f"{FROM}/{name}", folder / name)
    (folder / "lineitem.parquet").mkdir()
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute(f"CREATE TABLE l AS SELECT *, row_number() OVER () - 1 AS place FROM '{FROM}/lineitem.parquet'")
    for k in range(7):
        c.execute(f"COPY (SELECT * EXCLUDE (place) FROM l WHERE place // 9000 = {k} ORDER BY place) TO '{folder}/lineitem.parquet/part-{k}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def one_thread(apart):
    c = duckdb.connect()
    c.execute("SET threads = 1")
    c.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(apart):
        path = f"{apart}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(f"{r[i] + 0.0:.8g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["histogram_bins", "panel_derive", "qq_positions", "risk_block", "elect_hedge", "realized_block"])
def test_rows_of_many_files(spark, apart, one_thread, name):
    got, want = QUERIES[name](spark, apart), one_thread.execute(SQL[name])
    assert _rows(got.columns, got.collect()) == _rows([d[0] for d in want.description], want.fetchall())


def test_averages_by_hand(spark, tmp_path):
    for k, rows in enumerate(([(1, 0.1, None), (2, None, 1.0)], [(1, 0.2, 3.0), (1, 0.3, None)])):
        spark.createDataFrame(rows, "k long, x double, y double").coalesce(1).write.parquet(f"{tmp_path}/all/{k}")
    df = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/all")
    got = {r.k: (r.x, r.y) for r in averaged_in_order(df, "k", ["x", "y"]).collect()}
    # 0.1 + (0.2 + 0.3) is 0.6
    assert got == {1: ((0.1 + 0.2 + 0.3) / 3, 3.0), 2: (None, 1.0)} and got[1][0] != 0.6 / 3


def test_other_tables_stay(spark, apart):
    t = Tables(spark, apart)
    assert t.in_order.orders.columns == t.orders.columns and t.in_order.deals.columns == t.deals.columns
    assert t.lineitem.columns != t.in_order.lineitem.columns
