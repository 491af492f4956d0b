"""Each query with SQL gives that SQL's rows; the others give rows of a stable schema."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from tidewater.plans.catalogue import QUERIES, SQL  # noqa: E402

RAW = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(small):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in RAW:
        path = f"{small}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return f"{v + 0.0:.8g}"
    return str(v)[:10] if hasattr(v, "year") else str(v)


def _rows(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small, oracle, name):
    got = QUERIES[name](spark, small)
    want = oracle.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, got.collect()) == _rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns == QUERIES[name](spark, small).columns
    assert df.count() > 0
