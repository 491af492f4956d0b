"""Queries that pick one of many candidates make no pairs."""

from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import asof as A
from tidewater.plans.catalogue import QUERIES


def joined_rows(spark) -> int:
    """The most rows that a join of the last query has put out."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    most = 0
    for i in range(nodes.size()):
        node = nodes.apply(i)
        for j in range(node.metrics().size() if "Join" in node.name() else 0):
            metric = node.metrics().apply(j)
            if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """900 names and 500 companies that leave one remainder."""
    out = str(tmp_path_factory.mktemp("alike"))
    spark.range(1, 901).select((F.col("id") * 100).alias("p_partkey"), F.concat(F.lit("n"), "id").alias("p_name"), (F.col("id") % 50).cast("int").alias("p_size")).write.parquet(f"{out}/part.parquet")
    spark.range(1, 501).select((F.col("id") * 100).alias("s_suppkey")).write.parquet(f"{out}/supplier.parquet")
    return out


@pytest.mark.parametrize(("name", "rows"), [("candidate_rank", 500), ("override_candidates", 1500)])
def test_candidates_of_one_remainder_make_no_pairs(spark, alike, name, rows):
    assert len(QUERIES[name](spark, alike).collect()) == rows
    assert 0 < joined_rows(spark) <= 2 * rows


def test_best_window_picks_what_all_pairs_pick(spark):
    day = lambda n: None if n is None else date.fromordinal(730000 + n)
    names = [(i, i % 3, day((i * 7) % 23), day((i * 7) % 23 + (i * 11) % 17 - 2), f"n{i}") for i in range(60)]
    names += [(100, 0, None, None, "none"), (101, 4, None, None, "only none"), (102, 5, day(3), day(3), "one"), (103, 5, day(3), day(3), "two")]
    names = spark.createDataFrame(names, "permno long, k long, start date, end date, name string")
    left = spark.createDataFrame([(j, j % 7, day(j % 45)) for j in range(300)], "id long, k long, at date")
    got = A.best_window(left, names, "k", "at", "start", "end", "permno", ["permno", "name"])
    inside = (F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end"))
    pairs = left.join(names, "k").withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(inside.desc(), F.col("end").desc(), "permno")))
    want = pairs.where("n = 1").select("id", "k", "at", "permno", "name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_company_listed_twice_has_its_candidates_twice(spark, alike, tmp_path):
    spark.read.parquet(f"{alike}/part.parquet").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(100,), (200,), (200,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {(r["s_suppkey"], r["place"]): r["permno"] for r in QUERIES["override_candidates"](spark, str(tmp_path)).collect()}
    # keys are multiples of 100, so all hits are 0 and the least keys come first
    assert got == {(100, 1): 100, (100, 2): 200, (100, 3): 300, (200, 1): 100, (200, 2): 100, (200, 3): 200}
