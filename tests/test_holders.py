"""The holder fit keeps its grid inside a block's task."""

from pyspark.sql import functions as F

from tidewater.operators import holders as H
from tidewater.operators import payoff as P
from tidewater.operators.capacity import CapacityConfig

CFG = CapacityConfig()


def deals(spark, n):
    k = F.col("id")
    return spark.range(n).select(
        k.alias("event_id"), (k + 1).alias("pos"), F.when(k % 3 != 0, (k % 17) / 17.0).alias("f_cash"), F.when(k % 2 == 0, 0.65).otherwise(1.0).alias("weight"),
        F.when(k % 53 != 7, (k % 32) / 31.0).alias("passive"), F.element_at(F.array(F.lit("cash"), F.lit("stock"), F.lit("mixed"), F.lit(None)), (k % 4 + 1).cast("int")).alias("default_rule"),
        F.when(k % 41 != 5, 10.0 + k % 7).alias("cash"), F.when(k % 43 != 5, 9.0 + k % 9).alias("stock"), (9.5 + k % 8).alias("target_price"),
    )


def test_no_row_for_each_point_of_the_grid(spark):
    H.rolling_fit(deals(spark, 900), CFG, 128).collect()
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    last = runs.apply(runs.size() - 1).executionId()
    values, nodes = store.executionMetrics(last), store.planGraph(last).allNodes()
    rows = []
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for j in range(metrics.size()):
            if metrics.apply(j).name() in ("number of output rows", "shuffle records written") and values.contains(metrics.apply(j).accumulatorId()):
                rows.append(int(values.apply(metrics.apply(j).accumulatorId()).replace(",", "")))
    assert 900 <= max(rows) <= 2 * 900


def test_fits_are_those_of_the_columns_over_each_window(spark):
    d = deals(spark, 260)
    got = {r.event_id: tuple(r)[1:] for r in H.rolling_fit(d, CFG, 64).collect()}
    step = F.explode(F.sequence(F.lit(0), F.lit(10)))
    grid = d.where("f_cash is not null").withColumn("_p", step).withColumn("_q", step)
    miss = F.col("f_cash") - P.predicted_votes(F.col("_p") / 10.0, F.col("_q") / 10.0, *[F.col(c) for c in ("passive", "default_rule", "cash", "stock", "target_price")])["cash_demand"]
    errors: dict = {}
    for r in grid.select("event_id", "_p", "_q", (F.col("weight") * miss * miss).alias("e")).collect():
        errors.setdefault(r.event_id, {})[r._p, r._q] = r.e
    for k in range(260):
        window = [e for e in sorted(errors) if e < k][-50:]
        known = [errors[e] for e in window if None not in errors[e].values()]
        if len(known) < 10:
            assert got[k] == (0.5, 0.3, 0, None)
            continue
        sums = {}
        for pq in known[0]:
            sums[pq] = 0.0
            for e in known:
                sums[pq] += e[pq]
        p, q = min(sums, key=lambda pq: (round(sums[pq], 12), pq))
        assert got[k] == (p / 10, q / 10, len(known), round(sums[p, q], 9))


def test_no_labelled_event_gives_the_defaults(spark):
    d = deals(spark, 20).withColumn("f_cash", F.lit(None).cast("double"))
    assert {tuple(r)[1:] for r in H.rolling_fit(d, CFG).collect()} == {(0.5, 0.3, 0, None)}
