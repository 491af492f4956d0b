"""The held-out probabilities go over arrays, and give what the columns give."""

import math

from pyspark.sql import functions as F

from tidewater.operators import estimators as E


def test_arrays_give_what_the_columns_give(spark):
    rows = [(x / 23, a, b) for x in range(-1, 25) for a in (0.5, 1.0, 3.7, 40.0) for b in (0.6, 2.0, 25.0)] * 2
    d = spark.createDataFrame(rows, "x double, a double, b double")
    got = sorted((r.p, r.c) for r in E.held_out(d, "x", 50).collect())
    want = d.where("x > 0 and x < 1").distinct().select(E.beta_cdf(F.col("x"), F.col("a"), F.col("b")).alias("p"))
    want = sorted(r.p for r in want.collect())
    assert len(got) == len(want) == 22 * 12 and {c for _, c in got} == {2}
    assert all(math.isclose(p, q, rel_tol=1e-10, abs_tol=1e-13) for (p, _), q in zip(got, want, strict=True))


def test_calibration_counts_repeated_values(spark):
    d = spark.createDataFrame([(0.25, 1.0, 1.0)] * 3 + [(0.75, 1.0, 1.0), (None, 1.0, 1.0), (1.0, 1.0, 1.0)], "x double, a double, b double")
    r = E.pit_calibration(d, "x").collect()[0]
    assert r.n == 4 and abs(r["mean"] - 0.375) < 1e-12 and abs(r.ks - 0.5) < 1e-12 and r.inside_80 == 1.0
