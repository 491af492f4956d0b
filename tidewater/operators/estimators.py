"""Estimators as sums and closed forms; special functions where a p-value needs them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cuts import cut
from .running import running


def beta_from_moments(n: Column, mean: Column, variance: Column) -> tuple[Column, Column]:
    """Method of moments: (1, 1) from fewer than five values; a floor where the variance is none or too large for a Beta."""
    c = mean * (1 - mean) / F.nullif(variance, F.lit(0.0)) - 1
    bad = variance.isNull() | (variance <= 0) | (variance >= mean * (1 - mean))
    a = F.when(n < 5, 1.0).when(bad, F.greatest(20 * mean, F.lit(0.5))).otherwise(mean * c)
    b = F.when(n < 5, 1.0).when(bad, F.greatest(20 * (1 - mean), F.lit(0.5))).otherwise((1 - mean) * c)
    return a, b


def open_interval(x: Column) -> Column:
    return F.when((x > 0) & (x < 1), x)


def beta_fit(df: DataFrame, by: list[str], value: str) -> DataFrame:
    x = open_interval(F.col(value))
    s = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"))
    a, b = beta_from_moments(F.col("n"), F.col("mean"), F.when(F.col("n") > 1, F.col("var")))
    return s.select(*by, "n", a.alias("a"), b.alias("b"))


def beta_leave_one_out(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """For each row the fit on its group without it: the group's sums less the row's own, about a fixed centre of one half."""
    x = open_interval(F.col(value))
    d = x - 0.5
    sums = df.groupBy(*by).agg(F.count(x).alias("_n"), F.sum(d).alias("_s"), F.sum(d * d).alias("_q"))
    j = df.join(sums, by)
    own = x.isNotNull().cast("int")
    n = F.col("_n") - own
    s, q = F.col("_s") - F.coalesce(d, F.lit(0.0)), F.col("_q") - F.coalesce(d * d, F.lit(0.0))
    mean = s / F.nullif(n, F.lit(0)) + 0.5
    var = F.when(n > 1, (q - s * s / n) / (n - 1))
    a, b = beta_from_moments(n, mean, var)
    return j.select(*df.columns, n.alias("n"), a.alias("a"), b.alias("b"))


def logit_slope(df: DataFrame, by: list[str], share: str, x: str) -> DataFrame:
    """logit(share) on x: intercept, slope and the slope's standard error, from eight rows on."""
    y = F.when((F.col(share) > 0) & (F.col(share) < 1) & F.col(x).isNotNull(), F.ln(F.col(share) / (1 - F.col(share))))
    d = df.withColumn("_y", y).where("_y is not null")
    s = d.groupBy(*by).agg(F.count("_y").alias("n"), F.regr_slope("_y", x).alias("slope"), F.regr_intercept("_y", x).alias("intercept"), F.regr_sxx("_y", x).alias("sxx"), F.regr_syy("_y", x).alias("syy"), F.regr_sxy("_y", x).alias("sxy"))
    rest = (F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2)
    return s.where("n >= 8").select(*by, "n", "intercept", "slope", F.sqrt(rest / F.col("sxx")).alias("se_slope"))


def linear_fit(df: DataFrame, y: str, x: str, most: float) -> DataFrame:
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.abs(x) <= most))
    return d.agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r")).where("n >= 5")


def normal_equations(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """One row of the sums that least squares need: every product of 1, xs and y, over rows with all of them."""
    cols = {"one": F.lit(1.0), **{x: F.col(x) for x in xs}, y: F.col(y)}
    names = list(cols)
    products = {f"{a}_{b}": cols[a] * cols[b] for i, a in enumerate(names) for b in names[i:]}
    return df.na.drop(subset=[*xs, y]).agg(*[F.sum(v).alias(k) for k, v in products.items()])


def solve_least_squares(sums: dict[str, float], y: str, xs: list[str]) -> dict[str, float]:
    """Coefficients and R squared from normal_equations' row."""
    names = ["one", *xs]
    get = lambda a, b: sums.get(f"{a}_{b}", sums.get(f"{b}_{a}"))
    m = np.array([[get(a, b) for b in names] for a in names])
    v = np.array([get(a, y) for a in names])
    beta = np.linalg.lstsq(m, v, rcond=None)[0]
    total = get(y, y) - get("one", y) ** 2 / get("one", "one")
    rest = get(y, y) - 2 * beta @ v + beta @ m @ beta
    return {**dict(zip(["intercept", *xs], beta.tolist(), strict=True)), "r_squared": 1 - rest / total if total > 0 else float("nan")}


def least_squares(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """(term, value): coefficients and R squared, solved on an executor from the one row of normal_equations."""

    def solve(batches):
        for batch in batches:
            for row in batch.to_pylist():
                if row["one_one"]:
                    found = solve_least_squares(row, y, xs)
                    yield pa.RecordBatch.from_pydict({"term": list(found), "value": [float(v) for v in found.values()]})

    return normal_equations(df, y, xs).mapInArrow(solve, "term string, value double")


def ks_two_samples(df: DataFrame, group: str, a: str, b: str, value: str, least: int = 5) -> DataFrame:
    """The greatest difference of two samples' distribution functions. Counts by value come first; the running sums go over distinct values."""
    d = df.where(F.col(value).isNotNull() & F.col(group).isin(a, b))
    at = d.groupBy(value).agg(F.count_if(F.col(group) == a).alias("na"), F.count_if(F.col(group) == b).alias("nb"))
    f = running(at, [F.col(value)], {"before_a": "na", "before_b": "nb"}).select((F.col("before_a") + F.col("na")).alias("ca"), (F.col("before_b") + F.col("nb")).alias("cb"))
    totals = F.broadcast(at.agg(F.sum("na").alias("n_a"), F.sum("nb").alias("n_b")))  # one row
    s = f.crossJoin(totals).groupBy("n_a", "n_b").agg(F.max(F.abs(F.col("ca") / F.col("n_a") - F.col("cb") / F.col("n_b"))).alias("statistic"))
    return s.where((F.col("n_a") >= least) & (F.col("n_b") >= least))


def weighted_logit_line(df: DataFrame, share: str, x: str, weight: str) -> DataFrame:
    """Weighted least squares of logit(share), clipped to 1e-4, on x; a weight of 0 counts as a quarter."""
    y = F.ln(F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(share))) / (1 - F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(share)))))
    w = F.when(F.col(weight) == 0, 0.25).otherwise(F.col(weight))
    d = df.na.drop(subset=[share, x, weight]).select(y.alias("y"), F.col(x).alias("x"), w.alias("w"))
    s = d.agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("sw"), F.sum(F.expr("w * x")).alias("sx"), F.sum(F.expr("w * y")).alias("sy"), F.sum(F.expr("w * x * x")).alias("sxx"), F.sum(F.expr("w * x * y")).alias("sxy"))
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    return s.withColumn("slope", slope).select("n", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).alias("intercept"))


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x > 0: eight steps up, then Stirling's series."""
    z = x + 8
    shift = F.ln(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z) + 1 / (1188 * z * z * z * z * z * z * z * z * z)
    return (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def beta_cdf(x: Column, a: Column, b: Column, terms: int = 120) -> Column:
    """The regularised incomplete beta function: so many pairs of terms of its continued fraction, from the end at which it settles faster. Columns throughout, as a loop over
    an array inside the row."""
    turned = x > (a + 1) / (a + b + 2)
    args = F.struct(F.when(turned, 1 - x).otherwise(x).alias("x"), F.when(turned, b).otherwise(a).alias("a"), F.when(turned, a).otherwise(b).alias("b"))
    bound = F.transform(F.array(args), lambda v: _fraction(v["x"], v["a"], v["b"], terms))[0]
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), F.when(turned, 1 - bound).otherwise(bound))


def _fraction(x: Column, a: Column, b: Column, terms: int) -> Column:
    tiny = lambda v: F.when(F.abs(v) > 1e-300, v).otherwise(1e-300)

    def term(s: Column, num: Column) -> Column:
        # a lambda's argument is evaluated once; a column used twice would be twice in the plan
        new = F.transform(F.array(s), lambda v: F.struct(tiny(1 + num / v["c"]).alias("c"), (1 / tiny(1 + num * v["d"])).alias("d"), v["f"].alias("f")))[0]
        return F.transform(F.array(new), lambda v: F.struct(v["c"].alias("c"), v["d"].alias("d"), (v["f"] * v["c"] * v["d"]).alias("f")))[0]

    def step(s: Column, m: Column) -> Column:
        s = term(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
        return term(s, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)))

    first = 1 / tiny(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("f"))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.log1p(-x)) / a
    return front * F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda s: s["f"])


def kolmogorov_p(statistic: Column, n: Column) -> Column:
    """The p-value of a Kolmogorov statistic of n values by its limiting distribution, with Stephens' correction for n."""
    root = F.sqrt(n.cast("double"))
    t = (root + 0.12 + 0.11 / root) * statistic
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * k * k * t * t))
    return F.when(t < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * terms)))


def beta_cdf_of(x: np.ndarray, a: np.ndarray, b: np.ndarray, terms: int = 120) -> np.ndarray:
    """beta_cdf() of whole arrays; NaN where an argument is missing."""
    out = np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.nan))
    inside = np.flatnonzero((x > 0) & (x < 1) & ~np.isnan(a) & ~np.isnan(b))
    x, a, b = x[inside], a[inside], b[inside]
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    tiny = lambda v: np.where(np.abs(v) > 1e-300, v, 1e-300)
    c, d = np.ones(len(x)), 1 / tiny(1 - (a + b) * x / (a + 1))
    f = d
    for m in range(1, terms + 1):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            c, d = tiny(1 + num / c), 1 / tiny(1 + num * d)
            f = f * c * d
    bound = np.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a * f
    out[inside] = np.where(turned, 1 - bound, bound)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log_gamma() of an array."""
    z = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6) * (x + 7))
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) + 1 / (1188 * z**9)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def held_out(fitted: DataFrame, value: str, rows: int = 8192) -> DataFrame:
    """(p, c): the probability that each row's fit gives its value, and how many rows have the same value and fit. The continued fraction goes over arrays of so many rows."""
    asked = fitted.where((F.col(value) > 0) & (F.col(value) < 1)).groupBy(F.col(value).alias("x"), "a", "b").agg(F.count(F.lit(1)).alias("c"))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = batch.slice(i, rows)
                args = [part.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in ("x", "a", "b")]
                yield pa.RecordBatch.from_arrays([pa.array(beta_cdf_of(*args), from_pandas=True), part.column("c")], names=["p", "c"])

    return asked.mapInArrow(run, "p double, c long")


def pit_calibration(fitted: DataFrame, value: str) -> DataFrame:
    """(n, mean, inside_80, ks, p): held-out probabilities against the uniform distribution. fitted: value, a, b."""
    # kept, as ranges, totals and the number of rows read it
    at = cut(held_out(fitted, value).groupBy("p").agg(F.sum("c").alias("c")))
    f = running(at, [F.col("p")], {"before": "c"}).withColumn("upto", F.col("before") + F.col("c")).crossJoin(F.broadcast(at.agg(F.sum("c").alias("n"))))  # one row
    gap = F.greatest(F.col("upto") / F.col("n") - F.col("p"), F.col("p") - (F.col("upto") - F.col("c")) / F.col("n"))
    found = f.agg(F.max("n").alias("n"), (F.sum(F.col("p") * F.col("c")) / F.max("n")).alias("mean"), (F.sum(F.when(F.col("p").between(0.1, 0.9), F.col("c")).otherwise(0)) / F.max("n")).alias("inside_80"), F.max(gap).alias("ks"))
    return found.withColumn("p", kolmogorov_p(F.col("ks"), F.col("n")))
