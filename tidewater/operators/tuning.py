"""Tuning of the outcome model over expanding years, and its nested evaluation: every fit is one row of running sums, so nothing is refitted."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import cut
from .naive_bayes import MISSING, OTHER, STATES

#: The candidates (alpha, prior strength, variance shrinkage, likelihood weight, prior blend), powers of the decision rule, defaults.
GRID = tuple((alpha, 25.0, shrink, weight, blend) for alpha in (0.5, 2.0) for shrink in (0.5, 0.9) for weight in (0.25, 0.5, 1.0) for blend in (0.5, 0.75, 0.9, 0.95)) + (
    (0.5, 25.0, 0.9, 0.1, 0.0),
    (0.5, 25.0, 0.9, 0.25, 0.0),
    (2.0, 1.0, 0.9, 0.5, 0.75),
    (2.0, 100.0, 0.9, 0.5, 0.75),
)
UNTUNED = (1.0, 1.0, 0.0, 1.0, 0.0)
POWERS = (0.0, 0.25, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0)
DEFAULT_POWER = 0.5
DEFAULTS = (0.88, 0.07, 0.05)
NAMES = ("alpha", "strength", "shrink", "weight", "blend")
#: Smoothings that candidates take.
ALPHAS = tuple(sorted({c[0] for c in (*GRID, UNTUNED)}))


@dataclass(frozen=True)
class Features:
    """Names of the numeric features, each with a value about which its sums are taken, and of the categorical ones."""

    numeric: dict[str, float]
    categorical: Sequence[str]
    label: str = "label"
    year: str = "year"
    key: str = "event_id"


def yearly_models(rows: DataFrame, f: Features) -> DataFrame:
    """One row for each year from the first to the last with what a fit on all earlier years consists of: counts of states, of numeric features'
    values with means and variances, and of categories, as maps by state and feature. Categories are few, so a year's row is small. Rows are read
    once, into sums by year, state and categories, which all the rest is summed from."""
    state = [F.lit(x) for x in STATES]
    rows = rows.where(F.col(f.label).isin(*STATES) & F.col(f.year).isNotNull())
    d = {k: F.col(k).cast("double") - c for k, c in f.numeric.items()}
    sums = [x for i, v in enumerate(d.values()) for x in (F.count(v).alias(f"c{i}"), F.sum(v).alias(f"s{i}"), F.sum(v * v).alias(f"q{i}"))]
    named = [category(F.col(k)).alias(f"v{i}") for i, k in enumerate(f.categorical)]
    seen = cut(rows.groupBy(F.col(f.year).alias("year"), F.col(f.label).alias("label"), *named).agg(F.count(F.lit(1)).alias("n"), *sums))
    bounds = seen.agg(F.min("year").alias("lo"), F.max("year").alias("hi"))
    spine = bounds.select(F.explode(F.sequence("lo", "hi")).alias("year"))
    states = spine.withColumn("label", F.explode(F.array(*state)))

    def running(table: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
        """Sums over earlier years, from those of each year; every year has every group."""
        full = spine.crossJoin(table.select(*by).distinct()).join(table, ["year", *by], "left").na.fill(0, sums)
        before = Window.partitionBy(*by).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
        return full.select("year", *by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in sums])

    def as_map(table: DataFrame, key: Column, value: Column, name: str) -> DataFrame:
        return table.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct(key, value))).alias(name))

    counts = seen.groupBy("year", "label").agg(F.sum("n").alias("n"))
    counts = running(states.join(counts, ["year", "label"], "left").na.fill(0, ["n"]), ["label"], ["n"])
    out = counts.groupBy("year").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("classes"), F.sum("n").alias("fit_n"), F.min("n").alias("least"))

    parts = [F.struct(F.lit(k).alias("feature"), F.lit(float(c)).alias("centre"), *[F.col(f"{x}{i}").alias(x) for x in "csq"]) for i, (k, c) in enumerate(f.numeric.items())]
    by_year = seen.select("year", "label", F.inline(F.array(*parts))).where("c > 0").groupBy("year", "label", "feature", "centre").agg(*[F.sum(x).alias(x) for x in "csq"])
    own = running(by_year, ["label", "feature", "centre"], ["c", "s", "q"])
    whole = own.groupBy("year", "feature").agg(F.sum("c").alias("gc"), F.sum("s").alias("gs"), F.sum("q").alias("gq"))
    n, gn = F.col("c"), F.col("gc")
    moments = F.struct(
        n.alias("n"),
        (F.col("s") / F.nullif(n, F.lit(0)) + F.col("centre")).alias("mean"),
        F.when(n > 1, (F.col("q") - F.col("s") * F.col("s") / n) / (n - 1)).alias("var"),
        gn.alias("gn"),
        (F.col("gs") / F.nullif(gn, F.lit(0)) + F.col("centre")).alias("gmean"),
        F.greatest(F.when(gn > 1, (F.col("gq") - F.col("gs") * F.col("gs") / gn) / (gn - 1)).otherwise(1.0), F.lit(1e-4)).alias("gvar"),
    )
    out = out.join(as_map(own.join(whole, ["year", "feature"]), F.concat_ws("|", "label", "feature"), moments, "moments"), "year", "left")

    parts = [F.struct(F.lit(k).alias("feature"), F.col(f"v{i}").alias("v")) for i, k in enumerate(f.categorical)]
    by_year = seen.select("year", "label", "n", F.inline(F.array(*parts))).groupBy("year", "label", "feature", "v").agg(F.sum("n").alias("c"))
    own = running(by_year, ["label", "feature", "v"], ["c"]).where("c > 0")
    out = out.join(as_map(own, F.concat_ws("|", "label", "feature", "v"), F.col("c"), "counts"), "year", "left")
    out = out.join(as_map(own.groupBy("year", "label", "feature").agg(F.sum("c").alias("c")), F.concat_ws("|", "label", "feature"), F.col("c"), "totals"), "year", "left")
    words = own.groupBy("year", "feature").agg(F.array_union(F.collect_set("v"), F.array(F.lit(MISSING), F.lit(OTHER))).alias("words"))
    return out.join(as_map(words, F.col("feature"), F.col("words"), "words"), "year", "left")


def category(c: Column) -> Column:
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(MISSING))


def _at(name: str, key: Column | str, kind: str = "long") -> Column:
    return F.try_element_at(F.col(name), F.lit(key) if isinstance(key, str) else key)


def profiles(rows: DataFrame, models: DataFrame, f: Features, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(year, v0.., l_STATE_ALPHA..): the log likelihood of each combination of categories that occurs in a year, by the fit on the years before."""
    named = [category(F.col(k)).alias(f"v{i}") for i, k in enumerate(f.categorical)]
    j = rows.select(F.col(f.year).alias("year"), *named).distinct().join(F.broadcast(models), "year")
    found = {}
    for s in STATES:
        for a in alphas:
            ll = F.lit(0.0)
            for i, k in enumerate(f.categorical):
                words = F.coalesce(_at("words", k), F.array(F.lit(MISSING), F.lit(OTHER)))
                v = F.when(F.array_contains(words, F.col(f"v{i}")), F.col(f"v{i}")).otherwise(OTHER)
                c = F.coalesce(_at("counts", F.concat_ws("|", F.lit(s), F.lit(k), v)), F.lit(0))
                ll = ll + F.ln((c + a) / (F.coalesce(_at("totals", f"{s}|{k}"), F.lit(0)) + a * F.size(words)))
            found[_cat(s, a)] = ll
    return j.select("year", *[f"v{i}" for i in range(len(f.categorical))], *[v.alias(k) for k, v in found.items()])


def _cat(state: str, alpha: float) -> str:
    return f"l_{state}_{alpha}".replace(".", "_")


class Fits:
    """The fits of all years as arrays by year, state and numeric feature: a row of sums for each year, which goes to every task. What grows with the
    categories stays in profiles()."""

    def __init__(self, models: DataFrame, f: Features):
        found = models.select("year", "least", "fit_n", "classes", "moments").orderBy("year").collect()
        self.years, self.least, self.numeric = np.array([r.year for r in found], np.int64), [r.least for r in found], list(f.numeric)
        self.fit_n = np.array([r.fit_n for r in found], float)
        self.counts = np.array([[r.classes.get(s, 0) for s in STATES] for r in found], float).reshape(-1, len(STATES))
        shape = (len(found), len(STATES), len(self.numeric))
        self.mean, self.own, self.whole = np.zeros(shape), np.ones(shape), np.ones(shape)
        self.enough = np.zeros(shape, bool)
        for y, r in enumerate(found):
            for i, s in enumerate(STATES):
                for k, name in enumerate(self.numeric):
                    m = (r.moments or {}).get(f"{s}|{name}")
                    if m is not None and m.n >= 2:
                        self.mean[y, i, k], self.own[y, i, k], self.whole[y, i, k], self.enough[y, i, k] = m["mean"], m["var"], m["gvar"], True
                    elif m is not None and m.gn > 0:
                        self.mean[y, i, k], self.whole[y, i, k] = m["gmean"], m["gvar"]

    def prior(self, strength: float) -> np.ndarray:
        """By year and state."""
        return (self.counts + strength * np.array(DEFAULTS)) / (self.fit_n + strength * sum(DEFAULTS))[:, None]

    def variance(self, shrink: float) -> np.ndarray:
        return np.where(self.enough, np.maximum((1 - shrink) * self.own + shrink * self.whole, 1e-4), self.whole)


class Batch:
    """Rows of an Arrow batch under the fits of their years; every array is by state and row."""

    def __init__(self, batch: pa.RecordBatch, fits: Fits, alphas: Sequence[float]):
        self.fits = fits
        self.at = np.searchsorted(fits.years, batch.column("year").to_numpy(zero_copy_only=False))
        self.actual = batch.column("actual").to_numpy(zero_copy_only=False)
        self.hit = (self.actual == np.arange(len(STATES))[:, None]).astype(float)
        columns = [batch.column(f"x{k}") for k in range(len(fits.numeric))]
        self.known = [c.is_valid().to_numpy(zero_copy_only=False) for c in columns]
        self.values = [c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
        self.cat = {a: np.stack([batch.column(_cat(s, a)).to_numpy(zero_copy_only=False) for s in STATES]) for a in alphas}
        self._num: dict[float, np.ndarray] = {}

    def take(self, rows: np.ndarray) -> Batch:
        """These rows alone."""
        part = object.__new__(Batch)
        part.fits, part.at, part.actual, part.hit = self.fits, self.at[rows], self.actual[rows], self.hit[:, rows]
        part.known, part.values = [x[rows] for x in self.known], [x[rows] for x in self.values]
        part.cat, part._num = {a: x[:, rows] for a, x in self.cat.items()}, {}
        return part

    def num(self, shrink: float) -> np.ndarray:
        """Log likelihoods of the numeric features; what is missing adds nothing."""
        if shrink not in self._num:
            total, var = np.zeros(self.hit.shape), self.fits.variance(shrink)
            log = np.log(2 * math.pi * var)
            for i in range(len(STATES)):
                for k, (x, known) in enumerate(zip(self.values, self.known, strict=True)):
                    d = x - self.fits.mean[self.at, i, k]
                    total[i] += np.where(known, -0.5 * (log[self.at, i, k] + d * d / var[self.at, i, k]), 0.0)
            self._num[shrink] = total
        return self._num[shrink]

    def prior(self, strength: float) -> np.ndarray:
        return self.fits.prior(strength).T[:, self.at]

    def softmax(self, alpha: float, strength: float, shrink: float, weight: float) -> np.ndarray:
        """Log prior plus the weighted log likelihood, taken to shares of each row; not blended yet."""
        s = np.log(np.maximum(self.fits.prior(strength), 1e-12)).T[:, self.at] + weight * (self.num(shrink) + self.cat[alpha])
        e = np.exp(s - s.max(axis=0))
        return e / e.sum(axis=0)

    def probabilities(self, alpha: float, strength: float, shrink: float, weight: float, blend: float) -> np.ndarray:
        return (1 - blend) * self.softmax(alpha, strength, shrink, weight) + blend * self.prior(strength)


def decided(p: np.ndarray, prior: np.ndarray, power: float) -> np.ndarray:
    """The index of the state with the greatest probability over its prior to a power; of equal ones the first."""
    return np.round(p / np.maximum(prior**power, 1e-12), 12).argmax(axis=0)


def _prepared(rows: DataFrame, f: Features, kinds: DataFrame) -> DataFrame:
    """(key, year, actual as an index or -1, x0.., l_STATE_ALPHA..): rows as Batch reads them. kinds: their profiles()."""
    actual = F.coalesce(*[F.when(F.col(f.label) == s, i) for i, s in enumerate(STATES)], F.lit(-1))
    named = [f"v{i}" for i in range(len(f.categorical))]
    d = rows.select(F.col(f.key).alias("key"), F.col(f.year).alias("year"), actual.alias("actual"), *[F.col(k).cast("double").alias(f"x{i}") for i, k in enumerate(f.numeric)], *[category(F.col(k)).alias(v) for v, k in zip(named, f.categorical, strict=True)])
    return d.join(kinds, ["year", *named]).drop(*named)


def squared_error(prefix: str = "p") -> Column:
    return sum(((F.col(f"{prefix}_{s}") - F.when(F.col("actual") == s, 1.0).otherwise(0.0)) ** 2 for s in STATES), F.lit(0.0))


def _by_names(year: Sequence[int], candidates: Sequence[tuple]) -> list[pa.Array]:
    return [pa.array(year, pa.int32()), *[pa.array([c[i] for c in candidates], pa.float64()) for i in range(len(NAMES))]]


_BY_NAMES = "year int, " + ", ".join(f"{n} double" for n in NAMES)


def errors_by_year(rows: DataFrame, models: DataFrame, f: Features, candidates: Sequence[tuple] = GRID, kinds: DataFrame | None = None) -> DataFrame:
    """(year, least, NAMES, n, error): the sum of squared errors of each candidate in each year, by fits on the years before. kinds: profiles() of rows.

    Candidates that differ in their blend alone share a softmax e: the error of (1 - b) e + b q, q the prior, is (1 - b)^2 |e - y|^2 + 2 b (1 - b) (e - y)(q - y)
    + b^2 |q - y|^2, so a task adds up these three and no row is written for a candidate."""
    fits, candidates = Fits(models, f), [tuple(float(x) for x in c) for c in candidates]
    shared, alphas = list(dict.fromkeys(c[:4] for c in candidates)), sorted({c[0] for c in candidates})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        years = len(fits.years)
        n, own, mixed, base = np.zeros(years, np.int64), {c: np.zeros(years) for c in shared}, {c: np.zeros(years) for c in shared}, {c[1]: np.zeros(years) for c in shared}
        for batch in batches:
            b = Batch(batch, fits, alphas)
            off = {w: b.prior(w) - b.hit for w in base}
            total = lambda x, at=b.at: np.bincount(at, x, years)
            n += np.bincount(b.at, minlength=years)
            for w, x in off.items():
                base[w] += total((x * x).sum(axis=0))
            for c in shared:
                e = b.softmax(*c) - b.hit
                own[c] += total((e * e).sum(axis=0))
                mixed[c] += total((e * off[c[1]]).sum(axis=0))
        for y in np.flatnonzero(n).tolist():
            error = [(1 - c[4]) ** 2 * own[c[:4]][y] + 2 * c[4] * (1 - c[4]) * mixed[c[:4]][y] + c[4] ** 2 * base[c[1]][y] for c in candidates]
            many = len(candidates)
            made = _by_names([int(fits.years[y])] * many, candidates)
            yield pa.RecordBatch.from_arrays([*made, pa.array([fits.least[y]] * many, pa.int64()), pa.array([int(n[y])] * many), pa.array(error, pa.float64())], names=["year", *NAMES, "least", "n", "error"])

    j = _prepared(rows, f, profiles(rows, models, f, alphas) if kinds is None else kinds).drop("key")
    return j.mapInArrow(run, f"{_BY_NAMES}, least long, n long, error double").groupBy("year", "least", *NAMES).agg(F.sum("n").alias("n"), F.sum("error").alias("error"))


def decisions(rows: DataFrame, models: DataFrame, f: Features, asked: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(year, NAMES, power, actual, predicted, n): how often each decision is taken for each actual state, for each power. asked: (year, NAMES), the candidates
    by which a year's rows are scored; a few for each year."""
    fits, of = Fits(models, f), {}
    for r in asked.select("year", *NAMES).distinct().collect():
        of.setdefault(r.year, []).append(tuple(r)[1:])
    alphas = sorted({c[0] for cs in of.values() for c in cs})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = (len(STATES) + 1) * len(STATES)
        n = {(y, c, w): np.zeros(cells, np.int64) for y, cs in of.items() for c in cs for w in POWERS}
        for batch in batches:
            whole = Batch(batch, fits, alphas)
            for at in np.unique(whole.at).tolist():
                y, b = int(fits.years[at]), whole.take(np.flatnonzero(whole.at == at))
                for c in of.get(y, ()):
                    p, q = b.probabilities(*c), b.fits.prior(c[1])[at][:, None]
                    for w in POWERS:
                        n[y, c, w] += np.bincount((b.actual + 1) * len(STATES) + decided(p, q, w), minlength=cells)
        found = [(y, c, w, k, int(x[k])) for (y, c, w), x in n.items() for k in np.flatnonzero(x).tolist()]
        if found:
            states = [None, *STATES]
            rest = [pa.array([x[2] for x in found], pa.float64()), pa.array([states[x[3] // len(STATES)] for x in found], pa.string()), pa.array([STATES[x[3] % len(STATES)] for x in found]), pa.array([x[4] for x in found])]
            yield pa.RecordBatch.from_arrays([*_by_names([x[0] for x in found], [x[1] for x in found]), *rest], names=["year", *NAMES, "power", "actual", "predicted", "n"])

    rows = rows.where(F.col(f.year).isin(list(of)))
    j = _prepared(rows, f, profiles(rows, models, f, alphas) if kinds is None else kinds).drop("key")
    made = j.mapInArrow(run, f"{_BY_NAMES}, power double, actual string, predicted string, n long")
    return made.groupBy("year", *NAMES, "power", "actual", "predicted").agg(F.sum("n").alias("n"))


def predictions(rows: DataFrame, models: DataFrame, f: Features, choices: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """(key, year, actual, p_STATE, prior_STATE, untuned_p_STATE, untuned_prior_STATE, predicted) of the rows of the years in choices (outer, NAMES, power)."""
    fits, of = Fits(models, f), {r.outer: (tuple(r)[1:-1], r.power) for r in choices.select("outer", *NAMES, "power").collect()}
    alphas = sorted({UNTUNED[0], *(c[0] for c, _ in of.values())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, states = ["key", "year", "actual", *[f"{x}_{s}" for x in ("p", "prior", "untuned_p", "untuned_prior") for s in STATES], "predicted"], pa.array(STATES)
        for batch in batches:
            whole = Batch(batch, fits, alphas)
            for at in np.unique(whole.at).tolist():
                index = np.flatnonzero(whole.at == at)
                b, (c, power) = whole.take(index), of[int(fits.years[at])]
                p, q, up, uq = b.probabilities(*c), b.prior(c[1]), b.probabilities(*UNTUNED), b.prior(UNTUNED[1])
                own = batch.take(pa.array(index))
                yield pa.RecordBatch.from_arrays([own.column("key"), own.column("year"), states.take(pa.array(b.actual, mask=b.actual < 0)), *map(pa.array, (*p, *q, *up, *uq)), states.take(pa.array(decided(p, q, power)))], names=names)

    rows = rows.where(F.col(f.year).isin(list(of)))
    j = _prepared(rows, f, profiles(rows, models, f, alphas) if kinds is None else kinds)
    doubles = ", ".join(f"{x}_{s} double" for x in ("p", "prior", "untuned_p", "untuned_prior") for s in STATES)
    return j.mapInArrow(run, f"key {j.schema['key'].dataType.simpleString()}, year {j.schema['year'].dataType.simpleString()}, actual string, {doubles}, predicted string")


def _last_years(errors: DataFrame, outer: DataFrame, least: int, most_years: int) -> DataFrame:
    """(outer, year): for each outer year the last years before it in which the rarest state had been seen `least` times."""
    years = errors.where(F.col("least") >= least).select("year").distinct()
    pairs = outer.join(years, F.col("year") < F.col("outer"))  # a row for each pair of years
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("outer").orderBy(F.col("year").desc()))).where(F.col("r") <= most_years).drop("r")


def tuned(errors: DataFrame, outer: DataFrame, least: int = 10, most_years: int = 5) -> DataFrame:
    """(outer, NAMES, brier, rows, years): for each outer year the candidate with the least mean error over its validation years; of equal ones the
    greater weight, then the smaller alpha. Without such years the untuned one."""
    seen = _last_years(errors, outer, least, most_years).join(errors, "year")
    mean = seen.groupBy("outer", *NAMES).agg((F.sum("error") / F.sum("n")).alias("brier"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("years"))
    order = [F.round("brier", 10), F.col("weight").desc(), F.col("alpha"), F.col("strength"), F.col("shrink"), F.col("blend")]
    best = mean.withColumn("r", F.row_number().over(Window.partitionBy("outer").orderBy(*order))).where("r = 1").drop("r")
    chosen = [F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in zip(NAMES, UNTUNED, strict=True)]
    return outer.join(best, "outer", "left").select("outer", *chosen, "brier", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("years", F.lit(0)).alias("years"))


def class_scores(df: DataFrame, by: Sequence[str], n: Column | None = None) -> DataFrame:
    """(by, balanced_accuracy, macro_f1, rows) of rows with actual and predicted, each counted n times."""
    n = F.lit(1) if n is None else n
    ratio = lambda a, b: F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))
    many = lambda c: F.sum(F.when(c, n).otherwise(0))
    tp, called, truth = ({s: many(c(s)) for s in STATES} for c in (lambda s: (F.col("actual") == s) & (F.col("predicted") == s), lambda s: F.col("predicted") == s, lambda s: F.col("actual") == s))
    recall = sum((ratio(tp[s], truth[s]) for s in STATES), F.lit(0.0)) / 3
    f1 = sum((ratio(2 * tp[s], truth[s] + called[s]) for s in STATES), F.lit(0.0)) / 3
    return df.groupBy(*by).agg(recall.alias("balanced_accuracy"), f1.alias("macro_f1"), F.sum(n).cast("long").alias("rows"))


def decision_powers(rows: DataFrame, models: DataFrame, f: Features, errors: DataFrame, chosen: DataFrame, least: int = 5, most_years: int = 5, taken: DataFrame | None = None) -> DataFrame:
    """(outer, power, macro_f1, balanced_accuracy): the power of the decision rule that does best on each outer year's validation years under the
    candidate chosen for it: by macro F1, then balanced accuracy, then the smaller power; 0.5 without such years. taken: decisions() of those candidates."""
    years = _last_years(errors, chosen.select("outer"), least, most_years).join(chosen.select("outer", *NAMES), "outer")
    if taken is None:
        taken = decisions(rows, models, f, years)
    found = class_scores(taken.join(years, ["year", *NAMES]), ["outer", "power"], F.col("n"))
    order = [F.round("macro_f1", 10).desc(), F.round("balanced_accuracy", 10).desc(), F.col("power")]
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("outer").orderBy(*order))).where("r = 1")
    return chosen.select("outer").join(best, "outer", "left").select("outer", F.coalesce("power", F.lit(DEFAULT_POWER)).alias("power"), "macro_f1", "balanced_accuracy")


class Nested(NamedTuple):
    """choices: (outer, NAMES, brier, rows, years, power, macro_f1, balanced_accuracy, untuned_power). taken: decisions() of the candidates of each year.
    predictions: a row for each row of an outer year, made when it is read."""

    choices: DataFrame
    taken: DataFrame
    predictions: DataFrame


def tuned_years(rows: DataFrame, f: Features, least: int = 10, most_years: int = 5) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(rows, models, profiles, errors, chosen): the candidate that does best on validation years before each year with `least` rows of every state before it
    (half as many rows of each state suffice there). Of the rows, what is read again is kept; years in which nothing is validated are not scored."""
    # read by up to four passes; what it is joined from is joined once
    rows = cut(rows.select(*dict.fromkeys([f.key, f.year, f.label, *f.numeric, *f.categorical])))
    models = cut(yearly_models(rows, f))
    kinds = cut(profiles(rows, models, f))
    inner = max(3, least // 2)
    years = cut(kinds.select("year").distinct().join(models.select("year", "least"), "year"))
    outer = years.where(F.col("least") >= least).select(F.col("year").alias("outer"))
    validated = [r.year for r in _last_years(years, outer, inner, most_years).select("year").distinct().collect()]  # years, not rows
    errors = cut(errors_by_year(rows.where(F.col(f.year).isin(validated)), models, f, kinds=kinds))
    return rows, models, kinds, errors, cut(tuned(errors, outer, inner, most_years))


def nested(rows: DataFrame, f: Features, least: int = 10, most_years: int = 5) -> Nested:
    """The nested evaluation. Each year with `least` rows of every state before it is predicted by the fit on the years before, with
    the candidate and the decision power that do best on validation years before it (half as many rows of each state suffice there), and untuned.

    What is kept between the steps is the features of each row, a row for each combination of categories in a year, and one for each year and candidate."""
    rows, models, kinds, errors, chosen = tuned_years(rows, f, least, most_years)
    inner = max(3, least // 2)
    plain = chosen.select("outer", *[F.lit(v).alias(n) for n, v in zip(NAMES, UNTUNED, strict=True)])
    asked = [_last_years(errors, c.select("outer"), inner, most_years).join(c.select("outer", *NAMES), "outer").select("year", *NAMES) for c in (chosen, plain)]
    own = chosen.select(F.col("outer").alias("year"), *NAMES)
    taken = cut(decisions(rows, models, f, asked[0].unionByName(asked[1]).unionByName(own), kinds))
    power = decision_powers(rows, models, f, errors, chosen, inner, most_years, taken)
    plain_power = decision_powers(rows, models, f, errors, plain, inner, most_years, taken)
    choices = cut(chosen.join(power, "outer").join(plain_power.select("outer", F.col("power").alias("untuned_power")), "outer"))
    return Nested(choices, taken, predictions(rows, models, f, choices, kinds))
