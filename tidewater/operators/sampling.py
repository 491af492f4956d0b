"""Monte Carlo draws as rows, seeded by event, and their summaries."""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .payoff import CLIP, OutcomeDefaults


def event_seed(event_id: object, salt: int) -> int:
    return (zlib.crc32(str(event_id).encode()) + salt) % 2**32


@functools.lru_cache(1024)
def beta_quantiles(a: float, b: float, nodes: int = 2049) -> tuple[np.ndarray, np.ndarray]:
    """A Beta's distribution function and its values at places along the log odds that hold all of its mass but e^-45 of the peak, or but what is within e^-30 of 0 or 1.

    Steps are small against the distribution's width: a line between two places was off by 1.2e-5 of probability at most in six pairs of parameters
    that were tried. Draws nearer than e^-30 to 0 or 1 count as that near (2e-3 of them for 0.25 and 75), which no payoff tells apart. 20,000 draws
    themselves are off by some 7e-3. 33 MB in a worker hold 1,024 pairs of parameters.
    """
    z = np.linspace(-30.0, 30.0, 241)
    w = (a + b) * -np.log1p(np.exp(-z)) - b * z
    near = np.flatnonzero(w > w.max() - 45)
    z = np.linspace(z[max(near[0] - 1, 0)], z[min(near[-1] + 1, len(z) - 1)], nodes)
    value = 1 / (1 + np.exp(-z))
    w = (a + b) * np.log(value) - b * z
    w = np.exp(w - w.max())
    below = np.cumsum(np.concatenate([[w[0] / a], (w[1:] + w[:-1]) * ((z[1] - z[0]) / 2)]))
    return below / (below[-1] + w[-1] / b), value


def sorted_beta(a: float, b: float, n: int, rng: np.random.Generator) -> np.ndarray:
    """n independent draws of a Beta in ascending order: uniforms come in order from the sums of exponential gaps, so nothing is sorted."""
    upto = np.cumsum(rng.standard_exponential(n + 1))
    below, value = beta_quantiles(a, b)
    return np.interp(upto[:-1], below * upto[-1], value)


def _drawn(fits: DataFrame, n: int, salt: int, shape, columns: list[str], rows: int) -> DataFrame:
    """(event_id, draw_id, f, u) from shape(row, rng) -> (a, b), in batches of about so many rows."""

    def draw(batches):
        for batch in batches:
            values = batch.to_pylist()
            step = max(1, rows // n)
            for k in range(0, len(values), step):
                part = values[k : k + step]
                f, u = np.empty((len(part), n)), np.empty((len(part), n))
                for i, x in enumerate(part):
                    rng = np.random.default_rng(event_seed(x["event_id"], salt))
                    f[i] = rng.beta(*shape(x, rng), n)
                    u[i] = rng.random(n)
                ids = np.repeat(np.array([x["event_id"] for x in part], np.int64), n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(n), len(part))), pa.array(f.ravel()), pa.array(u.ravel())], names=["event_id", "draw_id", "f", "u"])

    return fits.select("event_id", *columns).mapInArrow(draw, "event_id long, draw_id long, f double, u double")


def beta_draws(fits: DataFrame, n: int, salt: int) -> DataFrame:
    """fits (event_id, a, b) to (event_id, draw_id, f, u): n draws of demand with a uniform for the outcome, from a generator seeded by the event
    alone, so that neither order nor partitioning changes them."""
    return _drawn(fits, n, salt, lambda x, rng: (x["a"], x["b"]), ["a", "b"], 1 << 16)


def _conditioned(x: dict, rng: np.random.Generator, uncertain: bool) -> tuple[float, float]:
    spread, slope, error = x["spread"], x["slope"], x["se_slope"]
    if spread is None or slope is None or not np.isfinite(spread) or not np.isfinite(slope):
        return x["a"], x["b"]
    if uncertain and error is not None and np.isfinite(error):
        slope = rng.normal(slope, error)
    mean, k = 1 / (1 + np.exp(-(x["intercept"] + slope * spread))), x["a"] + x["b"]
    return max(mean * k, 0.5), max((1 - mean) * k, 0.5)


_DEMAND = ["a", "b", "intercept", "slope", "se_slope", "spread"]


def demand_draws(fits: DataFrame, n: int, salt: int, condition: bool = True, uncertain: bool = True) -> DataFrame:
    """beta_draws given the spread: the Beta keeps its concentration a + b and is centred at the logistic line's mean, no parameter under one half. With
    uncertain, the slope is drawn once for each event from its standard error. fits: event_id, a, b, intercept, slope, se_slope, spread; without a
    spread or a slope, and with condition=False, draws are unconditional."""
    return _drawn(fits, n, salt, lambda x, rng: _conditioned(x, rng, uncertain) if condition else (x["a"], x["b"]), _DEMAND, 1 << 16)


def demand_summaries(fits: DataFrame, n: int, salt: int) -> DataFrame:
    """(event_id, mean, p05, p50, p95) of demand_draws(), made where they are drawn, so that no draw becomes a row."""

    def made(batches):
        for batch in batches:
            found = []
            for x in batch.to_pylist():
                rng = np.random.default_rng(event_seed(x["event_id"], salt))
                f = rng.beta(*_conditioned(x, rng, True), n)
                found.append((x["event_id"], f.mean(), *np.quantile(f, (0.05, 0.5, 0.95))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.float64() if k else pa.int64()) for k in range(5)], names=["event_id", "mean", "p05", "p50", "p95"])

    return fits.select("event_id", *_DEMAND).mapInArrow(made, "event_id long, mean double, p05 double, p50 double, p95 double")


def _returns(batch: pa.RecordBatch, n: int, salt: int) -> Iterator[tuple[object, np.ndarray]]:
    """event_id and n returns of each row (event_id, a, b, cash, stock, pi_cash, m, p_completed, p_terminated), from the draws of beta_draws: the better
    election after proration, or what is left when the deal is terminated or withdrawn; without probabilities the defaults."""
    names = ("event_id", "a", "b", "cash", "stock", "pi_cash", "m", "p_completed", "p_terminated")
    default = OutcomeDefaults()
    for event_id, a, b, cash, stock, pi, m, done, ended in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
        if done is None or ended is None:
            done, ended = default.completed, default.terminated
        rng = np.random.default_rng(event_seed(event_id, salt))
        f, u = np.clip(rng.beta(a, b, n), CLIP, 1 - CLIP), rng.random(n)
        cash_fill, stock_fill = np.minimum(1.0, pi / f), np.minimum(1.0, (1 - pi) / (1 - f))
        best = np.maximum(cash_fill * cash + (1 - cash_fill) * stock, stock_fill * stock + (1 - stock_fill) * cash)
        yield event_id, np.where(u < done, best, np.where(u < done + ended, m * 0.75, m * 0.65)) / m - 1


def deal_summaries(deals: DataFrame, n: int, salt: int) -> DataFrame:
    """summary() of n returns of each deal, made where they are drawn, so that no draw becomes a row. deals: as _returns reads them."""

    def made(batches):
        for batch in batches:
            found = []
            for event_id, r in _returns(batch, n, salt):
                p05, p50, p95 = np.quantile(r, (0.05, 0.5, 0.95))
                found.append((event_id, r.mean(), p05, p50, p95, (r < 0).mean(), r[r <= p05].mean()))
            names = ["event_id", "mean", "p05", "p50", "p95", "loss_probability", "cvar05"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.float64() if k else pa.int64()) for k in range(7)], names=names)

    return deals.mapInArrow(made, "event_id long, mean double, p05 double, p50 double, p95 double, loss_probability double, cvar05 double")


def mean_paths(deals: DataFrame, n: int, salt: int) -> DataFrame:
    """(draw_id, r): the mean return over all deals of each of n draws; a task hands on one sum for each draw."""

    def sums(batches):
        total, count = np.zeros(n), 0
        for batch in batches:
            for _, r in _returns(batch, n, salt):
                total, count = total + r, count + 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(np.full(n, count))], names=["draw_id", "s", "c"])

    return deals.mapInArrow(sums, "draw_id long, s double, c long").groupBy("draw_id").agg((F.sum("s") / F.sum("c")).alias("r"))


def _better(f: np.ndarray, pi: float, cash: float, stock: float) -> np.ndarray:
    """What the better election pays after proration: the dearer kind, filled up to its pool."""
    f = np.minimum(np.maximum(f, CLIP), 1 - CLIP)
    fill = pi / f if cash >= stock else (1 - pi) / (1 - f)
    return min(cash, stock) + np.minimum(1.0, fill) * abs(cash - stock)


@functools.lru_cache(2)
def _room(n: int) -> tuple[np.ndarray, ...]:
    """Arrays that a worker's deals write to in turn."""
    return np.empty(n, np.uint32), np.empty(n, np.intp), np.empty(n, complex), np.empty(n), np.empty(n), np.zeros(-(-n // 8) * 8, bool)


class Inverted:
    """A deal's return as a function of one uniform, which decides the outcome and, where the deal completes, places the demand in its Beta.

    The unit interval is cut into so many even cells. In a smooth one the return is a line between its ends; draws in the others, those with a step or a bend
    and the eight at either end of the completed part, go through the Beta's own table. Uniforms have 32 bits."""

    def __init__(self, x: tuple, bits: int = 10, ends: int = 8):
        self.a, self.b, self.cash, self.stock, self.pi, self.m, done, ended = x
        self.done, self.least, self.bits = done, done + ended, bits
        cells = 1 << bits
        whole = min(cells, max(0, int(done * cells)))  # cells that complete throughout
        below, value = beta_quantiles(self.a, self.b)
        self.line = np.empty(cells, complex)  # start and slope as one number, read at once
        start, slope = self.line.real, self.line.imag
        start[:], slope[:] = -0.25, 0.0
        start[min(cells, max(0, int(self.least * cells))) :] = -0.35
        if whole:
            at = np.arange(whole + 1)
            made = _better(np.interp(at / (cells * done), below, value), self.pi, self.cash, self.stock) / self.m - 1
            slope[:whole] = np.diff(made) * (cells / 2**32)
            start[:whole] = made[:-1] - slope[:whole] * (at[:-1] * (2**32 / cells))
        bend = done * np.interp(self.pi, value, below) * cells
        start[: min(ends, whole)] = start[max(0, whole - ends) : whole] = np.nan
        for c in (whole, int(bend), int(self.least * cells)):
            if 0 <= c < cells:
                start[c] = np.nan

    def exact(self, u: np.ndarray) -> np.ndarray:
        """Returns of these uniforms, without cells."""
        out = np.where(u < self.least, -0.25, -0.35)
        done = u < self.done
        if done.any():
            out[done] = _better(np.interp(u[done] / self.done, *beta_quantiles(self.a, self.b)), self.pi, self.cash, self.stock) / self.m - 1
        return out

    def returns(self, words: np.ndarray) -> np.ndarray:
        """Returns of uniforms given as 32-bit words, in an array that the next deal writes to."""
        n = len(words)
        short, cell, line, r, more, off = _room(n)
        np.right_shift(words, np.uint32(32 - self.bits), out=short)
        np.copyto(cell, short)
        np.take(self.line, cell, out=line, mode="clip")
        np.copyto(more, words)
        np.multiply(line.imag, more, out=r)
        r += line.real
        np.isnan(r, out=off[:n])
        eights = np.flatnonzero(off.view(np.uint64))  # few cells are rough, so most eights have none
        rough = (eights[:, None] * 8 + np.arange(8)).ravel()
        rough = rough[off[rough]]
        r[rough] = self.exact((words[rough] + 0.5) / 2**32)
        return r


def words_of(event_id: object, salt: int, n: int, source: np.random.PCG64) -> np.ndarray:
    """n random 32-bit words from a stream of the event's own, whatever came before: a hash of its id is the generator's state."""
    key = hashlib.blake2b(f"{salt}:{event_id}".encode(), digest_size=32).digest()
    source.state = {"bit_generator": "PCG64", "state": {"state": int.from_bytes(key[:16], "little"), "inc": int.from_bytes(key[16:], "little") | 1}, "has_uint32": 0, "uinteger": 0}
    return source.random_raw((n + 1) // 2).view(np.uint32)[:n]


def mean_paths_inverted(deals: DataFrame, n: int, salt: int) -> DataFrame:
    """mean_paths() by Inverted: the same law, other draws. A deal's draws are its own and independent of all others; neither order nor partitioning changes them."""
    names = ("event_id", "a", "b", "cash", "stock", "pi_cash", "m", "p_completed", "p_terminated")

    def sums(batches):
        total, count, default, source = np.zeros(n), 0, OutcomeDefaults(), np.random.PCG64(0)
        for batch in batches:
            for event_id, *x, done, ended in zip(*(batch.column(k).to_pylist() for k in names), strict=True):
                if done is None or ended is None:
                    done, ended = default.completed, default.terminated
                total += Inverted((*x, done, ended)).returns(words_of(event_id, salt, n, source))
                count += 1
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(total), pa.array(np.full(n, count))], names=["draw_id", "s", "c"])

    # equal Betas follow each other, so that a table serves all of them
    made = deals.sortWithinPartitions("a", "b").mapInArrow(sums, "draw_id long, s double, c long")
    return made.groupBy("draw_id").agg((F.sum("s") / F.sum("c")).alias("r"))


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """mean, p05, p50, p95, the mean of what is at or below p05, and the share below 0."""
    q = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q"), F.avg(F.when(F.col(value) < 0, 1.0).otherwise(0.0)).alias("loss_probability"))
    q = q.select(*by, "mean", F.get("q", F.lit(0)).alias("p05"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p95"), "loss_probability")
    tail = df.join(q.select(*by, "p05"), by).where(F.col(value) <= F.col("p05")).groupBy(*by).agg(F.avg(value).alias("cvar05"))
    return q.join(tail, by, "left").withColumn("cvar05", F.coalesce("cvar05", "p05"))
