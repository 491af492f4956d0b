"""Both trades of a deal, long with an election and short without one, on the same draws; and the sizes at which the long one still pays after its own vote.

Draws are arrays of one deal at a time inside a task, so that none becomes a row; all that follows from their summaries is column expressions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import capacity as C
from . import payoff as P
from .gates import GateConfig, risk_gate
from .sampling import event_seed, sorted_beta

#: The fraction by which even draws of the outcome go round.
GOLDEN = 0.6180339887498949
STATS = ("mean", "p05", "p50", "p95", "cvar05", "loss_probability")
REASONS = ("risk_adjusted_return_positive", "risk_adjusted_return_below_hurdle", "p05_below_floor", "loss_probability_above_ceiling", "source_allocation_unfilled")
PREFIXES = ("max", "optimal")
SIZE_STATS = ("q", "mean", "p05", "loss_probability", "shift", "impacted_demand", "seller_cash_prob")
CLIP = P.CLIP
#: Parts of demand in which the draws of a deal are summed up for many sizes.
BINS = 256


@dataclass(frozen=True)
class Draws:
    """n draws of demand, in ascending order, and of the outcome's uniform for each deal: of its fitted Beta, from a generator seeded by the event; or,
    even, the same mid-points for every deal, which SQL can follow. Outcomes do not depend on demand, so its order changes no joint draw's law."""

    n: int = 20_000
    salt: int = 11
    even: bool = False

    def of(self, event_id: object, a: float, b: float) -> tuple[np.ndarray, np.ndarray]:
        if self.even:
            k = np.arange(self.n)
            return (k + 0.5) / self.n, (k + 1) * GOLDEN % 1
        rng = np.random.default_rng(event_seed(event_id, self.salt))
        return np.clip(sorted_beta(a, b, self.n, rng), CLIP, 1 - CLIP), rng.random(self.n)


def return_stats(r: np.ndarray) -> tuple[float, ...]:
    """STATS of returns."""
    p05, p50, p95 = np.quantile(r, (0.05, 0.5, 0.95))
    return float(r.mean()), float(p05), float(p50), float(p95), float(r[r <= p05].mean()), float((r < 0).mean())


def one_deal(f: np.ndarray, u: np.ndarray, x: dict) -> tuple[float, ...]:
    """The mean of either election, the stock that each leaves on average, and STATS of the long and of the reverse trade."""
    f = np.clip(f, CLIP, 1 - CLIP)
    cash_fill, stock_fill = np.minimum(1.0, x["pi_cash"] / f), np.minimum(1.0, (1 - x["pi_cash"]) / (1 - f))
    cash, stock = x["cash"], x["stock"]
    by_cash, by_stock = cash_fill * cash + (1 - cash_fill) * stock, stock_fill * stock + (1 - stock_fill) * cash
    means = by_cash.mean(), by_stock.mean()
    held = by_cash if round(means[0], 9) >= round(means[1], 9) else by_stock
    done, ended = u < x["p_completed"], u < x["p_completed"] + x["p_terminated"]
    broken = np.where(ended, x["terminated_value"], x["withdrawn_value"])
    blend = x["pi_cash"] * cash + (1 - x["pi_cash"]) * stock
    m = x["entry"]
    long, reverse = (np.where(done, held, broken) - m) / m, (m - np.where(done, blend, broken)) / m
    return (float(means[0]), float(means[1]), float((1 - cash_fill).mean()), float(stock_fill.mean()), *return_stats(long), *return_stats(reverse))


def _between(r, n: int, share: float) -> float:
    """The quantile of n values that r gives by their place."""
    place = (n - 1) * share
    k = math.floor(place)
    low, high = r(k), r(min(k + 1, n - 1))
    return float(low + (high - low) * (place - k))


def with_atoms(r: np.ndarray, atoms: list[tuple[float, int]]) -> np.ndarray:
    """Ascending returns with (value, count) put among them."""
    parts, at = [], 0
    for value, count in sorted(atoms):
        k = int(np.searchsorted(r, value))
        parts += [r[at:k], np.full(count, value)]
        at = k
    return np.concatenate([*parts, r[at:]])


def stats_ascending(r: np.ndarray) -> tuple[float, ...]:
    """return_stats() of ascending returns."""
    p05, p50, p95 = (_between(r.__getitem__, len(r), q) for q in (0.05, 0.5, 0.95))
    return float(r.mean()), p05, p50, p95, float(r[: max(1, int(np.searchsorted(r, p05, "right")))].mean()), int(np.searchsorted(r, 0.0)) / len(r)


def stats_counted(atoms: list[tuple[float, int]]) -> tuple[float, ...]:
    """return_stats() of values that occur so often."""
    atoms = sorted(x for x in atoms if x[1])
    n = sum(c for _, c in atoms)

    def nth(k: int) -> float:
        for value, count in atoms:
            k -= count
            if k < 0:
                return value
        return atoms[-1][0]

    p05, p50, p95 = (_between(nth, n, q) for q in (0.05, 0.5, 0.95))
    tail = [x for x in atoms if x[0] <= p05] or atoms[:1]
    mean = lambda some: sum(v * c for v, c in some) / sum(c for _, c in some)
    return mean(atoms), p05, p50, p95, mean(tail), sum(c for v, c in atoms if v < 0) / n


def one_ascending(f: np.ndarray, u: np.ndarray, x: dict) -> tuple[float, ...]:
    """one_deal() of ascending draws within CLIP: a fill is whole on one side of the pool, a payoff rises or falls along demand, the broken states and the
    settlement are one value each; so nothing is sorted, and only what is beyond the pool is divided."""
    pi, cash, stock, m, n = x["pi_cash"], x["cash"], x["stock"], x["entry"], len(f)
    over, under = int(np.searchsorted(f, pi, "right")), int(np.searchsorted(f, pi))
    cash_fill = (over + float((pi / f[over:]).sum())) / n
    stock_fill = (n - under + float(((1 - pi) / (1 - f[:under])).sum())) / n
    means = cash_fill * cash + (1 - cash_fill) * stock, stock_fill * stock + (1 - stock_fill) * cash
    done = u < x["p_completed"]
    g = f[done]
    ended = int(np.count_nonzero(u < x["p_completed"] + x["p_terminated"])) - len(g)
    by_cash = round(means[0], 9) >= round(means[1], 9)
    fill, own, other = (np.minimum(1.0, pi / g), cash, stock) if by_cash else (np.minimum(1.0, (1 - pi) / (1 - g)), stock, cash)
    r = (other + fill * (own - other) - m) / m
    falls = (own >= other) == by_cash
    broken = [((x["terminated_value"] - m) / m, ended), ((x["withdrawn_value"] - m) / m, n - len(g) - ended)]
    settled = (m - (pi * cash + (1 - pi) * stock)) / m
    return (*means, 1 - cash_fill, stock_fill, *stats_ascending(with_atoms(r[::-1] if falls else r, broken)), *stats_counted([(settled, len(g)), *((-v, c) for v, c in broken)]))


_TERMS = ("event_id", "a", "b", "cash", "stock", "pi_cash", "entry", "p_completed", "p_terminated", "terminated_value", "withdrawn_value")
_PRICED = ("cash_mean", "stock_mean", "cash_stock_part", "stock_stock_part", *(f"{side}_{s}" for side in ("long", "reverse") for s in STATS))


def _rows(batch: pa.RecordBatch, columns: tuple[str, ...]) -> Iterator[dict]:
    for values in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
        yield dict(zip(columns, values, strict=True))


def priced(deals: DataFrame, draws: Draws) -> DataFrame:
    """deals (event_id, a, b, cash, stock, pi_cash, entry, p_completed, p_terminated, terminated_value, withdrawn_value, without a and b for even draws, and any others) with both trades' summaries."""
    schema = T.StructType([*deals.schema.fields, *(T.StructField(c, T.DoubleType()) for c in _PRICED)])

    def run(batches):
        for batch in batches:
            if draws.even:
                parts = [deals_together(*draws.of(None, 1.0, 1.0), _floats(batch.slice(i, TOGETHER), _TERMS[3:])) for i in range(0, batch.num_rows, TOGETHER)]
                made = [np.concatenate(v) for v in zip(*parts, strict=True)] or [[]] * len(_PRICED)
            else:
                made = list(zip(*(one_ascending(*draws.of(x["event_id"], x["a"], x["b"]), x) for x in _rows(batch, _TERMS)), strict=True)) or [[]] * len(_PRICED)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, pa.float64()) for v in made)], names=schema.names)

    return deals.mapInArrow(run, schema)


class Sizes:
    """Returns of one deal's election at any shift of demand, over one set of draws that is sorted once.

    Where the deal completes, the payoff rises or falls along sorted demand, and a shift leaves the order as it is; the two broken states are two
    values. So order statistics are places in the sorted draws, found by halving for all shifts at once, and only the mean's sum runs over draws.
    """

    def __init__(self, f: np.ndarray, u: np.ndarray, x: dict):
        done = u < x["p_completed"]
        ended = int(np.count_nonzero(u < x["p_completed"] + x["p_terminated"])) - int(np.count_nonzero(done))
        cash = x["elect"] == "CASH"
        self.n, self.m, self.sign = len(f), x["entry"], 1.0 if cash else -1.0
        # the election's own side: demand for it, its pool, its value, and the other kind's
        if (f[1:] < f[:-1]).any():
            order = np.argsort(f)
            f, done = f[order], done[order]
        self.all = f if cash else 1 - f[::-1]
        self.x = self.all[done if cash else done[::-1]]
        self.pool, self.own, self.other = (x["pi_cash"], x["cash"], x["stock"]) if cash else (1 - x["pi_cash"], x["stock"], x["cash"])
        self.falls = self.own >= self.other
        atoms = sorted([((x["terminated_value"] - self.m) / self.m, ended), ((x["withdrawn_value"] - self.m) / self.m, self.n - len(self.x) - ended)])
        self.value, self.count = np.array([a for a, _ in atoms]), np.array([c for _, c in atoms])
        self.upto = np.concatenate([[0.0], np.cumsum(self.all)])
        self.room = np.empty(len(self.x))
        self.bins: tuple[np.ndarray, np.ndarray, list[np.ndarray]] | None = None

    def _fill(self, at: np.ndarray) -> np.ndarray:
        return np.minimum(1.0, self.pool / np.clip(at, CLIP, 1 - CLIP))

    def _return(self, k: np.ndarray, shift: np.ndarray) -> np.ndarray:
        """The k-th least completed return at each shift."""
        k = np.clip(k, 0, len(self.x) - 1)
        at = self.x[len(self.x) - 1 - k] if self.falls else self.x[k]
        return (self.other + self._fill(at + shift) * (self.own - self.other) - self.m) / self.m

    def _below(self, limit: float, shift: np.ndarray) -> np.ndarray:
        """How many completed returns are under a limit, at each shift."""
        low, high = np.zeros(len(shift), np.int64), np.full(len(shift), len(self.x))
        if len(self.x) and self.own != self.other:
            # the demand at which the return is the limit tells where to look; what is found there bounds the halving
            with np.errstate(divide="ignore"):
                fill = (self.m * (1 + limit) - self.other) / (self.own - self.other)
                at = np.searchsorted(self.x, (np.inf if fill <= 0 else -np.inf if fill > 1 else self.pool / fill) - shift)
            at = len(self.x) - at if self.falls else at
            for near in (at - 2, at + 1):
                near = np.clip(near, 0, len(self.x) - 1)
                under = self._return(near, shift) < limit
                low, high = np.where(under, np.maximum(low, near + 1), low), np.where(under, high, np.minimum(high, near))
        while (low < high).any():
            mid = (low + high) // 2
            under = (self._return(mid, shift) < limit) & (low < high)
            low, high = np.where(under, mid + 1, low), np.where(under | (low >= high), high, mid)
        return low

    def _nth(self, k: int, below: list[np.ndarray], shift: np.ndarray) -> np.ndarray:
        """The k-th least of all returns."""
        (n1, n2), (v1, v2) = self.count, self.value
        c1, c2 = below
        free = np.full(len(shift), k)
        own = self._return(np.where(free < c1, k, np.where(free < c2 + n1, k - n1, k - n1 - n2)), shift) if len(self.x) else np.zeros(len(shift))
        return np.where((free >= c1) & (free < c1 + n1), v1, np.where((free >= c2 + n1) & (free < c2 + n1 + n2), v2, own))

    def _filled(self, d: float) -> float:
        """The sum of all fills after a move of the election's own demand by d: whole ones up to a place in the sorted draws, and the pool over demand after it."""
        full = int(np.searchsorted(self.x, self.pool - d, "right"))
        part = np.add(self.x[full:], d, out=self.room[: len(self.x) - full])
        if len(part) and part[-1] > 1 - CLIP:
            np.minimum(part, 1 - CLIP, out=part)
        if self.pool < CLIP:
            np.maximum(part, CLIP, out=part)
        return full + float(np.divide(self.pool, part, out=part).sum())

    def _summed(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Middles of BINS equal parts of demand, where each begins among the draws, and in each the sums of powers of the distance from its middle, as many as
        leave less than 1e-16 of a fill out."""
        if self.bins is None:
            middle = (np.arange(BINS) + 0.5) / BINS
            near = 0.5 / BINS / (self.pool - 0.5 / BINS)
            of = np.minimum((self.x * BINS).astype(np.int64), BINS - 1)
            far, power, sums = self.x - middle[of], np.ones(len(self.x)), []
            for _ in range(math.ceil(math.log(1e-16) / math.log(near))):
                sums.append(np.bincount(of, weights=power, minlength=BINS))
                power *= far
            self.bins = middle, np.searchsorted(of, np.arange(BINS + 1)), sums
        return self.bins

    def _filled_many(self, d: np.ndarray) -> np.ndarray:
        """_filled() of many moves: 1 / (x + d) of a part's draws by its series about the part's middle, and one by one in the parts where whole or clipped ones end."""
        if len(d) < 8 or self.pool < 8 / BINS or not len(self.x):
            return np.array([self._filled(v) for v in d.tolist()])
        middle, starts, sums = self._summed()
        full, top = np.searchsorted(self.x, self.pool - d, "right"), np.searchsorted(self.x, 1 - CLIP - d, "right")
        top = np.maximum(full, top)
        first, last = np.searchsorted(starts, full), np.searchsorted(starts, top, "right") - 1
        part = np.arange(BINS)
        inside = (part >= first[:, None]) & (part < last[:, None])
        t = 1 / np.where(inside, middle + d[:, None], 1.0)
        total = np.broadcast_to(sums[-1], t.shape)
        for m in sums[-2::-1]:
            total = m - t * total
        found = np.where(inside, t * total, 0.0).sum(axis=1)
        for i, v in enumerate(d.tolist()):
            if first[i] > last[i]:
                ends = [(full[i], top[i])]
            else:
                ends = [(full[i], starts[first[i]]), (starts[last[i]], top[i])]
            found[i] += sum((1 / (self.x[a:b] + v)).sum() for a, b in ends if a < b)
        return full + self.pool * (found + (len(self.x) - top) / (1 - CLIP))

    def means(self, shift: np.ndarray) -> np.ndarray:
        """The mean at each shift of cash demand."""
        fills = self._filled_many(self.sign * shift)
        completed = (len(self.x) * (self.other - self.m) + fills * (self.own - self.other)) / self.m
        return (completed + (self.value * self.count).sum()) / self.n

    def tails(self, shift: np.ndarray) -> dict[str, np.ndarray]:
        """p05 and loss_probability at each shift of cash demand: places, no sum."""
        s = self.sign * shift
        below = [self._below(v, s) for v in self.value]
        place = (self.n - 1) * 0.05
        k = math.floor(place)
        low, high = self._nth(k, below, s), self._nth(min(k + 1, self.n - 1), below, s)
        p05 = low + (high - low) * (place - k)
        loss = self._below(0.0, s) + int(self.count[self.value < 0].sum())
        return {"p05": p05, "loss_probability": loss / self.n}

    def stats(self, shift: np.ndarray, tail: bool = False) -> dict[str, np.ndarray]:
        """mean, p05, loss_probability and, if tail, cvar05 at each shift of cash demand, and the mean demand for cash after it."""
        s = self.sign * shift
        top, bottom = np.searchsorted(self.all, 1 - CLIP - s, "right"), np.searchsorted(self.all, CLIP - s, "left")
        demand = (self.upto[top] - self.upto[bottom] + s * (top - bottom) + (self.n - top) * (1 - CLIP) + bottom * CLIP) / self.n
        out = {"mean": self.means(shift), **self.tails(shift), "impacted_demand": demand if self.sign > 0 else 1 - demand}
        return out | ({"cvar05": self._tail(s, out["p05"])} if tail else {})

    def _tail(self, s: np.ndarray, p05: np.ndarray) -> np.ndarray:
        """The mean of what lies at or under the percentile: broken states, and one end of the sorted draws."""
        out = np.empty(len(s))
        for i, d in enumerate(s):
            j = int(self._below(np.nextafter(p05[i], np.inf), s[i : i + 1])[0])
            least = self.x[len(self.x) - j :] if self.falls else self.x[:j]
            atoms = self.value <= p05[i]
            total = ((self.other - self.m) * j + self._fill(least + d).sum() * (self.own - self.other)) / self.m + (self.value * self.count)[atoms].sum()
            out[i] = total / max(1, j + int(self.count[atoms].sum()))
        return out


def gate_reasons(stats: dict[str, np.ndarray], cfg: GateConfig) -> np.ndarray:
    """Places in REASONS, as risk_gate names them; figures count to nine digits, as a broken state's loss may be the floor itself."""
    value, p05, loss = np.round(stats[cfg.metric], 9), np.round(stats["p05"], 9), stats["loss_probability"]
    ok = (value > cfg.hurdle) & (p05 >= cfg.least_p05) & (loss <= cfg.most_loss_probability)
    return np.where(ok, 0, np.where(value <= cfg.hurdle, 1, np.where(p05 < cfg.least_p05, 2, 3)))


def allocated(pools: list[dict], q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each size the cash probability of those who sell it, pool by pool in order, and what they leave unfilled."""
    taken, cash = np.zeros(q.shape), np.zeros(q.shape)
    for pool in pools:
        take = np.minimum(np.maximum(q - taken, 0.0), np.maximum(0.0, pool["cap"]))
        taken, cash = taken + take, cash + take * pool["cash"]
    return np.divide(cash, taken, out=np.full(q.shape, np.nan), where=taken > 0), np.maximum(0.0, q - taken)


def best_sizes(sizes: Sizes, x: dict, points: int, cfg: GateConfig) -> dict:
    """Of `points` sizes up to the most that flows allow (raw_q), the largest and the most profitable one that pass the gate, and why the last that failed did."""
    q = np.linspace(x["raw_q"] / points, x["raw_q"], points)
    seller, unfilled = allocated(x["pools"], q)
    own = 1.0 if x["elect"] == "CASH" else 0.0
    shift = q * (own - np.where(np.isnan(seller), own, seller))
    stats = sizes.stats(shift, cfg.metric == "cvar05")
    reason = np.where(np.isnan(seller) | (unfilled > 1e-9), 4, gate_reasons(stats, cfg))
    failed, passed = np.flatnonzero(reason), np.flatnonzero(reason == 0)
    out = {"fail_reason": REASONS[reason[failed[-1]]] if len(failed) else None}
    if len(passed):
        pnl = q[passed] * stats["mean"][passed]
        for prefix, i in zip(PREFIXES, (passed[-1], passed[int(np.argmax(np.round(pnl, 12)))]), strict=True):
            found = {**stats, "q": q, "shift": shift, "seller_cash_prob": seller}
            out |= {f"{prefix}_{s}": float(found[s][i]) for s in SIZE_STATS}
    return out


def break_even(sizes: Sizes, x: dict, cfg: GateConfig, points: int = 201, seller: float = 0.5) -> dict:
    """The least share of the company, of `points` from nothing to all, at which a position bought from holders who elect at random fails the gate, and which gate."""
    own = 1.0 if x["elect"] == "CASH" else 0.0
    q = np.linspace(0.0, 1.0, points)
    tails, step = sizes.tails(q * (own - seller)), 16
    # up to the first share that fails by its tail only means can fail
    ends = np.flatnonzero(gate_reasons({cfg.metric: np.full(points, np.inf), **tails}, cfg))
    last = int(ends[0]) + 1 if len(ends) else points
    for k in range(0, last, step):
        part = slice(k, min(k + step, last))
        shift = q[part] * (own - seller)
        stats = sizes.stats(shift, True) if cfg.metric == "cvar05" else {"mean": sizes.means(shift), **{c: v[part] for c, v in tails.items()}}
        reason = gate_reasons(stats, cfg)
        if reason.any():
            i = int(np.flatnonzero(reason)[0])
            return {"break_even": float(q[k + i]), "proof_reason": REASONS[reason[i]]}
    return {"break_even": None, "proof_reason": None}


#: Even draws are few and the same for every deal, so deals go through arrays so many at a time.
TOGETHER = 256


def _floats(batch: pa.RecordBatch, columns: tuple[str, ...]) -> dict[str, np.ndarray]:
    """Columns as a row for each deal, for arrays whose last axis is draws."""
    return {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False)[:, None] for c in columns}


def stats_together(r: np.ndarray) -> list[np.ndarray]:
    """STATS of the returns on the last axis."""
    p05, p50, p95 = np.quantile(r, (0.05, 0.5, 0.95), axis=-1)
    tail = r <= p05[..., None]
    return [r.mean(-1), p05, p50, p95, np.where(tail, r, 0.0).sum(-1) / tail.sum(-1), (r < 0).mean(-1)]


def deals_together(f: np.ndarray, u: np.ndarray, x: dict[str, np.ndarray]) -> list[np.ndarray]:
    """one_deal() of many deals on the same draws."""
    f = np.clip(f, CLIP, 1 - CLIP)
    cash_fill, stock_fill = np.minimum(1.0, x["pi_cash"] / f), np.minimum(1.0, (1 - x["pi_cash"]) / (1 - f))
    cash, stock, m = x["cash"], x["stock"], x["entry"]
    by_cash, by_stock = cash_fill * cash + (1 - cash_fill) * stock, stock_fill * stock + (1 - stock_fill) * cash
    means = by_cash.mean(-1), by_stock.mean(-1)
    held = np.where((np.round(means[0], 9) >= np.round(means[1], 9))[:, None], by_cash, by_stock)
    done = u < x["p_completed"]
    broken = np.where(u < x["p_completed"] + x["p_terminated"], x["terminated_value"], x["withdrawn_value"])
    blend = x["pi_cash"] * cash + (1 - x["pi_cash"]) * stock
    long, reverse = (np.where(done, held, broken) - m) / m, (m - np.where(done, blend, broken)) / m
    return [*means, (1 - cash_fill).mean(-1), stock_fill.mean(-1), *stats_together(long), *stats_together(reverse)]


class SizesTogether:
    """Sizes of many deals on the same draws: stats() takes the deals wanted and a row of shifts for each."""

    def __init__(self, f: np.ndarray, u: np.ndarray, x: dict[str, np.ndarray], by_cash: np.ndarray):
        cash = by_cash[:, None]
        self.m, self.sign = x["entry"], np.where(cash, 1.0, -1.0)
        self.all = np.where(cash, f, 1 - f)[:, None, :]
        self.pool = np.where(cash, x["pi_cash"], 1 - x["pi_cash"])
        self.own, self.other = np.where(cash, x["cash"], x["stock"]), np.where(cash, x["stock"], x["cash"])
        self.done = (u < x["p_completed"])[:, None, :]
        broken = np.where(u < x["p_completed"] + x["p_terminated"], x["terminated_value"], x["withdrawn_value"])
        self.broken = ((broken - self.m) / self.m)[:, None, :]

    def stats(self, i: np.ndarray, shift: np.ndarray, tail: bool = False) -> dict[str, np.ndarray]:
        of = lambda a: a[i][:, :, None]
        at = np.clip(self.all[i] + (self.sign[i] * shift)[:, :, None], CLIP, 1 - CLIP)
        r = np.where(self.done[i], (of(self.other) + np.minimum(1.0, of(self.pool) / at) * of(self.own - self.other) - of(self.m)) / of(self.m), self.broken[i])
        demand = at.mean(-1)
        place = (r.shape[-1] - 1) * 0.05
        k = math.floor(place)
        least = np.partition(r, (k, min(k + 1, r.shape[-1] - 1)), axis=-1)
        low, high = least[..., k], least[..., min(k + 1, r.shape[-1] - 1)]
        p05 = low + (high - low) * (place - k)
        out = {"mean": r.mean(-1), "p05": p05, "loss_probability": (r < 0).mean(-1), "impacted_demand": np.where(self.sign[i] > 0, demand, 1 - demand)}
        if tail:
            under = r <= p05[..., None]
            out["cvar05"] = np.where(under, r, 0.0).sum(-1) / np.maximum(1, under.sum(-1))
        return out


def sizes_together(sizes: SizesTogether, by_cash: np.ndarray, raw_q: np.ndarray, pools: list[list[dict]], points: int, cfg: GateConfig) -> list[dict]:
    """best_sizes() of many deals."""
    n, most = len(raw_q), max(map(len, pools))
    q = np.linspace(raw_q / points, raw_q, points, axis=-1)
    padded = [[*p, *({"cap": 0.0, "cash": 0.0},) * (most - len(p))] for p in pools]
    seller, unfilled = allocated([{k: np.array([p[j][k] for p in padded])[:, None] for k in ("cap", "cash")} for j in range(most)], q)
    own = np.where(by_cash, 1.0, 0.0)[:, None]
    shift = q * (own - np.where(np.isnan(seller), own, seller))
    found = {**sizes.stats(np.arange(n), shift, cfg.metric == "cvar05"), "q": q, "shift": shift, "seller_cash_prob": seller}
    reason = np.where(np.isnan(seller) | (unfilled > 1e-9), 4, gate_reasons(found, cfg))
    passed = reason == 0
    pnl = np.where(passed, np.round(q * found["mean"], 12), -np.inf)
    last = lambda mask: points - 1 - np.argmax(mask[:, ::-1], axis=1)
    at = {"max": last(passed), "optimal": np.argmax(pnl, axis=1)}
    failed, any_failed, any_passed = reason[np.arange(n), last(~passed)], (~passed).any(1), passed.any(1)
    picked = {f"{p}_{s}": found[s][np.arange(n), at[p]] for p in PREFIXES for s in SIZE_STATS}
    return [
        {"fail_reason": REASONS[failed[i]] if any_failed[i] else None} | ({c: float(v[i]) for c, v in picked.items()} if any_passed[i] else {})
        for i in range(n)
    ]


def proofs_together(sizes: SizesTogether, by_cash: np.ndarray, cfg: GateConfig, points: int = 201, seller: float = 0.5) -> list[dict]:
    """break_even() of many deals; those that have failed look no further."""
    n = len(by_cash)
    own, q, live = np.where(by_cash, 1.0, 0.0), np.linspace(0.0, 1.0, points), np.arange(n)
    out: list[dict] = [{"break_even": None, "proof_reason": None} for _ in range(n)]
    for k in range(0, points, 16):
        if not len(live):
            break
        reason = gate_reasons(sizes.stats(live, q[k : k + 16] * (own[live] - seller)[:, None], cfg.metric == "cvar05"), cfg)
        hit = (reason != 0).any(1)
        first = np.argmax(reason != 0, axis=1)
        for i in np.flatnonzero(hit):
            out[live[i]] = {"break_even": float(q[k + first[i]]), "proof_reason": REASONS[reason[i, first[i]]]}
        live = live[~hit]
    return out


_SIZED = tuple(f"{p}_{s}" for p in PREFIXES for s in SIZE_STATS)
_SIZE_TERMS = (*_TERMS, "elect", "raw_q", "pools")


def sized(deals: DataFrame, draws: Draws, points: int, cfg: GateConfig, wanted: str = "sized", proof: bool = True, best: bool = True) -> DataFrame:
    """deals (as priced() reads them, with elect, raw_q and pools, and a boolean column named by wanted) with best_sizes() (if best) and break_even() (if proof) of those wanted.

    The draws of a deal are those that priced() summed up, made again from its seed.
    """
    fields = [*((c, T.DoubleType()) for c in (*_SIZED, "break_even")), ("proof_reason", T.StringType()), ("fail_reason", T.StringType())]
    schema = T.StructType([*deals.schema.fields, *(T.StructField(c, t) for c, t in fields)])

    def run(batches):
        for batch in batches:
            wants = np.array([bool(on) and q is not None and q > 0 for on, q in zip(batch.column(wanted).to_pylist(), batch.column("raw_q").to_pylist(), strict=True)], bool)
            made, places = [{} for _ in range(batch.num_rows)], np.flatnonzero(wants)
            if draws.even:
                for k in range(0, len(places), TOGETHER):
                    mine = places[k : k + TOGETHER]
                    part = batch.take(pa.array(mine))
                    by_cash = np.array([v == "CASH" for v in part.column("elect").to_pylist()])
                    together = SizesTogether(*draws.of(None, 1.0, 1.0), _floats(part, _TERMS[3:]), by_cash)
                    found = sizes_together(together, by_cash, part.column("raw_q").to_numpy(zero_copy_only=False), part.column("pools").to_pylist(), points, cfg) if best else [{}] * len(mine)
                    proofs = proofs_together(together, by_cash, cfg) if proof else [{}] * len(mine)
                    for i, one, other in zip(mine, found, proofs, strict=True):
                        made[i] = one | other
            else:
                for i, x in zip(places, _rows(batch.take(pa.array(places)), _SIZE_TERMS), strict=True):
                    sizes = Sizes(*draws.of(x["event_id"], x["a"], x["b"]), x)
                    made[i] = (best_sizes(sizes, x, points, cfg) if best else {}) | (break_even(sizes, x, cfg) if proof else {})
            added = [pa.array([v.get(c) for v in made], pa.string() if t == T.StringType() else pa.float64()) for c, t in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=schema.names)

    return deals.mapInArrow(run, schema)


def decided(d: DataFrame, cfg: GateConfig) -> DataFrame:
    """priced() with the election, both trades' gates, the signal and its reason, and the figures of the trade that counts: the one taken, or the better of
    the two where none is. d has entry, ratio, cash, stock, pi_cash, deadline_stock, terminated_value, withdrawn_value besides."""
    nine = lambda c: F.round(c, 9)
    by_cash = nine("cash_mean") >= nine("stock_mean")
    d = d.withColumns({"elect": F.when(by_cash, "CASH").otherwise("STOCK"), "long_fair_value": F.greatest("cash_mean", "stock_mean"), "settlement": F.col("pi_cash") * F.col("cash") + (1 - F.col("pi_cash")) * F.col("stock")})
    stock_part = F.when(by_cash, F.col("cash_stock_part")).otherwise(F.col("stock_stock_part"))
    d = d.withColumns({
        "arb_return": (F.col("long_fair_value") - F.col("entry")) / F.col("entry"),
        "reverse_completion_return": (F.col("entry") - F.col("settlement")) / F.col("entry"),
        "terminated_return": (F.col("terminated_value") - F.col("entry")) / F.col("entry"),
        "withdrawn_return": (F.col("withdrawn_value") - F.col("entry")) / F.col("entry"),
        "long_hedge": F.col("ratio") * stock_part,
        "reverse_hedge": F.col("ratio") * (1 - F.col("pi_cash")),
        "term_gap": F.greatest(P.term_gap(F.col("cash"), F.col("stock")), P.term_gap(F.col("cash"), F.col("deadline_stock"))),
    })
    for side in ("long", "reverse"):
        stats = [nine(F.col(f"{side}_{s}")) for s in ("mean", "p05", "cvar05", "loss_probability")]
        d = d.withColumns({f"{side}_gate": risk_gate(*stats, cfg), f"{side}_decision": F.col(f"{side}_{cfg.metric}")})
    gap, wild = nine(F.col("term_gap")) > cfg.most_gap, nine(F.greatest(F.abs("arb_return"), F.abs("reverse_completion_return"))) > cfg.most_return
    long_ok, reverse_ok = F.col("long_gate.ok"), F.col("reverse_gate.ok")
    reverse_better = nine(F.col("reverse_decision")) > nine(F.col("long_decision"))
    either = lambda reason: (F.col("long_gate.reason") == reason) | (F.col("reverse_gate.reason") == reason)
    signal = (
        F.when(gap | wild, "REVIEW")
        .when(reverse_ok & (~long_ok | reverse_better), "REVERSE")
        .when(long_ok, "ENTER")
        .when(either(REASONS[2]), "PASS_P05")
        .when(either(REASONS[3]), "PASS_LOSS_PROB")
        .otherwise("PASS")
    )
    d = d.withColumn("signal", signal)
    s = F.col("signal")
    reason = (
        F.when(s == "REVIEW", F.when(gap, "implausible_cash_vs_stock_term_gap").otherwise("abs_completion_or_election_return_above_30pct"))
        .when(s == "REVERSE", F.col("reverse_gate.reason"))
        .when(s == "ENTER", F.col("long_gate.reason"))
        .when(s == "PASS_P05", "best_candidate_p05_below_floor")
        .when(s == "PASS_LOSS_PROB", "best_candidate_loss_probability_above_ceiling")
        .otherwise("both_directions_below_hurdle")
    )
    strategy = F.when(s == "ENTER", "LONG_TARGET_ELECTION").when(s == "REVERSE", "SHORT_TARGET_PASSIVE").when(s == "REVIEW", "REVIEW").otherwise("PASS")
    short = F.when(s.isin("ENTER", "REVERSE"), s == "REVERSE").otherwise(reverse_better)
    of = lambda long, reverse: F.when(short, reverse).otherwise(long)
    size = F.when(s == "ENTER", F.col("long_gate.size")).when(s == "REVERSE", F.col("reverse_gate.size")).otherwise(0.0)
    return d.withColumns({
        "signal_reason": reason,
        "selected_strategy": strategy,
        "fair_value": of(F.col("long_fair_value"), F.col("settlement")),
        "risk_adjusted_value": of(F.col("entry") * (1 + F.col("long_mean")), F.col("entry") * (1 - F.col("reverse_mean"))),
        "e_return": of(F.col("long_mean"), F.col("reverse_mean")),
        "decision_value": F.greatest("long_decision", "reverse_decision") if cfg.metric == "mean" else of(F.col("long_decision"), F.col("reverse_decision")),
        **{x: of(F.col(f"long_{x}"), F.col(f"reverse_{x}")) for x in ("p05", "cvar05", "loss_probability")},
        "hedge_side": of(F.lit("SHORT_ACQUIRER"), F.lit("LONG_ACQUIRER")),
        "hedge_ratio": of(F.col("long_hedge"), F.col("reverse_hedge")),
        "size": size,
        "short": short,
    }).drop("long_gate", "reverse_gate")


def realized(d: DataFrame) -> DataFrame:
    """decided() with what came of either trade: long_realized, reverse_realized, realized_return of the one that counts, and where it is from. d has outcome
    ('' or null: none) and f_cash besides."""
    outcome, f = F.coalesce("outcome", F.lit("")), F.col("f_cash")
    got = P.prorate(f, F.col("pi_cash"), F.col("cash"), F.col("stock"))
    value = F.when(F.col("elect") == "CASH", got["cash_holder"]).otherwise(got["stock_holder"])
    closed = (outcome == "completed") | f.isNotNull()
    broke = lambda sign: F.when(outcome == "terminated", sign * F.col("terminated_return")).when(outcome == "withdrawn", sign * F.col("withdrawn_return"))
    d = d.withColumns({
        "long_realized": F.coalesce(broke(F.lit(1)), F.when(closed & f.isNotNull(), (value - F.col("entry")) / F.col("entry"))),
        "reverse_realized": F.coalesce(broke(F.lit(-1)), F.when(closed, F.col("reverse_completion_return"))),
        "realized_source": F.when(outcome.isin("terminated", "withdrawn"), "deal_outcome_label").when(f.isNotNull(), "realized_f_cash").when(closed, "completed_status_no_realized_f_cash").otherwise("missing_realized_outcome"),
        "actual_outcome": F.when((outcome == "") & f.isNotNull(), "completed").otherwise(outcome),
    })
    return d.withColumn("realized_return", F.when(F.col("short"), F.col("reverse_realized")).otherwise(F.col("long_realized")))


def flows(d: DataFrame, cfg: C.CapacityConfig) -> DataFrame:
    """Who would sell, lend and buy, and how much of the company that allows: raw_q and raw_binding of the long trade, pools, and reverse_q, reverse_binding and
    lenders of the other. Reads the columns of capacity.inputs(), default_rule, elect and both trades' means."""
    adv_cap = F.col("adv_pct") * cfg.build_days * cfg.adv_participation
    finite = (F.col("shares") > 0) & (F.col("adv") > 0)
    d = d.withColumns({
        "adv_cap": adv_cap,
        "flow_status": F.when(F.coalesce(finite, F.lit(False)), "ok").otherwise("missing_shares_or_adv"),
        "pools": C.long_pools(adv_cap, F.col("long_mean"), F.col("elect"), F.col("default_rule"), F.col("pi_cash"), cfg),
        "lenders": C.lending_pools(F.col("default_rule"), F.col("pi_cash"), cfg),
        "buyers": F.least(F.col("noisy_share"), adv_cap * cfg.noisy_buy),
    })
    long, long_name = C.binding(C.pool_total(F.col("pools")), F.col("adv_cap"), F.lit(cfg.position_limit))
    lent, lent_name = C.binding(C.pool_total(F.col("lenders")), F.col("adv_cap"), F.lit(cfg.position_limit))
    ok = F.col("flow_status") == "ok"
    return d.withColumns({
        "raw_q": F.when(ok, long),
        "raw_binding": F.when(ok, long_name),
        "reverse_q": F.when(ok, F.least(lent, F.col("buyers"))),
        "reverse_binding": F.when(ok, F.when(F.col("buyers") < lent, "noisy_buyer_demand").otherwise(lent_name)),
    })


def booked(d: DataFrame, cfg: C.CapacityConfig) -> DataFrame:
    """sized() with the capacity of the trade taken: for both prefixes its size, money, expected and realised result with and without its own vote, what binds, and who
    is on the other side; and for the sizes' optimum also the names without a prefix."""
    enter, reverse = F.col("signal") == "ENTER", F.col("signal") == "REVERSE"
    none = F.lit(None).cast("double")
    pick = lambda long, short: F.when(enter, long).when(reverse, short)
    found, lent = F.col("max_q").isNotNull(), F.col("reverse_q") > 0
    raw_q, raw_name = pick(F.col("raw_q"), F.col("reverse_q")), pick(F.col("raw_binding"), F.col("reverse_binding"))
    status = F.when(
        enter, F.when(F.col("flow_status") != "ok", F.col("flow_status")).when(found, "ok").when(F.col("raw_q") > 0, "zero_capacity_after_self_impact").otherwise("ok")
    ).when(reverse, F.col("flow_status")).otherwise("not_evaluated")
    lender = C.allocate(F.col("lenders"), F.col("reverse_q"))
    d = d.withColumns({"_lender": lender, "_raw_q": raw_q, "_raw_name": raw_name}).withColumn("_shift", F.col("reverse_q") * (F.col("noisy_cash") - F.col("_lender.cash_prob")))
    f, own = F.col("f_cash"), F.when(F.col("elect") == "CASH", 1.0).otherwise(0.0)
    out = {
        "capacity_status": status,
        "capacity_flow_model": pick(F.lit("long_target_buy_from_noisy_then_ev_sensitive_then_passive"), F.lit("short_target_borrow_from_inactive_sell_to_noisy_buyers")),
        "capacity_raw_max_binding": F.col("_raw_name"), "capacity_raw_max_q": F.col("_raw_q"), "capacity_raw_max_shares": F.col("_raw_q") * F.col("shares"), "capacity_raw_max_notional": F.col("_raw_q") * F.col("shares") * F.col("entry"),
        "capacity_own_cash_prob": F.when(enter, own), "capacity_lender_cash_prob": F.when(reverse, F.col("_lender.cash_prob")), "capacity_buyer_cash_prob": F.when(reverse, F.col("noisy_cash")),
        "capacity_sell_rate": pick(C.sell_rate(F.col("long_mean"), cfg), C.sell_rate(F.col("reverse_mean"), cfg)), "capacity_impact_in_payoff": enter,
    }
    max_name = F.when(F.col("max_q") < F.col("raw_q") * (1 - 1e-6), F.concat(F.lit("self_impact_"), F.coalesce("fail_reason", F.lit("gate")))).otherwise(F.col("raw_binding"))
    names = {"max": max_name, "optimal": F.when(F.abs(F.col("optimal_q") - F.col("max_q")) < 1e-12, max_name).otherwise("profit_optimal_before_max")}
    for p in PREFIXES:
        q = pick(F.col(f"{p}_q"), F.when(lent, F.col("reverse_q")))
        mean = pick(F.col(f"{p}_mean"), F.when(lent, F.col("reverse_mean")))
        moved = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), f + F.col(f"{p}_q") * (own - F.col(f"{p}_seller_cash_prob"))))
        got = P.prorate(moved, F.col("pi_cash"), F.col("cash"), F.col("stock"))
        after = (F.when(F.col("elect") == "CASH", got["cash_holder"]).otherwise(got["stock_holder"]) - F.col("entry")) / F.col("entry")
        notional = q * F.col("shares") * F.col("entry")
        ended = F.when(F.col("outcome") == "terminated", F.col("terminated_return")).when(F.col("outcome") == "withdrawn", F.col("withdrawn_return"))
        base = pick(F.coalesce(ended, F.when(f.isNotNull(), F.col("long_realized"))), F.col("reverse_realized"))
        impacted = pick(F.coalesce(ended, F.when(f.isNotNull() & F.col(f"{p}_q").isNotNull(), after)), F.col("reverse_realized"))
        long_mix = C.allocate(F.col("pools"), F.col(f"{p}_q"))["source_mix"]
        c = f"capacity_{p}"
        out |= {
            f"{c}_binding": pick(F.when(found, names[p]), F.when(lent, F.col("reverse_binding"))),
            f"{c}_source_mix": pick(F.when(found, long_mix), F.when(lent, F.col("_lender.source_mix"))),
            f"{c}_seller_cash_prob": F.when(enter, F.col(f"{p}_seller_cash_prob")), f"{c}_own_cash_prob": F.when(enter & found, own),
            f"{c}_lender_cash_prob": F.when(reverse & lent, F.col("_lender.cash_prob")), f"{c}_buyer_cash_prob": F.when(reverse & lent, F.col("noisy_cash")),
            f"{c}_q": q, f"{c}_shares": q * F.col("shares"), f"{c}_notional": notional,
            f"{c}_e_return": mean, f"{c}_p05": pick(F.col(f"{p}_p05"), F.when(lent, F.col("reverse_p05"))), f"{c}_loss_probability": pick(F.col(f"{p}_loss_probability"), F.when(lent, F.col("reverse_loss_probability"))),
            f"{c}_expected_pnl": notional * mean,
            f"{c}_demand_shift": pick(F.col(f"{p}_shift"), F.when(lent, F.col("_shift"))),
            f"{c}_impacted_demand": pick(F.col(f"{p}_impacted_demand"), F.when(lent, F.col("demand_mean") + F.col("_shift"))),
            f"{c}_baseline_realized_return": base, f"{c}_baseline_realized_pnl": notional * base,
            f"{c}_self_impact_realized_return": impacted, f"{c}_self_impact_realized_pnl": notional * impacted,
        }
    for x in ("binding", "source_mix", "shares", "notional", "q", "demand_shift", "impacted_demand", "baseline_realized_return", "baseline_realized_pnl", "self_impact_realized_return", "self_impact_realized_pnl"):
        out[f"capacity_{x}"] = out[f"capacity_optimal_{x}"]
    out["capacity_binding"] = F.when(enter & (F.col("raw_q") > 0) & ~found, F.coalesce("fail_reason", F.lit("self_impact_gate"))).otherwise(out["capacity_optimal_binding"])
    for x in ("e_return", "p05", "loss_probability"):
        out[f"capacity_adjusted_{x}"] = out[f"capacity_optimal_{x}"]
    out["capacity_adjusted_realized_return"] = out["capacity_optimal_self_impact_realized_return"]
    out["capacity_alpha_decay"] = pick(F.col("long_mean") - F.col("optimal_mean"), F.when(lent, F.lit(0.0)))
    proved = enter & (F.col("raw_q") > 0)
    out["self_impact_can_eliminate"] = F.coalesce(proved & F.col("break_even").isNotNull(), F.lit(False))
    out["self_impact_break_even_q"] = F.when(proved, F.col("break_even")).otherwise(none)
    out["self_impact_note"] = F.when(
        proved, F.when(F.col("break_even").isNotNull(), F.concat(F.lit("pure_noisy_counterparty_self_impact_hits_"), F.col("proof_reason"))).otherwise("not_within_100pct_target_shares_under_current_terms_and_gates")
    ).when(reverse & lent, "not_possible_for_reverse_under_fixed_pool_passive_blended_settlement")
    return d.withColumns(out).drop("_lender", "_shift", "_raw_q", "_raw_name")
