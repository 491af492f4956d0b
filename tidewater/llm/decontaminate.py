"""Benchmark decontamination: exact hits of pieces of each item, then Myers' bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import portions


def normalised(text: str | None) -> str:
    """Lower case, one space for each run of white space."""
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, rate: float) -> int:
    """Edits allowed in an item of n characters."""
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces of about equal length with their places: with so many edits at most, one of them stays whole."""
    k = errors + 1
    cuts = [len(item) * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(pattern: str, text: str, most: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern to any substring of text, the first such end; None if over `most` edits."""
    m = len(pattern)
    if masks is None:
        masks = symbol_masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = (m, 0)
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (full & ~(xh | plus))
        mh = plus & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best[0]:
                best = (score, j)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (full & ~(xv | ph))
        minus = ph & xv
    return best if best[0] <= most else None


def at_edge(text: str, k: int) -> bool:
    """Whether no word of letters and digits goes on over place k. Scripts from U+2E80 on are written without spaces: each letter is a word."""
    return not (0 < k < len(text) and text[k - 1].isalnum() and text[k].isalnum() and max(text[k - 1], text[k]) < "\u2e80")


def edged(pattern: str, text: str, a: int, b: int, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best match of the whole pattern to whole words of text[a:b], the first such end; None if over `most` edits."""
    n = b - a
    codes = np.frombuffer(text[a:b].encode("utf-32-le", "surrogatepass"), np.uint32)
    step = np.arange(n + 1)
    edge = np.array([at_edge(text, k) for k in range(a, b + 1)])
    far = len(pattern) + n + 1
    row = np.where(edge, 0, far)
    for c in pattern:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (codes != ord(c)))
        row = np.minimum.accumulate(new - step) + step
    row = np.where(edge, row, far)
    k = int(row.argmin())
    return (int(row[k]), a + k) if row[k] <= most else None


def symbol_masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Finds items, within their budgets of edits, in normalised texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.masks: dict[int, dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        for k, (_, text, errors) in enumerate(self.items):
            for at, piece in pieces(text, errors):
                if piece not in self.automaton:
                    self.automaton.add_word(piece, (len(piece), []))
                self.automaton.get(piece)[1].append((k, at))
        if len(self.automaton):
            self.automaton.make_automaton()

    def find(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(item, distance, end) for each item that the text holds, with its best match."""
        if not len(self.automaton):
            return
        places: dict[int, set[int]] = {}
        for end, (n, where) in self.automaton.iter(text):
            for k, at in where:
                places.setdefault(k, set()).add(end + 1 - n - at)
        for k, starts in places.items():
            item, pattern, errors = self.items[k]
            best = None
            # starts near each other lie in one window
            lo = hi = None
            for s in [*sorted(starts), None]:
                if lo is not None and (s is None or s > hi + 2 * errors + 1):
                    a, b = max(0, lo - errors), hi + len(pattern) + errors
                    exact = text.find(pattern, a, b)
                    while exact >= 0 and not (at_edge(text, exact) and at_edge(text, exact + len(pattern))):
                        exact = text.find(pattern, exact + 1, b)
                    if exact >= 0:
                        best = (0, exact + len(pattern))
                        break
                    if errors:
                        if k not in self.masks:
                            self.masks[k] = symbol_masks(pattern)
                        # Myers' distance is no more than that to whole words, which only its hits are measured by
                        got = myers(pattern, text[a:b], errors, self.masks[k]) and edged(pattern, text, a, min(b, len(text)), errors)
                        if got and (best is None or got[0] < best[0]):
                            best = got
                    lo = None
                if s is not None:
                    lo, hi = (s, s) if lo is None else (lo, s)
            if best:
                yield item, best[0], best[1]


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size, each read once through the driver."""
    rows, size = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        text = normalised(row.text)
        if not text:
            continue
        rows.append((row.item_id, text))
        size += len(text)
        if size >= block_chars:
            yield rows
            rows, size = [], 0
    yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 2 << 20) -> DataFrame:
    """(doc_id, item_id, distance, at): the documents that hold a benchmark item with at most rate * (its length) edits, wherever it stands.

    Whole texts are searched, in lower case and with single spaces; a match begins and ends where words do. `at` is the code point there at which
    the best match ends (the first of equal ones). The benchmark, a stated set of queries, is read in blocks of block_chars characters (an
    automaton of about 50 bytes for each in every worker); one block at a time goes to the tasks, documents are not shuffled.
    Nulls: null or blank texts and items match nothing; a null doc_id or item_id is passed on. Repeated rows are reported each; repeated items
    too. Other columns are left out. Empty tables: no rows. An item shorter than 1 / rate characters is matched exactly.
    """
    slim = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null")
    out = None
    for block in _blocks(benchmark, block_chars):

        def find(batches, block=block):
            matcher = Matcher(block, rate)
            for batch, texts in (x for whole in batches for x in portions(whole, most=4 << 20)):
                found = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                    found += [(doc_id, *x) for x in matcher.find(normalised(text.decode("utf-8", "replace")))]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "distance", "at"])

        part = slim.mapInArrow(find, "doc_id long, item_id long, distance long, at long")
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = 0.05, block_chars: int = 2 << 20) -> DataFrame:
    """docs without the rows that hold a benchmark item. All columns pass through; see contaminated for what matches."""
    out = docs
    for block in _blocks(benchmark, block_chars):

        def clean(batches, block=block):
            matcher = Matcher(block, rate)
            for batch, texts in (x for whole in batches for x in portions(whole, most=4 << 20)):
                keep = [next(matcher.find(normalised(text.decode("utf-8", "replace"))), None) is None for text in texts]
                yield batch.filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def op8_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
