"""Best matches of names in a register by the ratio of their sets of words, over candidates that share a rare word or a rare piece of one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import company_name
from .cuts import cut
from .identity import LEAST_SCORE


def longest_common(a: str, b: str) -> int:
    """The length of the longest common subsequence, all of a's places in the bits of one number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rest = full
    for c in b:
        hit = rest & masks.get(c, 0)
        rest = (rest + hit | rest - hit) & full
    return len(a) - rest.bit_count()


def set_ratio(a: str, b: str) -> float:
    """Of two normalised names, 0 to 100: what their sorted words have in common, or with what one of them adds to that, whichever is more alike; 100 if one's words are all in the
    other's. Alike is twice the common subsequence over both lengths."""
    wa, wb = set(a.split()), set(b.split())
    if not wa or not wb:
        return 0.0
    both, only_a, only_b = " ".join(sorted(wa & wb)), " ".join(sorted(wa - wb)), " ".join(sorted(wb - wa))
    if both and (not only_a or not only_b):
        return 100.0
    n, gap = len(both), bool(both)
    whole_a, whole_b = n + gap + len(only_a), n + gap + len(only_b)
    apart = len(only_a) + len(only_b) - 2 * longest_common(only_a, only_b)
    found = 1 - apart / (whole_a + whole_b)
    if both:
        found = max(found, 1 - (gap + len(only_a)) / (n + whole_a), 1 - (gap + len(only_b)) / (n + whole_b))
    return 100.0 * found


def _words(side: DataFrame, q: int) -> DataFrame:
    """side (id, norm) with its distinct words and their pieces: q characters at a time of each word between marks of its ends."""
    marked = F.transform("words", lambda w: F.concat(F.lit("^"), w, F.lit("$")))
    pieces = F.flatten(F.transform(marked, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - (q - 1))), lambda i: F.substr(w, i, F.lit(q)))))
    return side.withColumn("words", F.array_distinct(F.split("norm", " "))).withColumn("pieces", F.array_distinct(pieces))


def _rarest_first(side: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """(id, norm, ranked): the values of a column, those in the fewest names first."""
    each = side.select("id", "norm", F.explode(column).alias("value")).join(counts, "value")
    return each.groupBy("id", "norm").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("ranked"))


def _leading(ranked: Column, share: float) -> Column:
    """The rarest words whose lengths, each with a space, add up to more than a share of all: what has none of them in common has less than the rest of the name in common."""
    weigh = lambda x: F.length(x["value"]) + 1
    total = F.aggregate(ranked, F.lit(0), lambda a, x: a + weigh(x))
    step = lambda a, x: F.struct((a["w"] + weigh(x)).alias("w"), F.when(a["w"] <= total * share, F.concat(a["taken"], F.array(x["value"]))).otherwise(a["taken"]).alias("taken"))
    return F.aggregate(ranked, F.struct(F.lit(0).alias("w"), F.array().cast("array<string>").alias("taken")), step)["taken"]


def _sides(queries: DataFrame, register: DataFrame, least: float, pieces: int, q: int) -> tuple[list[tuple[DataFrame, DataFrame]], tuple[DataFrame, DataFrame]]:
    """Both sides (id, norm, key) of the two joins on words and of the one on pieces."""
    a, b = cut(_words(queries, q)), cut(_words(register, q))
    both = a.select("words", "pieces").unionByName(b.select("words", "pieces"))
    ranked = {}
    for column in ("words", "pieces"):
        counts = cut(both.select(F.explode(column).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n")))
        ranked[column] = [_rarest_first(side, column, counts) for side in (a, b)]
    t = least / 100
    # what one name adds is at most this share of what both have, so of the name's own length
    slack = 2 * (1 - t) / t
    keys = [r.select("id", "norm", F.explode(_leading(F.col("ranked"), slack / (1 + slack))).alias("key")) for r in ranked["words"]]
    every = [s.select("id", "norm", F.explode("words").alias("key")) for s in (a, b)]
    rare = [r.select("id", "norm", F.explode(F.slice(F.transform("ranked", lambda x: x["value"]), 1, pieces)).alias("key")) for r in ranked["pieces"]]
    return [(keys[0], every[1]), (every[0], keys[1])], (rare[0], rare[1])


def _paired(x: DataFrame, y: DataFrame) -> DataFrame:
    return x.join(y.withColumnsRenamed({"id": "match", "norm": "match_norm"}), "key").select(F.col("id").alias("query"), F.col("norm").alias("query_norm"), "match", "match_norm")


def candidates(queries: DataFrame, register: DataFrame, least: float = LEAST_SCORE, pieces: int = 10, q: int = 4) -> DataFrame:
    """(query, query_norm, match, match_norm): pairs that may reach `least`, of queries and register (id, norm), distinct names both.

    Names whose common words alone reach it, beside what one name adds, have one of the rarest words of that name in common (a prefix of its words by rarity; the bound is
    exact). Names that reach it by the letters of unlike words are looked for by their `pieces` rarest pieces of q letters; that finds nearly all. Words and pieces
    that many names have enter only where a name has none rarer.
    """
    words, rare = _sides(queries, register, least, pieces, q)
    pairs = _paired(*words[0]).unionByName(_paired(*words[1])).unionByName(_paired(*rare))
    return pairs.dropDuplicates(["query", "match"])


def letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each name's distinct words, with a space between: how often it has each of 32 classes of characters, and its length."""
    bags, sizes = np.zeros((len(names), 32), np.int16), np.zeros(len(names), np.int64)
    for i, name in enumerate(names):
        codes = np.frombuffer(" ".join(set(name.split())).encode("utf-32-le"), np.uint32)
        bags[i], sizes[i] = np.bincount(codes & 31, minlength=32), len(codes)
    return bags, sizes


def alike_letters(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float, cells: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Places (in a, in b) of names that may reach `least` by what their sequences have in common: no more than the characters that both have."""
    step = max(1, cells // max(1, len(b[1])))
    for k in range(0, len(a[1]), step):
        own, size = a[0][k : k + step], a[1][k : k + step]
        common = np.zeros((len(size), len(b[1])), np.int16)
        for c in range(32):
            common += np.minimum(own[:, c, None], b[0][:, c])
        i, j = np.nonzero(200.0 * common >= least * (size[:, None] + b[1]) - 1e-6)
        yield from zip((i + k).tolist(), j.tolist(), strict=True)


def _by_words(a: str, b: str) -> float:
    """set_ratio() without what unlike words have in common."""
    wa, wb = set(a.split()), set(b.split())
    both = wa & wb
    if not both:
        return 0.0
    n, only_a, only_b = sum(map(len, both)) + len(both) - 1, *(sum(len(w) + 1 for w in x - both) for x in (wa, wb))
    return 100.0 * (1 - min(only_a / (2 * n + only_a), only_b / (2 * n + only_b)))


_SCORED = "query long, query_norm string, match long, match_norm string, score double"


def scored(pairs: DataFrame, least: float = 0.0) -> DataFrame:
    """candidates() with the score of each pair; of those that neither common words nor letters let reach `least` none."""

    def may_count(asked: pa.Array, known: pa.Array) -> np.ndarray:
        sides = [x.dictionary_encode() for x in (asked, known)]
        (i, j), (a, b) = [x.indices.to_numpy() for x in sides], [letters(x.dictionary.to_pylist()) for x in sides]
        may = 200.0 * np.minimum(a[0][i], b[0][j]).sum(axis=1) >= least * (a[1][i] + b[1][j]) - 1e-6
        rest = np.flatnonzero(~may)
        names = [x.dictionary.to_pylist() for x in sides]
        may[rest] = [_by_words(names[0][p], names[1][r]) >= least - 1e-6 for p, r in zip(i[rest].tolist(), j[rest].tolist(), strict=True)]
        return may

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if least > 0 and batch.num_rows:
                batch = batch.filter(pa.array(may_count(batch.column("query_norm"), batch.column("match_norm"))))
            made = [set_ratio(x, y) for x, y in zip(batch.column("query_norm").to_pylist(), batch.column("match_norm").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.float64())], names=[*batch.schema.names, "score"])

    return pairs.mapInArrow(run, _SCORED)


def near_by_pieces(x: DataFrame, y: DataFrame, least: float, cells: int = 1 << 21) -> DataFrame:
    """Pairs of x and y (id, norm, key) of one key, with scores of at least `least`, but for those that only common words make alike. Names meet inside the task that has
    the key, and only those that have the letters for it are compared, so no pair is written that does not count. A key of more than `cells` pairs is dealt in parts of x."""
    n = x.groupBy("key").agg(F.count(F.lit(1)).alias("_x")).join(y.groupBy("key").agg(F.count(F.lit(1)).alias("_y")), "key")
    pairs = F.col("_x") * F.col("_y")
    parts = cut(n.select("key", F.least("_x", F.ceil(pairs / cells)).cast("int").alias("_parts"), pairs.alias("_pairs")))
    # few bytes but much work, so by a count that grows with the pairs
    tasks = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(parts.agg(F.sum("_pairs")).first()[0] or 0) // cells))
    mine = x.join(parts, "key").select("key", F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("part"), F.lit(0).alias("side"), "id", "norm")
    other = y.join(parts, "key").select("key", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("part"), F.lit(1).alias("side"), "id", "norm")

    def compared(sides: tuple[list, list]) -> list[tuple]:
        (own, others), found = sides, []
        if own and others:
            for i, j in alike_letters(letters([v for _, v in own]), letters([v for _, v in others]), least):
                score = set_ratio(own[i][1], others[j][1])
                if score >= least:
                    found.append((*own[i], *others[j], score))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.float64())
        names = ["query", "query_norm", "match", "match_norm", "score"]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for batch in batches:
            for key, part, side, id_, norm in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "side", "id", "norm")), strict=True):
                if (key, part) != at:
                    if found := compared(sides):
                        yield table(found)
                    at, sides = (key, part), ([], [])
                sides[side].append((id_, norm))
        if found := compared(sides):
            yield table(found)

    return mine.unionByName(other).repartition(tasks, "key", "part").sortWithinPartitions("key", "part", "side", "id").mapInArrow(run, _SCORED)


def near_matches(queries: DataFrame, register: DataFrame, least: float, pieces: int, q: int) -> DataFrame:
    """(query_norm, score, match, match_norm): for each of the queries (id, norm) that has one the best of candidates(). Pairs are scored where they meet, and each task
    hands on its best for a query."""
    words, rare = _sides(queries, register, least, pieces, q)
    near = scored(_paired(*words[0]).unionByName(_paired(*words[1])), least).where(F.col("score") >= least).unionByName(near_by_pieces(*rare, least))
    first = F.max(F.struct(F.round("score", 9).alias("rounded"), (-F.col("match")).alias("order"), "score", "match", "match_norm")).alias("best")
    return near.groupBy("query", "query_norm").agg(first).select("query_norm", "best.score", "best.match", "best.match_norm")


def best_matches(queries: DataFrame, register: DataFrame, least: float = LEAST_SCORE, pieces: int = 10, q: int = 4) -> DataFrame:
    """(query_id, query_norm, matched, score, match_id, match_norm, method) for each query (id, name): the register's (id, name) entry of the same normalised name, else the one with
    the highest score of at least `least`, of equal ones the smallest id; else none. Equal names are matched once. A name without words matches nothing."""
    norm = lambda d: d.select("id", company_name(F.col("name")).alias("norm"))
    asked = cut(norm(queries))
    names = asked.where("norm <> ''").groupBy("norm").agg(F.min("id").alias("id"))
    known = cut(norm(register).where("norm <> ''").groupBy("norm").agg(F.min("id").alias("id")))
    exact = names.join(known.select("norm", F.col("id").alias("match")), "norm")
    rest = names.join(known.select("norm"), "norm", "left_anti")
    near = near_matches(rest, known, least, pieces, q)
    found = exact.select(F.col("norm").alias("query_norm"), F.lit(100.0).alias("score"), F.col("match").alias("match_id"), F.col("norm").alias("match_norm"), F.lit("exact_norm").alias("method"))
    found = found.unionByName(near.select("query_norm", "score", F.col("match").alias("match_id"), "match_norm", F.lit("token_set").alias("method")))
    joined = asked.select(F.col("id").alias("query_id"), F.col("norm").alias("query_norm")).join(found, "query_norm", "left")
    return joined.select("query_id", "query_norm", F.col("match_id").isNotNull().alias("matched"), "score", "match_id", "match_norm", "method")
