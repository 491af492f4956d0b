"""Importance resampling toward a target: word tries count hashed features and score texts by the gains at their nodes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, numbered, portions, stored

#: Bytes as words see them: A-Z in lower case, digits, a-z and all bytes of other characters as they are, the rest a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_BYTES).split()


class WordTrie:
    """Runs of up to `longest` words as paths from the root, node 0.

    A node holds how often its run was met, and the CRC-32 of the run's bytes (its words joined by one space): the state from which the check sums of
    longer runs go on, so that no run is ever put together. With `gains`, by bucket, a node holds its bucket's gain too.
    """

    def __init__(self, longest: int, buckets: int, gains: np.ndarray | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[bytes, int]] = [{}]
        self.crc, self.gain, self.count = [0], [0], np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.crc)

    def _grow(self, at: int, word: bytes) -> int:
        node = len(self.crc)
        crc = zlib.crc32(b" " + word, self.crc[at]) if at else zlib.crc32(word)
        self.children[at][word] = node
        self.children.append({} if self.longest > 1 else self.children[0])
        self.crc.append(crc)
        if self.gains is not None:
            self.gain.append(int(self.gains[crc % self.buckets]))
        return node

    def walk(self, text: list[bytes]) -> list[int]:
        """The nodes of all runs of a text."""
        children, grow = self.children, self._grow
        root = children[0].get
        at = [root(w) or grow(0, w) for w in text]
        out = at
        for k in range(1, self.longest):
            at = [children[a].get(w) or grow(a, w) for a, w in zip(at, text[k:], strict=False)]
            out = out + at
        return out

    def add(self, nodes: np.ndarray) -> None:
        met = np.bincount(nodes, minlength=len(self))
        met[: len(self.count)] += self.count
        self.count = met

    def totals(self) -> np.ndarray:
        """How many features fell into each bucket since the last clear()."""
        return np.bincount(np.array(self.crc[1:], np.int64) % self.buckets, self.count[1:], self.buckets).astype(np.int64)


def bucket_totals(docs: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text", most_nodes: int = 1 << 18) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket. Each task keeps a trie of its own, which it empties into its totals beyond
    most_nodes nodes, and returns a row for each bucket that it met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, total = WordTrie(longest, buckets), np.zeros(buckets, np.int64)
        for _, texts in (x for whole in batches for x in portions(whole, text)):
            nodes: list[int] = []
            for t in texts:
                nodes += trie.walk(words(t))
            trie.add(np.array(nodes, np.int64))
            if len(trie) > most_nodes:
                total += trie.totals()
                trie.clear()
        total += trie.totals()
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], names=["bucket", "n"])

    return docs.select(text).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> np.ndarray:
    """Each bucket's gain: a thousand times the logarithm of its share in the target over its share in docs, one added to every count, rounded down.

    At most `buckets` rows of each table come to the driver, whatever their size.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for into, table in ((s, docs), (t, target)):
        for row in bucket_totals(table, longest, buckets, text).collect():
            into[row.bucket] = row.n
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighted(docs: DataFrame, gains: np.ndarray, longest: int = 1, text: str = "text", most_nodes: int = 1 << 18) -> DataFrame:
    """docs without the text, with n_words, n_features and weight, the mean gain of a text's features rounded down (none: 0)."""
    others = docs.drop(text, "n_words", "n_features", "weight")
    names = others.columns
    added = ("n_words", "n_features", "weight")
    schema = T.StructType([*others.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    buckets = len(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = WordTrie(longest, buckets, gains)
        for batch, texts in (x for whole in batches for x in portions(whole, text)):
            nodes: list[int] = []
            sizes, ends = [], [0]
            for t in texts:
                found = words(t)
                nodes += trie.walk(found)
                sizes.append(len(found))
                ends.append(len(nodes))
            upto = np.concatenate([[0], np.cumsum(np.array(trie.gain, np.int64)[nodes])]) if nodes else np.zeros(1, np.int64)
            end = np.array(ends)
            n = np.diff(end)
            weight = np.where(n > 0, np.diff(upto[end]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=[*names, *added])
            if len(trie) > most_nodes:
                trie.clear()

    return docs.select(*names, text).mapInArrow(weigh, schema)


def drawn_noise(seed: int, doc_id: Column) -> Column:
    """A thousand times a Gumbel draw, rounded down, from the first 32 bits of a hash of `seed:doc_id` (null id: nothing after the colon)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    longest: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    text: str = "text",
) -> DataFrame:
    """Draws floor(percent * N / 100) of the N documents of least_words words or more, without replacement, likelier the more alike to the target they are.

    docs: doc_id, text and any other columns; target: text. Returns every row of docs without its text, with n_words, n_features, weight, score (weight
    plus a Gumbel draw by doc_id, so that the highest scores are a weighted sample) and rank, from 1 in descending score, ties to the smaller doc_id; rows
    that are not drawn have none. Rows with that text join by doc_id.

    Scores are whole numbers in a range of at most some 200,000 (logarithms of counts), whatever the corpus, so their histogram is small: it tells the score
    above which rows are put in order, by range, in as many tasks as the shuffle has.

    Nulls: a null text has no words, a null doc_id draws as the empty text and comes last among ties. Empty texts have weight 0. Repeated rows share a
    score and take ranks one by one. Columns named like the added ones are replaced. Empty docs: no rows; empty target: gains from added counts alone.
    """
    added = ("n_words", "n_features", "weight", "score", "rank")
    others = [c for c in docs.columns if c.lower() not in (*added, text.lower())]
    gains = bucket_gains(docs, target, longest, buckets, text)
    scored = stored(weighted(docs.select(*others, text), gains, longest, text).withColumn("score", F.col("weight") + drawn_noise(seed, F.col("doc_id"))), "scored")
    eligible = F.col("n_words") >= least_words
    histogram = sorted(((r.score, r.n) for r in scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted, seen, least = sum(n for _, n in histogram) * percent // 100, 0, None
    for score, n in histogram:
        if seen >= wanted:
            break
        seen, least = seen + n, score
    high = eligible & (F.col("score") >= F.lit(least).cast("long")) if least is not None else F.lit(False)
    place = free_name(scored, "place")
    ranked = numbered(scored.where(high), [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], place)
    rank = F.when(F.col(place) < wanted, F.col(place) + 1)
    drawn = ranked.select(*scored.columns, rank.alias("rank"))
    return drawn.unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def op11_word_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


OP11_SQL = r"""
WITH RECURSIVE
tab(n, c, k) AS (
  SELECT n, n, 0 FROM range(256) t(n)
  UNION ALL
  SELECT n, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM tab WHERE k < 8),
crcs AS (SELECT list(c ORDER BY n) AS step FROM tab WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, words(text) AS w FROM documents),
b AS (SELECT words(text) AS w FROM benchmark),
sw AS (SELECT r, unnest(w) AS word FROM d),
tw AS (SELECT unnest(w) AS word FROM b),
sn AS (SELECT word, count(*) AS n FROM sw GROUP BY word),
tn AS (SELECT word, count(*) AS n FROM tw GROUP BY word),
vocabulary AS (SELECT word, hex(encode(word)) AS digits FROM (SELECT word FROM sn UNION SELECT word FROM tn)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(digits) // 2), lambda i: CAST('0x' || substr(digits, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, x: xor(c // 256, step[xor(c, x) % 256 + 1])), 4294967295::BIGINT) % 10000 AS bucket
  FROM vocabulary, crcs),
s AS (SELECT bucket, sum(n) AS n FROM sn JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS n FROM tn JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT CAST(coalesce((SELECT sum(n) FROM s), 0) AS DOUBLE) AS s_all, CAST(coalesce((SELECT sum(n) FROM t), 0) AS DOUBLE) AS t_all),
gains AS (
  SELECT g.bucket, CAST(floor(1000e0 * ln((coalesce(t.n, 0) + 1e0) * (s_all + 10000e0) / ((coalesce(s.n, 0) + 1e0) * (t_all + 10000e0)))) AS BIGINT) AS gain
  FROM range(10000) g(bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), totals),
summed AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM sw JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((gain - ((gain % n) + n) % n) // n, 0) AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM d LEFT JOIN summed USING (r)),
scored AS (SELECT r, doc_id, n_features, weight, weight + CAST(floor(-1000e0 * ln(-ln((h + 5e-1) / 4294967296e0))) AS BIGINT) AS score FROM weighed),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN ranked USING (r)
""".replace("words(text)", r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])")
