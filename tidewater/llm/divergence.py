"""How far sources of one language diverge in their use of terms, over integer-coded terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import numbered, portions, stored

#: Bytes as terms see them: A-Z in lower case, a-z and all bytes of other characters as they are, the rest a blank.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Shares are in billionths.
SCALE = 1_000_000_000


def encoded(terms: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """The distinct terms in the order of their bytes, and each term's place among them."""
    coded = pa.array(terms, pa.binary()).dictionary_encode()
    order = pa.compute.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)).to_pylist(), place[coded.indices.to_numpy()]


def group_terms(docs: DataFrame, portion: int = 8 << 20) -> DataFrame:
    """(lang, source, term, n, df): how often each term occurs in the group's texts, and in how many of them. Terms are UTF-8 bytes.

    docs has lang, source and text without nulls. A task codes the terms of some texts at a time and counts by code, so that a term leaves it once for
    each group that those texts have; sums over tasks are Spark's.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in (x for whole in batches for x in portions(whole, "text", most=portion)):
            terms: list[bytes] = []
            sizes = []
            for t in texts:
                found = t.translate(_BYTES).split()
                terms += found
                sizes.append(len(found))
            if not terms:
                continue
            kept, ids = encoded(terms)
            lang, source = (batch.column(c).cast(pa.binary()).dictionary_encode() for c in ("lang", "source"))
            pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            pairs, group = np.unique(pair, return_inverse=True)
            v = len(kept)
            in_doc, times = np.unique(np.repeat(np.arange(len(texts)), sizes) * v + ids, return_counts=True)
            cell, at = np.unique(group[in_doc // v] * v + in_doc % v, return_inverse=True)
            n = np.bincount(at, weights=times).astype(np.int64)
            df = np.bincount(at)
            of = pairs[cell // v]
            columns = (lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), pa.array(kept, pa.binary()).take(pa.array(cell % v)))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n), pa.array(df)], names=["lang", "source", "term", "n", "df"])

    made = docs.select("lang", "source", "text").mapInArrow(count, "lang binary, source binary, term binary, n long, df long")
    return made.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def shares(count: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)), exact in 64 bits: a long division with three digits of a thousand."""
    of = total + 2 * kept
    left, out = count + 2, np.zeros(np.broadcast(count, of).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // of
        left = left % of
    return 1 + out


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _objects(values: list[bytes]) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _audit(key, cells: pa.Table, groups: pa.Table, ranks: int, chunk: int) -> pa.Table:
    """One chunk of a language's kept terms, two blocks of its sources: sums for each pair of sources, and each source's best terms of the chunk."""
    lang, nth, one, two = (k.as_py() for k in key)
    sources = sorted(zip(groups["source"].to_pylist(), groups["block"].to_pylist(), groups["total"].to_pylist(), strict=True))
    of_lang, v = groups["of_lang"][0].as_py(), groups["kept"][0].as_py()
    block = np.array([b for _, b, _ in sources])
    total = np.array([t for _, _, t in sources], np.int64)[:, None]
    out: list[tuple] = []
    # the chunk's kept terms, sorted by their bytes, and each cell's id among them
    kept = _objects(sorted(set(cells["term"].to_pylist())))
    ids = np.searchsorted(kept, _objects(cells["term"].to_pylist()))
    row = np.searchsorted(_objects([s for s, _, _ in sources]), _objects(cells["source"].to_pylist()))
    # a cell comes once, so these are counts and no sums of them
    dense = np.bincount(row * len(kept) + ids, cells["n"].to_numpy(), len(sources) * len(kept)).astype(np.int64).reshape(len(sources), len(kept))
    whole = np.zeros(len(kept), np.int64)
    whole[ids] = cells["in_lang"].to_numpy()
    p = shares(dense, total, v) if v else dense
    # terms of the chunk that none of these sources has
    absent, rare = max(0, min(chunk, v - nth * chunk)) - len(kept), shares(np.zeros_like(total), total, v)[:, 0] if v else total[:, 0]
    for i, (name, b, _) in enumerate(sources):
        against = [j for j in range(len(sources)) if (block[j] == two and b == one if one != two else j > i)]
        if against:
            sums = (gaps(p[i], p[against]).sum(axis=1) + (absent * gaps(rare[i], rare[against]) if absent else 0)).tolist()
            for j, value in zip(against, sums, strict=True):
                out += [(name, "pair", sources[j][0], value), (sources[j][0], "pair", name, value)]
    if one == two and len(kept):
        q = shares(whole, of_lang, v)
        for i, (name, _, _) in enumerate(sources):
            over = np.flatnonzero((dense[i] > 0) & (p[i] > q))
            value = gaps(p[i, over], q[over])
            # ids are in the order of bytes, so a stable sort by value settles ties
            for k in np.argsort(-value, kind="stable")[:ranks]:
                out.append((name, "term", kept[over[k]], int(value[k])))
    columns = list(zip(*out, strict=True)) or [[], [], [], []]
    return pa.table([pa.array([lang] * len(out), pa.binary()), pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], names=["lang", "source", "part", "item", "value"])


def source_divergence(docs: DataFrame, least_documents: int = 10, ranks: int = 10, chunk: int = 4096, block: int = 128) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's use of terms is from that of every other source of its language (part `pair`, all
    ranks), and the terms that it uses more than the language does (part `term`, the first `ranks`).

    docs: text, lang, source and any others. A language keeps the terms in at least least_documents of its documents. Its kept terms are put in the order of
    their bytes by ranges, numbered, and cut into chunks of `chunk`; a task takes one chunk and up to two blocks of about `block` sources as dense
    arrays over the chunk's ids, so no task holds a vocabulary, all sources of a language, or a text's worth of terms for more than a slice of its input. All
    sums are of 64-bit whole numbers.

    Nulls in text, lang and source count as ''. Empty texts have no terms; a group without terms is compared like others. Ties go by the item's bytes.
    Repeated rows count as documents each. A language without kept terms gives pairs of value 0 and no terms; one source alone gives no pairs. Empty table: no rows.
    """
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = stored(group_terms(named), "terms")
    every = F.collect_list(F.struct("source", "n"))
    terms = stored(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("n").alias("in_lang"), every.alias("at")).where(F.col("df") >= least_documents).drop("df"), "kept")
    order = numbered(terms, [F.col("lang"), F.col("term")], "place")
    kept = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("of_lang"))
    totals = terms.select("lang", F.explode("at").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    pairs = named.select(F.col("lang").cast("binary").alias("lang"), F.col("source").cast("binary").alias("source")).distinct()
    zero = {"kept": F.coalesce("kept", F.lit(0)), "of_lang": F.coalesce("of_lang", F.lit(0)), "total": F.coalesce("total", F.lit(0))}
    groups = stored(pairs.join(kept, "lang", "left").join(totals, ["lang", "source"], "left").withColumns(zero), "groups")
    langs = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    first = order.groupBy("lang").agg(F.min("place").alias("first"))
    sizes = stored(langs.join(first, "lang", "left"), "langs").select("lang", "blocks", "first", F.greatest(F.lit(1), F.ceil(F.col("kept") / chunk)).cast("int").alias("chunks"))

    def blocked(rows: DataFrame) -> DataFrame:
        """rows (source, blocks) once for each pair of blocks that the source's block is in."""
        own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
        other = rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return other.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))

    cell = order.join(sizes.select("lang", "blocks", "first"), "lang").withColumn("chunk", F.floor((F.col("place") - F.col("first")) / chunk).cast("int")).withColumn("c", F.explode("at"))
    cells = blocked(cell.select("lang", "chunk", "term", "in_lang", "blocks", "c.source", "c.n")).select("lang", "chunk", "one", "two", "term", "in_lang", "source", "n")
    of_chunks = groups.join(sizes.select("lang", "blocks", "chunks"), "lang").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    sources = blocked(of_chunks).select("lang", "chunk", "one", "two", "source", "block", "total", "of_lang", "kept")
    by = ("lang", "chunk", "one", "two")

    def audit(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return _audit(key, left, right, ranks, chunk)

    parts = stored(cells.groupBy(*by).cogroup(sources.groupBy(*by)).applyInArrow(audit, "lang binary, source binary, part string, item binary, value long"), "divergence")
    whole = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item")))
    ranked = whole.withColumn("rank", place).where((F.col("part") == "pair") | (F.col("rank") <= ranks))
    return ranked.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source")], "part", F.col("item").cast("string").alias("item"), "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT r, lang, source,
    unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
k AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
t AS (SELECT lang, source, CAST(sum(n) AS HUGEINT) AS n FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    CAST(1 + 1000000000 * (CAST(coalesce(c.n, 0) AS HUGEINT) + 2) // (coalesce(t.n, 0) + 2 * l.v) AS BIGINT) AS p,
    CAST(1 + 1000000000 * (CAST(k.n AS HUGEINT) + 2) // (l.n + 2 * l.v) AS BIGINT) AS q
  FROM g JOIN l ON g.lang = l.lang JOIN k ON g.lang = k.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term LEFT JOIN t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sums.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM every)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
