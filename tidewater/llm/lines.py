"""Line deduplication by a line's frequency within its site; native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

_BLANKS = "\t\n\x0b\x0c\r "


def _key(line: Column) -> Column:
    """A 128-bit key of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 2) -> DataFrame:
    """(host, a, b): for each host, the keys of lines on more than `ratio` of its pages and on `least_pages` or more, as two arrays side by side.

    Each page counts a line once. Counts are summed before the shuffle, and a host has at most (its mean lines a page) / ratio such lines.
    """
    slim = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    lines = F.filter(F.array_distinct(F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)))), lambda x: x != "")
    pages = slim.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = slim.select("host", F.explode(F.transform(lines, _key)).alias("key")).groupBy("host", "key.a", "key.b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pages)
    return (
        counted.alias("c")
        .join(pages.alias("p"), F.col("c.host").eqNullSafe(F.col("p.host")))
        .where(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy(F.col("c.host").alias("host"))
        .agg(F.collect_list(F.struct("a", "b")).alias("keys"))
        .select("host", F.col("keys.a").alias("a"), F.col("keys.b").alias("b"))
    )


def _with_common(rows: DataFrame, common: DataFrame, host: str, broadcast_keys: int, salts: int) -> DataFrame:
    """rows (doc) with their host's lines. Up to broadcast_keys keys in all go to every task, so that texts are not shuffled; beyond that both sides
    are dealt by host and one of `salts` numbers, so that a host's texts meet in no one task."""
    common = stored(common, "boilerplate")
    keys = common.agg(F.coalesce(F.sum(F.size("a") + 1), F.lit(0))).first()[0]
    own = F.col("doc")[host]
    if keys <= broadcast_keys:
        return rows.join(F.broadcast(common), own.eqNullSafe(F.col("host")), "left")
    dealt = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("deal", F.pmod(F.xxhash64("doc"), F.lit(salts)).cast("int"))
    return salted.join(dealt, own.eqNullSafe(F.col("host")) & (F.col("deal") == F.col("salt")), "left")


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = 0.1, least_pages: int = 2, broadcast_keys: int = 100_000, salts: int = 64) -> DataFrame:
    """docs with the lines dropped that are on more than `ratio` of a host's pages; adds n_lines and n_dropped.

    Lines end at \\n and compare without white space at their ends. A line on one page of its host repeats nowhere, whatever share of a small host
    that page is, so least_pages is 2; with 1 the ratio alone decides, and hosts of fewer than 1 / ratio pages lose all lines.

    Nulls: null text stays null and has no lines; a null host is a host of its own. An empty text is one blank line; blank lines stay. Repeated rows
    count as pages each. Other columns pass through, whatever their names; columns named n_lines or n_dropped are replaced. Empty table: no rows.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    common = boilerplate_lines(docs, host, text, ratio, least_pages)
    # the row goes as one struct, so that its names clash with none here
    joined = _with_common(docs.select(F.struct(*others).alias("doc")), common, host, broadcast_keys, salts)

    def stays(line: Column) -> Column:
        trimmed = F.btrim(line, F.lit(_BLANKS))
        return ~(F.array_contains("a", F.xxhash64(trimmed)) & F.array_contains("b", F.xxhash64(F.lit(1), trimmed)))

    own = F.col("doc")[text]
    lines = F.split(own, "\n")
    # a page of a host without such lines keeps its text as it is
    cut = joined.select("doc", F.size(lines).alias("lines"), F.when(F.col("a").isNotNull(), F.filter(lines, stays)).alias("kept"))
    dropped = F.when(own.isNotNull() & F.col("kept").isNotNull(), F.col("lines") - F.size("kept")).otherwise(0).cast("long")
    left = F.when(dropped == 0, own).otherwise(F.array_join("kept", "\n"))
    columns = [(left if c == text else F.col("doc")[c]).alias(c) for c in others]
    return cut.select(*columns, F.when(own.isNotNull(), F.col("lines")).otherwise(0).cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def op9_line_frequency(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    kept = drop_boilerplate(docs)
    return kept.select("doc_id", "n_lines", "n_dropped", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


_TRIM = r"regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')"

LINES_CTES = r"""
pg AS (SELECT source, count(*) AS pages FROM {docs} GROUP BY source),
ln AS (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {trim}))) AS line FROM {docs} WHERE text IS NOT NULL),
fr AS (SELECT source, line, count(*) AS n FROM ln WHERE line <> '' GROUP BY source, line),
bp AS (SELECT fr.source, list(fr.line) AS common FROM fr JOIN pg ON fr.source IS NOT DISTINCT FROM pg.source WHERE fr.n > 1e-1 * pg.pages AND fr.n >= 2 GROUP BY fr.source),
kp AS (
  SELECT d.doc_id, d.text, string_split(d.text, chr(10)) AS lines,
    list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(bp.common, []), {trim})) AS kept
  FROM {docs} d LEFT JOIN bp ON d.source IS NOT DISTINCT FROM bp.source)
"""

OP9_SQL = "WITH " + LINES_CTES.format(docs="documents", trim=_TRIM) + r"""
SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines) - len(kept), 0) AS BIGINT) AS n_dropped,
  CAST(coalesce(length(array_to_string(kept, chr(10))), 0) AS BIGINT) AS kept_chars, md5(array_to_string(kept, chr(10))) AS kept_md5
FROM kp
"""
