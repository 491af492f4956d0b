"""Mixing sources to target weights by weighted sampling without replacement (exponential keys); native."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, stored

#: Characters that a text of good quality seldom holds, and the characters for a word (blanks counted) between which texts in general lie.
ODD = "!%$#*|&=+<>{}[]~^0123456789"
STRIDE = (4.0, 11.0)
#: A text's different words are at least so many times the root of all its words, where it does not say the same over and over.
VARIETY = 4.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column, size: Column | None = None) -> Column:
    """From 1/4 to 1, the product of four signs of quality: the share of a text's characters that are not ODD ones; less where its words (size of them) are shorter or longer than in
    general, where it has few different words for its length, and where its lines repeat. Texts without words weigh 1."""
    n = F.length(text)
    size = words(text) if size is None else size
    count = F.nullif(size, F.lit(0)).cast("double")
    share = F.length(F.translate(text, ODD, "")) / F.nullif(n, F.lit(0))
    stride = n / count
    different = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))))
    variety = F.least(F.lit(1.0), different / F.least(count, F.lit(VARIETY) * F.sqrt(count)))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit("\t\n\x0b\x0c\r ")) != "")
    unlike = F.size(F.array_distinct(lines)) / F.nullif(F.size(lines), F.lit(0))
    return F.coalesce(F.lit(0.25) + F.lit(0.75) * share * F.least(F.lit(1.0), stride / F.lit(STRIDE[0]), F.lit(STRIDE[1]) / stride) * variety * unlike, F.lit(1.0))


def draw_key(seed: int, doc_id: Column, weight: Column) -> Column:
    """Efraimidis and Spirakis: -ln(u) / weight, u from a hash of seed and doc_id, so that reruns agree; smaller keys are drawn first."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12), 16, 10).cast("double")
    return -F.ln((u + 0.5) / F.lit(float(2**48))) / weight


def _running(table: DataFrame, order: list[Column], sums: dict[str, str], spread: bool) -> DataFrame:
    """table with `nth`, the number of rows before each in an order, and for each name in sums the sum of its column over those rows.

    Spread: ranges of the order are summed in tasks of their own, and then the ranges' totals, one row each. Otherwise one window does it, for
    tables that are known to be small.
    """
    if not spread:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return table.withColumns({"nth": F.row_number().over(Window.orderBy(*order)) - 1, **{k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in sums.items()}})
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(table.repartitionByRange(parts, *order).withColumn("range_", F.spark_partition_id()), "ranges")
    ranges = dealt.groupBy("range_").agg(F.count(F.lit(1)).alias("rows_"), *[F.sum(c).alias(f"of_{k}") for k, c in sums.items()])
    # a row for each range, so this window and this broadcast hold no more rows than there are shuffle partitions
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("range_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ["rows_", *(f"of_{k}" for k in sums)]])
    own = Window.partitionBy("range_").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(ranges), "range_")
    return joined.select(
        *table.columns,
        (F.row_number().over(own) - 1 + F.col("rows__before")).alias("nth"),
        *[(F.coalesce(F.sum(c).over(before), F.lit(0)) + F.col(f"of_{k}_before")).alias(k) for k, c in sums.items()],
    )


def source_targets(sources: DataFrame, weights: Sequence[float], total_share: float, most: float, spread: bool = False) -> DataFrame:
    """sources (source, source_size) with target: shares by weight, at most `most` times a source's size, the excess reshared by weight.

    The level of that water-filling: with sources in order of cap / weight, the first k are capped, k the least for which the level that the
    others would get does not exceed the next cap. One row per source goes through this, never documents; with spread, in many tasks.
    """
    named = _running(sources, [F.col("source").asc_nulls_last()], {}, spread)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    named = named.withColumn("w", w).drop("nth").withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("w"))
    ordered = _running(named, [F.col("ratio"), F.col("source").asc_nulls_last()], {"capped": "source_size", "light": "w"}, spread)
    # totals and the level are a row each
    total = named.agg(F.sum("source_size"), F.sum("w")).first()
    rest = F.lit(float(total_share) * (total[0] or 0)) - F.lit(float(most)) * F.col("capped")
    level = rest / (F.lit(total[1]) - F.col("light"))
    got = ordered.withColumn("level", level).where(F.col("level") <= F.col("ratio")).agg(F.min(F.struct("ratio", "level"))["level"]).first()[0]
    share = F.col("ratio") if got is None else F.lit(got)
    return named.select("source", "source_size", F.least(F.lit(float(most)) * F.col("source_size"), share * F.col("w")).alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    total_share: float = 1.0,
    most: int = 3,
    seed: int = 20,
    size: Column | None = None,
    quality: Column | None = None,
    bucket_rows: int = 50_000,
    broadcast_sources: int = 100_000,
    salts: int = 64,
    most_in_order: int = 500_000,
) -> DataFrame:
    """Chooses how often each document enters a mix of sources; keeps every row of docs and adds size, source_size, target, copies and taken.

    docs: doc_id, source, text and any other columns, whatever their names (those named like the added ones are replaced). A source's target is its
    share by weight of total_share times all words, capped at `most` times its words with the excess reshared. It first takes all of its documents
    as many whole times as fit (complete epochs), then documents in the order of their exponential keys, scaled by quality (weights of about 1/4 to
    1), while the prefix sum of sizes fits what is left, and the one that crosses it if that brings the sum nearer.

    The order within a source is found in two levels, so that no source is sorted in one task: sizes are summed by bucket of key, and only the
    one bucket in which the target falls is put in order: by one task for each source, or, where a bucket has more than most_in_order rows (rows without ids, or copies of a
    row, share a draw), by ranges in many. There are as many buckets as hold about bucket_rows rows each. Up to broadcast_sources
    sources, a row for each goes to every task; beyond that sources are summed over ranges and documents meet their source in one of `salts` parts.

    Nulls: null text has size 0; a null source is a source of its own, last in order; a null doc_id draws as the text "null". Empty table: no rows.
    Documents of size 0 are taken with their epoch and cost nothing. Repeated rows share a key and count one by one.
    """
    size = words(F.col("text")) if size is None else size
    quality = quality_weight(F.col("text"), size) if quality is None else quality
    extra = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies", "taken")]
    # the row goes as one struct, so that its names clash with none here
    sized = stored(docs.select(F.struct(*extra).alias("doc"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id"), size.alias("size"), draw_key(seed, F.col("doc_id"), quality).alias("draw")), "mix")
    buckets = max(1024, -(-sized.count() // bucket_rows))
    # the key is exponential with a rate of 1/4 to 1; this maps it to buckets in order, all of them used
    sized = sized.withColumn("bucket", F.least(F.floor((1 - F.exp(-F.col("draw") / 2)) * buckets).cast("int"), F.lit(buckets - 1)))
    by_bucket = stored(sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"), F.count(F.lit(1)).alias("rows_in_bucket")), "mix-buckets")
    sources = stored(by_bucket.groupBy("source").agg(F.sum("in_bucket").alias("source_size")), "mix-sources")
    many = sources.count() > broadcast_sources
    targets = (
        source_targets(sources, weights, total_share, most, many)
        .withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
        .withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    )
    upto = Window.partitionBy("source").orderBy("bucket")
    running = by_bucket.withColumn("upto", F.sum("in_bucket").over(upto))
    edge = (
        targets.alias("t")
        .join(running.alias("r"), F.col("t.source").eqNullSafe(F.col("r.source")))
        .groupBy(F.col("t.source").alias("of"), "source_size", "target", "epochs", "left")
        .agg(F.min(F.when(F.col("upto") > F.col("left"), F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("under"), "rows_in_bucket"))).alias("edge"))
        .select("of", "source_size", "target", "epochs", "left", F.col("edge.bucket").alias("edge_bucket"), F.col("edge.under").alias("under"), F.col("edge.rows_in_bucket").alias("edge_rows"))
    )
    same = F.col("source").eqNullSafe(F.col("of"))
    edge = stored(edge, "mix-edges")
    if many:
        salted = sized.withColumn("salt", F.pmod(F.xxhash64("draw", "doc_id", "size"), F.lit(salts)).cast("int"))
        rows = salted.join(edge.withColumn("part_of", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), same & (F.col("salt") == F.col("part_of"))).drop("salt", "part_of")
    else:
        rows = sized.join(F.broadcast(edge), same)
    outside = rows.where(~F.col("bucket").eqNullSafe(F.col("edge_bucket"))).withColumn("part", F.when(F.col("edge_bucket").isNull() | (F.col("bucket") < F.col("edge_bucket")), 1).otherwise(0))
    order = ["draw", F.col("doc_id").asc_nulls_last(), "size"]
    edges = rows.where(F.col("bucket") == F.col("edge_bucket"))
    # rows that share a draw share a bucket, however many: null ids of one weight, or copies of a row
    if (edge.agg(F.max("edge_rows")).first()[0] or 0) > most_in_order:
        numbered_rows = stored(edges, "mix-edge").withColumn("row_", F.monotonically_increasing_id())
        summed = _running(numbered_rows, [F.col("source").asc_nulls_last(), *order, "row_"], {"before_": "size"}, True).drop("nth", "row_")
        starts = summed.groupBy(F.col("source").alias("of_source")).agg(F.min("before_").alias("start_"))
        # a row for each source that is cut
        placed = summed.join(F.broadcast(starts) if not many else starts, F.col("source").eqNullSafe(F.col("of_source")))
        inside = placed.withColumn("sum", F.col("under") + F.col("before_") - F.col("start_") + F.col("size")).drop("before_", "start_", "of_source")
    else:
        within = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = edges.withColumn("sum", F.col("under") + F.sum("size").over(within))
    inside = inside.withColumn("part", F.when((F.col("sum") <= F.col("left")) | (F.col("sum") - F.col("left") < F.col("left") - (F.col("sum") - F.col("size"))), 1).otherwise(0)).drop("sum")
    copies = F.col("epochs") + F.col("part")
    added = ["size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return outside.unionByName(inside).select(*[F.col("doc")[c].alias(c) for c in extra], *added)


def op6_source_mix(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sized = docs.withColumn("n", words(F.col("text")))
    slim = sized.select("doc_id", "source", "n", quality_weight(F.col("text"), F.col("n")).alias("q"))
    return mix_sources(slim, size=F.col("n"), quality=F.col("q")).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, size,
    -ln((CAST(('0x' || substr(md5('20:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) + 0.5e0) / 281474976710656e0)
      / coalesce(25e-2 + 75e-2 * (CAST(length(translate(text, '!%$#*|&=+<>{}[]~^0123456789', '')) AS DOUBLE) / nullif(length(text), 0)) * CASE WHEN size > 0 THEN least(1e0, stride / 4e0, 11e0 / stride) END
        * CASE WHEN size > 0 THEN least(1e0, different / least(CAST(size AS DOUBLE), 4e0 * sqrt(size))) END * (CAST(len(list_distinct(lines)) AS DOUBLE) / nullif(len(lines), 0)), 1e0) AS k
  FROM (SELECT *, CAST(length(text) AS DOUBLE) / nullif(size, 0) AS stride, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM (SELECT *, CAST(len(w) AS BIGINT) AS size, len(list_distinct(w)) AS different FROM (SELECT *, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)))),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS w
  FROM d GROUP BY source),
r AS (SELECT *, 3e0 * source_size / w AS ratio FROM s),
l AS (
  SELECT *, (1e0 * sum(source_size) OVER () - 3e0 * coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
m AS (SELECT min_by(level, ratio) AS level FROM l WHERE level <= ratio),
t AS (
  SELECT source, source_size, least(3e0 * source_size, coalesce(m.level, ratio) * w) AS target FROM l, m),
e AS (
  SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs FROM t),
c AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, greatest(0e0, e.target - e.epochs * e.source_size) AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id NULLS LAST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
  CAST((epochs + CASE WHEN upto <= rest OR upto - rest < rest - (upto - size) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM c
"""
