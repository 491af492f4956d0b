"""Corpus pipeline over the documents table: score, clean, deduplicate, decontaminate, mix.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of documents (doc_id, text, lang, source, n_chars);
the last one adds size, source_size, target, copies and taken. Each is written to the shared folder and read again before the next one runs; what
it stored on the way goes then. As stages return the columns of documents only, the first one's score does not reach the last one, which weighs texts by
built-in functions.

In every stage: rows with null ids or texts are documents like others (a null text is empty and loses nothing); rows equal in all columns stay or go
together, but for the mix, which counts them one by one; further columns pass through, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.decontaminate import decontaminate
from tidewater.llm.lines import drop_boilerplate
from tidewater.llm.minhash import drop_near_duplicates
from tidewater.llm.mixing import mix_sources
from tidewater.llm.quality import fit_quality, score_quality
from tidewater.llm.shared import fresh_path, free_name, scratch, stored

#: A document stays if it scores this or more.
LEAST_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that score under LEAST_SCORE go. A null or empty text scores the base rate; equal texts score the same."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    score = free_name(docs, "score")
    scored = score_quality(docs, fit_quality(docs, labels), score)
    return scored.where(F.col(score) >= LEAST_SCORE).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: lines on more than a tenth of a source's documents go from their texts; every document stays, with n_chars of what is left.

    A null source is a source of its own; a null text stays null and keeps its n_chars; repeated rows count as documents each.
    """
    n_chars = F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars")
    return drop_boilerplate(docs).withColumn("n_chars", n_chars).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, on five-word shingles at 0.8: of each group the document with the smallest doc_id stays, of one without ids that with the least
    hash. Texts without words link with nothing and stay."""
    return drop_near_duplicates(docs, width=5, threshold=0.8)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go. Null or blank texts and items match nothing."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the mix does not take go; `copies` says how often each of the others is taken. Ties in the drawn key go by doc_id,
    nulls last, then by size."""
    return mix_sources(docs).where("copies > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicates", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("source mixing", mixing_stage),
]

#: The classifier's dictionaries and the sketches have no SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
