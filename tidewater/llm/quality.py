"""Quality scores from two Zstandard dictionaries, one of good and one of bad labelled text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import portions


@dataclass(frozen=True)
class QualityModel:
    """Both dictionaries, the calibrator's three coefficients, and how texts are cut."""

    good: bytes
    bad: bytes
    coefficients: tuple[float, float, float]
    block: int = 1024
    smoothing: int = 64

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Rows (1, d, n / (n + smoothing)): d is the difference of the sizes under both dictionaries over n + smoothing, n a text's bytes. The last is
        for the calibrator alone: the same difference says less of a short text, whose first bytes any dictionary does little for, than of a long one.

        Texts are compressed in blocks, all of them, so that a dictionary counts as much at a text's end as at its start; the smoothing lets a
        text of a few bytes score near the base rate.
        """
        good, bad = _compressor(self.good), _compressor(self.bad)
        out = np.ones((len(texts), 3))
        for i, text in enumerate(texts):
            n, d = len(text), 0
            for k in range(0, n, self.block):
                part = text[k : k + self.block]
                d += len(bad.compress(part)) - len(good.compress(part))
            out[i, 1:] = d / (n + self.smoothing), n / (n + self.smoothing)
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return _logistic(self.features(texts) @ np.array(self.coefficients))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=3, dict_data=own, write_content_size=False, write_dict_id=False)


def _trained(texts: list[bytes], size: int, block: int) -> bytes:
    parts = [x[k : k + block] for x in texts for k in range(0, len(x), block)]
    try:
        return zstandard.train_dictionary(size, parts, level=3).as_bytes()
    except zstandard.ZstdError:  # too few texts
        return b"".join(parts)[:size]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's method on columns scaled to unit deviation; the first is the constant."""
    scale = x.std(axis=0) + 1e-9
    scale[0] = 1
    z, w = x / scale, np.zeros(x.shape[1])
    for _ in range(100):
        p = _logistic(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w / scale


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 1500,
    calibration: int = 4000,
    sample_bytes: int = 24 << 20,
    dictionary_bytes: int = 65536,
    block: int = 1024,
) -> QualityModel:
    """Fits on labelled rows outside the held-out fold (crc32 of the id as text modulo 5 is 0).

    A bounded sample: of one half of the labelled rows, by hash of the id, at most per_class texts of each class for the dictionaries; of the
    other half at most `calibration` rows for the calibrator; whole texts, and in all no more than sample_bytes of them (the rest of a sample is
    left out once that is reached). Null ids, qualities and texts are left out. With one class only, every text scores the smoothed base rate.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    seen = labels.where("doc_id is not null and quality in (0, 1)").where(fold != 0).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ranked = seen.select("doc_id", F.col("quality").cast("int").alias("quality"), F.xxhash64(F.lit(4), "doc_id").alias("h")).withColumn("half", F.pmod("h", F.lit(2)))
    picks = [ranked.where(f"half = 0 and quality = {q}").orderBy("h", "doc_id").limit(per_class) for q in (0, 1)]
    picks.append(ranked.where("half = 1").orderBy("h", "doc_id").limit(calibration))
    chosen = picks[0].unionByName(picks[1]).unionByName(picks[2])
    # at most 2 * per_class + calibration rows, so this side may be broadcast
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id").orderBy("h", "doc_id")
    texts: dict[tuple[int, int], list[bytes]] = {(h, q): [] for h in (0, 1) for q in (0, 1)}
    total = {0: 0, 1: 0}
    for row in sample.select("half", "quality", "text").toLocalIterator():
        text = row.text.encode("utf-8", "surrogatepass")
        if total[row.half] + len(text) <= sample_bytes // 2:
            total[row.half] += len(text)
            texts[row.half, row.quality].append(text)
    model = QualityModel(_trained(texts[0, 1], dictionary_bytes, block), _trained(texts[0, 0], dictionary_bytes, block), (0.0, 0.0, 0.0), block)
    x = model.features(texts[1, 0] + texts[1, 1])
    y = np.r_[np.zeros(len(texts[1, 0])), np.ones(len(texts[1, 1]))]
    if 0 < y.sum() < len(y):
        w = fit_logistic(x, y)
    else:
        good, bad = (sum(len(texts[h, q]) for h in (0, 1)) for q in (1, 0))
        w = np.array([np.log((good + 1) / (bad + 1)), 0, 0])
    return QualityModel(model.good, model.bad, tuple(float(v) for v in w), block)


def score_quality(docs: DataFrame, model: QualityModel, column: str = "score") -> DataFrame:
    """docs (with `text`) and a score from 0 to 1 for each whole text; higher: likelier good. A null text scores as an empty one.

    Other columns pass through, and one named like the score is replaced. Empty table: no rows.
    """
    others = docs.drop(column)
    schema = T.StructType([*others.schema.fields, T.StructField(column, T.DoubleType())])

    def score(batches):
        for batch, texts in (x for whole in batches for x in portions(whole, "text", most=4 << 20)):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(texts), pa.float64())], names=[*batch.schema.names, column])

    return others.mapInArrow(score, schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(docs, fit_quality(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
