"""What the operators of this subpackage share: written intermediate tables and batch helpers."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"


_OWN_FOLDER: dict[str, str] = {}
_SCRATCH: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application under spark.checkpoint.dir, which driver and executors share; it goes when the driver's JVM ends.

    Where that is unset, a temporary folder serves a local master; on a cluster it is an error, as executors would not see each other's files.
    """
    context = spark.sparkContext
    app = context.applicationId
    if app not in _OWN_FOLDER:
        root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
                raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors share (master is {context.master})")
            root = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        _OWN_FOLDER[app] = f"{root.rstrip('/')}/tidewater-{app}"
        path = context._jvm.org.apache.hadoop.fs.Path(_OWN_FOLDER[app])
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return _OWN_FOLDER[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_SCRATCH[-1] if _SCRATCH else shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within goes at the end, so what is to stay is written to a path taken before."""
    folder = fresh_path(spark, "scratch")
    _SCRATCH.append(folder)
    try:
        yield
    finally:
        _SCRATCH.remove(folder)
        remove(spark, folder)


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df, written in an order, with each row's place in it from 0 on as the column `name`.

    The sort deals ranges to tasks; a row's place in its range is part of the id that Spark gives it, and the sizes of the ranges, a row for each, are
    summed in one task. The row's number in df ends the order, so that rows equal in it are cut into ranges like any others; df is to be a written table.
    """
    last, at, of, start = (free_name(df, x) for x in ("_row", "_at", "_range", "_start"))
    ids = F.monotonically_increasing_id()
    placed = stored(df.withColumn(last, ids).orderBy(*order, last).drop(last).withColumn(at, ids), "numbered")
    part = F.shiftright(at, 33)
    sizes = placed.groupBy(part.alias(of)).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.orderBy(of).rowsBetween(Window.unboundedPreceding, -1)
    # a row for each range, so this side may be broadcast
    starts = sizes.select(of, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(start))
    joined = placed.join(F.broadcast(starts), part == F.col(of))
    return joined.select(*df.columns, (F.col(start) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """name, or with underscores after it, so that no column of df is called so (columns compare without regard to case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def apart(key: Column) -> Column:
    """The same key by another expression. A table that has been summed by a key is already dealt by it, and a join would take it as it is, in one
    stage with the sum; dealt anew, the stage of the join has two plain shuffles, whose hot keys adaptive execution can split."""
    return key.bitwiseXOR(F.lit(0).cast("long"))


def document_key(doc_id: str = "doc_id", text: str = "text"):
    """Two longs that stand for a document's row where doc_id may be null or repeated: rows equal in both are one document."""
    both = F.struct(F.coalesce(F.col(doc_id), F.lit(-1)), F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit("")))
    return F.xxhash64(both), F.xxhash64(F.lit(7), both)


def portions(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of a batch whose texts have about `most` bytes, with those texts (null: empty): arrays over all bytes stay small."""
    values = batch.column(column).cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(values), 0))
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a), [x or b"" for x in values.slice(a, b - a).to_pylist()]


def packed_texts(docs: DataFrame, column: str = "text") -> DataFrame:
    """docs with `packed` in place of a text: its UTF-8 bytes (null: none), compressed, as they go through a shuffle; unpacked() gives them back."""
    others = [f for f in docs.schema.fields if f.name != column]

    def pack(batches):
        z = zstandard.ZstdCompressor(level=1)
        for batch, texts in (x for whole in batches for x in portions(whole, column, most=4 << 20)):
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array([z.compress(x) for x in texts], pa.binary())], names=[*(f.name for f in others), "packed"])

    return docs.mapInArrow(pack, T.StructType([*others, T.StructField("packed", T.BinaryType())]))


def unpacked(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with `packed`, and their texts, of about `most` bytes."""
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, at = [], 0, 0
        for i, x in enumerate(batch.column("packed")):
            texts.append(z.decompress(x.as_py()))
            size += len(texts[-1])
            if size >= most:
                yield batch.slice(at, i + 1 - at), texts
                texts, size, at = [], 0, i + 1
        if texts:
            yield batch.slice(at), texts


def mix64(x: np.ndarray) -> np.ndarray:
    """A strong bijection on 64 bits (the splitmix finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The odd base of the rolling polynomial, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Powers:
    """Powers of the base, and of its inverse, grown on demand."""

    up = _powers(BASE, 1)
    down = _powers(_INVERSE, 1)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up, cls.down = _powers(BASE, n), _powers(_INVERSE, n)
        return cls.up[:n], cls.down[:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 prefix sums of the polynomial hash modulo 2^64: span_hash takes any span's hash from them."""
    up, _ = Powers.to(max(1, len(data)))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of each span of bytes, whatever its place."""
    _, down = Powers.to(max(1, len(prefix)))
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))
