"""Connected components of a graph of edges, by alternating large and small stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import apart, fresh_path, remove, stored


def forest(a: list[int], b: list[int]) -> dict[int, int]:
    """For each node of edges a - b the least node that it is connected with."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        at = up.setdefault(x, x)
        while at != up[at]:
            at = up[at] = up[up[at]]
        up[x] = at
        return at

    for x, y in zip(a, b, strict=True):
        x, y = root(x), root(y)
        if x < y:
            up[y] = x
        else:
            up[x] = y
    return {x: root(x) for x in up}


def _contracted(edges: DataFrame, chunk: int) -> DataFrame:
    """The same components with each chunk of so many edges as stars around their least nodes: a node less the root of each tree has one edge."""

    def contract(batches):
        left, right = [], []
        for batch in (*batches, None):
            if batch is not None:
                left.append(batch.column("a").to_numpy())
                right.append(batch.column("b").to_numpy())
                if sum(map(len, left)) < chunk:
                    continue
            if left:
                stars = forest(np.concatenate(left).tolist(), np.concatenate(right).tolist())
                rows = [(x, r) for x, r in stars.items() if x != r]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], names=["a", "b"])
                left, right = [], []

    return edges.mapInArrow(contract, "a long, b long")


def _with_least(edges: DataFrame, node: str, other: str) -> DataFrame:
    """Each edge with the least of its node and that node's neighbours. A sum by node and a join, so that no node's edges meet in one row or task."""
    least = edges.groupBy(node).agg(F.min(other).alias("_m")).select(apart(F.col(node)).alias("_n"), F.least("_m", node).alias("_m"))
    return edges.join(least, F.col(node) == F.col("_n")).select(node, other, "_m")


def connected_components(edges: DataFrame, chunk: int = 100_000) -> DataFrame:
    """(node, root) for every node of edges (a, b: longs), root the least node that can be reached. Nulls and loops are left out.

    Rounds go on until nothing changes. Before each, every chunk of edges is made stars of its own, so a graph of up to `chunk` edges, some
    megabytes, takes one pass in one task, and larger ones fewer rounds.
    """
    spark = edges.sparkSession
    both_ways = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    path = fresh_path(spark, "edges")
    edges = stored(both_ways, "edges", path)
    n = edges.count()
    if n <= chunk:
        done = stored(_contracted(edges.coalesce(1), chunk + 1), "components")
        return done.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(done.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    seen = None
    while True:
        edges = _contracted(edges, chunk)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b").where("b > a").select(F.col("b").alias("a"), F.col("_m").alias("b")).where("a <> b").distinct()
        near = _with_least(large, "a", "b")
        small = near.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(near.select("a", F.col("_m").alias("b"))).where("a <> b").distinct()
        old, path = path, fresh_path(spark, "edges")
        edges = stored(small, "edges", path)
        remove(spark, old)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
