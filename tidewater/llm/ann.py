"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard, searched with a beam."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stored


@dataclass(frozen=True)
class GraphParams:
    """degree: edges kept for a vector; beam: candidates a search holds; alpha: how much nearer a kept neighbour must be to drop another."""

    degree: int = 32
    build_beam: int = 64
    search_beam: int = 96
    alpha: float = 1.2
    batch: int = 512
    seed: int = 7


def beam_search(vectors: np.ndarray, edges: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Greedy searches of all queries side by side: each expands its nearest unexpanded candidate until the beam holds none.

    edges: (n, degree), -1 for none. Returns (queries, beam) ids and squared distances in order of distance, -1 and inf for none; with visited,
    of all that the search has expanded, as the graph's construction wants them.
    """
    m, n = len(queries), len(vectors)
    norms = np.einsum("ij,ij->i", vectors, vectors)
    own = np.einsum("ij,ij->i", queries, queries)
    k = min(beam, n)
    ids = np.full((m, k), -1, np.int64)
    dist = np.full((m, k), np.inf, np.float32)
    seen = np.zeros((m, n), bool)
    start = np.unique(entries)[:k]
    ids[:, : len(start)] = start
    dist[:, : len(start)] = own[:, None] + norms[start] - 2 * queries @ vectors[start].T
    seen[:, start] = True
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    done = ids < 0
    far_ids, far_dist = [], []
    live = np.arange(m)
    while len(live):
        first = np.argmin(done[live], axis=1)
        open_ = ~done[live, first]
        live, first = live[open_], first[open_]
        if not len(live):
            break
        done[live, first] = True
        at = ids[live, first]
        if visited:
            far_ids.append((live, at))
            far_dist.append(dist[live, first])
        near = edges[at]
        rows = np.broadcast_to(live[:, None], near.shape)
        ok = near >= 0
        ok &= ~seen[rows, np.maximum(near, 0)]
        r, c = rows[ok], near[ok]
        if not len(r):
            continue
        seen[r, c] = True
        d = (own[r] + norms[c] - 2 * np.einsum("ij,ij->i", queries[r], vectors[c])).astype(np.float32)
        width = near.shape[1]
        new_d, new_i = np.full((len(live), width), np.inf, np.float32), np.full((len(live), width), -1, np.int64)
        new_d[ok], new_i[ok] = d, c
        all_d = np.concatenate([dist[live], new_d], axis=1)
        all_i = np.concatenate([ids[live], new_i], axis=1)
        all_done = np.concatenate([done[live], new_i < 0], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :k]
        dist[live] = np.take_along_axis(all_d, order, 1)
        ids[live] = np.take_along_axis(all_i, order, 1)
        done[live] = np.take_along_axis(all_done, order, 1)
    if not visited:
        return ids, dist
    who = np.concatenate([x for x, _ in far_ids]) if far_ids else np.zeros(0, np.int64)
    what = np.concatenate([x for _, x in far_ids]) if far_ids else np.zeros(0, np.int64)
    d = np.concatenate(far_dist) if far_dist else np.zeros(0, np.float32)
    order = np.lexsort((d, who))
    who, what, d = who[order], what[order], d[order]
    counts = np.bincount(who, minlength=m)
    width = max(1, int(counts.max(initial=0)))
    out_i, out_d = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
    col = np.arange(len(who)) - np.repeat(np.cumsum(counts) - counts, counts)
    out_i[who, col], out_d[who, col] = what, d
    return out_i, out_d


def robust_prune(vectors: np.ndarray, node: int, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Keeps the nearest candidate, drops those that it is alpha times nearer to than the node is, and so on, up to degree edges."""
    candidates = np.unique(candidates[(candidates >= 0) & (candidates != node)])
    if not len(candidates):
        return candidates
    x = vectors[candidates]
    d = ((x - vectors[node]) ** 2).sum(axis=1)
    order = np.lexsort((candidates, d))[: 8 * degree]
    candidates, x, d = candidates[order], x[order], d[order]
    sq = np.einsum("ij,ij->i", x, x)
    between = sq[:, None] + sq[None, :] - 2 * x @ x.T
    alive, kept = np.ones(len(candidates), bool), []
    factor = alpha * alpha  # squared distances
    for i in range(len(candidates)):
        if alive[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            alive &= factor * between[i] > d
    return candidates[kept]


def build_graph(vectors: np.ndarray, p: GraphParams) -> tuple[np.ndarray, np.ndarray]:
    """(edges, entries): vectors enter in random order in growing batches; the search for each proposes its neighbours, which are pruned; so are
    the edges back. A second pass over all runs on the whole graph."""
    n = len(vectors)
    rng = np.random.default_rng(p.seed)
    edges = np.full((n, p.degree), -1, np.int64)
    centre = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin()) if n else 0
    entries = np.array([centre])
    order = rng.permutation(n)
    order = np.concatenate([[centre], order[order != centre]]) if n else order
    for alpha in (1.0, p.alpha):
        at = 1 if alpha == 1.0 else 0
        while at < n:
            size = min(p.batch, max(8, at) if alpha == 1.0 else p.batch)
            batch = order[at : at + size]
            at += size
            found, _ = beam_search(vectors, edges, entries, vectors[batch], p.build_beam, visited=True)
            back: dict[int, list[int]] = {}
            for node, near in zip(batch.tolist(), found, strict=True):
                # those that enter together know each other only through the graph as it was
                kept = robust_prune(vectors, node, np.concatenate([near, edges[node]]), p.degree, alpha)
                edges[node] = -1
                edges[node, : len(kept)] = kept
                for x in kept.tolist():
                    back.setdefault(x, []).append(node)
            for node, more in back.items():
                have = edges[node][edges[node] >= 0]
                both = np.union1d(have, more)
                if len(both) > p.degree:
                    both = robust_prune(vectors, node, both, p.degree, alpha)
                edges[node] = -1
                edges[node, : len(both)] = both
    return edges, entries


def usable(vectors: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is not null, empty or zero and holds no null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).where(~bad & F.exists(vec, lambda x: x != 0))


def _rows(batches, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches with a list column as a matrix."""
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _lifted(v: np.ndarray, most: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(0, most - (v * v).sum(axis=1)))
    return np.concatenate([v, rest[:, None]], axis=1).astype(np.float32)


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    vec: str = "embedding",
    shard_rows: int = 8192,
    shard_bytes: int = 32 << 20,
    query_block: int = 1024,
    params: GraphParams = GraphParams(),  # noqa: B008
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k nearest other rows found, by inner product in double precision, ties to smaller ids.

    Every row is indexed. Equal vectors are one node of the graph with their k + 1 smallest ids, which are all that can be among k nearest.
    Nodes are dealt by hash into shards of about shard_rows, fewer where these would take more than shard_bytes; each shard's graph is built in
    a task of its own and written to the shared folder. A query meets every shard: graphs are read as often as it takes to have as many tasks
    as the cluster runs at once, and the queries go to them in blocks, one after the other, so a task holds one graph and one block. Vectors get one more
    component that makes all norms equal, so that the nearest by distance is that of the largest inner product; scores are taken from the
    original vectors. Vectors of another length than a query's take no part in its search.

    Rows with a null id, or a vector that is null, zero or holds null or non-finite components, take no part. Of rows that are equal in id and
    vector one counts. Other columns are left out. Empty tables: no rows.
    """
    spark = vectors.sparkSession
    name = F.transform(F.col(vec), lambda x: x.cast("double") + 0.0)  # -0.0 is 0.0
    clean = usable(vectors.where(F.col(vec_id).isNotNull()), vec).select(F.col(vec_id).cast("long").alias("id"), name.alias("v"))
    ranked = clean.distinct().withColumn("h", F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")))
    # rows beyond k + 1 of a group are left out before the shuffle
    few = ranked.withColumn("r", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(f"r <= {k + 1}")
    nodes = few.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", "ids", F.xxhash64(F.lit(5), "v").alias("deal"))
    nodes = stored(nodes.withColumn("dim", F.size("v")).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), "ann-nodes")
    fit = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / (8 * F.col("dim")))))
    shape = nodes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("most")).withColumn("shards", F.ceil(F.col("n") / fit).cast("int"))
    # a row for each length of vector; shards are numbered through
    shape = stored(shape.withColumn("first", (F.sum("shards").over(Window.orderBy("dim")) - F.col("shards")).cast("int")), "ann-shape")
    shards = shape.agg(F.coalesce(F.sum("shards"), F.lit(0))).first()[0]
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    numbered = nodes.join(shape.select("dim", "most", "shards", "first"), "dim")
    dealt = numbered.withColumn("shard", (F.col("first") + F.pmod("deal", F.col("shards"))).cast("int"))

    def build(batches):
        parts = []
        for batch, v in _rows(batches, "v"):
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            parts.append((v.astype(np.float64), batch.column("deal").to_numpy(), sizes, batch.column("ids").flatten().to_numpy(), batch.column("shard")[0].as_py(), batch.column("most")[0].as_py()))
        if not parts:
            return
        v, deal, sizes = (np.concatenate([x[i] for x in parts]) for i in range(3))
        ids = np.split(np.concatenate([x[3] for x in parts]), np.cumsum(sizes)[:-1])
        order = np.lexsort((*v.T[:2], deal))
        v, shard, most = v[order], parts[0][4], parts[0][5]
        edges, entries = build_graph(_lifted(v, most), params)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([shard], pa.int32()), pa.array([v.shape[1]], pa.int32()), pa.array([most], pa.float64()), pa.array([v.tobytes()], pa.binary()), pa.array([edges.astype(np.int32).tobytes()], pa.binary()),
                pa.array([entries.astype(np.int64).tobytes()], pa.binary()), pa.array([sizes[order].astype(np.int64).tobytes()], pa.binary()), pa.array([np.concatenate([ids[x] for x in order.tolist()]).tobytes()], pa.binary()),
            ],
            names=["shard", "dim", "most", "vectors", "edges", "entries", "sizes", "ids"],
        )

    graph_schema = "shard int, dim int, most double, vectors binary, edges binary, entries binary, sizes binary, ids binary"
    by_shard = dealt.select("shard", "most", "deal", "v", "ids").repartitionById(shards, "shard")
    graphs = stored(by_shard.mapInArrow(build, graph_schema), "ann-graphs")

    asked = usable(queries.where(F.col(vec_id).isNotNull()), vec).select(F.col(vec_id).cast("long").alias("id"), name.alias("v")).distinct().withColumn("dim", F.size("v"))
    asked = stored(asked, "ann-queries")
    blocks = max(1, math.ceil(asked.count() / query_block))
    # copies of a graph: never more than there are blocks, nor than keep the cluster busy
    copies = min(blocks, max(1, math.ceil(2 * spark.sparkContext.defaultParallelism / shards)))
    graph_rows = graphs.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).select("shard", "copy", F.lit(-1).alias("block"), F.struct("dim", "most", "vectors", "edges", "entries", "sizes", "ids").alias("graph"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    # each query goes to each shard: a set of queries, stated as such, against all rows, in blocks
    sent = asked.join(shape.select("dim", "shards", "first"), "dim").withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("shards") - 1)))
    query_rows = sent.select("shard", F.pmod("block", F.lit(copies)).alias("copy"), "block", F.lit(None).cast(graph_rows.schema["graph"].dataType).alias("graph"), "id", "v")
    work = graph_rows.unionByName(query_rows).withColumn("task", (F.col("shard") * copies + F.col("copy")).cast("int"))
    work = work.repartitionById(shards * copies, "task").sortWithinPartitions("block", "id")

    def search(batches):
        graph = None
        for batch in batches:
            if batch.num_rows and batch.column("block")[0].as_py() < 0:  # the graph comes first
                g = batch.column("graph")[0].as_py()
                v = np.frombuffer(g["vectors"], np.float64).reshape(-1, g["dim"])
                sizes = np.frombuffer(g["sizes"], np.int64)
                graph = (v, _lifted(v, g["most"]), np.frombuffer(g["edges"], np.int32).reshape(len(v), -1).astype(np.int64), np.frombuffer(g["entries"], np.int64), sizes, np.frombuffer(g["ids"], np.int64), np.concatenate([[0], np.cumsum(sizes)]), g["most"])
                batch = batch.slice(1)
            if not batch.num_rows or graph is None:
                continue
            v, lifted, edges, entries, sizes, flat, first, most = graph
            asked_ids = batch.column("id").to_numpy()
            q = batch.column("v").flatten().to_numpy().reshape(len(asked_ids), -1)
            for a in range(0, len(q), 256):
                out = []
                part = np.concatenate([q[a : a + 256], np.zeros((len(q[a : a + 256]), 1))], axis=1)
                # a query's length does not change the order of inner products, only that of distances
                part *= np.sqrt(most) / np.maximum(1e-300, np.linalg.norm(part, axis=1, keepdims=True))
                near, _ = beam_search(lifted, edges, entries, part.astype(np.float32), max(params.search_beam, k + 1))
                for i, found in enumerate(near):
                    found = found[found >= 0]
                    score = np.repeat((v[found] * q[a + i]).sum(axis=1), sizes[found])
                    who = np.concatenate([flat[first[x] : first[x + 1]] for x in found.tolist()])
                    other = who != asked_ids[a + i]
                    who, score = who[other], score[other]
                    best = np.lexsort((who, -score))[:k]
                    out.append((np.full(len(best), asked_ids[a + i]), who[best], score[best]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    found = work.select("block", "graph", "id", "v").mapInArrow(search, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.withColumn("rank", F.row_number().over(by_query)).where(f"rank <= {k}")
    return best.select("query_id", "rank", "vec_id", "score")


def op7_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 20 = 0"))
