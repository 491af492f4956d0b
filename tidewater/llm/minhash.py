"""Near-duplicate detection with HyperMinHash registers, banded, then confirmed on the full shingle sets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import connected_components
from .shared import apart, document_key, free_name, mix64, packed_texts, portions, prefix_hash, span_hash, stored

#: Buckets of a sketch, bits of mantissa kept of each bucket's least hash, and how the registers are banded.
BUCKETS, MANTISSA = 128, 10
BANDS, ROWS = 32, 4
EMPTY = np.uint16(0xFFFF)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_EDGES = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(64 - 7)
_BAND_SALT = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct runs of `width` words; fewer words make one run, none an empty set.

    Words are runs of bytes other than ASCII white space; A-Z compare as a-z.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(x) + 1 for x in texts])
    ink = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], ink]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    own = span_hash(prefix_hash(_LOWER[data]), start, end)
    upto = np.searchsorted(start, ends)
    n = len(own)
    run = own.copy()
    for k in range(1, width):
        run[: max(0, n - k)] = mix64(run[: max(0, n - k)] * np.uint64(3) + own[k:])
    out, a = [], 0
    for b in upto.tolist():
        if b - a >= width:
            out.append(np.unique(run[a : b - width + 1]))
        elif b > a:
            h = own[a : a + 1]
            for k in range(a + 1, b):
                h = mix64(h * np.uint64(3) + own[k : k + 1])
            out.append(mix64(h + np.uint64(b - a)))
        else:
            out.append(own[:0])
        a = b
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of sorted hashes: for each bucket of the first 7 bits the leading zeros of the least other 57 and the bits after the first one."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(hashes):
        at = np.searchsorted(hashes, _EDGES)
        low = hashes[np.minimum(at, len(hashes) - 1)]
        there = (at < len(hashes)) & (low >> np.uint64(57) == np.arange(BUCKETS, dtype=np.uint64))
        rest = (low << np.uint64(7)) | np.uint64(64)
        zeros = (64 - np.frexp((rest >> np.uint64(11)).astype(np.float64))[1] - 11).astype(np.uint64)
        mantissa = (rest << (zeros + np.uint64(1))) >> np.uint64(64 - MANTISSA)
        out[there] = ((zeros << np.uint64(MANTISSA)) | mantissa)[there].astype(np.uint16)
    return out


def band_keys(sketches: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sketches, bands) keys of the bands, and which of them count: those with one filled register, two in sets of 64 shingles or more, three in
    those of 160 or more. A band of one shingle says little about a large set; enough others are left (at similarity 0.8 all fail once in 10^6)."""
    cut = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(_BAND_SALT, cut.shape[:2]).copy()
    for k in range(ROWS):
        key = mix64(key * np.uint64(31) + cut[:, :, k])
    least = 1 + (n >= 64).astype(int) + (n >= 160)
    return key, (cut != EMPTY).sum(axis=2) >= least[:, None]


def collision(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that one bucket's registers of two disjoint sets of n and m members agree: equal leading zeros, then an equal mantissa."""
    k = np.arange(56)
    hi, lo = 2.0**-k, 2.0 ** -(k + 1)
    p = lambda x: (1 - lo) ** (np.asarray(x, float)[..., None] / BUCKETS) - np.maximum(0, 1 - hi) ** (np.asarray(x, float)[..., None] / BUCKETS)
    return (p(n) * p(m)).sum(axis=-1) / 2**MANTISSA


def estimate(sketch: np.ndarray, n: float, others: np.ndarray, ms: np.ndarray) -> np.ndarray:
    """Jaccard similarities to others, corrected for registers that agree by chance: (share - c) / (1 - c)."""
    filled = (others != EMPTY) | (sketch != EMPTY)
    same = ((others == sketch) & filled).sum(axis=1) / np.maximum(1, filled.sum(axis=1))
    c = collision(np.full(len(ms), n), ms)
    return (same - c) / (1 - c)


def slack(threshold: float, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an estimate may lie below the threshold: five deviations of a sample without replacement, as the filled buckets are one of the union."""
    union = np.maximum(n, m).astype(float)
    filled = BUCKETS * (1 - (1 - 1 / BUCKETS) ** union)
    return 5 * np.sqrt(threshold * (1 - threshold) / filled * np.maximum(0.02, 1 - filled / union)) + 1 / filled


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, n, cls, sketch) for each document: its set's size, a 64-bit name of the set, its registers."""

    def make(batches):
        for batch, texts in (x for whole in batches for x in portions(whole)):
            sets = shingle_sets(texts, width)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("key"),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array(np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)),
                    pa.array([registers(x).tobytes() for x in sets], pa.binary()),
                ],
                names=["doc_id", "key", "n", "cls", "sketch"],
            )

    return docs.select("doc_id", "key", "text").mapInArrow(make, "doc_id long, key long, n long, cls long, sketch binary")


def _band_rows(classes: DataFrame) -> DataFrame:
    def explode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            key, ok = band_keys(regs, batch.column("n").to_numpy())
            cls = np.broadcast_to(batch.column("cls").to_numpy()[:, None], key.shape)
            yield pa.RecordBatch.from_arrays([pa.array(key[ok].view(np.int64)), pa.array(cls[ok])], names=["band", "cls"])

    return classes.select("cls", "n", "sketch").mapInArrow(explode, "band long, cls long")


#: Of a group too large for one task, the members that every block of it is compared with first.
PIVOTS = 4


def spanning_links(members: DataFrame, solve: Callable[[DataFrame], DataFrame], finish: Callable[[DataFrame], DataFrame], few: int) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that connect, within each group, whatever its links connect, and the parts (node, root) that they make.

    members: grp, node, blocks, the number of blocks in which a group is dealt. solve takes units (grp, i, j, node, own, part): of each (grp, i, j)
    the members of blocks i and j (own says which) with what they are known to be connected with; it returns links between members of i and of j
    that join all of their parts that any such link joins. finish takes nodes (node, part, outside) and returns the links between an outside one and any other of
    another part, found without comparing all of them.

    Groups of one block are solved at once. Of larger ones each block is first solved together with a few pivots that go to all blocks: where
    copies are near each other, that connects nearly all, and the work is in proportion to the group. Then only those outside the group's largest
    part are compared with the rest of it: block by block where they are `few` at most, else as finish() does. No link between different parts is lost.
    """
    blocks = F.col("blocks")
    own = F.pmod(F.xxhash64(F.lit(3), "node"), blocks).cast("int")
    units = members.select("grp", own.alias("i"), own.alias("j"), "node", own.alias("own"), F.col("node").alias("part"))
    large = members.where(blocks > 1)
    chosen = large.groupBy("grp", "blocks").agg(F.array_distinct(F.array(*[F.min_by("node", F.xxhash64(F.lit(k), "node")) for k in range(PIVOTS)])).alias("nodes"))
    everywhere = chosen.select("grp", F.explode("nodes").alias("node"), "blocks").select("grp", "node", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("i"))
    units = units.unionByName(everywhere.select("grp", "i", F.col("i").alias("j"), "node", F.col("i").alias("own"), F.col("node").alias("part")))
    links = stored(solve(units), "links")
    parts = connected_components(links)
    if large.isEmpty():
        return links, parts
    placed = large.join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
    counts = placed.groupBy("grp", "part", "blocks").agg(F.count(F.lit(1)).alias("c"))
    most = counts.groupBy(apart(F.col("grp")).alias("grp")).agg(F.max_by("part", "c").alias("main"), F.max("c").alias("inside"), F.sum("c").alias("all")).where(F.col("inside") < F.col("all"))
    most = stored(most, "parts")
    if most.isEmpty():
        return links, parts
    scattered = (F.col("all") - F.col("inside")) > few
    share = lambda n: F.greatest(F.lit(1), F.ceil(n * blocks / F.col("all"))).cast("int")
    hashed, outside = F.xxhash64(F.lit(4), "node"), F.col("part") != F.col("main")
    dealt = (
        placed.join(most.where(~scattered), "grp")
        .withColumns({"few": share(F.col("all") - F.col("inside")), "rest": share(F.col("inside"))})
        .withColumn("own", F.when(outside, F.pmod(hashed, F.col("few"))).otherwise(F.col("few") + F.pmod(hashed, F.col("rest"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.when(outside, F.col("few") + F.col("rest") - 1).otherwise(F.col("few") - 1))))
    )
    again = dealt.select("grp", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), "node", "own", "part")
    links = links.unionByName(stored(solve(again), "links"))
    loose = placed.join(most.where(scattered), "grp").groupBy("node").agg(F.min("part").alias("part"), F.max(outside).alias("outside"))
    loose = stored(loose, "loose")
    if not loose.isEmpty():
        links = links.unionByName(stored(finish(loose), "links"))
    return links, connected_components(links)


def prefix_pairs(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): pairs of an outside node and another one of a different part that may have as many tokens in common as they need; none that do is left out.

    tokens: node, token, distinct for each node; nodes: node, part, outside, size (of the whole), short and long. Tokens have one order, those of the fewest outside nodes first.
    Two sets with so much in common share one of the first `short` tokens of the smaller and of the first `long` ones of the larger. What sets of
    one template have in common stands last, and what sets them apart first, so they hardly ever meet.
    """
    held = stored(tokens, "tokens")
    counts = held.join(nodes.where("outside").select("node"), "node", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("c"))
    ranked = held.join(counts.select(apart(F.col("token")).alias("token"), "c"), "token", "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "token"))).alias("t"))
    first = ranked.join(nodes, "node").select("node", "part", "outside", "size", "short", F.posexplode(F.slice("t", F.lit(1), F.greatest("short", "long"))).alias("at", "x")).where("x.c > 0")
    first = stored(first.select("node", "part", "outside", "size", (F.col("at") < F.col("short")).alias("near"), F.col("x.token").alias("token")), "prefixes")
    # the outside node on the left, the other on the right
    left, right = first.where("outside").alias("l"), first.alias("r")
    apart_parts = (F.col("l.token") == F.col("r.token")) & (F.col("l.part") != F.col("r.part"))
    smaller = left.where("l.near").join(right, apart_parts & (F.col("l.size") <= F.col("r.size")))
    larger = left.join(right.where("r.near"), apart_parts & (F.col("r.size") < F.col("l.size")))
    ends = [F.least("l.node", "r.node").alias("a"), F.greatest("l.node", "r.node").alias("b")]
    return smaller.select(*ends).unionByName(larger.select(*ends)).distinct()


def joined_parts(left: np.ndarray, right: np.ndarray, part: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (indices) between left and right that join all parts that any such link joins; linked(x, others) gives those of others that x links
    with. A member is not compared with those of its own part, so near copies cost about one comparison each."""
    part, found = part.copy(), []
    same = len(left) == len(right) and np.array_equal(left, right)
    for k, x in enumerate(left.tolist()):
        others = right[k + 1 :] if same else right
        others = others[part[others] != part[x]]
        if not len(others):
            continue
        for y in linked(x, others).tolist():
            if part[y] != part[x]:
                part[part == part[y]] = part[x]
                found.append((x, y))
    return found


def _ended(batches):
    yield from batches
    yield None


def _groups(batches, rows: int = 4096):
    """Tables of whole groups, sorted by (grp, i, j), of about so many rows, each with where its groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in _ended(batches):
        if batch is not None:
            held.append(batch)
            if sum(x.num_rows for x in held) < rows:
                continue
        if not sum(x.num_rows for x in held):
            held = []
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        name = [table.column(k).to_numpy() for k in ("grp", "i", "j")]
        new = np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in name], axis=0)]))
        whole = len(table) if batch is None else int(new[-1])  # the last group may go on in the next batch
        held = table.slice(whole).to_batches()
        if whole:
            yield table.slice(0, whole), np.append(new[new < whole], whole)


def _links(cls: np.ndarray, found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = (cls[np.array(x, np.int64)] for x in (zip(*found, strict=True) if found else ((), ())))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _in_order(units: DataFrame) -> DataFrame:
    return units.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")


def estimated_parts(bands: DataFrame, classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, root): the parts that classes make which share a bucket of a band and whose estimate reaches the threshold less its slack."""
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(apart(F.col("band")).alias("band"), "m")
    members = stored(bands.join(full, "band").select(F.col("band").alias("grp"), F.col("cls").alias("node"), F.ceil(F.col("m") / block).cast("int").alias("blocks")), "buckets")

    def near(n, regs, x, y):
        """Whether the pairs x, y (indices, side by side) may be links."""
        ok = np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y]) - 1e-9
        x, y = x[ok], y[ok]
        filled = (regs[x] != EMPTY) | (regs[y] != EMPTY)
        same = ((regs[x] == regs[y]) & filled).sum(axis=1) / np.maximum(1, filled.sum(axis=1))
        c = collision(n[x], n[y])
        good = (same - c) / (1 - c) >= threshold - slack(threshold, n[x], n[y])
        return x[good], y[good]

    def find(batches):
        for table, new in _groups(batches):
            cls, own, n, part, i, j = (table.column(k).to_numpy() for k in ("node", "own", "n", "part", "i", "j"))
            regs = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            size = np.diff(new)
            pairs = new[:-1][(size == 2) & (i[new[:-1]] == j[new[:-1]])]
            x, y = near(n, regs, pairs, pairs + 1)
            found = list(zip(x.tolist(), y.tolist(), strict=True))
            for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                if b - a > 2 or b - a == 2 and i[a] != j[a]:
                    mine = np.arange(a, b)
                    left, right = mine[own[a:b] == i[a]], mine[own[a:b] == j[a]]
                    here = {p: k for k, p in enumerate(np.unique(part[a:b]).tolist())}
                    label = np.zeros(b, np.int64)
                    label[a:b] = [here[p] for p in part[a:b].tolist()]
                    label[:a] = -1
                    found += joined_parts(left, right, label, lambda x, o, n=n, regs=regs: near(n, regs, np.full(len(o), x), o)[1])
            yield _links(cls, found)

    def solve(units: DataFrame) -> DataFrame:
        rows = units.join(classes.select(F.col("cls").alias("node"), "n", "sketch"), "node")
        return _in_order(rows).mapInArrow(find, "a long, b long")

    def registers_of(batches):
        """Each node's filled registers as tokens, and how many of the rarest two nodes must share one of whose estimate may reach the threshold."""
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            filled = regs != EMPTY
            node = np.broadcast_to(batch.column("node").to_numpy()[:, None], regs.shape)
            token = np.arange(BUCKETS, dtype=np.int64) << 16 | regs
            yield pa.RecordBatch.from_arrays([pa.array(node[filled]), pa.array(token[filled])], names=["node", "token"])

    def needed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            n, f = batch.column("n").to_numpy(), (regs != EMPTY).sum(axis=1)
            # a partner has between threshold and 1 / threshold times as many shingles
            wide = np.max([slack(threshold, n, n * k) for k in np.linspace(1, 1 / threshold, 9)], axis=0) + 0.01
            least = np.maximum(1, np.ceil((threshold - wide) * f - 1e-9).astype(np.int64))
            first = np.maximum(1, f - least + 1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("part"), batch.column("outside"), pa.array(f.astype(np.int64)), pa.array(first.astype(np.int32)), pa.array(first.astype(np.int32))], names=["node", "part", "outside", "size", "short", "long"])

    def compare(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.concatenate([np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in ("sketch_a", "sketch_b")])
            n = np.concatenate([batch.column(k).to_numpy() for k in ("n_a", "n_b")])
            x, _ = near(n, regs, np.arange(batch.num_rows), np.arange(batch.num_rows) + batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(x)), batch.column("b").take(pa.array(x))], names=["a", "b"])

    def finish(nodes: DataFrame) -> DataFrame:
        drawn = stored(nodes.join(classes.select(F.col("cls").alias("node"), "n", "sketch"), "node"), "loose-sketches")
        sized = stored(drawn.mapInArrow(needed, "node long, part long, outside boolean, size long, short int, long int"), "loose-sizes")
        pairs = prefix_pairs(drawn.select("node", "sketch").mapInArrow(registers_of, "node long, token long"), sized)
        side = lambda k: drawn.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(compare, "a long, b long")

    return spanning_links(members, solve, finish, block)[1]


def verified_parts(around: DataFrame, classes: DataFrame, texts: DataFrame, width: int, threshold: float, block: int, block_shingles: int) -> DataFrame:
    """(node, root): the parts that the links within candidate parts make, by size, estimate and full sets."""
    percent = round(100 * threshold)
    sized = around.join(classes.select(F.col("cls").alias("node"), "n"), "node")
    sizes = sized.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s")).select(apart(F.col("root")).alias("root"), "m", "s")
    blocks = F.ceil(F.greatest(F.col("m") / block, F.least(F.col("m"), F.col("s") / block_shingles))).cast("int")
    members = stored(around.join(sizes, "root").select(F.col("root").alias("grp"), "node", F.greatest(F.lit(1), blocks).alias("blocks")), "candidates")

    def find(batches):
        unpack = zstandard.ZstdDecompressor()
        for table, new in _groups(batches, 256):
            for a, b in zip(new[:-1].tolist(), new[1:].tolist(), strict=True):
                rows = table.slice(a, b - a)
                cls, first = np.unique(rows.column("node").to_numpy(), return_index=True)  # a pivot may stand twice
                own, part = rows.column("own").to_numpy()[first], np.unique(rows.column("part").to_numpy()[first], return_inverse=True)[1]
                packed = rows.column("packed")
                sets = [shingle_sets([unpack.decompress(packed[int(k)].as_py())], width)[0] for k in first]
                regs = np.array([registers(x) for x in sets]).reshape(-1, BUCKETS)
                n = np.array([len(x) for x in sets], np.int64)

                def linked(x, others, n=n, regs=regs, sets=sets):
                    others = others[np.minimum(n[others], n[x]) * 100 >= percent * np.maximum(n[others], n[x])]
                    if not len(others):
                        return others
                    others = others[estimate(regs[x], n[x], regs[others], n[others]) >= threshold - slack(threshold, n[x], n[others])]
                    both = common_counts(sets[x], [sets[k] for k in others.tolist()])
                    return others[100 * both >= percent * (n[x] + n[others] - both)]

                i, j = rows.column("i")[0].as_py(), rows.column("j")[0].as_py()
                yield _links(cls, joined_parts(np.flatnonzero(own == i), np.flatnonzero(own == j), part, linked))

    # the texts of candidates, which grow with the corpus and are never broadcast, leave the other texts once
    keys = stored(around.select("node").join(classes.select(F.col("cls").alias("node"), "key"), "node"), "candidate-keys")
    own_texts = stored(texts.join(keys.hint("merge"), "key").select("node", "packed"), "candidate-texts")

    def solve(units: DataFrame) -> DataFrame:
        rows = units.join(own_texts.hint("merge"), "node").select("grp", "i", "j", "node", "own", "part", "packed")
        return _in_order(rows).mapInArrow(find, "a long, b long")

    def shingles_of(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for node, packed in zip(batch.column("node").to_pylist(), batch.column("packed"), strict=True):
                found = shingle_sets([unpack.decompress(packed.as_py())], width)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], names=["node", "token"])

    def compare(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            keep, one, own = [], None, None
            for k, (a, packed_a, packed_b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("packed_a"), batch.column("packed_b"), strict=True)):
                if a != one:
                    one, own = a, shingle_sets([unpack.decompress(packed_a.as_py())], width)[0]
                other = shingle_sets([unpack.decompress(packed_b.as_py())], width)[0]
                both = int(common_counts(own, [other])[0])
                if 100 * both >= percent * (len(own) + len(other) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    def finish(nodes: DataFrame) -> DataFrame:
        n, t = F.col("n"), percent / 100
        least = lambda share: F.greatest(F.lit(1), n - F.ceil(n * F.lit(share) - F.lit(1e-9)) + 1).cast("int")
        sized = nodes.join(classes.select(F.col("cls").alias("node"), "n"), "node").select("node", "part", "outside", n.alias("size"), least(2 * t / (1 + t)).alias("short"), least(t).alias("long"))
        texts_of = stored(nodes.select("node").join(own_texts.hint("merge"), "node"), "loose-texts")
        pairs = stored(prefix_pairs(texts_of.mapInArrow(shingles_of, "node long, token long"), stored(sized, "loose-sizes")), "loose-pairs")
        side = lambda k: texts_of.select(F.col("node").alias(k), F.col("packed").alias(f"packed_{k}")).hint("merge")
        return pairs.join(side("b"), "b").join(side("a"), "a").mapInArrow(compare, "a long, b long")

    return spanning_links(members, solve, finish, block)[1]


def common_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of a sorted set with others."""
    if not others:
        return np.zeros(0, np.int64)
    flat = np.concatenate(others)
    at = np.searchsorted(one, flat)
    hit = one[np.minimum(at, len(one) - 1)] == flat
    return np.add.reduceat(hit, np.concatenate([[0], np.cumsum([len(x) for x in others])[:-1]]), dtype=np.int64)


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, block: int = 512, block_shingles: int = 4_000_000) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, kept): documents linked where their sets of `width`-word shingles have a Jaccard similarity of
    threshold or more (in whole hundredths), and the smallest doc_id that links can reach.

    Documents with equal sets are one class; each class has a sketch of 128 HyperMinHash registers. Classes that share a band of four registers
    (at similarity 0.8 a pair shares no band in about 1 of 10^6 cases) are compared by the corrected estimate; those that reach the
    threshold less five deviations fall into one candidate part. Within each such part classes are then compared by size, by the estimate, and
    by their full sets, until all that links connect is connected: see spanning_links. Buckets and candidate parts are dealt in blocks of `block`
    classes, and of block_shingles shingles where texts are compared, so that none has to fit in a task.

    Nulls: a null text is empty; documents without words have n_shingles 0 and link with nothing; a null doc_id links as others do but is never
    the smallest, and is kept only where no other id is in its component. Rows equal in doc_id and text are one document and are kept or not
    together. `key` is that of shared.document_key, to join with. Other columns are left out. Empty table: no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("key", document_key()[0])
    made = stored(sketches(keyed, width), "sketches")
    classes = stored(made.where("n > 0").groupBy("cls").agg(F.first("n").alias("n"), F.min("key").alias("key"), F.first("sketch").alias("sketch")), "classes")
    around = estimated_parts(_band_rows(classes), classes, threshold, 8 * block)
    # texts are shuffled compressed: they are smaller than the hashes of their shingles
    linked = verified_parts(around, classes, packed_texts(keyed.select("key", "text")), width, threshold, block, block_shingles)
    own = made.select("doc_id", "key", "n", "cls").join(linked.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = own.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.min("key").alias("least_key")).select(apart(F.col("root")).alias("root"), "least", "least_key")
    joined = own.join(least, "root", "left")
    component = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    # without any id in the component, the least key stays
    kept = F.when(F.col("n") == 0, F.lit(True)).when(component.isNull(), F.col("key") == F.col("least_key")).otherwise(F.coalesce(F.col("doc_id") == component, F.lit(False)))
    return joined.select("doc_id", "key", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one document of each component of near_duplicates, that with the smallest doc_id; all columns pass through, whatever their names."""
    groups = near_duplicates(docs, width, threshold)
    key = free_name(docs, "near_key")
    gone = groups.where("not kept").select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, document_key()[0]).join(gone, key, "left_anti").select(*docs.columns)


def op10_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, width=2).select("doc_id", "n_shingles", "component_id", "kept")


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, CASE WHEN len(words) < 2 THEN words ELSE list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM s WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS g FROM c),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep AND a.n * 100 >= 80 * b.n AND b.n * 100 >= 80 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS node, rep AS root FROM c UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(m.root, s.doc_id) AS component_id, coalesce(m.root, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN m ON m.node = c.rep
"""
