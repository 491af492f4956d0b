"""Exact substring deduplication: suffix arrays, built in linear time by Lyndon groups, over what may repeat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import apart, document_key, packed_texts, portions, prefix_hash, span_hash, stored, unpacked


def suffix_array(text: Sequence[int]) -> list[int]:
    """The order of all suffixes of a sequence of integers, an end being smaller than any symbol.

    Linear: suffixes start in a group each by their first symbol. Groups are taken from the greatest down. A group's members leave a linked list
    of positions; what is then to the left of a member is its previous smaller suffix, whose Lyndon prefix goes on over that member. Those
    suffixes move, by how many members they are followed by, into new groups right above their own. In the end a group holds the suffixes of
    one Lyndon prefix; a pass over the groups from the least suffix on then puts each suffix, and along the pointers those before it, at the
    next place of its group.
    """
    n = len(text)
    if not n:
        return []
    left, right = list(range(-1, n)), list(range(1, n + 2))  # right[-1] and left[n] serve as ends
    group, smaller = [0] * n, [-1] * n
    symbols = sorted(set(text))
    members: list[list[int]] = [[] for _ in symbols]
    name = {c: g for g, c in enumerate(symbols)}
    for i, c in enumerate(text):
        g = group[i] = name[c]
        members[g].append(i)
    below = list(range(-1, len(symbols) - 1))
    above = [*range(1, len(symbols)), -1]
    top = len(symbols) - 1
    lowest, g = 0, top
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        counts: list[list[int]] = []
        last = -1
        for i in own:
            p = left[i]
            q = right[i]
            left[q] = p
            if p >= 0:
                right[p] = q
                if p == last:
                    counts[-1][1] += 1
                else:
                    counts.append([p, 1])
                    last = p
            smaller[i] = p
        if counts:
            by: dict[int, dict[int, list[int]]] = {}
            for p, k in counts:
                by.setdefault(k, {}).setdefault(group[p], []).append(p)
            for k in sorted(by, reverse=True):
                for old, moved in by[k].items():
                    new = len(members)
                    members.append(moved)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = new
                    below[up] = new
                    for p in moved:
                        group[p] = new
        g = below[g]
    # the first place of each group, in order
    place = [0] * len(members)
    g, at = lowest, 0
    while g >= 0:
        place[g] = at
        at += len(members[g])
        g = above[g]
    order = [-1] * n
    done = bytearray(n)
    for i in range(-1, n):
        s = (order[i] if i >= 0 else n) - 1
        while s >= 0 and not done[s]:
            done[s] = 1
            g = group[s]
            order[place[g]] = s
            place[g] += 1
            s = smaller[s]
    return order


def common_prefixes(text: Sequence[int], order: list[int]) -> list[int]:
    """For each rank the symbols that its suffix shares with the one before (Kasai and others)."""
    n = len(text)
    rank = [0] * n
    for r, i in enumerate(order):
        rank[i] = r
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            most = n - max(i, j)
            while h < most and text[i + h] == text[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def _shared_length(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _levels(strings: list[bytes]) -> tuple[np.ndarray, list[int], np.ndarray]:
    """Of strings: the depths at which any two of them part or end, the longest prefix that each shares with another, and for each depth (row)
    the class of each string's prefix up to there."""
    order = sorted(range(len(strings)), key=strings.__getitem__)
    near = np.array([_shared_length(strings[a], strings[b]) for a, b in zip(order, order[1:], strict=False)], np.int64)
    most = np.zeros(len(strings), np.int64)
    most[order[1:]] = near
    most[order[:-1]] = np.maximum(most[order[:-1]], near)
    depths = np.unique(near[near > 0])
    classes = np.zeros((len(depths), len(strings)), np.int64)
    for k, d in enumerate(depths.tolist()):
        classes[k, order] = np.concatenate([[0], np.cumsum(near < d)])
    return depths, most.tolist(), classes


class Repeats:
    """Finds which windows of contexts repeat. Contexts of one key hold the same span of `inner` bytes, with `before` and `after` around it."""

    def __init__(self, window: int, inner: int):
        self.rest = window - inner
        self.text: list[int] = []
        self.starts: list[tuple[int, int, list[int], list[int]]] = []  # place in text, context, depths before (descending), depths after
        self.contexts: list[tuple[int, int]] = []
        self.names: list = []
        self.symbol = 0

    def add(self, contexts: list[tuple[object, bytes, bytes, int, int]]) -> None:
        """The contexts of one key, all different: a name, before, after, and the range of bytes before the span at which its windows begin.

        Depths at which some two contexts part are the only ends that a repeat can have; between them, bytes become one symbol each: its number
        stands for the whole of a context from the span up to that depth, so suffixes match only where they stand alike.
        """
        rest = self.rest
        before = [x[1][::-1] for x in contexts]
        after = [x[2] for x in contexts]
        d_before, m_before, c_before = _levels(before)
        d_after, m_after, c_after = _levels(after)
        base = self.symbol + 1
        width = len(contexts)
        self.symbol += (len(d_before) + len(d_after)) * width
        for i, (name, _, _, low, high) in enumerate(contexts):
            if m_before[i] + m_after[i] < rest or max(low, rest - m_after[i]) > min(high, m_before[i]):
                continue
            nb = int(np.searchsorted(d_before, m_before[i], "right"))
            na = int(np.searchsorted(d_after, m_after[i], "right"))
            place = len(self.text)
            self.text += [base + k * width + int(c_before[k, i]) for k in range(nb - 1, -1, -1)]
            self.text += [base + (len(d_before) + k) * width + int(c_after[k, i]) for k in range(na)]
            self.symbol += 1
            self.text.append(-self.symbol)  # an end like no other
            self.starts.append((place, len(self.contexts), d_before[:nb][::-1].tolist(), d_after[:na].tolist()))
            self.contexts.append((low, high))
            self.names.append(name)

    def solve(self) -> dict:
        """name -> ranges (first, last) of windows' starts, in bytes before the span, that another context has too."""
        order = suffix_array(self.text)
        shared = common_prefixes(self.text, order)
        rank = [0] * len(order)
        for r, i in enumerate(order):
            rank[i] = r
        shared.append(0)
        found: dict = {}
        for place, c, before, after in self.starts:
            low, high = self.contexts[c]
            ranges = []
            for k in range(len(before) + 1):
                r = rank[place + k]
                m = max(shared[r], shared[r + 1]) - (len(before) - k)
                if m < 0:
                    continue
                far = after[m - 1] if m else 0
                a, b = max(low, self.rest - far), min(high, before[k] if k < len(before) else 0)
                if a <= b:
                    ranges.append((a, b))
            if ranges:
                found[self.names[c]] = ranges
        return found


def window_runs(texts: list[bytes], window: int, inner: int) -> dict[str, np.ndarray]:
    """The windows of texts in runs of one minimiser: the span of `inner` bytes in a window with the least hash, the first of equal ones.

    For each run: the text, first and number of windows' starts, the span's place, its hash (key), and a hash of all bytes of the run (ctx).
    Equal windows have equal minimisers at the same place in them, wherever the windows stand.
    """
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(x) for x in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    w, n = window - inner + 1, len(data)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "first", "count", "span", "key", "ctx")}
    if n < window:
        return empty
    prefix = prefix_hash(data)
    at = np.arange(n - inner + 1)
    hashed = span_hash(prefix, at, at + inner)
    m = len(at)
    low = (hashed & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)  # the place settles ties
    grid = np.concatenate([low, np.full(-m % w + w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    del low
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    del grid
    least = (np.minimum(back[:m], ahead[w - 1 : w - 1 + m]) & np.uint64(0xFFFFFF)).astype(np.int64)
    del ahead, back
    long = np.flatnonzero(sizes >= window)
    if not len(long):
        return empty
    edge = np.zeros(n + 2, np.int8)
    np.add.at(edge, offsets[long], 1)
    np.add.at(edge, offsets[long] + sizes[long] - window + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    span = least[start]
    text = np.searchsorted(offsets, start, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (span[1:] != span[:-1]) | (text[1:] != text[:-1])]))
    first, count = start[new], np.diff(np.append(new, len(start)))
    span, text = span[new], text[new]
    return {"text": text, "first": first - offsets[text], "count": count, "span": span - offsets[text], "key": hashed[span].view(np.int64), "ctx": span_hash(prefix, first, first + count - 1 + window).view(np.int64)}


def _pieces(text: bytes, window: int, most: int = 1 << 20):
    """A long text in pieces that share all but one byte of a window, so that each window is in one of them."""
    step = most - window + 1
    for a in range(0, max(1, len(text) - window + 1), step):
        yield a, text[a : a + most]


def split_large_groups(contexts: DataFrame, rest: int, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Groups of contexts of at most `most` each, and the windows (key, ctx, low, high) that were found to repeat on the way (None: no group was larger).

    contexts: key, ctx, grp, lo, hi, low, high, before, after. Those of one grp share lo bytes before the span and rest - hi after it, and only
    windows that begin from lo to hi bytes before the span concern them. A larger group is split in the middle of that range: windows that begin
    at or beyond it can only equal those of contexts with the same bytes from there to the span, the others only those with the same bytes after
    the span as far as they all reach. So each window goes to one half, in a group of those that share half of what was open. Contexts that agree
    in all bytes of their windows there repeat each other as a whole (two 64-bit hashes say so); one of them goes on. Ranges halve, and a range of
    one window leaves one context to a group, so it ends.
    """
    ready, repeated = None, None
    while True:
        large = stored(contexts.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("grp"), "large-groups")
        if large.isEmpty():
            return (contexts if ready is None else ready.unionByName(contexts)), repeated
        fit = contexts.join(large, "grp", "left_anti")
        ready = fit if ready is None else ready.unionByName(fit)
        mid = F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int")
        open_ = contexts.join(large, "grp", "left_semi").withColumn("mid", mid)
        near = (
            open_.where("low < mid")
            .withColumn("grp", F.xxhash64("grp", F.lit(0), F.expr(f"substring(after, 1, {rest} - mid + 1)")))
            .withColumn("hi", F.col("mid") - 1)
            .withColumn("high", F.least("high", F.col("mid") - 1))
        )
        far = (
            open_.where("high >= mid")
            .withColumn("grp", F.xxhash64("grp", F.lit(1), F.expr("substring(before, length(before) - mid + 1, mid)")))
            .withColumn("lo", F.col("mid"))
            .withColumn("low", F.greatest("low", "mid"))
        )
        cut = (
            near.unionByName(far)
            .withColumn("before", F.expr("substring(before, length(before) - high + 1, high)"))
            .withColumn("after", F.expr(f"substring(after, 1, {rest} - low)"))
            .withColumn("same_a", F.xxhash64("before", "after"))
            .withColumn("same_b", F.xxhash64(F.lit(1), "after", "before"))
            .drop("mid")
        )
        cut = stored(cut, "split-groups")
        alike = ["grp", "low", "high", "same_a", "same_b"]
        counts = cut.groupBy(*alike).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*alike[:-1], apart(F.col("same_b")).alias("same_b"))
        again = stored(cut.join(counts, alike).select("key", "ctx", "low", "high"), "repeated-windows")
        repeated = again if repeated is None else repeated.unionByName(again)
        names = ("key", "ctx", "lo", "hi", "before", "after")
        contexts = stored(cut.groupBy(*alike).agg(F.first(F.struct(*names)).alias("one")).select("grp", "low", "high", "one.*"), "contexts")


def repeated_windows(docs: DataFrame, window: int, inner: int, solve_symbols: int = 100_000, group: int = 2000) -> DataFrame:
    """(dkey, spans): for each document (dkey, text) the ranges (first, last) of starts of windows that also start elsewhere in the corpus.

    1. Windows fall into runs by their minimiser. Only hashes go through the shuffle: runs whose key occurs once have no repeats.
    2. Runs that are equal as a whole, by key and ctx, repeat as a whole; one of them stands for all. Both are hashes of 64 bits, of the span and
       of all bytes of the run: for two different runs to pass for equal, both would have to collide, once in 2^128 of the pairs.
    3. Different runs of one key are fetched, once each, and compared with each other: the suffix array of their symbols gives for each the
       windows that another one has. A key with more than `group` of them is split by longer spans first.

    A key that very many runs share stands in no single task: it is summed before each shuffle, and joins with it are between two plain shuffles,
    whose large partitions adaptive execution splits.
    """

    def find(batches):
        for batch, texts in (x for whole in batches for x in portions(whole, most=1 << 20)):
            whole = [(0, x) for x in texts] if max(map(len, texts)) <= 2 << 20 else None
            owner = np.arange(len(texts))
            if whole is None:
                cut = [(i, *x) for i, t in enumerate(texts) for x in _pieces(t, window)]
                owner, whole = np.array([x[0] for x in cut]), [x[1:] for x in cut]
            groups = [range(len(whole))] if len(whole) == len(texts) else [[k] for k in range(len(whole))]
            for g in groups:
                runs = window_runs([whole[k][1] for k in g], window, inner)
                if not len(runs["text"]):
                    continue
                piece = np.asarray(list(g))[runs["text"]]
                shift = np.array([x[0] for x in whole], np.int64)[piece]
                dkey = batch.column("dkey").to_numpy()[owner[piece]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(runs["key"]), pa.array(runs["ctx"]), pa.array(dkey), pa.array(runs["first"] + shift), pa.array(runs["count"].astype(np.int32)), pa.array((runs["span"] - runs["first"]).astype(np.int32))],
                    names=["key", "ctx", "dkey", "first", "count", "high"],
                )

    runs = stored(docs.select("dkey", "text").mapInArrow(find, "key long, ctx long, dkey long, first long, count int, high int"), "runs")
    twice = runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(apart(F.col("key")).alias("key"))
    runs = stored(runs.join(twice, "key", "left_semi"), "shared-runs")
    # the columns of one row: they are set together
    classes = stored(runs.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("dkey", "first", "count", "high")]), "run-classes")
    mixed = classes.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(apart(F.col("key")).alias("key"))
    fetch = classes.join(mixed, "key", "left_semi").groupBy("dkey").agg(F.collect_list(F.struct("key", "ctx", "first", "count", "high")).alias("wanted"))

    def read(batches):
        names = ("key", "ctx", "low", "high", "before", "after")
        for batch, texts in unpacked(batches):
            for text, wanted in zip(texts, batch.column("wanted"), strict=True):
                out = {k: [] for k in names}
                for x in wanted.as_py():
                    span, low = x["first"] + x["high"], x["high"] - x["count"] + 1
                    row = (x["key"], x["ctx"], low, x["high"], text[x["first"] : span], text[span + inner : x["first"] + x["count"] - 1 + window])
                    for k, v in zip(names, row, strict=True):
                        out[k].append(v)
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(out[k], t) for k, t in zip(names, kinds, strict=True)], names=list(names))

    contexts = packed_texts(docs.select("dkey", "text")).join(fetch, "dkey").select("packed", "wanted").mapInArrow(read, "key long, ctx long, low int, high int, before binary, after binary")
    contexts = stored(contexts.withColumns({"grp": F.col("key"), "lo": F.lit(0), "hi": F.lit(window - inner)}), "contexts")
    contexts, repeated = split_large_groups(contexts, window - inner, group)

    def solve(batches):
        todo, grp, own = Repeats(window, inner), None, []

        def done():
            out = todo.solve()
            ranges = [[{"low": a, "high": b} for a, b in v] for v in out.values()]
            kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.int64()), pa.array([k[1] for k in out], pa.int64()), pa.array(ranges, kind)], names=["key", "ctx", "ranges"])

        for batch in batches:
            for k, ctx, g, low, high, before, after in zip(*(batch.column(c).to_pylist() for c in ("key", "ctx", "grp", "low", "high", "before", "after")), strict=True):
                if g != grp:
                    if len(own) > 1:
                        todo.add(own)
                    if len(todo.text) >= solve_symbols:
                        yield done()
                        todo = Repeats(window, inner)
                    grp, own = g, []
                own.append(((k, ctx, g), before, after, low, high))
        if len(own) > 1:
            todo.add(own)
        yield done()

    by_group = contexts.repartition("grp").sortWithinPartitions("grp", "ctx", "low")
    partly = by_group.mapInArrow(solve, "key long, ctx long, ranges array<struct<low:int,high:int>>")
    if repeated is not None:  # then one run has its windows in several groups
        partly = partly.unionByName(repeated.select("key", "ctx", F.array(F.struct("low", "high")).alias("ranges")))
        partly = partly.groupBy("key", "ctx").agg(F.flatten(F.collect_list("ranges")).alias("ranges"))
    flagged = classes.where("n > 1").select("key", "ctx", F.lit(None).cast("array<struct<low:int,high:int>>").alias("ranges"))
    once = classes.where("n = 1").select("key", "ctx").join(stored(partly, "partly"), ["key", "ctx"])
    marks = runs.join(stored(flagged.unionByName(once), "flags"), ["key", "ctx"])
    whole = F.array(F.struct((F.col("high") - F.col("count") + 1).alias("low"), F.col("high").alias("high")))
    spans = F.transform(F.coalesce("ranges", whole), lambda x: F.struct((F.col("first") + F.col("high") - x["high"]).alias("a"), (F.col("first") + F.col("high") - x["low"]).alias("b")))
    # a document's own runs, so no more than its bytes
    return marks.select("dkey", spans.alias("spans")).groupBy("dkey").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def drop_repeated_strings(docs: DataFrame, window: int = 400, inner: int = 200) -> DataFrame:
    """Removes each byte of a text that a string of `window` bytes covers which also starts anywhere else in the corpus, the same text included.

    docs: doc_id, text; other columns do not count. Returns doc_id, kept (the bytes that are left, which may cut a character), n_bytes, n_removed and n_spans (maximal runs
    removed) for each row. Strings are those of the texts as given; matches never cross texts. inner is the length of the spans by which
    windows meet; it changes the cost only.

    Nulls: a null text is empty; a null doc_id is a document like others. Repeated rows are documents each, so all of a repeated text of window
    bytes or more goes. Texts shorter than window stay. Other columns are left out. Empty table: no rows.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("dkey", document_key()[0])
    joined = packed_texts(keyed).join(repeated_windows(keyed, window, inner), "dkey", "left").select("doc_id", "packed", "spans")

    def cut(batches):
        for batch, texts in unpacked(batches):
            kept, made = [], {"n_bytes": [], "n_removed": [], "n_spans": []}
            for text, spans in zip(texts, batch.column("spans"), strict=True):
                gone = []
                for a, b in sorted((x["a"], x["b"] + window) for x in spans.as_py() or []):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                left, at = [], 0
                for a, b in gone:
                    left.append(text[at:a])
                    at = b
                left.append(text[at:])
                kept.append(b"".join(left))
                made["n_bytes"].append(len(text))
                made["n_removed"].append(len(text) - len(kept[-1]))
                made["n_spans"].append(len(gone))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kept, pa.binary()), *(pa.array(v, pa.int64()) for v in made.values())], names=["doc_id", "kept", *made])

    return joined.mapInArrow(cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digest, has_repeats says whether a document lost bytes, and text is what is left of it (bytes that are no UTF-8 as U+FFFD)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    left = F.make_valid_utf8(F.col("kept").cast("string")).alias("text")
    return drop_repeated_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("has_repeats"), left)
