"""Substring deduplication over sliding runs of consecutive sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import apart, document_key, mix64, packed_texts, portions, prefix_hash, span_hash, stored, unpacked

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_PAUSE = np.zeros(256, bool)
_PAUSE[list(b",;:")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Sentences:
    """The sentences of a batch of texts, as arrays over all of them: doc, start and end (bytes, white space after it not included), words, and whether a
    whole sentence begins there.

    A sentence ends at white space after one of .!? and at each line end. One of more than long_words words is cut into its clauses, which end after one
    of ,;: as well: a passage may begin and end within sentences, and of long ones it would hold too few.
    """

    def __init__(self, texts: list[bytes], long_words: int = 20):
        self.data = np.frombuffer(b"\n".join(texts), np.uint8)
        sizes = np.array([len(x) + 1 for x in texts], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        ink = np.flatnonzero(~_SPACE[self.data])
        if not len(ink):
            self.doc = self.start = self.end = self.words = np.zeros(0, np.int64)
            self.whole = np.zeros(0, bool)
            return
        lines = np.cumsum(self.data == 10)
        gap = np.flatnonzero(np.diff(ink) > 1)
        before, word = ink[gap], ink[gap + 1]
        cut = _STOP[self.data[before]] | (lines[word] > lines[before])
        sentence = np.cumsum(cut)  # of the word after each gap; that before it is in the same one, unless it is cut there
        long = np.bincount(np.concatenate([[0], sentence])) > long_words
        ends = cut.copy()
        cut |= _PAUSE[self.data[before]] & long[sentence]
        self.whole = np.concatenate([[True], ends[cut]])
        self.start = np.concatenate([ink[:1], word[cut]])
        self.end = np.concatenate([before[cut] + 1, ink[-1:] + 1])
        starts = np.concatenate([ink[:1], word])
        at = np.searchsorted(starts, self.start)
        self.words = np.diff(np.append(at, len(starts)))
        self.doc = np.searchsorted(self.offsets, self.start, "right") - 1

    def runs(self, n: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First place, the one after the last, hash and size in bytes of the runs of each text, in order of their first places, and whether they are runs of whole
        sentences: every run of n consecutive sentences, all of a text with fewer; and, from each clause on and up to each, the shortest run of n
        clauses or more that has least_words words."""
        m = len(self.start)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
        prefix = prefix_hash(_LOWER[self.data])
        own = span_hash(prefix, self.start, self.end)
        first = np.searchsorted(self.doc, self.doc, "left")
        last = np.searchsorted(self.doc, self.doc, "right")
        # whole sentences
        w = np.flatnonzero(self.whole)
        low, high = np.searchsorted(self.doc[w], self.doc[w], "left"), np.searchsorted(self.doc[w], self.doc[w], "right")
        past = np.arange(len(w)) + np.minimum(n, high - low)
        inside = past <= high
        ends = np.where(past < high, np.append(w, m)[np.minimum(past, len(w))], last[w])
        sentences = w[inside] * (m + 1) + ends[inside]
        # clauses
        least = np.minimum(n, last - first)
        words = np.concatenate([[0], np.cumsum(self.words)])
        sizes = np.concatenate([[0], np.cumsum(self.end - self.start)])
        at = np.arange(m)
        since = np.minimum(at + 1 - least, np.searchsorted(words, words[at + 1] - least_words, "right") - 1)
        to = np.maximum(at + least, np.searchsorted(words, words[at] + least_words, "left"))
        ahead, back = to <= last, since >= first
        pairs = np.unique(np.concatenate([sentences, at[ahead] * (m + 1) + to[ahead], since[back] * (m + 1) + at[back] + 1]))
        of_sentences = np.isin(pairs, sentences)
        at, to = pairs // (m + 1), pairs % (m + 1)
        hashed, live, k = np.zeros(len(at), np.uint64), np.arange(len(at)), 0
        while len(live):
            hashed[live] = mix64(hashed[live] + own[at[live] + k])
            k += 1
            live = live[at[live] + k < to[live]]
        return at, to, hashed, sizes[to] - sizes[at], of_sentences

    def first_of_their_text(self, at: np.ndarray, hashed: np.ndarray) -> np.ndarray:
        """Of runs, whether no equal one stands before it in its text."""
        order = np.lexsort((at, hashed, self.doc[at]))
        again = np.zeros(len(at), bool)
        doc, run = self.doc[at][order], hashed[order]
        again[order[1:]] = (doc[1:] == doc[:-1]) & (run[1:] == run[:-1])
        return ~again


def sentence_runs(docs: DataFrame, n: int, least_words: int) -> DataFrame:
    """(run, size, place, key, sentence, past) from docs (place, key, text): a hash of each different run of a text with its bytes, and the numbers
    in the text of its first place and of the one after its last, where it stands first; `past` is negative for a run of clauses."""

    def find(batches):
        for batch, texts in (x for whole in batches for x in portions(whole)):
            found = Sentences(texts)
            at, to, hashed, size, whole = found.runs(n, least_words)
            new = found.first_of_their_text(at, hashed)
            if not len(at):
                continue
            at, to, hashed, size, whole = at[new], to[new], hashed[new], size[new], whole[new]
            doc = found.doc[at]
            first = np.searchsorted(found.doc, doc, "left")
            pick = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashed.view(np.int64)), pa.array(size.astype(np.int32)), batch.column("place").take(pick), batch.column("key").take(pick), pa.array((at - first).astype(np.int32)), pa.array((np.where(whole, 1, -1) * (to - first)).astype(np.int32))],
                names=["run", "size", "place", "key", "sentence", "past"],
            )

    return docs.select("place", "key", "text").mapInArrow(find, "run long, size int, place decimal(38,0), key long, sentence int, past int")


def drop_repeated_runs(docs: DataFrame, n: int = 3, least_words: int = 20) -> DataFrame:
    """Removes the sentences that lie in a run of sentences which an earlier document, or the same one before, holds too.

    Every run of n consecutive sentences is hashed, however short they are, and all of a text that has fewer: so a repeated passage of n sentences is
    covered from end to end, and of equal texts one stays. Beside these, as passages begin and end within sentences, sentences of more than 20 words are taken by
    their clauses: from each clause on, and up to each, the shortest run of n clauses or more that has least_words words counts as well.

    docs: doc_id, text. Returns for each row doc_id, n_removed (sentences, or clauses of those of more than 20 words), n_spans (maximal removed runs), n_sentences
    (counted alike), n_by_clauses (what only runs of clauses removed), and text, what is left. The first of equal runs, by doc_id (nulls first), then by a
    hash of the text, then by place, stays. Sentences compare without regard to A-Z case or to the white space between them.

    Nulls: a null text is empty and loses nothing. Rows equal in doc_id and text are one document: none of them is a copy of the other. Other
    columns are left out. Empty table: no rows. Only hashes are shuffled to find repeats, counted before the shuffle; texts, compressed, to be cut.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", document_key()[0])
    # the order of documents in one number, so that its least is kept in place by a hash aggregate
    place = F.coalesce("doc_id", F.lit(-(2**63))).cast("decimal(19,0)") * F.lit(2**60).cast("decimal(19,0)") + F.shiftrightunsigned("key", 4).cast("decimal(19,0)")
    runs = stored(sentence_runs(keyed.withColumn("place", place.cast("decimal(38,0)")), n, least_words), "sentence-runs")
    repeated = runs.groupBy("run", "size").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first")).where("n > 1").select(apart(F.col("run")).alias("run"), "size", "first")
    later = runs.join(repeated, ["run", "size"]).where(F.col("place") != F.col("first"))
    # a document's own sentences, so no larger than the document
    marks = later.groupBy("key").agg(F.collect_list(F.struct("sentence", "past")).alias("runs"))
    marked = packed_texts(keyed).join(marks, "key", "left").select("doc_id", "packed", "runs")
    names = ("n_removed", "n_spans", "n_sentences", "n_by_clauses")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(k, T.LongType()) for k in names), T.StructField("text", T.StringType())])

    def cut(batches):
        for batch, texts in unpacked(batches):
            found = Sentences(texts)
            m = len(found.start)
            # where removed runs begin and end: those of whole sentences, and those of clauses
            edges = np.zeros((2, m + 1), np.int64)
            at, to, hashed, _, whole = found.runs(n, least_words)
            again = ~found.first_of_their_text(at, hashed)
            kind = (~whole[again]).astype(np.int64)
            np.add.at(edges, (kind, at[again]), 1)
            np.add.at(edges, (kind, to[again]), -1)
            upto = np.searchsorted(found.doc, np.arange(len(texts) + 1))
            for i, runs in enumerate(batch.column("runs")):
                for run in runs.as_py() or ():
                    edge = edges[int(run["past"] < 0)]
                    edge[upto[i] + run["sentence"]] += 1
                    edge[upto[i] + abs(run["past"])] -= 1
            by_sentences, by_clauses = np.cumsum(edges, axis=1)[:, :m] > 0
            gone = by_sentences | by_clauses
            kept, made = [], {k: [] for k in names}
            for i, text in enumerate(texts):
                a, b = int(upto[i]), int(upto[i + 1])
                mine = gone[a:b]
                made["n_sentences"].append(b - a)
                made["n_removed"].append(int(mine.sum()))
                made["n_by_clauses"].append(int((mine & ~by_sentences[a:b]).sum()))
                ends = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                made["n_spans"].append(len(ends) // 2)
                if len(ends):
                    bounds = np.append(found.start[a:b] - found.offsets[i], len(text))[ends].tolist()
                    text = b"".join(text[x:y] for x, y in zip([0, *bounds[1::2]], [*bounds[::2], len(text)], strict=True))
                kept.append(text.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, pa.int64()) for v in made.values()), pa.array(kept, pa.string())], names=["doc_id", *made, "text"])

    return marked.mapInArrow(cut, schema)


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return drop_repeated_runs(docs).select("doc_id", "n_removed", "n_spans", (F.col("n_removed") > 0).alias("has_repeats"), "text", "n_by_clauses")
