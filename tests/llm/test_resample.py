"""Importance resampling against a version by dictionaries, and its odd cases."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tidewater.llm")

from tidewater.llm import resample  # noqa: E402

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text, longest):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def brute(rows, target, longest=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = collections.Counter(bucket(f) for _, x in rows for f in features(x, longest)[1])
    t = collections.Counter(bucket(f) for x in target for f in features(x, longest)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        w, f = features(x, longest)
        weight = sum(gain[bucket(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    order = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = order[: len(order) * percent // 100]
    return sorted(((*r[:4], next((k for k, y in enumerate(drawn, 1) if y is r), None)) for r in out), key=str)


def got(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


ROWS = [
    (1, "One two, THREE four-five " * 9), (1, "One two, THREE four-five " * 9), (2, None), (3, ""), (None, "é ü ÄÖ word2vec 42 " * 6), (4, "\x00,;. \n"), (5, "tail " * 19), (6, "tail " * 20),
    *[(i, " ".join(f"w{(i * k) % 37}" for k in range(15 + i % 30))) for i in range(10, 90)], (7, "long " * 50_000),
]
TARGET = ["w1 w2 w3 tail", None, "", "three four w5 w6 É"]


@pytest.mark.parametrize("longest,buckets,percent", [(1, 10_000, 10), (3, 97, 50), (2, 10_000, 100), (1, 10, 0)])
def test_resample(spark, longest, buckets, percent):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(5)
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    made = resample.resample(docs, target, longest=longest, buckets=buckets, percent=percent)
    assert got(made) == brute(ROWS, TARGET, longest, buckets, percent)


def test_documents(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert got(resample.op11_word_tries(spark, small)) == brute(rows, target)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"ab", "é".encode()]), max_size=12), max_size=5), st.integers(1, 4))
def test_trie_holds_counts_and_check_sums(texts, longest):
    trie, runs = resample.WordTrie(longest, 1 << 20), collections.Counter()
    for t in texts:
        nodes = trie.walk(t)
        trie.add(np.array(nodes, np.int64))
        mine = [b" ".join(t[i : i + k]) for k in range(1, longest + 1) for i in range(len(t) - k + 1)]
        assert [trie.crc[n] for n in nodes] == [zlib.crc32(x) for x in mine]
        runs.update(zlib.crc32(x) % (1 << 20) for x in mine)
    assert dict(runs) == {k: n for k, n in enumerate(trie.totals()) if n}


def test_small_tries_change_nothing(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    for longest in (1, 2):
        assert sorted(resample.bucket_totals(docs, longest, most_nodes=1).collect()) == sorted(resample.bucket_totals(docs, longest).collect())
        gains = np.arange(10_000) - 5000
        assert sorted(resample.weighted(docs, gains, longest, most_nodes=1).collect(), key=str) == sorted(resample.weighted(docs, gains, longest).collect(), key=str)


def test_clashing_names_empty_tables_and_ties(spark):
    schema = "doc_id long, text string, score string, rank string, place string, _row string, _at string, _range string, n string, bucket string"
    docs = spark.createDataFrame([(3, "same words " * 20, *"abcdefgh")] * 40 + [(None, "same words " * 20, *"abcdefgh")] * 40, schema)
    target = spark.createDataFrame([("other",)], "text string")
    out = resample.resample(docs, target, percent=30)
    assert out.columns == ["doc_id", "place", "_row", "_at", "_range", "n", "bucket", "n_words", "n_features", "weight", "score", "rank"]
    rows = out.collect()
    assert len(rows) == 80 and all((r.place, r["_row"], r["_at"], r["_range"], r.n, r.bucket) == tuple("cdefgh") for r in rows)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, 25))
    assert resample.resample(docs.limit(0), target).count() == 0 and resample.resample(docs, target.limit(0)).count() == 80
