"""Divergence of sources against a version by dictionaries and whole numbers of any size, and its odd cases."""

import collections
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tidewater.llm")

from tidewater.llm import divergence  # noqa: E402

TERMS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, least=10, ranks=10):
    """rows: (text, lang, source)."""
    terms, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        found = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in TERMS.findall(text or "")]
        terms[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang in {a for a, _ in terms}:
        kept = sorted((t for t, n in df[lang].items() if n >= least), key=str.encode)
        v = len(kept)
        sources = sorted(s for a, s in terms if a == lang)
        share = lambda count, n: 1 + 1_000_000_000 * (count + 2) // (n + 2 * v)
        total = {s: sum(terms[lang, s][t] for t in kept) for s in sources}
        p = {s: [share(terms[lang, s][t], total[s]) for t in kept] for s in sources}
        q = [share(sum(terms[lang, s][t] for s in sources), sum(total.values())) for t in kept]
        gap = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((-sum(map(gap, p[s], p[o])), o.encode()) for o in sources if o != s))
            best = sorted((-gap(a, b), t.encode()) for t, a, b in zip(kept, p[s], q) if terms[lang, s][t] and a > b)[:ranks]
            for part, found in (("pair", pairs), ("term", best)):
                out += [(lang, s, part, x.decode(), -value, k) for k, (value, x) in enumerate(found, 1)]
    return sorted(out)


def _texts(seed):
    rng = np.random.default_rng(seed)
    words = ["the", "THE", "é", "É", "zeta", "alpha", "漢字", "x1y", "b'c", "rare"] + [f"t{chr(97 + k)}" for k in range(26)]
    rows = []
    for k in range(400):
        n = int(rng.integers(0, 30))
        rows.append((" ".join(rng.choice(words[:9] + words[10:], n)), [None, "", "de", "en"][k % 4], [None, "", "a", "b", "ü", "c"][int(rng.integers(0, 6))]))
    return rows + [(None, "en", "silent"), ("", "only", "one"), ("few words", "zz", "p"), (None, "zz", "q"), ("many " * 40_000, "en", "a"), ("rare", "en", "a")] + [("the same row", "en", "b")] * 30


@pytest.mark.parametrize("chunk,block,portion", [(4096, 128, 8 << 20), (5, 2, 200), (1, 1, 1)])
def test_against_dictionaries(spark, chunk, block, portion, monkeypatch):
    rows = _texts(chunk)
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows], "text string, lang string, source string, term string, value string").repartition(3)
    monkeypatch.setattr(divergence, "group_terms", lambda d, f=divergence.group_terms: f(d, portion))
    got = sorted(tuple(r) for r in divergence.source_divergence(docs, chunk=chunk, block=block).collect())
    assert got == brute(rows)


def test_documents(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in divergence.op13_source_divergence(spark, small).collect()) == brute(rows)


def test_empty_and_single(spark):
    schema = "text string, lang string, source string"
    assert divergence.source_divergence(spark.createDataFrame([], schema)).count() == 0
    assert divergence.source_divergence(spark.createDataFrame([("a b", "x", "y")] * 20, schema)).collect() == []  # p is never over q, and no other source
    two = divergence.source_divergence(spark.createDataFrame([("a", "x", None), ("b", "x", "s")], schema)).collect()
    assert sorted(tuple(r) for r in two) == [("x", "", "pair", "s", 0, 1), ("x", "s", "pair", "", 0, 1)]


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**13), st.integers(0, 10**13), st.integers(1, 10**9))
def test_shares_are_exact(count, more, kept):
    total = count + more
    assert int(divergence.shares(np.array([count], np.int64), np.int64(total), kept)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * kept)


def test_ids_keep_the_order_of_bytes():
    names, ids = divergence.encoded([x.encode() for x in ["z", "é", "a", "z", "漢", "Z"]])
    assert names == sorted(names) and [names[i].decode() for i in ids] == ["z", "é", "a", "z", "漢", "Z"]
