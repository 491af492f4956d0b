"""Tokenizer rules against counts by hand, for every row, and bands that find what is planted."""

import collections
import math
import os
import random
import re
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tidewater.llm")

from tidewater.llm import fertility  # noqa: E402

pytestmark = pytest.mark.skipif(not os.path.isdir(fertility.VOCABULARIES), reason="no vocabularies here")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORDS.findall(text)
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    met = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {j for i in range(len(w) - 7) if met[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again)


def entropy(ids, window=128):
    total = 0.0
    for k in range(0, len(ids), window):
        part = ids[k : k + window]
        n = len(part)
        h = -sum(c / n * math.log2(c / n) for c in collections.Counter(part).values())
        total += n * (h / math.log2(n) if n > 1 else 1.0)
    return total / len(ids)


def quartile(values, q):
    """The linear quartile."""
    v = sorted(values)
    at = q * (len(v) - 1)
    low = math.floor(at)
    return v[low] + (at - low) * (v[min(low + 1, len(v) - 1)] - v[low])


def spark_round(x, digits):
    return math.copysign(math.floor(abs(x) * 10**digits + 0.5) / 10**digits, x)


def brute(rows, encode, parts, fence=3.0, margins=(1.5, 0.5, 0.3), least_documents=30, sure=1024):
    """(doc_id, base..., base_failed, kept) for rows (doc_id, text, lang)."""
    seen = []
    for i, text, lang in rows:
        b = base(text)
        ids = encode([" ".join(WORDS.findall(text or ""))])[0]
        m = (b[1] / len(ids), float(np.mean(parts[ids])), entropy(ids)) if ids else (None,) * 3
        seen.append((i, b, b[0] < 20 or 100 * b[4] > 30 * b[0], lang, fertility.scripts([(text or "").encode()])[0], m, min(len(ids), sure)))
    groups = collections.defaultdict(list)
    for r in seen:
        if not r[2]:
            for key in (("lang", r[3]), ("script", r[4]), ("all", "")):
                groups[key].append(r)
    bands = {}
    for key, g in groups.items():
        if len(g) >= least_documents and key[1] is not None:
            for k in range(3):
                centre = quartile([spark_round(r[5][k], 3) for r in g], 0.5)
                off = [spark_round((r[5][k] - centre) * math.sqrt(r[6]), 2) for r in g]
                bands.setdefault(key, []).append((centre, quartile(off, 0.25), quartile(off, 0.75)))
    out = {}
    for i, b, failed, lang, script, m, n in seen:
        band = next((bands[x] for x in (("lang", lang), ("script", script), ("all", "")) if x in bands), None)
        bad = False
        if band and not failed:
            for k, margin in enumerate(margins):
                centre, low, high = band[k]
                off, reach = (m[k] - centre) * math.sqrt(n), max(fence * (high - low), margin)
                bad |= (off < low - reach and k != 1) or (off > high + reach and k != 2)
        out[i] = (*b, failed, not failed and not bad)
    return out


def test_documents(spark, small):
    for folder in (small, "/root/testdata/sf0.01"):
        rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()]
        want = brute(rows, *fertility.load_vocabulary(f"{fertility.VOCABULARIES}/piece_bpe_32k.model"))
        got = {r.doc_id: tuple(r)[1:8] for r in fertility.op12_token_fertility(spark, folder).collect()}
        assert got == want


def test_clean_documents_stay_and_junk_goes(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = collections.defaultdict(list)
    for r in fertility.op12_token_fertility(spark, folder).collect():
        if r.doc_id in labels and not r.base_failed:
            kept[labels[r.doc_id]].append(r.kept)
    assert statistics.mean(kept[1]) > 0.98 and statistics.mean(kept[0]) < 0.5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab #|\n\té", max_size=60), min_size=1, max_size=4))
def test_base_counts(texts):
    _, counts = fertility.base_counts([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert tuple(int(counts[c][i]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base(t)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=40), min_size=1, max_size=4), st.integers(2, 9))
def test_entropy_by_windows(texts, window):
    flat, of = [x for t in texts for x in t], [i for i, t in enumerate(texts) for _ in t]
    got = fertility.window_entropy(np.array(flat, np.int64), np.array(of, np.int64), len(texts), window)
    for i, t in enumerate(texts):
        assert math.isclose(got[i], entropy(t, window) if t else 0.0, abs_tol=1e-9)


def test_scripts():
    texts = ["hello 123", "привет x", "漢字かな漢", "ελληνικα", "한국어", "123 !?", "", "שלום", "مرحبا"]
    assert fertility.scripts([t.encode() for t in texts]) == ["Latin", "Cyrillic", "Han", "Greek", "Hangul", None, None, "Hebrew", "Arabic"]


def _prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


@pytest.mark.parametrize("vocabularies", [("piece_bpe_32k.model",), ("byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model")])
def test_bands_by_language_script_and_all(spark, vocabularies):
    rng = random.Random(5)
    rows = [(i, _prose(rng, "etaoinshr", 120), "xx") for i in range(60)] + [(100 + i, _prose(rng, "оеаинтср", 120), f"y{i}") for i in range(40)]
    rows += [(200, "the the the the " * 30 + "end", "xx"), (201, "ᚠᚢ ᚦᚨᚱᚲ ᚷᚹᚺ " * 3 + _prose(rng, "ᚠᚢᚦᚨᚱᚲᚷᚹᚺᚾᛁ", 80), "xx"), (202, _prose(rng, "etaoinshr", 90), None), (203, None, "xx"), (204, "few", None), (205, _prose(rng, "ᚠᚢᚦᚨᚱᚲᚷᚹᚺᚾᛁ", 90), "y1")]
    rows += [(206, "l" * 300_000 + " " + _prose(rng, "etaoinshr", 60), "xx"), (207, " ".join(rng.choice(["aba", "cab", "dad", "ebb", "fed"]) for _ in range(300)), "xx")]
    docs = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], "doc_id long, text string, lang string, kept string, script string, doc string").repartition(3)
    out = fertility.fertility_rules(docs, vocabularies)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(rows) and out.columns[:3] == ["doc_id", "lang", "doc"] and {r.doc for r in got.values()} == {"c"}
    assert [i for i in range(60) if not got[i].kept] == [] and [i for i in range(100, 140) if not got[i].kept] == [] and got[202].kept
    assert got[200].base_failed and got[203].base_failed and got[203].n_words == 0 and got[204].base_failed and not got[204].kept
    assert any(x.startswith(("byte_share", "chars_per_token")) for x in got[201].rejected_by) and not got[205].kept and not got[206].kept
    assert any(x.startswith("token_entropy") for x in got[207].rejected_by)
    assert fertility.fertility_rules(docs.limit(0), vocabularies).count() == 0
    few = fertility.fertility_rules(docs.where("doc_id in (1, 2, 200, 201)"), vocabularies).collect()
    assert {r.doc_id for r in few if r.kept} == {1, 2, 201}  # too few for any band


def test_blocks_change_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    a, b = (fertility.measured(docs, ["piece_bpe_32k.model"], block_words=n).orderBy("doc_id").collect() for n in (7, 1 << 20))
    assert a == b
