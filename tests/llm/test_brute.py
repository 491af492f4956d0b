"""Operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

pytest.importorskip("tidewater.llm")

from tidewater.llm import ann, decontaminate, graph, html, minhash, quality, registry, sentences, suffix, warc  # noqa: E402


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=30))
def test_suffix_array_sorts(text):
    order = suffix.suffix_array(text)
    assert order == sorted(range(len(text)), key=lambda i: text[i:])
    shared = suffix.common_prefixes(text, order)
    for r in range(1, len(order)):
        a, b = text[order[r - 1] :], text[order[r] :]
        assert shared[r] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def removed(texts, window):
    seen = collections.Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                mark[k : k + window] = b"\1" * window
        out.append((len(t), sum(mark), sum(1 for k in range(len(t)) if mark[k] and not (k and mark[k - 1])), bytes(b for b, m in zip(t, mark) if not m)))
    return out


@pytest.mark.parametrize("window,inner", [(400, 200), (40, 20), (64, 16)])
def test_repeated_strings(spark, window, inner):
    rng = random.Random(window)
    base = "".join(rng.choice("abcd ") for _ in range(600))
    texts = ["", "a" * 1000, "ab" * 700, "a" * (window - 1), base, base[:450] + "X" + base[451:], base[100:] + "é" * 30 + base[:420], "zz" + base]
    for _ in range(30):
        s = list(base)
        for _ in range(rng.randint(0, 3)):
            s[rng.randrange(600)] = "#"
        texts.append("".join(s)[rng.randint(0, 100) :])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix.drop_repeated_strings(df, window, inner).collect()}
    for i, want in enumerate(removed([t.encode() for t in texts], window)):
        assert got[i] == want, i


def test_repeated_strings_of_documents(spark, small):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    got = {r.doc_id: tuple(r)[1:] for r in registry.QUERIES["op1_suffix_array"](spark, small).collect()}
    for (i, _), (n, gone, spans, kept) in zip(rows, removed([t for _, t in rows], 400)):
        assert got[i] == (n, gone, spans, hashlib.sha256(kept).hexdigest(), gone > 0, got[i][-1])
        assert got[i][-1] == kept.decode("utf-8", "replace") or b"\xef\xbf\xbd" in got[i][-1].encode()


@pytest.mark.parametrize("group", [2, 5, 20])
def test_a_key_of_many_contexts_is_split(spark, group):
    rng = random.Random(group)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = []
    for _ in range(60):
        s = list("".join(rng.choice("xyz ") for _ in range(rng.randint(0, 40))) + passage + "".join(rng.choice("xy") for _ in range(rng.randint(0, 40))))
        for _ in range(rng.choice([0, 0, 1, 2])):
            s[rng.randrange(len(s))] = rng.choice("#+")
        texts.append("".join(s))
    texts += texts[:5]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("dkey", F.col("doc_id"))
    got = {i: set() for i in range(len(texts))}
    for r in suffix.repeated_windows(df, 40, 16, group=group).collect():
        got[r.dkey] = {k for x in r.spans for k in range(x.a, x.b + 1)}
    seen = collections.Counter(t[k : k + 40] for t in texts for k in range(len(t) - 39))
    for i, t in enumerate(texts):
        assert got[i] == {k for k in range(len(t) - 39) if seen[t[k : k + 40]] > 1}, i


def components(sets, threshold=80):
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if 100 * min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= threshold * (len(a) + len(b) - both):
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(spark, small, width):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    sets = {r.doc_id: shingles(r.text, width) for r in docs.collect()}
    want = components(sets)
    for r in minhash.near_duplicates(docs, width).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_large_group_of_near_copies_in_blocks(spark):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(60)] = f"x{rng.randrange(999)}"
        rows.append((i, " ".join(w)))
    for i in range(40):  # a chain, in which only neighbours are near enough
        rows.append((100 + i, " ".join(f"c{k}" for k in range(i, i + 30))))
    want = components({i: shingles(t, 2) for i, t in rows})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kw in ({"block": 16}, {"block": 1}, {"block": 4, "block_shingles": 100}):
        assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2, **kw).collect()} == want


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_components(spark, chunk):
    rng = random.Random(chunk)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(60)] + [(200 + i, 201 + i) for i in range(30)] + [(300, 300 + i) for i in range(40)] + [(5, None)]
    want = graph.forest([a for a, b in edges if b is not None and a != b], [b for a, b in edges if b is not None and a != b])
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), chunk).collect()}
    assert got == want and want[230] == 200 and want[339] == 300


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    for j in (0.2, 0.5, 0.9):
        both = rng.integers(0, 2**63, int(3000 * j), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**63, (3000 - len(both)) // 2, dtype=np.uint64)])) * np.uint64(2) for _ in range(2))
        got = minhash.estimate(minhash.registers(np.sort(a)), len(a), minhash.registers(np.sort(b))[None], np.array([len(b)]))[0]
        assert abs(got - j) < 0.2


SENTENCE_END = re.compile(r"(?<=[.!?])[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]*\n\s*")


def covered_by_repeats(texts, n):
    """For each text its sentences, and which of them lie in a run of n of them (all, of a text with fewer) that stands somewhere before: the method as it is told."""
    split = [[" ".join(u.split()).lower() for u in SENTENCE_END.split(t.strip()) if u] for t in texts]
    seen, out = set(), []
    for u in split:
        gone = set()
        k = min(n, len(u))
        for a in range(len(u) - k + 1 if u else 0):
            run = tuple(u[a : a + k])
            if run in seen:
                gone |= set(range(a, a + k))
            seen.add(run)
        out.append((u, gone))
    return out


def test_sentence_runs(spark, small):
    n, least = 3, 20
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    whole = dict(zip((i for i, _ in docs), covered_by_repeats([t for _, t in docs], n), strict=True))

    def clauses(u):
        return re.split(r"(?<=[,;:])\s+", u) if len(u.split()) > 20 else [u]

    units = {i: [c for u in whole[i][0] for c in clauses(u)] for i, _ in docs}

    def runs(u):
        def enough(a, b):
            return b - a >= min(n, len(u)) and sum(len(x.split()) for x in u[a:b]) >= least

        ahead = {(a, next((b for b in range(a + 1, len(u) + 1) if enough(a, b)), None)) for a in range(len(u))}
        back = {(next((a for a in range(b - 1, -1, -1) if enough(a, b)), None), b) for b in range(1, len(u) + 1)}
        return sorted((a, b) for a, b in ahead | back if a is not None and b is not None)

    def places(i):
        """The clauses of each sentence."""
        at = 0
        for u in whole[i][0]:
            yield range(at, at + len(clauses(u)))
            at += len(clauses(u))

    first = {}
    for i, _ in docs:
        for a, b in runs(units[i]):
            first.setdefault(tuple(units[i][a:b]), (i, a))
    want = {}
    for i, _ in docs:
        by_sentences = {j for k, at in enumerate(places(i)) if k in whole[i][1] for j in at}
        gone = by_sentences | {j for a, b in runs(units[i]) if first[tuple(units[i][a:b])] != (i, a) for j in range(a, b)}
        want[i] = (len(units[i]), len(gone), sum(j - 1 not in gone for j in gone), len(gone - by_sentences), [u for j, u in enumerate(units[i]) if j not in gone])
    rows = sentences.drop_repeated_runs(spark.read.parquet(f"{small}/documents.parquet")).collect()
    words = lambda units: " ".join(units).split()
    got = {r.doc_id: (r.n_sentences, r.n_removed, r.n_spans, r.n_by_clauses, r.text.lower().split()) for r in rows}
    assert got == {i: (*w[:4], words(w[4])) for i, w in want.items()} and any(r.n_removed > r.n_by_clauses for r in rows)


def test_every_run_of_sentences_counts(spark):
    rng = random.Random(8)
    # short sentences out of few, so that runs of every length repeat
    texts = [" ".join(rng.choice(["A b.", "C!", "D e f?", "G h i j k.", "L", "M n.\n"]) for _ in range(rng.randint(0, 9))) for _ in range(120)]
    for n in (1, 2, 3):
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        got = {r.doc_id: r.text.lower().split() for r in sentences.drop_repeated_runs(docs, n=n, least_words=10**6).collect()}
        assert got == {i: " ".join(x for j, x in enumerate(u) if j not in gone).split() for i, (u, gone) in enumerate(covered_by_repeats(texts, n))}


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.text("abc", max_size=14))
def test_myers(pattern, text):
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for k, p in enumerate(pattern, 1):
            new.append(min(row[k] + 1, new[-1] + 1, row[k - 1] + (p != c)))
        row = new
        best = min(best, row[-1])
    got = decontaminate.myers(pattern, text, len(pattern))
    assert got[0] == best


def test_edits_within_the_budget_are_found(spark):
    rng = random.Random(2)
    items = ["".join(rng.choice("abcdefghij ") for _ in range(120)).strip() for _ in range(6)]
    rows = []
    for i in range(60):
        s = list(" ".join(items[i % 6].split()))
        for _ in range(i % 9):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([["z"], [], ["q", "q"]])
        rows.append((i, "before  " + "".join(s).upper() + "\nafter"))
    bench = [(k, t) for k, t in enumerate(items)]

    def least(p, t):
        """The distance of p to whole words of t, cell by cell."""
        edge = [k in (0, len(t)) or not (t[k - 1].isalnum() and t[k].isalnum()) for k in range(len(t) + 1)]
        row = [0 if e else 10**6 for e in edge]
        for c in p:
            new = [row[0] + 1]
            for j in range(1, len(t) + 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (t[j - 1] != c)))
            row = new
        return min(d for d, e in zip(row, edge) if e)

    rows += [(60 + k, f"x{items[k]} y") for k in range(3)] + [(70 + k, f"x {items[k]}, y") for k in range(3)]
    want = {}
    for i, t in rows:
        for k, item in bench:
            p = decontaminate.normalised(item)
            if (d := least(p, decontaminate.normalised(t))) <= decontaminate.budget(len(p), 0.05):
                want[i, k] = d
    out = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"), block_chars=200)
    assert {(r.doc_id, r.item_id): r.distance for r in out.collect()} == want and len(want) > 20


def test_items_match_whole_words(spark):
    bench = spark.createDataFrame([(1, "art"), (2, "大学"), (3, "c++")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a party"), (2, "Art, of course"), (3, "state of the art"), (4, "他在大学里"), (5, "smart artful heart"), (6, "use C++!")], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()} == {(2, 1), (3, 1), (4, 2), (6, 3)}


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    scored = registry.QUERIES["op4_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in scored) >= 0.93 * len(scored)


def test_quality_scores_by_brute_force(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    good, bad = (zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad))
    rows = registry.QUERIES["op4_quality"](spark, small).collect()
    assert len(rows) == len(text)
    for r in rows:
        t = text[r.doc_id]
        cut = [t[k : k + 1024] for k in range(0, len(t), 1024)]
        d = (sum(len(bad.compress(x)) for x in cut) - sum(len(good.compress(x)) for x in cut)) / (len(t) + 64)
        want = 1 / (1 + math.exp(-(model.coefficients[0] + model.coefficients[1] * d + model.coefficients[2] * len(t) / (len(t) + 64))))
        assert abs(r.score - want) < 1e-12 and r.predicted == (want >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    # labels of the held-out fold change nothing
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert quality.fit_quality(docs, flipped) == model


def test_archive_round_trip():
    records = [warc.record_bytes(k, f"http://x/{k}", b"<p>%d</p>" % k * 40, warc.sha1_base32(b"<p>%d</p>" % k * 40), False, None, "1970-01-01T00:00:00Z") for k in range(50)]
    for dictionary in (b"", b"raw content of no special form", warc.train_dictionary(records * 4, 4096)):
        out = io.BytesIO()
        writer = warc.ArchiveWriter(out, dictionary)
        for r in records:
            writer.write(r)
        data = out.getvalue()
        assert list(warc.read_frames(io.BytesIO(data).read)) == records
        with pytest.raises(warc.WarcError):
            list(warc.read_frames(io.BytesIO(data[:-3]).read))
    packed = warc.skippable_frame(zstandard.ZstdCompressor().compress(dictionary)) + data[8 + len(dictionary) :]
    assert list(warc.read_frames(io.BytesIO(packed).read)) == records  # a compressed dictionary
    for bad in (records[0][:-1], records[0].replace(b"WARC/1.1", b"WARC/9"), records[0].replace(b"<p>0", b"<p>1", 1), records[0].replace(b"WARC-Date", b"No-Date")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_main_text_of_pages(spark, small):
    import html as entities

    for page in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", page.html, re.S)[1]
        parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>?", "", p.replace("<br>", " ")))).strip() for p in re.split(r"</?(?:p|h1)[^>]*>?", inner)]
        assert html.main_text(page.html) == "\n\n".join(p for p in parts if p)


def test_main_text_leaves_the_rest_out():
    page = """<html><body><header><h1>Site</h1></header><nav>Home, more</nav><div id="content"><h1>T</h1><p>Some, long, text that goes on, and on, for a while, yes.</p>
      <p>More, of it, &eacute; here; enough, text to count.</p><form><p>mail, now</p></form></div><div class="sidebar"><p>x, y, z</p></div><div class=comments><p>nice, good, text</p></div><footer>end</footer>"""
    assert html.main_text(page) == "T\n\nSome, long, text that goes on, and on, for a while, yes.\n\nMore, of it, é here; enough, text to count."


def test_recall_of_neighbours(spark):
    v = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = sorted((r.vec_id, r.embedding) for r in v.collect())
    ids, m = np.array([i for i, _ in rows]), np.array([x for _, x in rows])
    got = collections.defaultdict(set)
    for r in ann.nearest(v, v.where("vec_id % 20 = 0"), shard_rows=200).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q, found in got.items():
        s = m @ m[ids == q][0]
        s[ids == q] = -np.inf
        hits += len(found & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got) and len(got) == (ids % 20 == 0).sum()


def test_entry_lists_every_operator():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in registry.QUERIES)] == []
    assert set(registry.SQL) <= set(registry.QUERIES)


def test_mix_meets_its_targets(spark, small):
    by = registry.QUERIES["op6_source_mix"](spark, small).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.max("size").alias("most"), F.count_if(F.col("taken") > 3 * F.col("size")).alias("over"))
    for r in by.collect():
        assert abs(r.taken - r.target) <= r.most and r.over == 0
