"""The pipeline's stages against brute force on a small fixture, and on rows that are odd."""

import collections
import hashlib
import math
import re

import pytest

pytest.importorskip("tidewater.llm")
pipeline = pytest.importorskip("corpus_pipeline")

from test_brute import components, shingles  # noqa: E402

from tidewater.llm import quality  # noqa: E402


def without_common_lines(rows):
    pages, seen = collections.Counter(r.source for r in rows), collections.Counter()
    for r in rows:
        if r.text is not None:
            seen.update({(r.source, x.strip(" \t\n\x0b\x0c\r")) for x in r.text.split("\n")})

    def goes(r, line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return line and seen[r.source, line] >= 2 and seen[r.source, line] > 0.1 * pages[r.source]

    return {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if not goes(r, x)) for r in rows}


def mixed(rows):
    """doc_id -> copies: water-filling by repeated passes, then draws in order."""
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    size = collections.Counter()
    for r in rows:
        size[r.source] += words[r.doc_id]
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(size.values())), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 3 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    out = {}
    for s in names:
        mine = []
        for r in (r for r in rows if r.source == s):
            t, n = r.text or "", words[r.doc_id]
            share = len(t.translate({ord(c): None for c in "!%$#*|&=+<>{}[]~^0123456789"})) / len(t) if t else 1.0
            w = 0.25 + 0.75 * share * min(1.0, len(t) / n / 4, 11 / (len(t) / n)) if n else 1.0
            u = (int(hashlib.md5(f"20:{r.doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            mine.append((-math.log(u) / w, r.doc_id, n))
        epochs = int(target[s] // size[s]) if size[s] else 0
        rest, total = max(0.0, target[s] - epochs * size[s]), 0
        for _, i, n in sorted(mine):
            total += n
            out[i] = epochs + (total <= rest or total - rest < rest - (total - n))
    return out


def test_each_stage_does_its_part(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept = {r.doc_id: r for r in docs.collect()}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for name, stage in pipeline.STAGES:
        before, given = kept, docs
        docs = pipeline.stored(stage(spark, docs, small), "t")
        kept = {r.doc_id: r for r in docs.collect()}
        assert set(kept) <= set(before) and kept
        if name != "source mixing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "quality classifier":
            model = quality.fit_quality(given, spark.read.parquet(f"{small}/labels.parquet"))
            assert set(kept) == {i for i, r in before.items() if model.score([r.text.encode()])[0] >= 0.3} and len(kept) < len(before)
        elif name == "line dedup":
            want = without_common_lines(list(before.values()))
            assert {i: r.text for i, r in kept.items()} == want and all(r.n_chars == len(r.text) for r in kept.values())
        elif name == "near-duplicates":
            want = components({i: shingles(r.text, 5) for i, r in before.items()})
            assert set(kept) == {i for i, root in want.items() if i == root}
        elif name == "benchmark decontamination":
            assert set(kept) == {i for i, r in before.items() if not any(b in " ".join(r.text.lower().split()) for b in bench)}
        else:
            want = mixed(list(before.values()))
            assert {i: r.copies for i, r in kept.items()} == {i: c for i, c in want.items() if c}
    assert all(r.copies > 0 and r.taken == r.copies * r.size for r in kept.values())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, score double, doc string, near_key string"


def test_stages_take_odd_rows(spark, small):
    text = "All of this is quite ordinary prose, of no special kind, and it goes on for a while.\nSecond line here."
    rows = [(1, text, "en", "a"), (1, text, "en", "a"), (2, None, None, None), (None, text + " More of it.", None, "a"), (None, None, None, "b"), (3, "", "en", "b"), (4, "word " * 30000, "en", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 0.5, "d", "n") for r in rows], SCHEMA)
    bench = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    docs = docs.unionByName(spark.createDataFrame([(9, f"Before. {bench} After.", "en", "b", 9, 0.5, "d", "n")], SCHEMA))
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, small)
        got = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns and stage(spark, docs.limit(0), small).count() == 0, name
        assert all((r.score, r.doc, r.near_key) == (0.5, "d", "n") for r in got), name
        ids = collections.Counter(r.doc_id for r in got)
        assert ids[1] in (0, 2), name
        if name == "line dedup":
            assert len(got) == 8 and [r.text for r in got if r.doc_id == 2] == [None] and {r.text for r in got if r.doc_id == 1} == {""}
        elif name == "near-duplicates":
            assert ids[1] == 2 and ids[None] == 1 and ids[2] == ids[3] == ids[4] == 1
        elif name == "benchmark decontamination":
            assert 9 not in ids and len(got) == 7


def test_run_gives_the_last_stage(spark, small):
    assert pipeline.run(spark, small).columns[-5:] == ["size", "source_size", "target", "copies", "taken"]
