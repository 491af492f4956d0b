"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with clashing names, for every operator."""

import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidewater.llm")

from tidewater.llm import ann, decontaminate, html, lines, minhash, mixing, quality, sentences, suffix, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, key string, n_dropped string, _key string"
LONG = "the quick brown fox jumps over it again, " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    a = "one two three four five six seven eight nine ten eleven twelve. " * 9
    rows = [(1, a), (2, a), (2, a), (3, a.upper()), (4, None), (None, None), (None, "word " * 40), (5, ""), (6, " \n\t "), (7, LONG), (8, "é" * 500), (9, "x")]
    return spark.createDataFrame([(i, t, None, None if i in (4, 9) else f"s{(i or 0) % 2}", None, "c", "c", "c", "c", "c") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_suffix(docs, none):
    out = suffix.drop_repeated_strings(docs).collect()
    assert len(out) == docs.count() and suffix.drop_repeated_strings(none).count() == 0
    by = {r.doc_id: r for r in out if r.doc_id}
    assert by[1].n_removed == by[1].n_bytes == by[2].n_bytes and by[1].n_spans == 1  # a repeat of each other; nothing is left
    assert by[4].n_bytes == by[5].n_bytes == 0 and by[9].n_removed == 0
    assert by[7].n_removed > 0 and by[8].n_bytes == 1000 and by[8].n_removed == 1000


def test_sentences(docs, none):
    out = sentences.drop_repeated_runs(docs).collect()
    assert sentences.drop_repeated_runs(none).count() == 0 and len(out) == docs.count()
    kept = {r.doc_id: r for r in out if r.doc_id}
    assert kept[3].text == "" and kept[3].n_removed == kept[3].n_sentences and kept[4].text == "" and kept[9].text == "x" and kept[9].n_removed == 0
    assert [r.text for r in out if r.doc_id == 2] == ["", ""] and kept[7].n_removed == 2999 and kept[1].n_removed > 0  # a text that repeats itself


def test_minhash(docs, none):
    out = minhash.near_duplicates(docs, width=2).collect()
    assert len(out) == docs.count() and minhash.near_duplicates(none).count() == 0
    by = {r.doc_id: r for r in out if r.doc_id}
    assert by[1].component_id == by[2].component_id == by[3].component_id == 1 and by[1].kept and not by[3].kept
    assert by[4].n_shingles == by[5].n_shingles == by[6].n_shingles == 0 and by[5].component_id == 5 and by[5].kept
    assert by[9].n_shingles == 1
    stay = minhash.drop_near_duplicates(docs)
    assert stay.columns == docs.columns and {r.doc_id for r in stay.collect()} >= {1, 4, 5, 6, 7, 8, 9}


def test_lines(spark, docs, none):
    out = lines.drop_boilerplate(docs)
    assert out.count() == docs.count() and lines.drop_boilerplate(none).count() == 0
    assert {r.doc_id for r in out.collect() if r.n_dropped} == {2}  # a repeated row
    same = spark.createDataFrame([(i, f"menu\nown {i}\n\n", None) for i in range(8)], "doc_id long, text string, source string")
    alone = spark.createDataFrame([(1, "a\nb", "x"), (2, "a\nc", "y")], "doc_id long, text string, source string")
    assert [r.n_dropped for r in lines.drop_boilerplate(alone).collect()] == [0, 0] and [r.text for r in lines.drop_boilerplate(alone, least_pages=1).collect()] == ["", ""]
    cut = lines.drop_boilerplate(same).orderBy("doc_id").collect()
    salted = lines.drop_boilerplate(same, broadcast_keys=0, salts=3).orderBy("doc_id").collect()
    assert salted == cut
    assert cut[0].text == "own 0\n\n" and all(r.n_dropped == 1 and r.n_lines == 4 for r in cut)


def test_mixing(docs, none):
    out = mixing.mix_sources(docs).collect()
    assert len(out) == docs.count() and mixing.mix_sources(none).count() == 0
    assert all(r.taken == r.copies * r.size and r.taken <= 3 * r.size for r in out)
    for many in (mixing.mix_sources(docs), mixing.mix_sources(docs, broadcast_sources=0, salts=3), mixing.mix_sources(docs, bucket_rows=1)):
        assert sorted(map(tuple, many.collect()), key=str) == sorted(map(tuple, out), key=str)


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, "jumps over it again, the quick brown fax jumps over"), (2, None), (3, " "), (1, "é" * 500)], "item_id long, text string")
    out = decontaminate.contaminated(docs, bench, rate=0.1).collect()
    assert {(r.doc_id, r.item_id, r.distance) for r in out} == {(7, 1, 1), (8, 1, 0)}
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    clean = decontaminate.decontaminate(docs, bench, rate=0.1)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (7, None), (3, 1), (3, 1)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    out = quality.score_quality(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    assert quality.score_quality(none, model).count() == 0
    blank = quality.fit_quality(none, labels.limit(0))
    assert blank.score([b""])[0] == 0.5


def test_html(spark):
    pages = spark.createDataFrame([(1, None, "c"), (2, "", "c"), (3, "<p>a<p>b &amp; c", "c"), (4, "<div>" * 3000 + "deep", "c"), (5, "<script>x", "c"), (5, "< <<p", "c")], "page_id long, html string, text string")
    out = {r.page_id: r for r in html.extract_main_text(pages).collect() if r.page_id < 5}
    assert out[1].text == out[2].text == "" and out[3].text == "a\n\nb & c" and out[4].text == "deep" and out[3].n_chars == 8
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/ü\r\n%", "x" * 500, 1), (2, None, "x" * 500, 1), (2, None, "x" * 500, 1), (3, "u", None, 1), (4, "u", "", 1), (None, "v", "solo", 1)], "page_id long, url string, html string, more int")
    out = warc.read_archives(warc.write_archives(pages)).collect()
    by = {r.page_id: r for r in out}
    assert len(out) == 6 and by[1].url == "http://a/ü\r\n%" and by[1].payload == b"x" * 500
    assert by[2].record_type == "revisit" and by[2].refers_to == 1 and by[2].payload_bytes == 500 and by[2].payload is None
    assert by[3].record_type == "response" and by[4].refers_to == 3 and by[None].record_type == "response"
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


FOREIGN = b"""WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 9\r\n\r\nsoftware:\r\n\r\n
WARC/1.0\r\nWARC-Type: request\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 4\r\n\r\nGET \r\n\r\n
WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:uuid:3>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Target-URI:\r\n http://a/b\r\n\t?c\r\nContent-Length: 37\r\n\r\nHTTP/1.1 200 OK\r\nServer: x\r\n y\r\n\r\nabc\r\n\r\n
WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:4>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Block-Digest: xxh:0\r\nWARC-Truncated: length\r\nContent-Length: 43\r\n\r\nHTTP/1.0 200 OK\r\nContent-Length: 99\r\n\r\nabcd\r\n\r\n
WARC/1.0\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:uuid:5>\r\nWARC-Refers-To: <urn:uuid:3>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 0\r\n\r\n\r\n\r\n
WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:uuid:6>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: 1\r\n\r\nm\r\n\r\n"""


def test_archives_of_others_are_read(spark, tmp_path):
    records = [x + b"\r\n\r\n" for x in FOREIGN.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n\n")]
    name = f"{tmp_path}/foreign.warc.zst"
    with open(name, "wb") as out:
        for r in records:
            out.write(warc.zstandard.ZstdCompressor().compress(r))
    paths = spark.createDataFrame([(f"file://{name}",), (None,)], "path string")
    got = {r.record_id: r for r in warc.read_archives(paths).collect()}
    assert set(got) == {"<urn:uuid:3>", "<urn:uuid:4>", "<urn:uuid:5>"}
    three, four, five = (got[f"<urn:uuid:{k}>"] for k in (3, 4, 5))
    assert (three.url, three.payload, three.payload_bytes, three.page_id) == ("http://a/b ?c", b"abc", 3, None) and three.payload_digest == warc.sha1_base32(b"abc")
    assert (four.payload, four.payload_bytes, four.record_type) == (b"abcd", 4, "response")
    assert (five.record_type, five.refers_to_record, five.payload, five.payload_bytes) == ("revisit", "<urn:uuid:3>", None, None)
    for bad in (records[2].replace(b"abc", b"ab"), records[2].replace(b"HTTP/", b"HTML/"), records[2].replace(b"warc-type", b"warc-kind"), records[3].replace(b"WARC-Truncated: length\r\n", b""), records[0].replace(b"WARC/1.0", b"WARC/2.0"), records[5].replace(b"WARC-Type", b"WARC-Block-Digest: sha1:AAAA\r\nWARC-Type")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


def test_revisits_name_the_record_they_revisit(spark):
    pages = spark.createDataFrame([(i, f"u{i}", "same") for i in range(4)], "page_id long, url string, html string")
    by = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert by[0].refers_to_record is None and {by[i].refers_to_record for i in (1, 2, 3)} == {by[0].record_id} and len({r.record_id for r in by.values()}) == 4


def test_ann(spark):
    nan = float("nan")
    rows = [(i, [float(i % 5), 1.0, float(i % 3)]) for i in range(60)] + [(60, None), (61, [0.0, 0.0, 0.0]), (62, [1.0, nan, 0.0]), (63, [1.0, None, 1.0]), (None, [1.0, 1.0, 1.0]), (64, [1.0, 2.0]), (65, [2.0, 1.0]), (65, [2.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = ann.nearest(v, v.where("vec_id % 20 = 0 or vec_id >= 60"), k=4).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 64, 65} and got[64] == [(65, 4.0)]
    own = {i: x for i, x in rows[:60]}
    for q in (0, 20, 40):
        want = sorted((-sum(a * b for a, b in zip(own[q], own[i])), i) for i in own if i != q)[:4]
        assert got[q] == [(i, -s) for s, i in want]
    many = ann.nearest(v, v.where("vec_id % 20 = 0 or vec_id >= 60"), k=4, shard_bytes=64, query_block=2).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, out))
    assert ann.nearest(v.limit(0), v).count() == 0 and ann.nearest(v, v.limit(0)).count() == 0


NAMES = ("_key", "_gone", "_host", "_common", "_salt", "_deal", "_text", "_bucket", "host", "key", "a", "b", "doc", "kept", "lines", "salt", "bucket", "part", "epochs", "left", "under", "edge", "root", "cls", "packed", "place", "draw")


@pytest.mark.parametrize("broadcast", [0, 100_000])
def test_columns_of_other_names_keep_their_values(spark, broadcast):
    rows = [(i, ["the menu\none two three four five", "the menu\nsix seven eight nine", None][i % 3], f"s{i % 2}", *(f"{n}{i}" for n in NAMES)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` string" for n in NAMES))
    model = quality.QualityModel(b"", b"", (0.0, 0.0, 0.0))
    bench = spark.createDataFrame([(1, "no such thing")], "item_id long, text string")
    made = {
        "lines": lines.drop_boilerplate(docs, broadcast_keys=broadcast),
        "mixing": mixing.mix_sources(docs, broadcast_sources=broadcast),
        "minhash": minhash.drop_near_duplicates(docs),
        "quality": quality.score_quality(docs, model),
        "decontaminate": decontaminate.decontaminate(docs, bench),
    }
    for name, out in made.items():
        assert out.columns[: len(docs.columns)] == docs.columns, name
        for r in out.collect():
            assert [r[n] for n in NAMES] == [f"{n}{r.doc_id}" for n in NAMES], name
    assert {r.doc_id for r in made["minhash"].collect()} == {0, 1, 2, 5, 8, 11}
    assert made["lines"].count() == made["mixing"].count() == made["quality"].count() == made["decontaminate"].count() == 12


def test_mixing_in_ranges_is_the_same(docs, spark):
    """Rows that share a draw fill one bucket; its order by ranges in many tasks takes what one window takes."""
    copies = spark.createDataFrame([(None, f"w{k % 5} b c", None, f"s{k % 3}", None, "c", "c", "c", "c", "c") for k in range(90)], SCHEMA)
    # rows that tie in draw, id and size may stand for each other
    held = ["doc_id", "source", "size", "source_size", "target", "copies", "taken"]
    for table in (docs, copies):
        rows = [sorted(map(str, mixing.mix_sources(table, most_in_order=most, broadcast_sources=few).select(*held).collect())) for most in (500_000, 1) for few in (100_000, 0)]
        assert len(rows[0]) == table.count() and all(x == rows[0] for x in rows[1:])
    taken = mixing.mix_sources(copies, most_in_order=1).groupBy("target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 3 for r in taken)
