"""Rules that no operator may cut short."""

import time

import pytest

pytest.importorskip("tidewater.llm")

from tidewater.llm import html, sentences  # noqa: E402
from tidewater.llm.registry import QUERIES  # noqa: E402

SHORT = "Milk, eggs, bread, butter, salt, sugar, flour, rice, beans, tea, coffee, oil, honey, figs, dates, plums, pears, nuts, corn, peas."


def test_sentence_runs_of_short_sentences(spark, tmp_path):
    lines = "\n".join(f"line {i}" for i in range(30))
    short = SHORT.replace(",", ".")
    rows = [(1, "Alpha. " + short), (2, short), (3, lines), (4, "Before it, other words stand.\n" + lines), (5, "Milk. Eggs. Bread."), (6, "One. Two. Three. " + short + " Four. Five. Six.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in QUERIES["op5_sentence_spans"](spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 20, 3: 0, 4: 30, 5: 3, 6: 20}


def test_short_repeats_go_whatever_their_words(spark):
    three = "The cat sat on mats. The dog ate one bone. The bird sang all day."
    rows = [(1, three), (2, three), (3, f"New words here. {three} Old words there."), (4, "Two only. Words."), (5, "two  only. WORDS."), (6, "Two only. Others.")]
    got = {r.doc_id: (r.text, r.n_by_clauses) for r in sentences.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (three, 0), 2: ("", 0), 3: ("New words here. Old words there.", 0), 4: ("Two only. Words.", 0), 5: ("", 0), 6: ("Two only. Others.", 0)}


def test_sentence_runs_cover_the_ends_of_a_passage(spark):
    passage = "a b c d e f. g h i j k l. m n o p q r. s t u. v."
    docs = spark.createDataFrame([(1, passage + " other words."), (2, "New. " + passage + " End of it.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentences.drop_repeated_runs(docs).collect()}
    assert got == {1: passage + " other words.", 2: "New. End of it."}


def test_long_sentences_count_by_clauses(spark):
    clauses = [f"clause {k} has five words," for k in range(8)]
    docs = spark.createDataFrame([(1, "It begins, as ever, so: " + " ".join(clauses) + " and ends."), (2, "Elsewhere " + " ".join(clauses[1:]) + " and goes on. Short, and whole.")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in sentences.drop_repeated_runs(docs).collect()}
    assert got[2] == "Elsewhere clause 1 has five words, and goes on. Short, and whole."


LONG = "This, that, and more of it, goes on for a good while, so that it counts. " * 4


def test_article_is_whole():
    assert html.main_text(f"<body><nav>Home</nav><article><h1>T</h1><div><p>{LONG}</p></div></article></body>") == f"T\n\n{LONG.strip()}"
    page = f"<body><article><h1>T</h1><section><p>{LONG}</p><p>{LONG}</p></section><section><h2>U</h2><p>Short.</p></section><ul><li>one</li><li>two</li></ul><blockquote>Said.</blockquote></article><footer>F</footer></body>"
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip(), LONG.strip(), "U", "Short.", "one", "two", "Said."]


def test_siblings_without_article():
    page = f"<body><div><h1>T</h1><div><p>{LONG}</p></div><ul><li>one</li></ul><div><a href='x'>a link</a></div></div></body>"
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip(), "one"]


def nested(piece, size):
    return piece * (size // len(piece))


@pytest.mark.parametrize("piece", ["<div>a, b ", "<ul><li>a, b ", "<b>a ", "<i><div><b><b></i>", "<p><span>a</section>", "<a '", '<a "', "<table><tr><td>a", "</div><p>", "<!-", "<div class='"])
def test_pages_of_a_megabyte_are_read_in_time_with_their_length(piece):
    began = time.process_time()
    html.main_text(nested(piece, 1 << 20) + "'")
    assert time.process_time() - began < 4


def test_wrappers_do_not_hide_the_article():
    body = f"<h2>T</h2><p>{LONG}</p><p>{LONG}</p>"
    want = ["T", LONG.strip(), LONG.strip()]
    side = "<div class='sidebar'><p>Other, things, here.</p></div><div id='footer'><p>All rights, reserved.</p></div>"
    for head, tail in (("<div class='with-sidebar'>", "</div>"), ("<div class='content tags'>", "</div>"), ("<form action='x'>", "</form>"), ("<div class='page header-layout header'>", "</div>"), ("<div class='sidebar'>", "</div>"), ("<form><div id='content'>", "</div></form>")):
        assert html.main_text(f"<html><body><nav>Home</nav>{head}{body}{tail}{side}</body></html>").split("\n\n") == want, head


def test_form_around_the_whole_page():
    page = f"<body><form id='aspnet'><div class='menu'><ul><li><a href='x'>Home</a></li></ul></div><div><h1>T</h1><p>{LONG}</p><form><p>Mail, name, here.</p></form></div><div class='footer'>F</div></form></body>"
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip()]


def test_comments_longer_than_the_article():
    thread = "".join(f"<li><p>{LONG}</p></li>" for _ in range(12))
    for comments in (f"<div class='comments'><ol>{thread}</ol></div>", f"<section id='comments'><ul>{thread}</ul></section>"):
        assert html.main_text(f"<body><div id='content'><h1>T</h1><p>{LONG}</p></div>{comments}</body>").split("\n\n") == ["T", LONG.strip()]
        assert html.main_text(f"<body><article><h1>T</h1><p>{LONG}</p>{comments}</article></body>").split("\n\n") == ["T", LONG.strip()]


def test_tables_and_open_elements():
    page = f"<body><div><h1>T</h1><table><tr><td>{LONG}<td>two<tr><td>three</table><ul><li><p>four<li>five</ul></div><footer>F</footer></body>"
    assert html.main_text(page).split("\n\n") == ["T", LONG.strip(), "two", "three", "four", "five"]
