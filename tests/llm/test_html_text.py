"""Main text of pages: pages whose text is known, broken markup, and the table's pages against their article element."""

import html
import os
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import queries
from quirelake.llm.html_text import main_text, main_texts

SF = "/root/testdata/sf0.001"
LONG = "The river rose in the night, as it had for years, and by morning the lower road was gone under brown water."
MORE = "Nobody in the village was surprised, though some, who had come only lately, stood long at the edge and looked."


def plain_article(page):
    """The article element's headings and paragraphs, by cutting at its tags."""
    out = []
    for x in re.split(r"</?(?:h1|p)>", re.search(r"<article>(.*)</article>", page, re.DOTALL)[1]):
        out.append(" ".join(html.unescape(re.sub(r"</?[a-z][^>]*>", "", x.replace("<br>", " "))).split()))
    return "\n".join(x for x in out if x)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_the_query_against_article_elements(spark):
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    want = sorted((i, u, plain_article(h), len(plain_article(h))) for i, u, h in pages)
    assert sorted(tuple(r) for r in queries.op12_html_text(spark, SF).collect()) == want


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><div id=nav><a href=1>One</a><a href=2>Two</a></div><div class=main-content><h2>High water</h2><p>{LONG}<p>{MORE}</div><div class=sidebar><p>{LONG} Read on.</div></body>", f"High water\n{LONG}\n{MORE}"),
        (f"<div><div><p>{LONG}</p><p>{MORE}</p><p>Yes.</p></div><div><a href=1>{MORE}</a> <a href=2>{LONG}</a> <a>x</a></div></div>", f"{LONG}\n{MORE}\nYes."),
        (f"<main><h1>High water</h1><div><p>{LONG}</p><p>{MORE}</p></div></main>", f"High water\n{LONG}\n{MORE}"),
        (f"<article><header><h1>High &amp; low</h1></header><p>{LONG}</p><ul><li>one</li><li>two &lt;b&gt;</ul><aside>{MORE}</aside><form><p>{MORE}</p></form><section class='comments'><article class='comment-body'><p>{MORE} {MORE}</p></article></section></article>", f"High & low\n{LONG}\none\ntwo <b>"),
        (f"<div class='cookie-notice'><p>{LONG}, {MORE}</p></div><header><h1>The Daily</h1></header><div><p>{LONG}</p></div>", LONG),
        (f"<form id=aspnet><article><p>{LONG}</p></article></form>", LONG),
        (f"<article><p>{LONG}</p><ul><li><a href=1>a</a><li><a href=2>b</a><li><a href=3>c</a></ul></article>", LONG),
        (f"<ol class=comment-list><li><article class=comment><p>{LONG} {MORE}</p></article></ol><div class=post><p>{MORE}</p></div>", MORE),
        ("<p>short.</p>", "short."),
        ("just text, no tags", "just text, no tags"),
        ("a < b & c &lt; d <3 &nbsp;&#32; e", "a < b & c < d <3 e"),
        ("<p>one<br>two\n\t three<p><b>four<p>five", "one two three\nfour\nfive"),
        ("<script>var t='</p><p>no';</script><style>p{}</style><p>yes<!-- <p>no -- > --><!--> yes<p title='a>b'>on</p>", "yes yes\non"),
        ("<p>kept<!-- never closed <p>gone", "kept"),
        ("<div title='never closed><p>text here</p><p>and \"here</p>", "text here\nand \"here"),
        ("<nav><a href=1>One</a></nav><footer>c</footer>", ""),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("", ""),
        (None, ""),
    ],
)
def test_pages_of_known_text(page, want):
    assert main_text(page) == want


def test_work_is_linear_in_broken_pages():
    for unit in ("<div>", "</b>", "<p><b>", "<a x='", "<!--", "<", "&", "<td>", "<li>x", "<p><object>", "<i>y"):
        assert isinstance(main_text(unit * 40_000 + LONG), str)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "text, ", "<b>", "</b>", "<li>", "<table>", "<td>", "</table>", "&amp;", "<", "'", '"', "<a href='x'>", "</a>", "<!--", "-->", "<script>", "</script>", "<br/>", "\n", "<object>", "</object>"]), max_size=40))
def test_any_markup_gives_clean_blocks(pieces):
    text = main_text("".join(pieces))
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    rows = [(1, None, f"<p>{LONG}", "x", 1), (1, None, f"<p>{LONG}", "x", 1), (None, "u", None, None, 2), (2, "u", "", "y", 3), (3, "v", f"<p>{LONG} " * 20_000, "z", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(repr, (tuple(r) for r in main_texts(df).collect())))
    long_text = "\n".join([LONG] * 20_000)
    assert got == sorted(map(repr, [(1, None, LONG, len(LONG)), (1, None, LONG, len(LONG)), (None, "u", "", 0), (2, "u", "", 0), (3, "v", long_text, len(long_text))]))
    assert main_texts(df.limit(0)).count() == 0
    assert main_texts(df.select("page_id")).collect()[0]["text"] == ""
