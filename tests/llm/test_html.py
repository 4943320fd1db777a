"""Main text of pages: hand-made layouts with their article, hard markup, hard rows, and linear time."""

import random
import time

import numpy as np
import pytest

from gridwx.llm.html import Page, extract_main_text, main_text, smoothed

A = [f"Paragraph {i} tells of the matter at hand in a good number of plain words, as articles do." for i in range(4)]
BODY = "".join(f"<p>{p}</p>" for p in A)
ARTICLE = "\n".join(["Title", *A])
NAV = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li></ul></nav>"
LONG = "These words are long enough to pass for a paragraph of the article itself, but they are none of it at all."
COMMENTS = f"<section id='comments'><h2>3 Comments</h2><article class='comment'><p>{LONG}</p></article><div class='comment-body'>{LONG}</div></section>"

LAYOUTS = {
    "plain": f"{NAV}<article><h1>Title</h1>{BODY}</article><footer>&copy; x</footer>",
    "advert and notice": f"<div class='cookie-notice'>{LONG}</div>{NAV}<div class='ad'>{LONG}</div><article><h1>Title</h1>{BODY}<div class='ad-slot'>{LONG}</div></article>",
    "aside in article": f"<article><h1>Title</h1>{BODY}<aside>{LONG}</aside><footer>By me</footer></article>",
    "header, form, comments": f"<header><h1>Site</h1>{NAV}</header><main><article><header><h1>Title</h1></header>{BODY}</article>{COMMENTS}</main><form>{LONG}<input><button>Go</button></form>",
    "form around the page": f"<form action=/>{NAV}<article><h1>Title</h1>{BODY}</article></form>",
    "no article element": f"<div id=header><a href=/>Site</a></div><div id='menu'><a href=/>Home</a></div><div class='content'><h1>Title</h1>{BODY}</div><div class='sidebar'><p>{LONG}</p></div>",
    "class about the page": f"<body class='has-sidebar'><div class='wrap with-sidebar'><div class='post'><h1>Title</h1>{BODY}</div></div><div id='sidebar'>{LONG}</div>",
    "named like a sidebar": f"<div class='container sidebar-right'>{NAV}<main><h1>Title</h1>{BODY}</main></div>",
    "flat body": f"<a href=/>Home</a> <a href=/b>About</a><h1>Title</h1>{BODY}<div class=footer>{LONG}</div>",
    "unnamed links around": f"<div><a href=/>Home</a> | <a href=/b>More</a></div><div><h1>Title</h1>{BODY}</div><div><a href=/>Terms of use</a> <a href=/>Imprint</a></div>",
    "heading before the article": f"<main><h1>Title</h1><article>{BODY}</article><div class=related><a>x</a>{LONG}</div></main>",
    "unclosed": f"<nav><a href=/>x</a></nav><article><h1>Title</h1><p>{A[0]}<p><b>{A[1]}<br><p>{A[2]}<p>{A[3]}</article><footer>x",
    "roles": f"<div role=navigation>{LONG}</div><div role=main><div role=article><h1>Title</h1>{BODY}</div></div><div role=contentinfo>{LONG}</div>",
    "scripts": f"<script>var a='</p><p>{LONG}';</script><style>p{{}}</style><article><h1>Title</h1>{BODY}<script>if (a<b) x('</article>')</script><noscript>{LONG}</noscript></article>",
    "camel case": f"<div id='cookieBanner'>{LONG}</div><div class='articleBody'><h1>Title</h1>{BODY}</div><div id='commentList'><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>",
    "hidden": f"<article><h1>Title</h1>{BODY}<p hidden>{LONG}</p><div style='display: none'>{LONG}</div></article>",
    "only one word beside much else": f"<article><h1>Title</h1>{BODY}</article><div class='x'><a href=/>{LONG}</a></div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layout(name):
    for html in (LAYOUTS[name], f"<!DOCTYPE html><html><head><title>Other</title></head><body>{LAYOUTS[name]}</body></html>", LAYOUTS[name].replace("><", ">\n  <")):
        assert main_text(html) == ARTICLE


def test_blocks_and_references():
    page = "<article><h2>A&amp;B &lt;x&gt; &#8212; &eacute;&nbsp;y</h2>\n<p>one\n\t two<br>three <b>fo</b>ur</p><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><th>3</table>tail &amp no semicolon<pre>x\n y</pre></article>"
    assert main_text(page) == "A&B <x> — é y\none two three four\na\nb\n1 2\n3\ntail & no semicolon\nx y"
    assert main_text("<article>Hi.</article><div class=ad>" + LONG + "</div>") == "Hi."
    assert main_text("<p>1 < 2 and 3 > 2, a<b</p>") in ("1 < 2 and 3 > 2, a", "1 < 2 and 3 > 2, a<b")
    assert main_text("just words &copy; 2") == "just words © 2"


@pytest.mark.parametrize("page", [None, "", " \n", "<", "<p", "<!--", "<!-- x", "<![foo", "<![CDATA[x]]>", "<!x", "</", "</>", "<a href='", "&", "&#xZ;", "&#99999999999;", "<script>", "<title>x", "</p></div>", "<td>", "<tr><td>", "\x00"])
def test_hard_markup(page):
    assert main_text(page) in ("", "<", "&", "&#xZ;", "�", "]]>", "]", "\x00", "</")


def test_truncated_pages_keep_what_came():
    page = f"<article><h1>Title</h1>{BODY}</article><footer>x</footer>"
    for end in range(len(page)):
        assert ARTICLE.startswith(main_text(page[:end])), end


def test_random_markup_never_fails():
    rng = random.Random(4)
    tags = "p div article main nav li ul table tr td th b a span form h1 header footer script style option select dl dt dd br hr svg template body html head title".split()
    for _ in range(400):
        page = "".join(rng.choice([f"<{t} class='{rng.choice(['', 'ad', 'comments'])}'>", f"</{t}>", " words of text ", f"<{t}/>", "<!-- c -->", "&amp;"]) for t in rng.choices(tags, k=60))
        text = main_text(page)
        assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_time_grows_with_the_page():
    def seconds(page):
        began = time.process_time()
        main_text(page)
        return time.process_time() - began

    for part in ("<div>", "<li><div>", "<p>word", "</div>", "<b>", "<td>", "<a class=ad>x", "<div class=ad><article>x", "<article>x", "<h1>x", "&amp", "<table><tr>", "<span class=ad>x<p>"):
        assert seconds(part * 12_000) < 30 * max(seconds(part * 2_000), 0.02), part


def test_smoothing_is_a_mean_over_neighbours():
    values = np.random.default_rng(1).random(50)
    kernel = np.exp(-0.5 * np.arange(-3, 4) ** 2)
    for i, s in enumerate(smoothed(values)):
        near = [(values[i + d], kernel[d + 3]) for d in range(-3, 4) if 0 <= i + d < 50]
        assert abs(s - sum(v * w for v, w in near) / sum(w for _, w in near)) < 1e-12
    assert smoothed(np.array([2.0])).tolist() == [2.0]


def test_tables(spark):
    rows = [(1, LAYOUTS["plain"], "t", 7), (1, LAYOUTS["plain"], "t", 7), (None, None, None, None), (2, "", "", 0), (3, "<article>" + "<p>word</p>" * 30_000 + "</article>", None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    found = extract_main_text(pages)
    assert found.columns == ["page_id", "text", "n_chars"] and dict(found.dtypes)["n_chars"] == "bigint"
    got = {(r["page_id"], r["text"], r["n_chars"]) for r in found.collect()}
    long = "\n".join(["word"] * 30_000)
    assert found.count() == 5 and got == {(1, ARTICLE, len(ARTICLE)), (None, "", 0), (2, "", 0), (3, long, len(long))}
    assert extract_main_text(pages.limit(0)).collect() == []


def test_lines_know_their_tags():
    page = Page().read("<div><p>a<b>c</b></p><p>d</p></div>")
    assert page.texts == ["ac", "d"] and page.tag_counts == [5, 2]
