"""Main text: pages with every kind of surrounding, broken markup, and the given pages against their article element."""

import html
import re

import pytest

from codestrata.llm import html as H

BODY = "<p>A paragraph with quite a few words in it, so that it is text.</p><p>Short.</p><p>The last one &amp; more&nbsp;of it.</p>"
TEXT = "A paragraph with quite a few words in it, so that it is text. Short. The last one & more of it."
AROUND = {
    "menu": '<div class="main-menu"><a href="/">Home</a> <a href="/b">About us and what we do</a></div>',
    "nav": "<nav><ul><li><a href=x>Home<li><a href=y>News</ul></nav>",
    "header": "<header><h1>The Site of All Sites</h1><p>We write about everything, every day of the year.</p></header>",
    "footer": "<footer><p>All rights reserved by us, and a long line of legal words that nobody has ever read.</p></footer>",
    "sidebar": '<div id="sideBar"><h3>Popular</h3><p>Some other long teaser text that is not of this article at all.</p></div>',
    "aside": "<aside><p>Some other long teaser text that is not of this article at all.</p></aside>",
    "notice": '<div role="alert" class="x"><p>We use cookies, and we would very much like you to agree to that now.</p></div>',
    "advert": '<div class="ad-slot ad2"><p>Buy this thing now, it is the best thing that money can buy, really.</p></div>',
    "form": "<form><p>Write your name and address and all the rest of it in here</p><select><option>A<option>B</select></form>",
    "script": "<script>var p = '<p>no text</p>';</script><style>p{content:'</p>'}</style><noscript>Enable it.</noscript>",
    "comments": '<section id="comments"><article><p>I am a reader, and I find this rather well written indeed.</p></article></section>',
    "hidden": '<div style="display: none"><p>This is a text that nobody is meant to see on this page.</p></div>',
    "markup": "<!-- a comment <p>in the page</p> --><svg><text>drawn</text></svg><iframe>framed</iframe>",
}


@pytest.mark.parametrize("kind", sorted(AROUND))
@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", '<div class="post">{}</div>', "{}"])
def test_what_is_not_the_article_goes(kind, frame):
    for page in (AROUND[kind] + frame.format(BODY), frame.format(BODY) + AROUND[kind], frame.format(BODY + AROUND[kind])):
        if kind == "header" and page.endswith("</header></article>") or kind == "header" and page.endswith("</header></main>"):
            continue  # a header of the article itself is part of it
        assert H.main_text(f"<!DOCTYPE html><html><head><title>T</title></head><body>{page}</body></html>") == TEXT


def test_blocks_white_space_and_references():
    page = "<article><h1> A\n title</h1><p>one<br>two <b>thr</b>ee\t&eacute;&#233;&lt;p&gt;</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>"
    assert H.main_text(page) == "A title one two three éé<p> x y 1 2"
    assert H.main_text("<article>a<p>b<div>c</div>d</article>e") == "a b c d"


def test_broken_markup():
    assert H.main_text("<article><p><b>open <p>again</article><footer>no</footer>") == "open again"
    assert H.main_text("</div></p><article>text</article></b>") == "text"
    assert H.main_text("<head><title>no<body><article>yes</article>") in ("yes", "")
    assert H.main_text("<article>text <!-- never closed") == "text"
    assert H.main_text("<article>a < b & c</article>") == "a < b & c"
    assert H.main_text("only words, no markup") == "only words, no markup"


def test_titles_layout_classes_and_article_heads():
    assert H.main_text(f"<h1>Title</h1><div class=text>{BODY}</div>") == f"Title {TEXT}"
    assert H.main_text(f'<body class="sidebar-left"><div class="has-sidebar">{BODY}</div></body>') == TEXT
    assert H.main_text(f'<div class="sidebar-layout"><main>{BODY}</main></div>') == TEXT
    assert H.main_text(f"<article><header><h1>Title</h1></header>{BODY}</article>") == f"Title {TEXT}"


def test_empty_and_very_long_pages():
    assert [H.main_text(x) for x in (None, "", " \n", "<p></p>", "<nav>menu</nav>")] == [""] * 5
    long = "<article>" + "<p>word and more words</p>" * 60_000 + "</article>"
    assert len(H.main_text(long)) == 60_000 * 20 - 1
    deep = "<div>" * 5_000 + BODY + "</div>" * 5_000
    assert H.main_text(deep) == TEXT


def test_smoothing_and_clusters():
    import numpy as np

    flat = H.smoothed(np.full(7, 2.0))
    assert np.allclose(flat, 2.0)
    assert 1.0 < H.threshold(np.array([0.0, 1.0, 9.0, 10.0])) < 9.0


def test_tables(spark):
    rows = [(1, "u", "<article>a</article>", "x", 1), (1, "u", "<article>a</article>", "x", 1), (None, None, None, None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row long")
    found = H.extract(frame)
    assert found.columns == ["page_id", "url", "text", "row", "main_text"]
    assert sorted(tuple(r)[-1] for r in found.collect()) == ["", "a", "a"]
    assert H.extract(frame.limit(0)).collect() == []


def test_given_pages_give_their_article(spark):
    sf = "/root/testdata/sf0.001"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = H.query(spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        article = re.search("<article>(.*)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert r.n_chars == len(r.text)
