import html
import os
import re

import pyarrow.parquet as pq
import pytest

from gleaner.llm.html_main_text import extract, main_text, smoothed

PAGES = "/root/testdata/sf0.001/pages.parquet"


def plain_article(page):
    """The article by regular expressions that know how these pages are built."""
    body = re.search(r"<article>(.*)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1|br)>", body)
    return " ".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split())))


@pytest.mark.skipif(not os.path.exists(PAGES), reason="no test tables")
def test_tables_pages_match_their_articles():
    for page in pq.read_table(PAGES, columns=["html"])["html"].to_pylist():
        assert main_text(page) == plain_article(page)


def test_boilerplate_goes_and_short_text_stays():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><a href=x>Home</a><a href=y>About us and more</a></nav><div class="cookie-notice">We use cookies to do many things here.</div>
    <article><h1>Head &amp; line</h1><p>Short.<p>A   much longer\n paragraph with <b>bold</b> and <a href=z>a link</a> in it.
    <form><input name=q><button>Go</button></form><ul><li>one<li>two</ul><aside>Aside text that is long enough to look like content.</aside>
    <div class="ad-slot">Buy this great thing now, it is really great.</div></article>
    <section id="comments"><article><p>A reader writes a rather long comment about the article above.</p></article></section>
    <footer>&copy; 2020 All rights reserved by the owner of this site</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert main_text(page) == "Head & line Short. A much longer paragraph with bold and a link in it. one two"


def test_pages_without_article():
    page = "<body><div id=menu><a href=1>One</a> <a href=2>Two</a></div><div class=content><h2>Title</h2><p>Some words that make a paragraph of text.</p><p>End.</p></div><div class=footer>Imprint and other words of the owner.</div></body>"
    assert main_text(page) == "Title Some words that make a paragraph of text. End."


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("<p>", ""), ("just text &am", "just text &am"), ("<nav>only menu</nav>", ""), ("<p class=notice>x<p>Real text", "Real text"), ("a<b", "a<b"), ("&amp&lt;", "&<"), ("<p>x</p>" * 20_000, " ".join("x" * 20_000))])
def test_odd_pages(page, want):
    assert main_text(page) == want


def test_forms_around_everything_and_headers_in_articles():
    assert main_text("<form id=aspnet><article><header><h1>The title</h1><p>By an author</p></header><p>Text of the article.</p></article></form>") == "The title Text of the article."
    assert main_text("<body><form><div><p>All of this page stands in a form.</p></div></form></body>") == "All of this page stands in a form."
    assert main_text("<header><h1>Site</h1></header><article><p>Text of the article.</p></article>") == "Text of the article."


def test_ratio_decides_inside_articles():
    links = "".join(f"<li><a href={i}>another story number {i}</a>" for i in range(9))
    text = "".join(f"<p>Paragraph {i} of an article that says a few things.</p>" for i in range(5))
    got = main_text(f"<article><h2>Title</h2>{text}<h3>End</h3><p>Bye.</p><p>So.</p><ul>{links}</ul></article>")
    assert got.startswith("Title Paragraph 0") and "Bye. So." in got and "number 4" not in got and "number 8" not in got


def test_pages_without_article_elements_by_ratio():
    """Articles in plain containers, with nothing named: the ratio alone tells them from the link lists around them."""
    for page in pq.read_table(PAGES, columns=["html"])["html"].to_pylist()[:100] if os.path.exists(PAGES) else []:
        plain = re.sub(r"</?nav>", "", page.replace("<article>", "<div>").replace("</article>", "</div>").replace('<div class="ad">', "<div hidden>"))
        assert main_text(plain) == plain_article(page)


def test_crossed_tags_take_linear_time():
    import time

    began = time.process_time()
    assert main_text("<div>" * 100_000 + "x" + "</section>" * 100_000) == "x"
    assert main_text("<p>x</section></b>" * 50_000) == " ".join("x" * 50_000)
    assert time.process_time() - began < 20


def test_unfinished_markup_takes_linear_time():
    import time

    began = time.process_time()
    for piece, n in (("<a href='", 110_000), ("<!--", 250_000), ("<!-- x > ", 110_000), ("<![CDATA[", 110_000), ("<?x", 300_000), ("</a", 300_000), ("<script>", 120_000), ("<!", 500_000), ('<p class="', 100_000), ("<script><!--", 90_000), ("&", 1_000_000), ("<a b=c ", 140_000)):
        main_text("<p>Text before.</p>" + piece * n)
        main_text("<p>Text before.</p>" + piece * n + ">")
    assert time.process_time() - began < 60


def test_unfinished_markup():
    assert main_text("<p>Some text.</p><!-- never ends <p>more</p>") == "Some text."
    assert main_text("<p>Some text.</p><!-- ends --><p>More text.</p>") == "Some text. More text."
    assert main_text('<p>Some text.</p><script>var s = "<!--";</script><p>More text.</p>') == "Some text. More text."
    assert main_text("<p>Some text.</p> and a < b") == "Some text. and a < b"


@pytest.mark.parametrize("mark", ['class="mw-header"', 'class="social-good"', 'class="search-results-note"', 'id="alert-levels"', 'class="shareholders comment-worthy"', 'id="bannerman"'])
def test_names_that_only_sound_like_boilerplate(mark):
    page = f"<article><h1>Title</h1><p>A paragraph of the article with some words.</p><div {mark}><p>Another paragraph that belongs to it.</p></div><p>The end of it.</p></article>"
    assert main_text(page) == "Title A paragraph of the article with some words. Another paragraph that belongs to it. The end of it."


@pytest.mark.parametrize("mark", ['class="ad"', 'class="ad-slot"', 'class="cookie-notice"', 'id="related-posts"', 'class="big social-share-links"', 'role="navigation"', 'class="newsletterSignup"'])
def test_names_that_tell_of_boilerplate(mark):
    page = f"<article><h1>Title</h1><p>A paragraph of the article with some words.</p><div {mark}><p>Another paragraph that does not belong to it.</p></div><p>The end of it.</p></article>"
    assert main_text(page) == "Title A paragraph of the article with some words. The end of it."


def test_unnamed_footers_and_sidebars():
    text = "".join(f"<p>Paragraph {i} of the page, which says a few things about it.</p>" for i in range(6))
    page = f"<body><div><a href=/>Home</a> <a href=/a>About</a></div><div><h1>The title</h1></div><div>{text}</div><div><h4>Latest</h4><ul><li><a href=1>One story</a><li><a href=2>Other story</a></ul></div><div><p>Copyright 2020 Example Corp. All rights reserved.</p><a href=t>Terms</a> <a href=p>Privacy</a></div></body>"
    want = "The title " + " ".join(f"Paragraph {i} of the page, which says a few things about it." for i in range(6))
    assert main_text(page) == want
    parts = f"<body><div>{text}</div><div><p>A short part.</p></div><div>{text}</div></body>"
    assert "A short part." in main_text(parts)


def test_smoothing_keeps_a_constant():
    import numpy as np

    assert np.allclose(smoothed(np.full(9, 3.0)), 3.0) and len(smoothed(np.array([1.0]))) == 1


def test_tables(spark):
    rows = [(1, "u", "<p>naïve text</p>", "x"), (None, None, None, None), (1, "u", "<p>naïve text</p>", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in extract(pages).collect())
    assert got == [("1", "u", "naïve text", 10), ("1", "u", "naïve text", 10), ("None", "None", "", 0)]
    assert extract(pages.limit(0)).collect() == []
