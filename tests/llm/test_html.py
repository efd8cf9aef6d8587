import re
import time
from html import unescape

import pytest

from mastwire.llm import html
from mastwire.llm.store import table

LONG = "Words of the article, more of them, and so on until the line is long enough to count. "
PLAIN = f"""<html><head><title>No</title><style>p{{}}</style></head><body class="has-sidebar">
<header><a href="/">Site</a> slogan</header><div id="topNav"><ul><li><a href="a">Home</a><li><a href="b">News</a></ul></div>
<div class="wrap"><div class="sidebar"><p>{LONG}</p></div><h1>Head&eacute;</h1>
<div class="post-body"><p>One &amp; {LONG}<p>Two<br>lines&nbsp;here <a href="x">link</a> <b>bold</b>.
<!-- not <p>this</p> --><script>var a = "</p><p>no";</script><ul><li>item 1<li>item 2</ul><form><p>Name <input></p></form>
<div class="ad-slot">Buy</div><table><tr><td>c1<td>c2</table></div>
<p>{LONG}{LONG}</p><div class="comments"><p>{LONG}</p></div></div><footer>End</footer></body></html>"""


def test_article_without_article_element():
    long = LONG.strip()
    assert html.main_text(PLAIN).split("\n") == [
        "Headé", f"One & {long}", "Two lines here link bold.", "item 1", "item 2", "c1", "c2", f"{long} {long}"]


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a</p><p>b", "a\nb"), ("<nav>x</nav>", ""), ("a < b <c", "a < b <c"),
    ("<article><p>x</p><article class='comment'><p>y</p></article></article>", "x"),
    ("<main><article><header><h1>T</h1></header><p>x, y</p><aside>z</aside></article></main>", "T\nx, y"),
    ("<p title='a>b'>q</p><p hidden>no</p><p style='display: none'>no</p>", "q"),
    ("<div><a href='unclosed>x</div><p>y</p>", "x\ny"), ("<article><p>&lt;p&gt; &#233;&bogus;</p></article>", "<p> é&bogus;"),
])
def test_odd_pages(page, want):
    assert html.main_text(page) == want


def test_long_and_deep_pages_take_linear_time():
    start = time.process_time()
    for page in ("<div>" * 20000 + "x", "<p>word, " * 50000, "<" * 200000, "<a b='" * 20000, "<!--" * 50000, "<b>" * 20000 + "</i>" * 200):
        html.main_text(page)
    assert time.process_time() - start < 60


def test_given_pages(spark):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    got = {r.page_id: r for r in html.extracted(pages).collect()}
    for r in pages.collect():
        own = re.search(r"<article>(.*?)(</article>|<footer|$)", r.html, re.S)[1].replace("<br>", " ")
        lines = [" ".join(unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)>", own)]
        assert got[r.page_id].text == "\n".join(x for x in lines if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_nulls_and_repeats(spark):
    rows = [(1, "u", None, "x"), (None, None, "<p>a</p>", "x"), (1, "u", None, "x")]
    got = html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(map(tuple, got), key=str) == [(1, "u", "", 0), (1, "u", "", 0), (None, None, "a", 1)]
    assert html.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
