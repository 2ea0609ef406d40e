"""Main text against pages whose article is known, and against a plain reading of the supplied pages."""

import re
from html import unescape

import pytest

from newslens.llm import host_paths as hp

SCHEMA = "page_id bigint, url string, html string, TEXT string, host string"


def extracted(spark, rows):
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return {r.page_id: (r.text, r.n_chars) for r in hp.extracted(pages).collect()}


def own_best(html):
    page = hp.Page(html)
    return page.text(page.best())


def shell(article, before="", after=""):
    return f'<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home page of it all</a></ul></nav>{before}{article}{after}<footer>&copy; all rights</footer></body></html>'


@pytest.mark.parametrize(
    "article, text",
    [
        ("<article><h1>A &amp; B</h1><p><b>One<br><p>two\n\n three </article>", "A & B\nOne\ntwo three"),
        ("<article><header><p class=by>by X<h1>Title</h1></header><p>Body text here.</p></article>", "Title\nBody text here."),
        ("<article>x<script>var t='</p></article>'</script>y<!-- <p>z</p> -->w</article>", "xyw"),
        ("<article><p>a<div class='ad-box'>buy</div><aside>s</aside><form>f<input></form><p>b</article>", "a\nb"),
        ("<article><ul><li>one<li>two<ul><li>three</ul></ul><table><tr><td>c1<td>c2<tr><td>c3</table></article>", "one\ntwo\nthree\nc1\nc2\nc3"),
        ("<article class='post comments-open has-sidebar'><p>kept text</p><section class=comments><p>a reader says</section></article>", "kept text"),
        ('<article><p title="a > b">quoted</p><p title="unclosed>still</p></article>', "quoted\nstill"),
        ("<article><p>1 < 2 &lt;b&gt; &#233;&nbsp;&eacute;&unknown;</p></article>", "1 < 2 <b> é é&unknown;"),
        ("<article><div class=body><p>long text of the article here</p></div><h2>End</h2></article>", "long text of the article here\nEnd"),
        ("<div id=main><div class=story><h1>H</h1><p>story text that is long enough</p><p>and more</p></div></div>", "H\nstory text that is long enough\nand more"),
    ],
)
def test_article_of_a_page(article, text):
    after = '<div class="related"><a href=x>Something else that is long and much longer than the article itself is</a></div><div class="comments"><article class="comment"><p>I do not agree with any of it at all, not at all.</p></article></div>'
    assert own_best(shell(article, '<div class="cookie-notice">We use cookies, lots and lots of cookies</div>', after)) == text


def test_host_votes_decide_where_a_page_alone_would_not(spark):
    """On one page a list of links and teasers outscores the article; the other pages of the host know better."""
    good = "<div class='content c{0}'><p>Article number {0} has a few sentences. They are plain.</p></div><div class='box'>short</div>"
    odd = "<div class='content c77'><p>Brief one.</p></div><div class='box'>A much longer teaser that has nothing to do with it, on and on and on.</div>"
    rows = [(i, f"http://User@News.example.com:80/{i}", shell(good.format(i))) for i in range(12)] + [(77, "https://news.example.com/77", shell(odd))]
    rows += [(78, "https://other.example.com/", shell(odd)), (79, None, shell(odd))]
    got = extracted(spark, rows)
    assert got[77] == ("Brief one.", 10)
    assert all(got[i][0].startswith(f"Article number {i} ") for i in range(12))
    assert got[78][0].startswith("A much longer") and got[79] == got[78]


def test_defined_results(spark):
    deep = "<div>" * 30_000 + "deep text" + "</div>" * 30_000
    rows = [(1, "http://a/1", None), (2, "no url", ""), (3, None, "plain text only"), (4, "http://a/4", "<p>unclosed <b>all"), (5, "http://deep/", deep)]
    rows += [(6, "http://a/6", shell("<article><p>same</p></article>"))] * 2 + [(None, "http://a/7", shell("<article></article>")), (8, "http://a/8", "<body>&#0;&#x110000;ok"), (9, "http://a/9", "<body><!-- never closed")]
    rows += [(10, "http://a/10", "<article><p>" + "word " * 400_000)]
    got = extracted(spark, rows)
    assert got[1] == ("", 0) and got[2] == ("", 0) and got[6] == ("same", 4) and got[None] == ("", 0) and got[9] == ("", 0)
    assert got[5] == ("deep text", 9) and got[4][0] == "" and got[10][1] == 400_000 * 5 - 1
    assert extracted(spark, []) == {}


def test_winning_paths_by_share(spark):
    cast = spark.createDataFrame([("h", 1)] * 60 + [("h", 2)] * 30 + [("h", 3)] * 4 + [("h", k) for k in range(10, 16)] + [("lone", 9)], "host string, path bigint")
    assert {r.host: sorted(r.paths) for r in hp.winning_paths(cast, 0.05).collect()} == {"h": [1, 2]}


def test_supplied_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in hp.extracted(pages).collect()}
    for row in pages.collect():
        inside = re.search(r"<article>(.*)</article>", row.html, re.S).group(1)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert got[row.page_id] == "\n".join(b for b in blocks if b)
