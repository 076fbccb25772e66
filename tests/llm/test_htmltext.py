"""Main text of pages in several layouts, the consensus of hosts, and the rows the docstring names."""

import html
import os
import random
import re

import duckdb
import pytest

from annalist.llm import htmltext, queries
from annalist.llm.htmltext import Page

SF = "/root/testdata/sf0.001"
SAID = [f"Sentence {i} of the article, with a few more words so that it reads like a paragraph & counts." for i in range(8)]
ASIDE = "Another story that readers liked, told at length in a box beside the article, again and again and again. " * 3


def extracted(spark, rows):
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, host string, paths string")
    return {r.page_id: r for r in htmltext.extract(pages).collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_query_equals_a_plain_reading_of_its_pages(spark):
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in queries.QUERIES["op11_html_extraction"](spark, SF).collect()}
    rows = duckdb.connect().execute(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    for i, url, source in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|$)", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", part))).split()) for part in re.split(r"</?(?:p|h1)>", inside))
        want = "\n".join(b for b in blocks if b)
        assert got[i] == (url, want, len(want))
    assert len(got) == len(rows)


def escaped(texts):
    return "".join(f"<p>{html.escape(t)}</p>" for t in texts)


LAYOUTS = {
    "article": "<body><header><h1>Site</h1><nav><a href=/>Home</a></nav></header><article><header><h1>Title</h1></header>{body}<footer>Filed under x</footer><section class='comments'><article class=comment><p>{aside}</p></article></section></article><aside><p>{aside}</p></aside></body>",
    "classes": "<div id=page><div class='site-header'>Site <ul class=menu><li><a href=/>Home</a></ul></div><div class='wrap has-sidebar'><div class='post post-{n}'><h2>Title</h2><div class=entry-content>{body}</div></div><div id=sidebar><p>{aside}</div></div><div class=cookieNotice><p>{aside}</div></div>",
    "main": "<html><head><title>t</title><body><div role=navigation>x</div><main><h1>Title</h1>{body}<form action=/><p>Subscribe</p><input><button>Go</button></form><div class='ad-slot'><p>{aside}</p></div></main><div class='reader-comments'><p>{aside}</p></div>",
    "table": "<body><table><tr><td class=nav><a href=1>one</a><td><h1>Title</h1>{body}<tr><td colspan=2 class=footer>{aside}</table>",
    "form": "<body><form id=aspnetForm><div class=banner>{aside}</div><main><h1>Title</h1>{body}</main></form>",
    "hidden": "<body><article><h1>Title</h1>{body}<div style='display: none'>{aside}</div><p hidden>{aside}</p><noscript>{aside}</noscript><script>var a='<p>x</p>';</script><style>p{{}}</style><!-- {aside} --></article><dialog open>{aside}</dialog>",
    "sections": "<body><div><section>{body}</section><section><h2>Title</h2></section></div><div class=related><p>{aside}</div>",
}


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_layouts(name):
    got = Page(LAYOUTS[name].format(body=escaped(SAID), aside=ASIDE, n=7)).main_text({}).split("\n")
    assert [t for t in got if t != "Title"] == SAID and "Title" in got


def test_text_is_decoded_once_and_trimmed():
    page = "<article><p> a&nbsp;b\n\t c<br>d &amp;lt; &#x41;&copy &am <b>bo</b>ld<a href='x>y'>link</a> 1 < 2 <p title=it's>e<ul><li>f<li>g</ul>h<td>i</article>"
    assert Page(page).main_text({}) == "a b c d &lt; A© &am boldlink 1 < 2\ne\nf\ng\nh\ni"


def test_stray_and_unclosed_tags():
    assert Page("</div><p>one</b></article><p>two <b>three<p>four</p></p><div>five").main_text({}) == "one\ntwo three\nfour\nfive"
    assert Page("plain text, no tag").main_text({}) == "plain text, no tag"
    assert Page("<p>cut off <a href='/x").main_text({}) == "cut off"
    assert Page("").main_text({}) == Page("<script>only</script><!-- x").main_text({}) == ""
    deep = Page("<div>" * 20_000 + "<p>deep</p>" * 3)
    assert deep.main_text({}) == "deep\ndeep\ndeep" and len(deep.path) <= htmltext.DEPTH
    assert Page("<div class=modal><p>all there is</p></div>").main_text({}) == "all there is"


def test_hosts_outvote_a_page(spark):
    page = "<body><div class='b{n}1'><p>{short}</p></div><div class='s{n}'><p>{box}</p></div></body>"
    rows = [(i, f"https://Site.example/{i}", page.format(n=i, short=" ".join(SAID), box="A box.")) for i in range(30)]
    rows += [(100, "http://site.example", page.format(n=5, short="A short article.", box=ASIDE)), (101, None, page.format(n=5, short="A short article.", box=ASIDE)), (102, "http://other.example/", "<div class=x1><p>other</p></div>")]
    got = extracted(spark, rows)
    assert all(got[i].text == " ".join(SAID) for i in range(30))
    assert got[100].text == "A short article." and got[101].text == ASIDE.strip() and got[102].text == "other"


def test_consensus_counts_votes_and_keeps_a_twentieth(spark):
    rows = [(i, "http://h.example/x", f"<div class='{'a' if i < 60 else 'b' if i < 98 else 'c' if i < 99 else 'd'}'><p>text</p></div>") for i in range(100)]
    found = htmltext.consensus(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(r.host, r.paths) for r in found] == [("h.example", {"body>div.a": 60, "body>div.b": 38})]


def test_nulls_repeated_rows_and_empty_tables(spark):
    rows = [(1, None, None), (2, "http://a.example", ""), (None, "no host", "<p>x</p>"), (3, "http://a.example", "<p>long</p>" * 50_000), (4, "http://", "<p>y")]
    got = extracted(spark, rows)
    assert {k: (r.url, r.n_chars) for k, r in got.items()} == {1: (None, 0), 2: ("http://a.example", 0), None: ("no host", 1), 3: ("http://a.example", 250_000 - 1), 4: ("http://", 1)}
    twice = spark.createDataFrame([(1, "http://a.example", "<p>x")] * 3, "page_id long, url string, html string")
    assert [r.text for r in htmltext.extract(twice).collect()] == ["x"] * 3
    assert htmltext.extract(twice.limit(0)).collect() == []
    broken = spark.sql("SELECT 1L AS page_id, 'http://a.example' AS url, CAST(X'3C703EFF61' AS STRING) AS html")
    assert [r.text for r in htmltext.extract(broken).collect()] == ["�a"]


def test_rows_without_a_shared_order_are_alike(spark):
    r = random.Random(11)
    rows = [(i, f"http://h{i % 3}.example/", LAYOUTS[r.choice(sorted(LAYOUTS))].format(body=escaped(r.sample(SAID, r.randint(1, 8))), aside=ASIDE, n=i)) for i in range(60)]
    one, other = extracted(spark, rows), extracted(spark, rows[::-1])
    assert {k: v.text for k, v in one.items()} == {k: v.text for k, v in other.items()}
