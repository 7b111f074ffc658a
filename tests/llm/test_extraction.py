"""Main text of pages: markup as browsers read it, and what recurs on a host."""

import html
import re

import pytest

from changegrid.llm import extraction


def _text(page):
    blocks, _ = extraction.read_page(page)
    best = max((level for _, level, _ in blocks), default=0)
    return [t for t, level, _ in blocks if level == best]


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        ("<p>a<p>b<ul><li>x<li>y</ul>c", ["a", "b", "x", "y", "c"]),
        ("<div class='ad'>no</div><p>yes &lt;b&gt; &amp x &am &nbsp; y</p>", ["yes <b> & x &am y"]),
        ("plain < text & 2<3 more", ["plain < text & 2<3 more"]),
        ("<nav>n</nav><article><header><h1>T</h1><p>by</p></header><p>one<br>two</p><aside>no</aside><section class='comments'><p>no</p></section></article><p>out", ["T", "one two"]),
        ("<main><p>kept</p><form>no<p>no</form></main><div>out</div>", ["kept"]),
        ("<p title=\"a>b\">q</p><p x='>z", ["q", "z"]),
        ("<script>if(a<b){'</p>'}</script>ok<style>x", ["ok"]),
        ("<title>no</title><body><table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<span class='share'>no <span>in</span> no</span>yes<b>!</b>", ["yes!"]),
        ("<!-- c --><p>x<!-- <p>y</p> -->z</p><!-- open", ["xz"]),
        ("<article><p><b>x<br><p>y</b> z<footer>no</footer>", ["x", "y z"]),
        ("<p>cut off <a hre", ["cut off"]),
        ("<article><p>a</p><article class=comment><p>no</p></article></article>", ["a"]),
        ("", []), ("   \n ", []), ("</p></div>", []),
        ("<div>" * 5000 + "deep" + "</div>" * 5000, ["deep"]),
    ],
)
def test_markup(page, blocks):
    assert _text(page) == blocks


def _page(text, menu="<div class=x><ul><li>Home<li>About</ul></div>", notice="<section>We use your data</section>"):
    return f"<html><body>{menu}{text}{notice}</body></html>"


def test_what_recurs_goes(spark):
    """Parts without a telling name go where a host repeats them; on another host they stay."""
    site = [(i, f"https://User@A.example.org:80/{i}", _page(f"<div><p>text of page {i}</p></div>")) for i in range(30)]
    other = [(100 + i, f"http://b.example.org/{i}", _page(f"<div><p>other {i}</p></div>")) for i in range(4)]
    copies = [(200 + i, f"http://c.example.org/{i}?x", _page("<div><p>one article, many times</p></div>", f"<nav>{i}</nav>")) for i in range(40)]
    marked = [(300 + i, f"http://d.example.org/{i}", _page(f"<article><p>a passage that all share</p><div>Read more of this</div><p>own {i}</p></article>")) for i in range(20)]
    odd = [(None, None, None), (400, None, _page("<p>no url</p>")), (401, "not a url", ""), (402, "http://a.example.org/", "<p>long " + "word " * 200_000 + "</p>")]
    rows = site + other + copies + marked + odd + [site[0], site[0]]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as text", "1 as host", "2 as page").repartition(4)
    got = extraction.main_text(frame, min_pages=10, min_share=0.2).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"text of page {i}" for i in range(30))
    assert all(text[100 + i] == f"Home\n\nAbout\n\nother {i}\n\nWe use your data" for i in range(4))
    assert all(text[200 + i] == "one article, many times\n\nWe use your data" for i in range(40))
    assert all(text[300 + i] == f"a passage that all share\n\nown {i}" for i in range(20))
    assert text[None] == "" and text[401] == "" and text[400].endswith("no url\n\nWe use your data") and len(text[402]) == 5 * 200_001 - 1
    assert all(r.n_chars == len(r.text) for r in got) and all(r.n_template >= 2 for r in got if r.page_id in range(30))
    assert extraction.main_text(frame.limit(0)).count() == 0


def test_given_pages(spark):
    """Against a plain reading of the one layout that the given pages have."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extraction.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(?:</article>|<footer>)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)
