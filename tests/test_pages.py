"""Page text against pages worked out by hand and a plain walk over all stored pages."""

import html
import re

import pytest
from sedge.plans.queries import QUERIES
from sedge.sources import pages


@pytest.mark.parametrize(
    "page, title, content, holder",
    [
        ("<title>T &amp; t</title><body>a<nav>x</nav> b&nbsp;&eacute;&#x41;<script>var a='</p>'</script></body>", "T & t", "a b éA", "body"),
        ("<h1>Head</h1><main>m<article>a<article>b</article></article></main>", "Head", "abb", "article"),
        ("<main>one</main><div class='x content'>two</div><main>three</main>", "example.org", "onethree", "main"),
        ("<div class=content>c<div>d<div>e</div></div>f</div>g", "example.org", "cdef", ".content"),
        ("<div id=content>i</div><p class='post'>p<p>q", "example.org", "p", ".post"),
        ("<div id='content'>i<b>j</div>k", "example.org", "ij", "#content"),
        ("<article></article><p>left", "example.org", "left", "body"),
        ("<article> \n</article><p>left", "example.org", "", "article"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e</p></b>f", "example.org", "abcdef", "body"),
        ("<article><nav>n<div>m</nav>kept</article></div>after", "example.org", "kept", "article"),
        ("<div class='sidebar'>s</div><div class='advertisement x'>t</div><aside>u</aside>v<!-- <article>w</article> -->", "example.org", "v", "body"),
        ("<p>a<div class=article>b<p>c</div>d", "example.org", "bc", ".article"),
        ("<article>open <b>never closed", "example.org", "open never closed", "article"),
        ("", "example.org", "", "body"),
        ("<<>< a < b &unknown; &lt;article&gt;", "example.org", "<<>< a < b &unknown; <article>", "body"),
        ("<head><title>x</title></head>\n<body class='content'>body text<footer>f</footer></body> tail", "x", "body text tail", ".content"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "example.org", "abc", "body"),
    ],
)
def test_pages(page, title, content, holder):
    assert pages.read_page(page, "https://Example.org:8080/a?b") == (title, content, holder)


def test_deep_and_long_pages():
    assert pages.read_page("<div>" * 50_000 + "x", None)[1] == "x"
    assert len(pages.read_page("<article>" + "word " * 400_000 + "</article>", None)[1]) == 5 * 400_000 - 1


def walk(page):
    """Names and texts one after another: the depth of what is dropped and of articles, nothing else."""
    page = re.sub(r"(?s)<!--.*?-->", "", page)
    page = re.sub(r"(?is)<(script|style)\b.*?</\1>", "", page)
    out, drop, inside, title, in_title = [], 0, 0, [], False
    for tag, text in re.findall(r"(<[^>]*>)|([^<]+)", page):
        if tag:
            name = re.match(r"</?\s*([a-z0-9!]*)", tag.lower())[1]
            step = -1 if tag.startswith("</") else 1
            drop += step * (name in ("nav", "footer", "header", "aside"))
            inside += step * (name == "article")
            in_title = (step == 1) if name == "title" else in_title
        elif in_title:
            title.append(text)
        elif inside and not drop:
            out.append(text)
    return " ".join(html.unescape("".join(title)).split()), " ".join(html.unescape("".join(out)).split())


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_all_stored_pages(spark, sf):
    path = f"/root/testdata/sf{sf}"
    stored = {r.page_id: r.html for r in spark.read.parquet(f"{path}/pages.parquet").collect()}
    got = {r.page_id: (r.title, r.content) for r in QUERIES["s7_page_tree"](spark, path).collect()}
    assert got == {k: walk(h or "") for k, h in stored.items()}


def test_null_page_and_other_names(spark):
    df = spark.createDataFrame([("k", None, None, 1), ("l", "<p>x", "http://h.example/", 2)], "name string, page string, address string, html int")
    got = pages.page_documents(df, "name", "page", "address")
    assert {tuple(r) for r in got.collect()} == {("k", "", "", "body"), ("l", "h.example", "x", "body")}
    assert pages.page_documents(df.limit(0), "name", "page", "address").count() == 0
