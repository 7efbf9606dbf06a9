import pytest
from pyspark.sql import functions as F

from docloom.functions import dom, html, markdown as md, urls


def values(spark, rows, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("x"))).collect()]


def test_paths(spark):
    u = ["https://docs.example.com/guide/getting-started.html", "https://docs.example.com", "https://e.org/a/b/?q=1#f", "https://e.org/x.htm.html", None]
    assert values(spark, u, urls.url_to_path) == ["guide/getting-started", "index", "a/b", "x", None]
    assert values(spark, ["a/b/c", "a", None], urls.parent_path) == ["a/b", None, None]
    assert values(spark, ["a/index", "getting-started", "a/my_APIGuide  x"], urls.title_from_path) == ["Overview", "Getting Started", "My APIGuide X"]


def test_normalized(spark):
    u = ["HTTPS://E.org:443/a/#x", "http://e.org:80", "http://e.org/", "http://e.org/a/?b/"]
    assert values(spark, u, urls.normalize_url) == ["https://e.org/a", "http://e.org/", "http://e.org/", "http://e.org/a/?b"]


def test_guard(spark):
    u = ["http://10.1.2.3/", "https://[::1]/", "http://localhost:80/", "ftp://e.org/", "https://x.local/", "https://8.8.8.8/", "https://e.org/", "http://172.31.0.1/", "http://172.32.0.1/", None, "nonsense"]
    assert values(spark, u, urls.guarded) == [True, True, True, True, True, False, False, True, False, True, True]


@pytest.mark.parametrize("glob,path,want", [("/docs/*", "/docs/a", True), ("/docs/*", "/docs/a/b", False), ("/docs/**", "/docs/a/b", True), ("/a?c", "/abc", True), ("/a.c", "/abc", False)])
def test_globs(spark, glob, path, want):
    import re

    assert bool(re.search(urls.glob_regex(glob), path)) == want
    assert values(spark, [path], lambda c: c.rlike(urls.glob_regex(glob))) == [want]


def test_scope(spark):
    f = lambda c: urls.in_scope(c, F.lit("e.org"), includes=["/docs/**"], excludes=["/docs/old/**"])
    assert values(spark, ["https://e.org/docs/a", "https://e.org/docs/old/a", "https://f.org/docs/a", "https://e.org/x", None], f) == [True, False, False, False, False]


def test_links(spark):
    df = spark.createDataFrame([("https://e.org/a/b", "/c#d"), ("https://e.org/a/b", "../x"), ("https://e.org/a/b", "//f.org/y"), ("https://e.org/a/b", "c.html")], "b string, h string")
    got = [r[0] for r in df.select(urls.resolve_any(F.col("b"), F.col("h"))).collect()]
    assert got == ["https://e.org/c", "https://e.org/x", "https://f.org/y", "https://e.org/a/c.html"]


def test_cleanup(spark):
    x = "# A\n\n\n\n\n# B\n```language-js\n<div>x</div>\n```\n<div class='a'>y</div>   \n[l](/z) ![i](/i.png)"
    assert values(spark, [x], lambda c: md.cleanup(c, F.lit("https://e.org/p/q"))) == ["# A\n\n\n## B\n```js\n<div>x</div>\n```\ny\n[l](https://e.org/z) ![i](/i.png)\n"]
    assert values(spark, ["", "\n\n", "x"], md.final_newline) == ["\n", "\n", "x\n"]
    assert values(spark, ["a b\n```\nc d\n```\n# e ## f", ""], md.word_count) == [4, 0]


PAGES = {
    "docusaurus": '<html><head><meta name="generator" content="Docusaurus v2"></head><body><ul class="menu__list"><li><a class="menu__link" href="/docs/x">X</a></ul><article><div class="markdown"><h1>Set up</h1><p>Run it.</p></div></article><footer class="theme-doc-footer">Edit</footer></body></html>',
    "vitepress": '<div id="VPContent"><aside class="VPSidebar"><a href="/guide/">Guide</a></aside><main><div class="vp-doc"><h1>Hi</h1></div></main></div>',
    "gitbook": '<meta name="gitbook"><section class="markdown-section"><h1>Quick</h1></section>',
    "readthedocs": '<div class="wy-nav-side"></div><div role="main"><h1>Ref</h1><footer>no</footer></div>',
    "generic": "<nav>menu</nav><main><h1>About</h1><p>us</p><script>bad()</script></main><footer>foot</footer>",
}


@pytest.mark.parametrize("name", PAGES)
def test_adapters(name):
    doc = dom.parse(PAGES[name])
    a = html.adapter_of(doc)
    assert a.name == name
    body = html.adapter_content(doc, a)
    assert "<h1>" in body and "foot" not in body and "bad()" not in body and "Edit" not in body and "no</" not in body


def test_adapter_tocs():
    toc = {n: html.adapter_toc(d := dom.parse(x), html.adapter_of(d)) for n, x in PAGES.items()}
    assert toc["docusaurus"] == [("X", "x")] and toc["vitepress"] == [("Guide", "guide/")] and toc["generic"] == [("About", "about")] and toc["readthedocs"] == []
    x = dom.parse('<div class="wy-nav-side"><ul class="wy-menu"><a href="#here">Here</a><a href="/ref/api.html">API</a></ul></div>')
    assert html.adapter_toc(x, html.adapter_of(x)) == [("API", "ref/api")]


def test_tree():
    doc = dom.parse("<ul><li>a<li>b</ul><p>one<p>two<table><tr><th>h<td>x<tr><td>1</table>&amp;&copy;")
    assert [e.text() for e in dom.select(doc, "li")] == ["a", "b"]
    assert [e.text() for e in dom.select(doc, "p")] == ["one", "two"]
    assert "&©" in doc.text()
    assert dom.table_markdown([["a", "b"], ["1"]], True) == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert dom.table_markdown([["a"], ["b"]], False) == "| a |\n| --- |\n| a |\n| b |"


def test_markdown():
    x = dom.markdown(dom.parse("<h2>T</h2><p>a <b>b</b> <a href='/c'>c</a></p><ul><li>x<li>y<ol><li>z</ol></ul><pre><code class='language-py'>k = 1</code></pre><script>s</script>"))
    assert "## T" in x and "a **b** [c](/c)" in x and "- x" in x and "1. z" in x and "```language-py\nk = 1\n```" in x and "s</" not in x


def test_facts_of_nulls(spark):
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p>x")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.facts(df).collect()}
    assert got[1]["adapter"] is None and got[2]["adapter"] == "generic" and "x" in got[3]["raw"]


ODD_HTML = [
    "<H1 class='x>y'>Big &amp; <b>bold</b> &eacute;&#233;&#xE9;&mdash;</H1><A HREF='/a&amp;b'>x</A><a href=plain.html>y</a>",
    "<!-- <h1>no</h1><a href='/no'>n</a> --><h1\n id=t> Real&nbsp;</h1 ><a title='a > b' href = \"../up?q=1#f\">u</a>",
    "<script>var x = '<h1>no</h1><a href=\"/no\">';</script><style>h1 {}</style><h1></h1><a data-href='/no' href='?q=2'>q</a><a name=n>none</a>",
    "<abbr href='/no'>a</abbr><a href=' /blank '>b</a><a\thref=\"/tab\">t</a><a href=\"\">e</a><a href='//cdn.example.org/x'>c</a>",
    "<p>none</p>", "", None,
]


def test_titles_and_links_equal_those_of_the_tree(spark):
    from tests.conftest import DATA
    from tests.test_html import plain_tree

    htmls = ODD_HTML + [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    df = spark.createDataFrame(list(enumerate(htmls)), "i int, html string")
    got = {r["i"]: r for r in html.facts(df, "title", "hrefs").collect()}
    for i, x in enumerate(htmls):
        e = dom.first(plain_tree(x or ""), "h1")
        assert got[i]["title"] == (None if x is None or e is None else e.text().strip()), x
        assert (got[i]["hrefs"] or []) == [e.attrs["href"].strip() for e in dom.select(plain_tree(x or ""), "a[href]")], x


def test_links_resolve_as_the_standard_says(spark):
    from urllib.parse import urldefrag, urljoin

    from docloom.functions import urls

    bases = ["https://e.org", "https://e.org/", "https://e.org/a/b/c?q=1#f", "https://e.org/a/b/", "http://e.org:8080/x.html"]
    hrefs = ["x", "x/y.html", "./x", "../x", "../../x", "../../../x", ".", "..", "../", "./", "a/./b/../c", "?q=2", "/r", "/r/../s", "/r?x=..", "x?y=../z", "//h.org/p", "https://o.org/p#f", "x#f", "g;x=1/../y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "base string, href string")
    for r in df.withColumn("u", urls.resolve_any(F.col("base"), F.col("href"))).collect():
        assert r["u"] == urldefrag(urljoin(r["base"], r["href"]))[0], (r["base"], r["href"])
    none = spark.createDataFrame([("https://e.org/a", h) for h in ("mailto:x@y", "tel:1", "javascript:void(0)", "", "#top", None)], "base string, href string")
    assert all(r["u"] is None for r in none.select(urls.resolve_any(F.col("base"), F.col("href")).alias("u")).collect())


def test_skipped_links(spark):
    from docloom.operators import crawl

    met = spark.createDataFrame([("a",), ("a",), ("b",), (None,), ("s",)], "node string")
    assert tuple(crawl.skipped(met, spark.createDataFrame([("s",), ("s",)], "node string")).first()) == (5 - 1, 2)
    assert tuple(crawl.skipped(met.limit(0), met.limit(0)).first()) == (0, 0)
