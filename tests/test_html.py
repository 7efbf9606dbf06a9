"""The event stream and the tree on it, against a tree on the standard library's parser, over many broken pages."""

import random
import re
import time
from html.entities import html5
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from docloom.functions import dom, events, html
from docloom.sources import pages as src
from tests.conftest import DATA


class PlainTree(HTMLParser):
    """The same rules of implied ends on another tokenizer, by walking up the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = dom.Element("#document")

    def shut(self, tags):
        e = self.at
        while e is not self.root and (e.tag not in dom.BARRIERS or e.tag in tags):
            if e.tag in tags:
                self.at = e.parent
                return
            e = e.parent

    def handle_starttag(self, tag, attrs):
        if tag in dom.BLOCKS:
            self.shut({"p"})
        for _ in dom.ENDS.get(tag, ()):
            self.shut(dom.ENDS[tag])
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        e = dom.Element(tag, first, parent=self.at)
        self.at.children.append(e)
        if tag not in dom.VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # the standard ignores the slash

    def handle_endtag(self, tag):
        e = self.at
        while e is not self.root and e.tag != tag:
            e = e.parent
        if e is not self.root:
            self.at = e.parent

    def handle_data(self, data):
        self.at.children.append(data)


def plain_tree(x):
    p = PlainTree()
    p.feed(x)
    p.close()
    return p.root


def shape(root):
    """The tree as one flat list, with neighbouring texts joined."""
    out, todo = [], [root]
    while todo:
        e = todo.pop()
        if not isinstance(e, dom.Element):
            if isinstance(e, str) and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + e)
            else:
                out.append(("text", e) if isinstance(e, str) else e)
            continue
        out.append(("start", e.tag, tuple(e.attrs.items())))
        todo.append(("end", e.tag))
        todo.extend(reversed(e.children))
    return out


TAGS = ["div", "p", "li", "ul", "b", "table", "tr", "td", "h1", "a", "article", "span", "dl", "dt", "dd", "option", "select", "section", "br", "img"]


def broken(rng, x):
    """A page with some of its tags dropped, repeated, in capitals, with odd attributes, references or comments."""
    parts = re.split(r"(<[^>]*>)", x)
    out = []
    for p in parts:
        k = rng.random()
        if p.startswith("<") and k < 0.08:
            continue
        if p.startswith("<") and k < 0.12 and not re.match("</?(script|style|title)", p):
            p = p.upper() if rng.random() < 0.5 else p + p
        elif k < 0.2:
            name = rng.choice(TAGS)
            p += rng.choice([f"<{name}>", f"</{name}>", f"<{name} title='a > b' HREF=\"/q?a=1&amp;b\" class=x/y data-x>", f"<{name}\n id = 'k' id=second href=/p/q>", f"<{name}/>"])
        elif k < 0.26 and not p.startswith("<"):
            p += rng.choice([f"&{rng.choice(list(html5))}", f"&#{rng.randrange(1, 70000)};", "&#x41;", "<!-- <h1>no</h1> -->", "a < b & c", "&nosuch;", "<!doctype html>"]) + " "
        out.append(p)
    return "".join(out)


def test_trees_of_broken_pages_equal_those_of_another_tokenizer(spark):
    rng = random.Random(11)
    pages = [r["html"] for r in spark.read.parquet(f"{DATA}/pages.parquet").limit(40).collect()]
    for x in pages:
        x = re.sub(r"(?is)<(script|style|title)\b.*?</\1>", "", x)  # the other tokenizer treats their text in ways of its own
        for _ in range(8):
            y = broken(rng, x)
            want = plain_tree(y)
            assert shape(dom.parse(y)) == shape(want), y
            first = dom.first(want, "h1")
            assert dom.title(y) == (None if first is None else first.text().strip())
            assert events.hrefs(y) == [e.attrs["href"].strip(" \t\r\n\f") for e in dom.select(want, "a[href]")]


def test_all_named_references():
    for name in html5:
        want = html5[name]
        assert dom.parse(f"<p>&{name} ").text() == want + " "
        assert events.attributes(f'href="&{name}"')["href"] == want
    assert events.attributes("a='&copy=1' b='&copyx' c=&copy d='&#65;&amp'") == {"a": "&copy=1", "b": "&copyx", "c": "©", "d": "A&"}


@pytest.mark.parametrize("x,want", [
    ("<script>a<b></script >x", [(0, "script", ""), (2, "", "a<b>"), (1, "script", ""), (2, "", "x")]),
    ("<TITLE>a &amp; <b></title>", [(0, "title", ""), (2, "", "a & <b>"), (1, "title", "")]),
    ("a<!-->b<!--->c<!--d--!>e<!--f", [(2, "", "a"), (2, "", "b"), (2, "", "c"), (2, "", "e")]),
    ("</>a</ b>c<?d>e<![CDATA[f]]>g", [(2, "", "a"), (2, "", "c"), (2, "", "e"), (2, "", "g")]),
    ("<a title=it's href=x>", [(0, "a", " title=it's href=x")]), ("a<b title='x>", [(2, "", "a")]), ("a <", [(2, "", "a <")]), ("1 < 2 <3", [(2, "", "1 < 2 <3")]), ("", []),
])
def test_tokens(x, want):
    assert list(events.events(x)) == want


@pytest.mark.parametrize("x", [
    "<div>" * 5000 + "<h1>t", "<b>" * 5000 + "x<p>" * 2000, "<ul><li>" * 5000 + "x", "<blockquote>" * 5000 + "x", "<table><tr><td>" * 3000 + "x", "<div>" * 5000 + "</x>" * 20000,
    "<!--" * 20000, "<a href='" * 20001, '<a title="x ' * 20001, "<" * 100000, "<h1" * 20000, "&amp" * 50000, "<p>a" * 20000, "<script>" * 20000, "<i><div>" * 3000 + "</i>" * 3000,
])
def test_deep_and_hostile_pages_take_linear_time(x):
    began = time.time()
    doc = dom.parse(x)
    dom.title(x), events.hrefs(x), doc.inner(), html.to_markdown(doc), html.adapter_toc(doc, html.adapter_of(doc)), html.adapter_content(doc, html.ADAPTERS[-1])
    assert time.time() - began < 20


def test_facts_in_one_pass(spark):
    rows = [(1, "https://e.org/a", "<title>t</title><main><h1> A &Aring;</h1><a href=/b>b</a><p>x"), (2, "https://e.org/b", None), (3, "https://e.org/c", ""), (4, "https://e.org/d", "<div>" * 1500 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html.facts(df, *html.FACTS).collect()}
    assert got[1]["title"] == "A Å" and got[1]["hrefs"] == ["/b"] and got[1]["adapter"] == "generic" and got[1]["content_len"] == len(rows[0][2]) and got[1]["toc"][0]["path"] == "a-å"
    assert all(got[2][k] is None for k in html.FACTS) and got[3]["title"] is None and got[3]["hrefs"] == [] and "deep" in got[4]["raw"]
    assert html.facts(df.limit(0), "title").count() == 0
    clash = html.facts(df.withColumn("title", F.lit("old")), "title")
    assert clash.columns == ["page_id", "url", "title"] and clash.filter("page_id = 1").first()["title"] == "A Å"
    assert {r["page_id"]: r["title"] for r in src.page_table(df).collect()} == {1: "A Å", 2: None, 3: None, 4: None}
    with_status = src.page_table(df.withColumn("status_code", F.lit(404)))
    assert {r[0] for r in with_status.select("status_code").collect()} == {404}
