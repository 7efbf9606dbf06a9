"""Facts of HTML pages: each page is read once, in Arrow batches, for all that are asked of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from docloom.functions import dom, events, markdown as md
from docloom.shipping import ship

# Selectors of main content, tried in this order.
CONTENT = ("article .markdown", ".vp-doc", ".markdown-section", "[role=main]", "article", "main", ".content")


@dataclass
class Adapter:
    """How a documentation generator marks its pages: register more in ``ADAPTERS``, before the generic one."""

    name: str
    detect: Callable[[dom.Element], bool]
    content: tuple[str, ...]
    drop: str = ""
    toc: tuple[str, ...] = ()
    fallback: bool = False  # the body, if no selector fits


def _generator(word: str) -> Callable[[dom.Element], bool]:
    return lambda d: any(word in e.attrs.get("content", "").lower() for e in dom.select(d, "meta[name=generator]"))


def _any(selector: str) -> Callable[[dom.Element], bool]:
    return lambda d: dom.first(d, selector) is not None


# Marks and selectors of each generator.
ADAPTERS = [
    Adapter("docusaurus", lambda d: _generator("docusaurus")(d) or _any("[data-docusaurus-version]")(d), ("article .markdown", "article", ".markdown", "main"), ".theme-doc-footer, .pagination-nav", (".menu__list .menu__link",), True),
    Adapter("vitepress", _any("#VPContent, .VPDoc"), (".vp-doc", ".VPDoc", "#VPContent main", "main"), "", (".VPSidebar a",)),
    Adapter("gitbook", _any("meta[name=gitbook], .gitbook-root"), (".markdown-section", ".page-inner section", "main section", "main"), "", ("aside nav a, .sidebar nav a",)),
    Adapter("readthedocs", _any("meta[name=readthedocs], .wy-nav-side, .wy-body-for-nav, link[href*=_static]"), ("[role=main]", ".document", ".rst-content .section", "main"), "footer, [role=navigation]", (".wy-menu a", ".toctree-wrapper a", "nav.wy-nav-side a")),
    Adapter("generic", lambda d: True, ("main", "article", "[role=main]", ".content"), "nav, header, footer, aside, script, style, .sidebar, .nav", (), True),
]


def adapter_of(doc: dom.Element) -> Adapter:
    return next(a for a in ADAPTERS if a.detect(doc))


def main_element(doc: dom.Element) -> dom.Element | None:
    """The first main-content element that fits, else the body."""
    return next((e for s in (*CONTENT, "body") if (e := dom.first(doc, s)) is not None), None)


def content(html: str) -> str:
    """Inner HTML of the main element, or the text as it is if there is none."""
    e = main_element(dom.parse(html))
    return html if e is None else e.inner()


def adapter_content(doc: dom.Element, a: Adapter) -> str:
    """What an adapter takes for content, without what it drops; empty if nothing fits and it has no fallback."""
    for s in (*a.content, *(["body"] if a.fallback else [])):
        if (e := dom.first(doc, s)) is not None:
            part = dom.parse(e.inner())
            if a.drop:
                dom.drop(part, a.drop)
            return part.inner()
    return ""


def _toc_path(href: str, adapter: str) -> str:
    """Path of an entry: without slashes in front, and for most generators without .html behind."""
    p = href.lstrip("/")
    if adapter == "gitbook":
        return p
    while adapter == "docusaurus" and p.startswith("docs/"):
        p = p.removeprefix("docs/")
    while p.endswith(".html"):
        p = p.removesuffix(".html")
    return p.rstrip("/") if adapter == "docusaurus" else p


def adapter_toc(doc: dom.Element, a: Adapter) -> list[tuple[str, str]]:
    """Title and path of each entry of the page's own navigation; headings on generic pages."""
    if not a.toc:
        out = []
        for e in dom.select(doc, "h1, h2"):
            t = " ".join(e.text().split())
            if t:
                out.append((t, "-".join("".join(c if c.isalnum() else " " for c in t.lower()).split())))
        return out
    for s in a.toc:
        found = [(e.text().strip(), e.attrs.get("href", "")) for e in dom.select(doc, s)]
        found = [(t, h) for t, h in found if t and h and not (a.name == "readthedocs" and h.startswith("#"))]
        if found:
            return [(t, _toc_path(h, a.name)) for t, h in found]
    return []


def to_markdown(doc: dom.Element) -> str:
    """Markdown of a page's main element, before clean-up."""
    e = main_element(doc)
    return dom.markdown(dom.Element("#document", children=(doc if e is None else e).children))


def _with_tree(f: Callable[[dom.Element, Adapter], object]) -> Callable:
    return lambda html, tree: f(tree(), adapter_of(tree()))


#: What can be asked of a page: its type in Spark and in Arrow, and a function of the html and of its tree (made when first asked for).
FACTS: dict[str, tuple[T.DataType, pa.DataType, Callable]] = {
    "title": (T.StringType(), pa.string(), lambda html, tree: dom.title(html)),
    "hrefs": (T.ArrayType(T.StringType()), pa.list_(pa.string()), lambda html, tree: events.hrefs(html)),
    "content_hash": (T.StringType(), pa.string(), lambda html, tree: sha256(html.encode()).hexdigest()),
    "content_len": (T.LongType(), pa.int64(), lambda html, tree: len(html.encode())),
    "adapter": (T.StringType(), pa.string(), _with_tree(lambda doc, a: a.name)),
    "content": (T.StringType(), pa.string(), lambda html, tree: html if (e := main_element(tree())) is None else e.inner()),
    "body": (T.StringType(), pa.string(), _with_tree(adapter_content)),
    "toc": (T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("path", T.StringType())])), pa.list_(pa.struct([("title", pa.string()), ("path", pa.string())])), _with_tree(lambda doc, a: [{"title": t, "path": p} for t, p in adapter_toc(doc, a)])),
    "raw": (T.StringType(), pa.string(), lambda html, tree: to_markdown(tree())),
    "raw_whole": (T.StringType(), pa.string(), lambda html, tree: dom.markdown(tree())),
}
#: Rows and bytes of an Arrow batch at most: whole pages travel in them.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def _bound(spark) -> None:
    """Small Arrow batches for whole pages, unless the session asks for smaller ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def facts(pages: DataFrame, *asked: str, html_col: str = "html") -> DataFrame:
    """All other columns, and the facts asked of each page (those of ``FACTS``): one pass, and one tree at most. Null html gives nulls.

    Columns that have the name of a fact that is asked for are replaced.
    """
    asked = asked or ("adapter", "content", "body", "toc", "raw")
    ship(pages.sparkSession)
    _bound(pages.sparkSession)
    keep = [c for c in pages.columns if c != html_col and c not in asked]
    pages = pages.select(*[F.col(f"`{c}`") for c in (*keep, html_col)])
    schema = T.StructType([*pages.schema.fields[:-1], *(T.StructField(k, FACTS[k][0]) for k in asked)])
    kinds, tasks = [FACTS[k][1] for k in asked], [FACTS[k][2] for k in asked]

    def one(html: str) -> list:
        held: list[dom.Element] = []

        def tree() -> dom.Element:
            if not held:
                held.append(dom.parse(html))
            return held[0]

        return [f(html, tree) for f in tasks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = [None] * len(asked)
        for b in batches:
            got = [none if x is None else one(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *(pa.array([r[i] for r in got], k) for i, k in enumerate(kinds))], names=[*keep, *asked])

    return pages.mapInArrow(run, schema)


def convert(pages: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """page_id, url, title, markdown (with front matter) and word_count of pages (page_id, url, html)."""
    return converted(facts(pages.select("page_id", "url", "html"), "raw"), fetched_at)


def convert_extracted(parts: DataFrame, fetched_at: Column | None = None) -> DataFrame:
    """As ``convert``, of HTML that is content already: no main element is sought, and all of it is converted."""
    return converted(facts(parts.select("page_id", "url", "html"), "raw_whole").withColumnRenamed("raw_whole", "raw"), fetched_at)


def converted(read: DataFrame, fetched_at: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``convert``, of pages that are read already (page_id, url, raw); columns ``keep`` stay."""
    f = read.select("page_id", "url", *keep, md.cleanup(F.col("raw"), F.col("url")).alias("clean"))
    f = f.withColumn("title", md.title(F.col("clean")))
    return f.select("page_id", "url", *keep, "title", F.concat(md.frontmatter(F.col("url"), F.col("title"), fetched_at), F.lit("\n"), "clean").alias("markdown"), md.word_count(F.col("clean")).alias("word_count"))


def table_markdown(rows: Column) -> Column:
    """Markdown of a table given as an array of arrays of cells; the first row is the header."""
    wide = F.array_max(F.transform(rows, F.size))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), wide - F.size(r))), " | "), F.lit(" |"))
    head = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), wide), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(rows[0]), head), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))), line)), "\n")

