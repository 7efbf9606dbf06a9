"""Adding and updating knowledge bases: fetched pages in, tables of a store out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F

from docloom.checkpoints import cut
from docloom.functions import html, markdown as md, urls
from docloom.operators import artifacts, diff, enrich, identity, navigation
from docloom.sources import llmstxt, pages as src
from docloom.sources.config import EngineError
from docloom.sources.store import Store


def choose_pages(mode: str, listed: Callable[[], DataFrame], crawled: Callable[[], DataFrame]) -> DataFrame:
    """Pages by mode: ``llms-txt``, ``crawl``, or anything else: listed ones, and crawled ones if there are none or listing fails."""
    if mode == "llms-txt":
        return listed()
    if mode == "crawl":
        return crawled()
    try:
        found = listed()
        return crawled() if found.isEmpty() else found
    except EngineError:
        return crawled()


def listed_pages(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched pages (page_id, url, html) that an llms.txt (id, body) lists with an absolute URL."""
    urls = llmstxt.entries(llmstxt.parse(files.filter(llmstxt.valid(F.col("body"))))).filter(F.col("url").rlike("^https?://")).select("url").distinct()
    return fetched.join(urls, "url", "left_semi")


#: Bytes of a page that are sent for its summary and its description, and of a knowledge base's summaries.
SENT = {"summary": 12_000, "description": 8_000}
CONTEXT = 4_000


def _bodies(contents: DataFrame) -> DataFrame:
    """Tasks of each page: its Markdown without front matter, cut to what is sent."""
    body = contents.select("kb_id", "path", F.regexp_replace("markdown", r"(?s)^---\n.*?\n---\n", "").alias("body"))
    return body.select("kb_id", "path", F.explode(F.array(*[F.struct(F.lit(k).alias("artifact_type"), md.truncate(F.col("body"), n).alias("content")) for k, n in SENT.items()])).alias("t")).select("kb_id", "path", "t.*")


def _whole(summaries: DataFrame) -> DataFrame:
    """Tasks of each knowledge base: the summaries of its first pages, as far as they fit."""
    line = summaries.select("kb_id", "path", F.concat(F.lit("- "), "path", F.lit(": "), "summary").alias("line"))
    order = Window.partitionBy("kb_id").orderBy("path", "line")
    first = line.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= CONTEXT)  # each line has a byte at least
    first = first.withColumn("size", F.sum(F.octet_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("size") <= CONTEXT) | (F.col("k") == 1))
    text = first.groupBy("kb_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("content"))
    return text.select("kb_id", F.lit(None).cast("string").alias("path"), F.explode(F.array(*[F.lit(t) for t in enrich.TASKS])).alias("artifact_type"), md.truncate(F.col("content"), CONTEXT).alias("content"))


def _results(store: Store, tasks: DataFrame, touched: DataFrame, call: Callable[[str], str], model: str) -> DataFrame:
    """kb_id, path, artifact_type and result_json of tasks (kb_id, path, artifact_type, content); those without a cached result call the model."""
    tasks = tasks.select("kb_id", "artifact_type", enrich.prompt_hash(F.col("content"), F.col("artifact_type")).alias("prompt_hash"), F.lit(model).alias("model_id"), "path", "content")
    cache = store.of("cache", touched)
    done = enrich.complete(tasks, cache, call)
    new = done.filter(~F.col("hit") & F.col("result").isNotNull()).select(*enrich.KEYS, F.col("result").alias("result_json"))
    store.merge("cache", diff.upsert(cache, new, enrich.KEYS, []), touched)
    return tasks.join(store.of("cache", touched), enrich.KEYS).select("kb_id", "path", "artifact_type", "result_json")


def _derived(store: Store, pages: DataFrame, kbs: DataFrame, contents: DataFrame, touched: DataFrame, call: Callable[[str], str], model: str, told: Callable[[str], None]) -> None:
    """Contents, toc, postings, enrichment and artifacts of the pages of touched knowledge bases."""
    store.merge("contents", contents, touched)
    store.merge("toc", navigation.table_of_contents(pages, store.of("nav", touched)), touched)
    t = store.of("toc", touched)
    store.reindex(pages, touched)
    told("enrichment")
    results = _results(store, _bodies(contents), touched, call, model)
    summaries = results.filter("artifact_type = 'summary'").select("kb_id", "path", F.col("result_json").alias("summary"))
    about = results.filter("artifact_type = 'description'").select("kb_id", "path", F.col("result_json").alias("description"))
    whole = _results(store, _whole(summaries), touched, call, model).select("kb_id", "artifact_type", F.col("result_json").alias("body"))
    told("artifacts")
    named = kbs.join(artifacts.kb_summary(kbs, summaries), "kb_id")
    full = contents.join(pages.select("kb_id", "path", "url", "title"), ["kb_id", "path"])
    full = full.select("kb_id", F.col("path").alias("ord"), F.coalesce("title", "path").alias("title"), "url", F.col("markdown").alias("content"))
    body = lambda task: named.join(whole.filter(F.col("artifact_type") == task).select("kb_id", "body"), "kb_id", "left")
    files = artifacts.llms_txt(t, named, about).withColumn("filename", F.lit("llms.txt"))
    files = files.unionByName(artifacts.skill_md(body("skill").withColumn("description", F.col("summary"))).withColumn("filename", F.lit("SKILL.md")))
    for name in artifacts.PASSED:
        files = files.unionByName(artifacts.passed_through(body(name.removesuffix(".md")), name).withColumn("filename", F.lit(name)))
    files = files.withColumns({"piece": F.lit(0), "at": F.lit(0).cast("long")})
    files = files.unionByName(artifacts.llms_full_parts(full, named).withColumnRenamed("part", "piece").withColumn("filename", F.lit("llms-full.txt")))
    store.merge("artifacts", files, touched)
    told("done")


def _kbs(pages: DataFrame, now: str, known: DataFrame) -> DataFrame:
    k = pages.groupBy("kb_id").agg(F.count("*").alias("page_count")).join(known.select("kb_id", "created_at"), "kb_id", "left")
    return k.select("kb_id", F.col("kb_id").alias("name"), F.concat(F.lit("https://"), "kb_id", F.lit("/")).alias("source_url"), F.coalesce("created_at", F.lit(now)).alias("created_at"), F.lit(now).alias("updated_at"), "page_count")


def one_each(pages: DataFrame) -> DataFrame:
    """Of pages with one path in a knowledge base, the one fetched last (the largest page_id)."""
    keyed = pages.withColumns({"__key": F.concat_ws("\n", "kb_id", "path"), "__same": F.lit(0)})
    return diff.last_of(keyed, "__key", "__same", "page_id").drop("__key", "__same")


def read_once(fetched: DataFrame, *more: str) -> DataFrame:
    """Rows of the page table of fetched pages, one a path, with ``fetched_id`` (the fetcher's number, unique among them) and the facts asked for: each page is parsed once.

    The latest of each path is found on narrow rows; the facts are joined to those alone.
    """
    whole = cut(src.read_facts(fetched, *more), "facts")
    latest = one_each(src.of_facts(whole)).withColumnRenamed("page_id", "fetched_id")
    latest = latest.join(whole.select(F.col("page_id").alias("fetched_id"), *more), "fetched_id") if more else latest
    return cut(latest, "read")


def identified(new: DataFrame, old: DataFrame) -> DataFrame:
    """New rows of the page table under ids that last: those of ``old`` where it has the path. A missing path counts as an empty one."""
    named = lambda t: t.withColumn("path", F.coalesce("path", F.lit("")))
    ids = identity.identify(named(new), named(old)).withColumnRenamed("path", "__path")
    return new.withColumn("__path", F.coalesce("path", F.lit(""))).join(ids, ["kb_id", "__path"]).drop("__path")


def add(store: Store, fetched: DataFrame, now: str, call: Callable[[str], str] = enrich.offline_model, model: str = "offline", told: Callable[[str], None] = lambda step: None) -> None:
    """Fill the knowledge bases of fetched pages (page_id, url, html); those that the store holds besides stay. No pages are an error.

    ``told`` is called with the name of each step that begins.
    """
    if fetched.isEmpty():
        raise EngineError("no pages were fetched")
    told("pages")
    read = read_once(fetched, "hrefs", "raw", "adapter", "toc")
    touched = cut(read.select("kb_id").distinct(), "touched")
    read = cut(identified(read, store.of("pages", touched)), "pages")
    store.merge("pages", read, touched)
    pages = store.of("pages", touched)
    kbs = _kbs(pages, now, store.of("kbs", touched))
    told("contents")
    store.merge("links", _links(read), touched)
    store.merge("nav", navigation.entries(read), touched)
    store.merge("kbs", kbs, touched)
    _derived(store, pages, store.of("kbs", touched), _contents(read, now), touched, call, model, told)


def _contents(read: DataFrame, now: str) -> DataFrame:
    text = html.converted(read.select("page_id", "url", "raw", "kb_id", "path"), F.lit(now), keep=("kb_id", "path"))
    return text.select("kb_id", "path", "markdown")


def _links(read: DataFrame) -> DataFrame:
    """The links table's rows of pages that are read: internal links stay on the page's host."""
    kind = F.when(urls.host(F.col("to_url")) == F.col("kb_id"), "internal").otherwise("external")
    return src.links_of_facts(read, keep=("kb_id",)).withColumn("kind", F.when(F.col("to_url").isNotNull(), kind))


def refresh(store: Store, fetched: DataFrame, now: str) -> None:
    """Take fetched pages into their knowledge bases, and leave all else of these as it is: pages, links, contents, toc, index and kbs follow.

    What a stream of batches builds so equals what one ``add`` of all pages builds, but for enrichment and artifacts, which are not asked for here.
    A batch that is taken again changes nothing.
    """
    read = read_once(fetched, "hrefs", "raw", "adapter", "toc")
    touched = cut(read.select("kb_id").distinct(), "touched")
    old = store.of("pages", touched)
    read = cut(identified(read, old), "pages")
    mine = read.select("kb_id", "path", "page_id")
    store.merge("pages", diff.upsert(old, read.select(*old.columns), ["kb_id", "path"], ["page_id"]), touched)
    pages = store.of("pages", touched)
    links = store.of("links", touched).join(mine.select("kb_id", F.col("page_id").alias("from_page_id")), ["kb_id", "from_page_id"], "left_anti")
    links = links.unionByName(_links(read))
    store.merge("links", links, touched)
    contents = store.of("contents", touched).join(mine.select("kb_id", "path"), ["kb_id", "path"], "left_anti").select("kb_id", "path", "markdown")
    store.merge("contents", contents.unionByName(_contents(read, now)), touched)
    nav = store.of("nav", touched).join(mine.select("kb_id", "page_id"), ["kb_id", "page_id"], "left_anti").select("kb_id", "page_id", "pos", "title", "path")
    store.merge("nav", nav.unionByName(navigation.entries(read)), touched)
    store.merge("toc", navigation.table_of_contents(pages, store.of("nav", touched)), touched)
    store.reindex(pages, touched)
    store.merge("kbs", _kbs(pages, now, store.of("kbs", touched)), touched)


def update(store: Store, fetched: DataFrame, now: str, prune: bool = False, force: bool = False, call: Callable[[str], str] = enrich.offline_model, model: str = "offline", told: Callable[[str], None] = lambda step: None) -> dict[str, int]:
    """Bring the knowledge bases of fetched pages up to date and return the counts of the difference; others stay as they are.

    Only new and changed pages are converted; the others keep their text. Pages keep the id that their path has,
    whatever the fetcher numbers them, and knowledge bases their time of creation. Without ``prune``, pages that
    have gone stay in the page table but leave the contents and the toc.
    """
    if fetched.isEmpty():
        raise EngineError("no pages were fetched")
    told("pages")
    read = read_once(fetched, "hrefs", "adapter", "toc")
    touched = cut(read.select("kb_id").distinct(), "touched")
    old = store.of("pages", touched)
    read = cut(identified(read, old), "pages")
    new = read.select(*old.columns)
    change = diff.page_diff(old, new, force)
    counts = diff.summary(change, prune).first().asDict()
    todo = cut(diff.needs_convert(change), "changed")
    merged = diff.upsert(old, new, ["kb_id", "path"], ["page_id"])
    store.merge("pages", diff.prune(merged, new) if prune else merged, touched)
    pages = diff.prune(store.of("pages", touched), new)
    told("contents")
    due = read.join(todo, ["kb_id", "path"], "left_semi").select("fetched_id", "kb_id", "path")
    raw = html.facts(fetched.join(due.select(F.col("fetched_id").alias("page_id")), "page_id", "left_semi").select(F.col("page_id").alias("fetched_id"), "url", F.coalesce("html", F.lit("")).alias("html")), "raw")
    fresh = _contents(raw.join(due, "fetched_id").withColumn("page_id", F.col("fetched_id")), now)
    kept = store.of("contents", touched).join(new.select("kb_id", "path"), ["kb_id", "path"], "left_semi").join(todo, ["kb_id", "path"], "left_anti").select("kb_id", "path", "markdown")
    store.merge("links", _links(read), touched)  # those of the pages as fetched now
    store.merge("nav", navigation.entries(read), touched)
    store.merge("kbs", _kbs(pages, now, store.of("kbs", touched)), touched)
    _derived(store, pages, store.of("kbs", touched), kept.unionByName(fresh), touched, call, model, told)
    return counts
