"""Tables of contents from page paths: two levels, as sections group their direct children only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.functions import urls


def _rank(parts: list[str], *extra) -> Window:
    """Paths that end in ``index`` first, then by lower-case title, then in the order of input."""
    return Window.partitionBy(*parts).orderBy(F.when(F.col("path").endswith("index"), 0).otherwise(1), F.lower("title"), *extra)


def flat(pages: DataFrame) -> DataFrame:
    """kb_id, section (from 1), item (0 for the section itself, then from 1), depth, title, path and source_url.

    pages: page_id, kb_id, path, title, url. A page goes under its parent path; a parent without a page
    of its own becomes a section without a source. A page without parent is a section. One shuffle on
    (kb_id, parent) ranks the items of a section, one on kb_id ranks sections.
    """
    p = pages.select("kb_id", "path", F.coalesce("title", urls.title_from_path(F.col("path"))).alias("title"), F.col("url").alias("source_url"), "page_id", urls.parent_path(F.col("path")).alias("parent"))
    roots = p.filter(F.col("parent").isNull()).select("kb_id", "path", "title", "source_url", F.lit(0).alias("made"), F.col("page_id").alias("ord"))
    parents = p.filter(F.col("parent").isNotNull()).select("kb_id", F.col("parent").alias("path")).distinct()
    made = parents.join(roots.select("kb_id", "path"), ["kb_id", "path"], "left_anti")
    made = made.select("kb_id", "path", urls.title_from_path(F.col("path")).alias("title"), F.lit(None).cast("string").alias("source_url"), F.lit(1).alias("made"), F.lit(0).cast("long").alias("ord"))
    top = roots.unionByName(made).withColumn("section", F.row_number().over(_rank(["kb_id"], "made", "ord", "path")))
    items = p.filter(F.col("parent").isNotNull()).withColumn("item", F.row_number().over(_rank(["kb_id", "parent"], "page_id")))
    items = items.join(top.groupBy("kb_id", "path").agg(F.min("section").alias("section")).withColumnRenamed("path", "parent"), ["kb_id", "parent"])
    a = top.select("kb_id", "section", F.lit(0).alias("item"), F.lit(0).alias("depth"), "title", "path", "source_url")
    return a.unionByName(items.select("kb_id", "section", "item", F.lit(1).alias("depth"), "title", "path", "source_url"))


def nested(flat_toc: DataFrame) -> DataFrame:
    """kb_id and sections: array of (title, path, source_url, children), in order."""
    item = F.struct("item", "title", "path", "source_url")
    sections = flat_toc.groupBy("kb_id", "section").agg(F.array_sort(F.collect_list(item)).alias("rows"))
    own = F.col("rows")[0]
    kids = F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1))), lambda x: F.struct(x["title"].alias("title"), x["path"].alias("path"), x["source_url"].alias("source_url")))
    one = F.struct("section", own["title"].alias("title"), own["path"].alias("path"), own["source_url"].alias("source_url"), kids.alias("children"))
    ordered = F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(*[x[c].alias(c) for c in ("title", "path", "source_url", "children")]))
    return sections.groupBy("kb_id").agg(ordered.alias("sections"))


def covers(entries, pages):
    """Whether a navigation of so many entries stands for a base of so many pages: numbers, or columns of them."""
    return (entries > 0) & (entries * 2 + 1 >= pages)


def choose(adapter_entries: int, pages: int) -> str:
    """Which structure counts: the adapter's if it covers half of the pages, else that of the paths."""
    return "adapter" if covers(adapter_entries, pages) else "paths"


def missing(flat_toc: DataFrame, files: DataFrame) -> DataFrame:
    """kb_id and path of entries that have no file (kb_id, path)."""
    return flat_toc.filter(F.col("source_url").isNotNull()).select("kb_id", "path").distinct().join(files, ["kb_id", "path"], "left_anti")
