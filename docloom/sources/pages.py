"""Fetched pages: (page_id, url, html) becomes the page table and its links.

The knowledge base of a page is its host. Only these projections read html; all later queries work
on the narrow tables that they give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import html, urls


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def read_facts(pages: DataFrame, *more: str) -> DataFrame:
    """page_id, url, and what the page table, the links and the contents need of the html (and ``more``), all read in one pass."""
    status = ["status_code"] if "status_code" in pages.columns else []
    return html.facts(pages.select("page_id", "url", *status, F.coalesce("html", F.lit("")).alias("html")), "title", "content_hash", "content_len", *more)


def page_table(pages: DataFrame) -> DataFrame:
    """page_id, kb_id, url, path, title, content_hash, content_len (bytes) and status_code; the hash is that of the raw html.

    The status is that of the fetch, if pages have a column ``status_code``, and else 200.
    """
    return of_facts(read_facts(pages))


def of_facts(read: DataFrame) -> DataFrame:
    """The page table of pages that are read already."""
    status = F.col("status_code").cast("int") if "status_code" in read.columns else F.lit(200)
    return read.select("page_id", urls.kb_name(F.col("url")).alias("kb_id"), "url", urls.url_to_path(F.col("url")).alias("path"), "title", "content_hash", "content_len", status.alias("status_code"))


def links(pages: DataFrame) -> DataFrame:
    """from_page_id, pos (from 0), href and to_url (null for links of other schemes) of every followable link; repeats stay."""
    return links_of_facts(html.facts(pages.select("page_id", "url", "html"), "hrefs"))


def links_of_facts(read: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The links of pages that are read already (page_id, url, hrefs); columns ``keep`` of the page stay."""
    a = read.select(F.col("page_id").alias("from_page_id"), "url", *keep, F.posexplode(F.filter("hrefs", urls.followable)).alias("pos", "href"))
    return a.select(*keep, "from_page_id", F.col("pos").cast("long").alias("pos"), "href", urls.resolve_any(F.col("url"), F.col("href")).alias("to_url"))
