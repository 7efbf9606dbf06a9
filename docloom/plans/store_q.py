"""Queries that fill a store from the pages, bring it up to date and read it back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.checkpoints import new_path
from docloom.plans import ingest
from docloom.plans.registry import h1, path, query
from docloom.sources import pages as src
from docloom.sources.store import Store

C = F.col


def _moved(spark: SparkSession, d: str, bases: int) -> DataFrame:
    """All pages, dealt to a number of hosts."""
    host = F.concat(F.lit("https://base"), (C("page_id") % bases).cast("string"), F.lit(".org"))
    return src.read(spark, d).select("page_id", F.concat(host, F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")).alias("url"), "html")


def _updated(spark: SparkSession, d: str, bases: int) -> DataFrame:
    """A first fetch without every fifth page, then one of all pages under other numbers, which repeat those of other pages."""
    store, pages = Store(spark, new_path(spark, "store")), _moved(spark, d, bases)
    ingest.add(store, pages.filter("page_id % 5 <> 0"), "t1")
    first = store.table("pages").select("kb_id", "path", C("page_id").alias("first_id"))
    top = pages.agg(F.max("page_id")).first()[0] or 0
    ingest.update(store, pages.withColumn("page_id", F.lit(top) - C("page_id")), "t2")
    words = store.table("postings").groupBy("kb_id", "page_id").agg(F.count("*").alias("n_postings"))
    links = store.table("links").groupBy("kb_id", C("from_page_id").alias("page_id")).agg(F.count("*").alias("n_links"))
    out = store.table("pages").join(words, ["kb_id", "page_id"], "left").join(links, ["kb_id", "page_id"], "left").join(first, ["kb_id", "path"], "left")
    ids = store.table("pages").groupBy("page_id").agg(F.count("*").alias("pages_of_id"))
    return out.join(ids, "page_id").select("kb_id", "path", "title", F.coalesce("n_postings", F.lit(0)).alias("n_postings"), F.coalesce("n_links", F.lit(0)).alias("n_links"), C("first_id").isNotNull().alias("known"), (C("first_id").isNull() | (C("first_id") == C("page_id"))).alias("id_kept"), "pages_of_id")


def _sql(bases: int) -> str:
    tok = lambda x: rf"len(regexp_extract_all({x}, '[\p{{L}}\p{{N}}]+'))"
    return rf"""WITH m AS (SELECT page_id, 'base' || page_id % {bases} || '.org' AS kb_id, {path('url')} AS path, {h1('html')} AS title,
  CAST(len(list_filter(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda h: NOT (starts_with(h, '#') OR starts_with(h, 'javascript:') OR starts_with(h, 'mailto:')))) AS BIGINT) AS n_links FROM pages),
old AS (SELECT DISTINCT kb_id, path FROM m WHERE page_id % 5 <> 0), last AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY kb_id, path ORDER BY page_id) = 1)
SELECT kb_id, path, title, CAST(coalesce({tok('title')}, 0) + {tok('path')} AS BIGINT) AS n_postings, n_links, old.path IS NOT NULL AS known, true AS id_kept, CAST(1 AS BIGINT) AS pages_of_id
FROM last LEFT JOIN old USING (kb_id, path)"""


@query(_sql(1))
def update_one_base(spark, d):
    """All pages in one knowledge base, fetched twice under numbers that clash: every page keeps its id, its links and its words."""
    return _updated(spark, d, 1)


@query(_sql(2))
def update_two_bases(spark, d):
    """As ``update_one_base``, with the pages dealt to two knowledge bases: neither has words or links of the other."""
    return _updated(spark, d, 2)
