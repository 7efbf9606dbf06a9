"""The navigation of a whole knowledge base from those of its pages: one order that the pages' own orders agree with as far as they can."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from docloom.operators import toc


def entries(read: DataFrame) -> DataFrame:
    """kb_id, page_id, pos, title and path of the entries of each page's own navigation; pages of no known generator have headings only, and give none.

    read: kb_id, page_id, adapter and toc, as pages are read.
    """
    named = read.filter((F.col("adapter") != "generic") & F.col("adapter").isNotNull())
    return named.select("kb_id", "page_id", F.posexplode("toc").alias("pos", "e")).select("kb_id", "page_id", F.col("pos").cast("int").alias("pos"), "e.title", "e.path")


def merged(nav: DataFrame) -> DataFrame:
    """kb_id, seq (from 1), title and path: every entry of the pages' navigations once, in one order.

    The base of the order is the longest navigation of a page that the most pages share, then the one of the least entries in text order. An entry
    that it lacks, as of a menu that is open on some pages only, follows the last base entry in front of it there, as far behind as it stands
    behind it: of several such places the one that most pages give, then the nearest. Its title is the one that most pages give.
    Navigations are taken apart by page and put together by path: no task holds a knowledge base.
    """
    first = nav.filter("path is not null").groupBy("kb_id", "page_id", "path").agg(F.min(F.struct("pos", "title")).alias("r")).select("kb_id", "page_id", "path", "r.pos", "r.title")
    shape = first.groupBy("kb_id", "page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "path"))).alias("all"))  # a page's own entries
    shape = shape.withColumn("all", F.transform("all", lambda x: x["path"]))
    kinds = shape.groupBy("kb_id", "all").agg(F.count("*").alias("pages"))
    base = kinds.groupBy("kb_id").agg(F.max_by("all", F.struct(F.size("all"), "pages", F.concat_ws("\n", "all"))).alias("base"))
    base = base.select("kb_id", F.posexplode("base").alias("seq", "path"))
    own = first.join(base, ["kb_id", "path"], "left")
    before = Window.partitionBy("kb_id", "page_id").orderBy("pos")
    anchor = F.last(F.when(F.col("seq").isNotNull(), F.struct("seq", "pos")), ignorenulls=True).over(before)
    own = own.withColumn("anchor", anchor).select("kb_id", "path", "title", F.coalesce("seq", "anchor.seq", F.lit(-1)).alias("seq"), F.when(F.col("seq").isNotNull(), 0).otherwise(F.col("pos") - F.coalesce("anchor.pos", F.lit(-1))).alias("behind"))
    title = own.groupBy("kb_id", "path", "title").agg(F.count("*").alias("n")).groupBy("kb_id", "path").agg(F.max_by("title", F.struct("n", "title")).alias("title"))
    places = own.groupBy("kb_id", "path", "seq", "behind").agg(F.count("*").alias("n"))
    place = places.groupBy("kb_id", "path").agg(F.min_by(F.struct("seq", "behind"), F.struct(-F.col("n"), "behind", "seq")).alias("at"))
    out = place.join(title, ["kb_id", "path"]).select("kb_id", "path", "title", "at.seq", "at.behind")
    w = Window.partitionBy("kb_id").orderBy("seq", "behind", "path")  # narrow rows, a row an entry
    return out.select("kb_id", F.row_number().over(w).alias("seq"), "title", "path")


def table_of_contents(pages: DataFrame, nav: DataFrame) -> DataFrame:
    """The toc of each knowledge base (see ``toc.flat``): its navigation, where that has half as many entries as the base has pages at least, else that of the paths.

    Entries of a navigation are sections in its order, with the URL of the page that has their path.
    """
    order = merged(nav)
    size = pages.groupBy("kb_id").agg(F.count("*").alias("pages")).join(order.groupBy("kb_id").agg(F.count("*").alias("entries")), "kb_id")
    good = size.filter(toc.covers(F.col("entries"), F.col("pages"))).select("kb_id")
    urls = pages.groupBy("kb_id", "path").agg(F.min("url").alias("source_url"))
    mine = order.join(good, "kb_id", "left_semi").join(urls, ["kb_id", "path"], "left")
    mine = mine.select("kb_id", F.col("seq").alias("section"), F.lit(0).alias("item"), F.lit(0).alias("depth"), "title", "path", "source_url")
    return toc.flat(pages.join(good, "kb_id", "left_anti")).unionByName(mine)
