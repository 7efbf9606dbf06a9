"""Text artifacts of a knowledge base, each assembled by one ordered aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import urls
from docloom.operators import concat

TOOL = "docloom v1"
# The files of a knowledge base's artifacts folder and what stands in for missing content.
NAMES = ("llms.txt", "llms-full.txt", "SKILL.md", "rules.md", "style.md", "do_dont.md")
PASSED = {
    "rules.md": ("Coding Rules", "No specific coding rules were extracted from this documentation."),
    "style.md": ("Style Guide", "No specific style guidelines were extracted from this documentation."),
    "do_dont.md": ("Do's and Don'ts", "No specific do's and don'ts were extracted from this documentation."),
}
LEAF, SECTION = "Documentation page", "Section overview"


def provenance(source_url: Column) -> Column:
    return F.concat(F.lit(f"<!-- Generated by {TOOL} from "), source_url, F.lit(" -->\n\n"))


def llms_txt(toc: DataFrame, kbs: DataFrame, descriptions: DataFrame) -> DataFrame:
    """kb_id and content. toc: flat rows; kbs: kb_id, name, source_url, summary; descriptions: kb_id, path, description."""
    has = toc.filter("item > 0").select("kb_id", "section").distinct().withColumn("kids", F.lit(True))
    t = toc.join(has, ["kb_id", "section"], "left").join(descriptions, ["kb_id", "path"], "left")
    heading = (F.col("item") == 0) & F.col("kids").isNotNull()
    link = lambda default: F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.coalesce("source_url", "path"), F.lit("): "), F.coalesce("description", F.lit(default)), F.lit("\n"))
    head = F.concat(F.lit("\n## "), F.col("title"), F.lit("\n\n"), F.when(F.col("source_url").isNotNull(), link(SECTION)).otherwise(""))
    t = t.select("kb_id", F.struct("section", "item", F.when(heading, head).otherwise(link(LEAF)).alias("text")).alias("r"))
    body = t.groupBy("kb_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda x: x["text"]), "").alias("links"))
    top = F.concat(provenance(F.col("source_url")), F.lit("# "), F.col("name"), F.lit("\n\n> "), F.col("summary"), F.lit("\n\n"))
    return kbs.join(body, "kb_id", "left").select("kb_id", F.concat(top, F.coalesce("links", F.lit(""))).alias("content"))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _full_texts(pages: DataFrame, kbs: DataFrame) -> DataFrame:
    """kb_id, kind, ord and text of all that llms-full.txt is made of: its head, a line for each page, and the pages."""
    body = F.concat(F.lit("---\n\n## "), "title", F.lit("\n\n<!-- source: "), "url", F.lit(" -->\n\n"), _trimmed(F.col("content")), F.lit("\n\n"))
    line = F.concat(F.lit("- ["), "title", F.lit("](#"), urls.title_anchor(F.col("title")), F.lit(")\n"))
    kinds = F.array(F.struct(F.lit(1).alias("kind"), line.alias("text")), F.struct(F.lit(3).alias("kind"), body.alias("text")))
    p = pages.join(kbs.select("kb_id"), "kb_id", "left_semi").select("kb_id", "ord", F.explode(kinds).alias("t")).select("kb_id", "t.kind", "ord", "t.text")
    top = F.concat(provenance(F.col("source_url")), F.lit("# "), F.col("name"), F.lit(" — Full Documentation\n\n## Table of Contents\n\n"))
    ends = kbs.join(pages.select("kb_id").distinct(), "kb_id", "left_semi").select("kb_id", F.explode(F.array(F.struct(F.lit(0).alias("kind"), top.alias("text")), F.struct(F.lit(2).alias("kind"), F.lit("\n").alias("text")))).alias("t"))
    return p.unionByName(ends.select("kb_id", "t.kind", F.lit(None).cast(pages.schema["ord"].dataType).alias("ord"), "t.text"))


def llms_full_parts(pages: DataFrame, kbs: DataFrame, part_bytes: int = concat.PART_BYTES) -> DataFrame:
    """kb_id, part, at and content of llms-full.txt in ordered parts. pages: kb_id, ord, title, url, content.

    A knowledge base of any number of pages is written by many tasks: no row and no task holds more than a part and a page.
    """
    return concat.in_parts(_full_texts(pages, kbs), "kb_id", ["kind", "ord"], "text", part_bytes)


def llms_full_txt(pages: DataFrame, kbs: DataFrame) -> DataFrame:
    """kb_id and content: the parts of ``llms_full_parts`` in one row each, for knowledge bases that fit in one."""
    row = F.array_sort(F.collect_list(F.struct("kind", "ord", "text")))
    return _full_texts(pages, kbs).groupBy("kb_id").agg(F.array_join(F.transform(row, lambda x: F.coalesce(x["text"], F.lit(""))), "").alias("content"))


def skill_md(kbs: DataFrame) -> DataFrame:
    """kb_id and content. kbs: kb_id, name, source_url, description, body (or null)."""
    front = F.concat(F.lit("---\nname: "), "name", F.lit('\nversion: 1.0.0\ndescription: "'), "description", F.lit('"\nsource: '), "source_url", F.lit("\n---\n\n"))
    plain = F.concat(F.lit("# "), "name", F.lit("\n\n"), "description", F.lit("\n\n## Overview\n\nSee the documentation at "), "source_url")
    return kbs.select("kb_id", F.concat(provenance(F.col("source_url")), front, F.coalesce(_trimmed(F.col("body")), plain), F.lit("\n\n")).alias("content"))


def passed_through(kbs: DataFrame, name: str) -> DataFrame:
    """kb_id and content of rules.md, style.md or do_dont.md. kbs: kb_id, name, source_url, body (or null)."""
    heading, fallback = PASSED[name]
    return kbs.select("kb_id", F.concat(provenance(F.col("source_url")), F.lit(f"# {heading} — "), "name", F.lit("\n\n"), F.coalesce(_trimmed(F.col("body")), F.lit(fallback)), F.lit("\n\n")).alias("content"))


def meta(files: DataFrame) -> DataFrame:
    """kb_id, filename, sha256 and size_bytes of artifacts (kb_id, filename, content)."""
    return files.select("kb_id", "filename", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size_bytes"))


def summaries_json(summaries: DataFrame) -> DataFrame:
    """kb_id and one JSON object of path and summary, in the order of paths, so that equal summaries give equal text."""
    rows = F.array_sort(F.collect_list(F.struct("path", "summary")))
    summaries = summaries.groupBy("kb_id", "path").agg(F.max("summary").alias("summary"))  # a path counts once
    return summaries.groupBy("kb_id").agg(F.to_json(F.map_from_entries(rows)).alias("json"))


def kb_summary(kbs: DataFrame, summaries: DataFrame) -> DataFrame:
    """kb_id and summary: that of the least path, else a plain sentence."""
    first = summaries.groupBy("kb_id").agg(F.min_by("summary", "path").alias("s"))
    return kbs.join(first, "kb_id", "left").select("kb_id", F.coalesce("s", F.concat(F.lit("Documentation for "), "name")).alias("summary"))
