"""Queries over tables of contents, enrichment and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import html
from docloom.operators import artifacts, diff, enrich, toc
from docloom.plans import pages_q
from docloom.plans.registry import PM, parent, query, title_from
from docloom.sources import pages as src

C = F.col

_TOC = f"""p AS (SELECT kb_id, path, coalesce(title, {title_from('path')}) AS title, url AS source_url, page_id, {parent('path')} AS parent FROM pm),
rt AS (SELECT kb_id, path, title, source_url, 0 AS made, page_id AS ord FROM p WHERE parent IS NULL
  UNION ALL SELECT kb_id, path, {title_from('path')}, NULL, 1, 0 FROM (SELECT DISTINCT kb_id, parent AS path FROM p WHERE parent IS NOT NULL) m WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.parent IS NULL AND p.kb_id = m.kb_id AND p.path = m.path)),
tp AS (SELECT *, row_number() OVER (PARTITION BY kb_id ORDER BY CASE WHEN path LIKE '%index' THEN 0 ELSE 1 END, lower(title), made, ord, path) AS section FROM rt),
it AS (SELECT *, row_number() OVER (PARTITION BY kb_id, parent ORDER BY CASE WHEN path LIKE '%index' THEN 0 ELSE 1 END, lower(title), page_id) AS item FROM p WHERE parent IS NOT NULL),
tf AS (SELECT kb_id, CAST(section AS INT) AS section, 0 AS item, 0 AS depth, title, path, source_url FROM tp
  UNION ALL SELECT it.kb_id, CAST(t.section AS INT), CAST(it.item AS INT), 1, it.title, it.path, it.source_url FROM it JOIN (SELECT kb_id, path, min(section) AS section FROM tp GROUP BY ALL) t ON t.kb_id = it.kb_id AND t.path = it.parent)"""
_T = f"WITH {PM}, {_TOC} "


def flat(spark: SparkSession, d: str) -> DataFrame:
    return toc.flat(pages_q.table(spark, d))


@query(_T + "SELECT * FROM tf")
def toc_flat(spark, d):
    return flat(spark, d)


@query(_T + "SELECT kb_id, section, count(*) FILTER (item > 0) AS n_children, string_agg(path, ',' ORDER BY item) FILTER (item > 0) AS children FROM tf GROUP BY kb_id, section")
def toc_children(spark, d):
    n = toc.nested(flat(spark, d)).select("kb_id", F.posexplode("sections").alias("k", "s"))
    kids = F.transform("s.children", lambda x: x["path"])
    return n.select("kb_id", (C("k") + 1).alias("section"), F.size(kids).cast("long").alias("n_children"), F.when(F.size(kids) > 0, F.array_join(kids, ",")).alias("children"))


@query(_T + "SELECT kb_id, string_agg(path, ',' ORDER BY section, item) AS paths FROM tf GROUP BY kb_id")
def toc_paths(spark, d):
    s = toc.nested(flat(spark, d))
    each = F.flatten(F.transform("sections", lambda x: F.concat(F.array(x["path"]), F.transform(x["children"], lambda y: y["path"]))))
    return s.select("kb_id", F.array_join(each, ",").alias("paths"))


@query(_T + "SELECT DISTINCT kb_id, path FROM tf WHERE source_url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM pm WHERE pm.kb_id = tf.kb_id AND pm.path = tf.path AND pm.page_id % 4 <> 1)")
def toc_missing_files(spark, d):
    return toc.missing(flat(spark, d), pages_q.table(spark, d).filter("page_id % 4 <> 1").select("kb_id", "path"))


_TASKS = """t AS (SELECT kb_id, k AS artifact_type, sha256(coalesce(title, '') || chr(10) || path || k) AS prompt_hash, 'model-a' AS model_id, path, coalesce(title, '') || chr(10) || path AS content, page_id FROM pm, (VALUES ('summary'), ('description')) v(k)),
ch AS (SELECT kb_id, artifact_type, prompt_hash, CASE WHEN page_id % 6 = 0 THEN 'model-b' ELSE 'model-a' END AS model_id, 'About ' || path AS result_json FROM t WHERE page_id % 3 = 0)"""


def tasks(spark: SparkSession, d: str) -> DataFrame:
    p = pages_q.table(spark, d).withColumn("content", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), "path"))
    t = p.select("kb_id", F.explode(F.array(F.lit("summary"), F.lit("description"))).alias("artifact_type"), "path", "content", "page_id")
    return t.select("kb_id", "artifact_type", enrich.prompt_hash(C("content"), C("artifact_type")).alias("prompt_hash"), F.lit("model-a").alias("model_id"), "path", "content", "page_id")


def cache(spark: SparkSession, d: str) -> DataFrame:
    """Results of every third page, half of them under another model."""
    t = tasks(spark, d).filter("page_id % 3 = 0")
    return t.select("kb_id", "artifact_type", "prompt_hash", F.when(C("page_id") % 6 == 0, "model-b").otherwise("model-a").alias("model_id"), F.concat(F.lit("About "), "path").alias("result_json"))


@query(f"WITH {PM}, {_TASKS} SELECT t.kb_id, t.artifact_type, t.path, ch.result_json AS result, ch.result_json IS NOT NULL AS hit FROM t LEFT JOIN ch USING (kb_id, artifact_type, prompt_hash, model_id)")
def cache_lookup(spark, d):
    return enrich.lookup(tasks(spark, d), cache(spark, d)).select("kb_id", "artifact_type", "path", "result", "hit")


@query(f"""WITH {PM}, {_TASKS}, n AS (SELECT kb_id, artifact_type, prompt_hash, model_id, 'New ' || path AS result_json FROM t WHERE page_id % 2 = 0)
SELECT DISTINCT * FROM n UNION ALL SELECT DISTINCT * FROM ch WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.kb_id = ch.kb_id AND n.artifact_type = ch.artifact_type AND n.prompt_hash = ch.prompt_hash AND n.model_id = ch.model_id)""")
def cache_upsert(spark, d):
    new = tasks(spark, d).filter("page_id % 2 = 0").select(*enrich.KEYS, F.concat(F.lit("New "), "path").alias("result_json"))
    return diff.upsert(cache(spark, d), new, enrich.KEYS, [])


@query(f"WITH {PM}, {_TASKS} SELECT * FROM ch WHERE kb_id <> 'ththre.example.com'")
def cache_invalidate(spark, d):
    return cache(spark, d).filter("kb_id <> 'ththre.example.com'")


@query(rf"""WITH {PM}, {_TASKS}, x AS (SELECT ch.result_json IS NOT NULL AS hit, len(string_split_regex(trim(content), '\s+')) AS i, coalesce(title, '') AS title, path FROM t JOIN pm USING (page_id, kb_id, path) LEFT JOIN ch USING (kb_id, artifact_type, prompt_hash, model_id)),
y AS (SELECT *, len(string_split_regex(trim(CASE WHEN trim(title, '# ') <> '' THEN trim(title, '# ') ELSE path END), '\s+')) AS o FROM x)
SELECT count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, CAST(coalesce(sum(i) FILTER (NOT hit), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(o) FILTER (NOT hit), 0) AS BIGINT) AS tokens_out FROM y""")
def cache_stats(spark, d):
    return enrich.stats(enrich.complete(tasks(spark, d).select(*enrich.KEYS, "path", "content"), cache(spark, d)))


@query(f"WITH {PM} SELECT kb_id, 2 * count(*) + 4 AS n_tasks FROM pm GROUP BY kb_id")
def task_totals(spark, d):
    return pages_q.table(spark, d).groupBy("kb_id").agg((F.count("*") * 2 + len(enrich.TASKS)).alias("n_tasks"))


_KBS = """kb AS (SELECT kb_id, kb_id AS name, 'https://' || kb_id || '/' AS source_url, 'Pages of ' || kb_id AS summary, CASE WHEN count(*) > 4 THEN '  Body of ' || kb_id || chr(10) END AS body FROM pm GROUP BY kb_id)"""
_TOP = f"'<!-- Generated by {artifacts.TOOL} from ' || source_url || ' -->' || chr(10) || chr(10)"


def kbs(spark: SparkSession, d: str) -> DataFrame:
    k = pages_q.table(spark, d).groupBy("kb_id").agg(F.count("*").alias("n"))
    return k.select(
        "kb_id", C("kb_id").alias("name"), F.concat(F.lit("https://"), "kb_id", F.lit("/")).alias("source_url"), F.concat(F.lit("Pages of "), "kb_id").alias("summary"),
        F.when(C("n") > 4, F.concat(F.lit("  Body of "), "kb_id", F.lit("\n"))).alias("body"),
    )


@query(_T + f""", {_KBS}, ds AS (SELECT kb_id, path, 'About ' || path AS description FROM pm WHERE page_id % 3 = 0),
hs AS (SELECT DISTINCT kb_id, section FROM tf WHERE item > 0),
x AS (SELECT tf.kb_id, section, item, CASE WHEN item = 0 AND hs.kb_id IS NOT NULL THEN E'\\n## ' || title || E'\\n\\n' || CASE WHEN source_url IS NOT NULL THEN '- [' || title || '](' || source_url || '): ' || coalesce(description, 'Section overview') || E'\\n' ELSE '' END
  ELSE '- [' || title || '](' || coalesce(source_url, path) || '): ' || coalesce(description, 'Documentation page') || E'\\n' END AS t FROM tf LEFT JOIN hs USING (kb_id, section) LEFT JOIN ds USING (kb_id, path))
SELECT kb.kb_id, {_TOP} || '# ' || name || E'\\n\\n> ' || summary || E'\\n\\n' || (SELECT string_agg(t, '' ORDER BY section, item) FROM x WHERE x.kb_id = kb.kb_id) AS content FROM kb""")
def llms_txt(spark, d):
    about = pages_q.table(spark, d).filter("page_id % 3 = 0").select("kb_id", "path", F.concat(F.lit("About "), "path").alias("description"))
    return artifacts.llms_txt(flat(spark, d), kbs(spark, d), about)


@query(rf"""WITH {PM}, {_KBS}, x AS (SELECT kb_id, page_id, title, url, regexp_replace(replace(lower(title), ' ', '-'), '[^\p{{L}}\p{{N}}-]', '_', 'g') AS a, content_hash AS c FROM pm WHERE title IS NOT NULL)
SELECT kb.kb_id, {_TOP} || '# ' || name || E' — Full Documentation\n\n## Table of Contents\n\n' || string_agg('- [' || title || '](#' || a || E')\n', '' ORDER BY page_id) || chr(10)
  || string_agg(E'---\n\n## ' || title || E'\n\n<!-- source: ' || url || E' -->\n\n' || c || E'\n\n', '' ORDER BY page_id) AS content FROM kb JOIN x USING (kb_id) GROUP BY kb.kb_id, name, source_url""")
def llms_full_txt(spark, d):
    p = pages_q.table(spark, d).filter("title is not null").select("kb_id", C("page_id").alias("ord"), "title", "url", F.concat(F.lit("\n "), "content_hash", F.lit(" \n")).alias("content"))
    return artifacts.llms_full_txt(p, kbs(spark, d))


def _bodies(spark, d):
    """Pages in the order of their paths, with their html for a text."""
    p = pages_q.table(spark, d).join(src.read(spark, d).select("page_id", "html"), "page_id")
    return p.select("kb_id", F.concat_ws(" ", "path", F.lpad(C("page_id").cast("string"), 12, "0")).alias("ord"), F.coalesce("title", "path").alias("title"), "url", C("html").alias("content"))


@query(rf"""WITH {PM}, {_KBS}, x AS (SELECT pm.kb_id, concat_ws(' ', path, lpad(CAST(pm.page_id AS VARCHAR), 12, '0')) AS ord, coalesce(title, path) AS t, pm.url, html FROM pm JOIN pages USING (page_id)),
y AS (SELECT kb_id, ord, 1 AS kind, '- [' || t || '](#' || regexp_replace(replace(lower(t), ' ', '-'), '[^\p{{L}}\p{{N}}-]', '_', 'g') || E')\n' AS s FROM x
  UNION ALL SELECT kb_id, ord, 3, E'---\n\n## ' || t || E'\n\n<!-- source: ' || url || E' -->\n\n' || regexp_replace(html, '^\s+|\s+$', '', 'g') || E'\n\n' FROM x
  UNION ALL SELECT kb_id, '', 0, {_TOP} || '# ' || name || E' — Full Documentation\n\n## Table of Contents\n\n' FROM kb UNION ALL SELECT kb_id, '', 2, chr(10) FROM kb),
z AS (SELECT kb_id, kind, ord, s, coalesce(sum(strlen(s)) OVER (PARTITION BY kb_id ORDER BY kind, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM y),
g AS (SELECT kb_id, b // 20000 AS cell, min(b) AS first_byte, string_agg(s, '' ORDER BY b, kind, ord) AS c FROM z GROUP BY ALL)
SELECT kb_id, CAST(row_number() OVER (PARTITION BY kb_id ORDER BY cell) - 1 AS INT) AS part, CAST(first_byte AS BIGINT) AS first_byte, CAST(strlen(c) AS BIGINT) AS n_bytes, sha256(c) AS sha256 FROM g""")
def llms_full_parts(spark, d):
    """The full documentation of whole pages, in ordered parts of 20,000 bytes and a page: where each begins, its size and its digest."""
    parts = artifacts.llms_full_parts(_bodies(spark, d), kbs(spark, d), 20_000)
    return parts.select("kb_id", "part", F.col("at").alias("first_byte"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


@query()
def llms_full_txt_whole(spark, d):
    """The full documentation with the Markdown of all pages, those without a title under their path; no SQL follows the converter."""
    p = pages_q.table(spark, d).select("kb_id", "page_id", "url", F.coalesce("title", "path").alias("title"))
    text = html.convert(src.read(spark, d)).select("page_id", C("markdown").alias("content"))
    return artifacts.llms_full_txt(p.join(text, "page_id").withColumnRenamed("page_id", "ord"), kbs(spark, d))


@query(rf"""WITH {PM}, {_KBS} SELECT kb_id, {_TOP} || E'---\nname: ' || name || E'\nversion: 1.0.0\ndescription: "' || summary || E'"\nsource: ' || source_url || E'\n---\n\n'
  || CASE WHEN body IS NOT NULL THEN 'Body of ' || kb_id ELSE '# ' || name || E'\n\n' || summary || E'\n\n## Overview\n\nSee the documentation at ' || source_url END || E'\n\n' AS content FROM kb""")
def skill_md(spark, d):
    return artifacts.skill_md(kbs(spark, d).withColumn("description", C("summary")))


_PASSED = " UNION ALL ".join(f"SELECT kb_id, '{n}' AS filename, {_TOP} || '# {h.replace(chr(39), chr(39) * 2)} — ' || name || E'\\n\\n' || coalesce(trim(body, E' \\n'), '{f.replace(chr(39), chr(39) * 2)}') || E'\\n\\n' AS content FROM kb" for n, (h, f) in artifacts.PASSED.items())


def _passed(spark, d):
    k = kbs(spark, d)
    out = None
    for name in artifacts.PASSED:
        one = artifacts.passed_through(k, name).select("kb_id", F.lit(name).alias("filename"), "content")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {PM}, {_KBS} {_PASSED}")
def passthrough_artifacts(spark, d):
    return _passed(spark, d)


@query(f"WITH {PM}, {_KBS}, a AS ({_PASSED}) SELECT kb_id, filename, sha256(content) AS sha256, CAST(strlen(content) AS BIGINT) AS size_bytes FROM a")
def artifact_meta(spark, d):
    return artifacts.meta(_passed(spark, d))


@query(f"WITH {PM}, s AS (SELECT DISTINCT kb_id, path, 'About ' || path AS s FROM pm) SELECT kb_id, '{{' || string_agg('\"' || path || '\":\"' || s || '\"', ',' ORDER BY path) || '}}' AS json FROM s GROUP BY kb_id")
def summaries_json(spark, d):
    return artifacts.summaries_json(pages_q.table(spark, d).select("kb_id", "path", F.concat(F.lit("About "), "path").alias("summary")))


@query(f"WITH {PM}, {_KBS} SELECT kb_id, coalesce((SELECT min_by('About ' || path, path) FROM pm WHERE pm.kb_id = kb.kb_id AND page_id % 3 = 0), 'Documentation for ' || name) AS summary FROM kb")
def kb_summary(spark, d):
    s = pages_q.table(spark, d).filter("page_id % 3 = 0").select("kb_id", "path", F.concat(F.lit("About "), "path").alias("summary"))
    return artifacts.kb_summary(kbs(spark, d), s)
