"""Queries over Markdown built from documents, so that every pass has something to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import markdown as md
from docloom.operators import enrich
from docloom.plans.registry import query
from docloom.sources import llmstxt

C = F.col
BASE = "https://docs.example.com/guide/start.html?x=1"


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source", "lang")


_HEAD = "```lang-python\n<div>code</div>\n# kept or not\n```\n<div class=\"x\">"
_TAIL = "</div>  \n#  Second\n  ```\n<span>in</span>\n```\n<span>out</span>\t\r\n[a](sub/up.md) [b](/root/x.md) ![i](/img.png) [c](https://e.org/z) [d](#frag) [m](mailto:a@b.c)\n## #\n\n"


def _text() -> Column:
    return F.concat(F.lit("# "), "source", F.lit("\n\n\n\n\n"), F.lit(_HEAD), F.coalesce("text", F.lit("")), F.lit(_TAIL))


def _e(x: str) -> str:
    return "E'" + x.replace("\\", "\\\\").replace("'", "''").replace("\n", "\\n").replace("\t", "\\t").replace("\r", "\\r") + "'"


_MD = f"m AS (SELECT doc_id, '# ' || source || {_e(chr(10) * 5)} || {_e(_HEAD)} || coalesce(text, '') || {_e(_TAIL)} AS x FROM documents)"


def _lines(x: str) -> str:
    y = f"replace({x}, {_e(chr(13) + chr(10))}, chr(10))"
    return f"string_split(CASE WHEN {y} LIKE '%' || chr(10) THEN left({y}, length({y}) - 1) ELSE {y} END, chr(10))"


_FENCE = r"'(?m)^[ \t]*```[^\n]*'"
_TAGS = rf"'</?(?:{'|'.join(md.DROPPED)})(?:\s[^>\n]*)?>'"


def _headings(src: str, out: str) -> str:
    return rf"""{out}_l AS (SELECT doc_id, {_lines('x')} AS l FROM {src}), {out}_f AS (SELECT doc_id, l, list_position(list_transform(l, lambda s: regexp_matches(s, '^#\s+.+$')), true) AS f FROM {out}_l),
{out} AS (SELECT doc_id, array_to_string(list_transform(l, lambda s, i: CASE WHEN i > f AND regexp_matches(s, '^#\s+.+$') THEN regexp_replace(s, '^#\s+(.+)$', '## \1') ELSE s END), chr(10)) AS x FROM {out}_f)"""


def _strip(src: str, out: str) -> str:
    return rf"""{out}_l AS (SELECT doc_id, array_to_string({_lines('x')}, chr(10)) AS x FROM {src}),
{out}_p AS (SELECT doc_id, string_split_regex(x, {_FENCE}) AS p, list_append(regexp_extract_all(x, {_FENCE}), '') AS f FROM {out}_l),
{out} AS (SELECT doc_id, array_to_string(list_transform(p, lambda s, i: CASE WHEN i % 2 = 1 THEN regexp_replace(s, {_TAGS}, '', 'g') ELSE s END || f[i]), '') AS x FROM {out}_p)"""


_LANG = r"regexp_replace(x, '(?m)^```(?:language-|lang-|highlight-)([\p{L}\p{N}_]+)', '```\1', 'g')"
_BLANKS = r"regexp_replace(x, '\n{4,}', chr(10) || chr(10) || chr(10), 'g')"
_RESOLVE = r"""regexp_replace(regexp_replace(x, '(^|[^!])\[([^\]]*)\]\((/[^)]*)\)', '\1[\2](https://docs.example.com\3)', 'g'), '(^|[^!])\[([^\]]*)\]\((sub/[^)]*)\)', '\1[\2](https://docs.example.com/guide/\3)', 'g')"""
_TRIM = rf"array_to_string(list_transform({_lines('x')}, lambda s: regexp_replace(s, '[\s\p{{Z}}]+$', '')), chr(10))"
_FINAL = r"regexp_replace(x, '\n+$', '') || chr(10)"


def _one(f) -> callable:
    return lambda spark, d: docs(spark, d).select("doc_id", f(_text()).alias("md"))


query(f"WITH {_MD}, {_headings('m', 'h')} SELECT doc_id, x AS md FROM h", "md_headings")(_one(md.normalize_headings))
query(f"WITH {_MD} SELECT doc_id, {_BLANKS} AS md FROM m", "md_blank_lines")(_one(md.clean_blank_lines))
query(f"WITH {_MD} SELECT doc_id, {_LANG} AS md FROM m", "md_fence_lang")(_one(md.fence_languages))
query(f"WITH {_MD}, {_strip('m', 's')} SELECT doc_id, x AS md FROM s", "md_strip_tags")(_one(md.strip_tags))
query(f"WITH {_MD} SELECT doc_id, {_RESOLVE} AS md FROM m", "md_links")(_one(lambda x: md.resolve_links(x, F.lit(BASE))))
query(f"WITH {_MD} SELECT doc_id, {_TRIM} AS md FROM m", "md_trim")(_one(md.trim_lines))
query(f"WITH {_MD} SELECT doc_id, {_FINAL} AS md FROM m", "md_final_newline")(_one(md.final_newline))
query(f"""WITH {_MD}, {_headings('m', 'h')}, b AS (SELECT doc_id, {_BLANKS} AS x FROM h), g AS (SELECT doc_id, {_LANG} AS x FROM b), {_strip('g', 's')},
r AS (SELECT doc_id, {_RESOLVE} AS x FROM s), t AS (SELECT doc_id, {_TRIM} AS x FROM r) SELECT doc_id, {_FINAL} AS md FROM t""", "md_cleanup_all")(_one(lambda x: md.cleanup(x, F.lit(BASE))))


@query(rf"WITH {_MD} SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(regexp_replace(x, '(?s)```.*?```', '', 'g'), '[\s\p{{Z}}\x0B\x1C-\x1F\x85]+'), lambda w: w <> '' AND NOT (starts_with(w, '#') AND strlen(w) <= 2))) AS BIGINT) AS n_words FROM m")
def word_count(spark, d):
    return docs(spark, d).select("doc_id", md.word_count(_text()).alias("n_words"))


@query(rf"WITH {_MD} SELECT doc_id, coalesce(nullif(trim(regexp_extract(x, '(?m)^#[ \t]+(.+)$', 1)), ''), 'Untitled') AS title FROM m")
def md_title(spark, d):
    return docs(spark, d).select("doc_id", md.title(_text()).alias("title"))


@query(r"""SELECT doc_id, '---' || chr(10) || 'source_url: "https://e.org/' || doc_id || '"' || chr(10) || 'title: "' || replace(replace('a\b "' || source || '"', '\', '\\'), '"', '\"') || '"' || chr(10)
 || 'fetched_at: "2026-01-02T03:04:05Z"' || chr(10) || '---' || chr(10) AS front FROM documents""")
def frontmatter(spark, d):
    url = F.concat(F.lit("https://e.org/"), C("doc_id").cast("string"))
    return docs(spark, d).select("doc_id", md.frontmatter(url, F.concat(F.lit('a\\b "'), "source", F.lit('"')), F.lit("2026-01-02T03:04:05Z")).alias("front"))


@query(f"""WITH c AS (SELECT doc_id, text, strlen(text) AS n, list_max(list_filter(range(greatest(4000 // 4, 0), 4001), lambda k: strlen(left(text, k)) <= 4000)) AS k FROM (SELECT doc_id, text FROM documents WHERE strlen(text) > 4000))
SELECT doc_id, CASE WHEN k IS NULL THEN d.text ELSE left(c.text, k) || {_e(md.TRUNCATED)} END AS cut FROM documents d LEFT JOIN c USING (doc_id)""")
def truncate(spark, d):
    return docs(spark, d).select("doc_id", md.truncate(C("text"), md.LIMITS["context"]).alias("cut"))


@query("SELECT doc_id, sha256(coalesce(text, '') || 'summary') AS hash FROM documents")
def prompt_hash(spark, d):
    return docs(spark, d).select("doc_id", enrich.prompt_hash(F.coalesce("text", F.lit("")), F.lit("summary")).alias("hash"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS hash, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents")
def content_hash(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """An llms.txt for each document; every ninth has no heading first, every fourth no summary, every fifth no sections."""
    i = C("doc_id").cast("string")
    body = F.concat(
        F.when(C("doc_id") % 9 == 0, "no heading\n").otherwise(F.concat(F.lit("\n#  Docs "), i, F.lit("\n\n"))),
        F.when(C("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("> first "), "lang", F.lit("\n\n>second\n"))),
        F.lit("intro text\n- [Top](https://e.org/top)\n"),
        F.when(C("doc_id") % 5 == 0, "").otherwise(F.concat(F.lit("## One "), "source", F.lit("\n* [A b](https://e.org/"), i, F.lit(") \n- [B](/b):  some notes \nwords\n## Empty\n### Third\n- [no link\n##  Two\n- [C](/c?d=(e)"))),
    )
    return docs(spark, d).select(C("doc_id").alias("id"), body.alias("body"))


_FILES = r"""fl AS (SELECT doc_id AS id, CASE WHEN doc_id % 9 = 0 THEN E'no heading\n' ELSE E'\n#  Docs ' || doc_id || E'\n\n' END || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '> first ' || lang || E'\n\n>second\n' END
 || E'intro text\n- [Top](https://e.org/top)\n' || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '## One ' || source || E'\n* [A b](https://e.org/' || doc_id || E') \n- [B](/b):  some notes \nwords\n## Empty\n### Third\n- [no link\n##  Two\n- [C](/c?d=(e)' END AS body FROM documents),
ln AS (SELECT id, list_filter(list_transform(string_split(body, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS rows FROM fl),
ok AS (SELECT id, regexp_matches(rows[1], '^#\s+.+$') AS ok, rows FROM ln),
li AS (SELECT id, unnest(range(1, len(rows) + 1)) AS pos, unnest(rows) AS line FROM ok WHERE ok)"""


@query(rf"""WITH {_FILES} SELECT id, ok, CASE WHEN ok THEN trim(regexp_extract(rows[1], '^#\s+(.+)$', 1)) END AS title,
  CASE WHEN ok AND regexp_matches(rows[2], '^>') THEN trim(regexp_extract(rows[2], '^>\s*(.+)$', 1)) || ' ' || trim(regexp_extract(rows[3], '^>\s*(.+)$', 1)) END AS summary FROM ok""")
def llms_validate(spark, d):
    return llmstxt.parse(files(spark, d)).select("id", "ok", "title", "summary")


@query(rf"""WITH {_FILES}, s AS (SELECT id, pos, line, max(CASE WHEN regexp_matches(line, '^##\s+.+$') THEN pos END) OVER (PARTITION BY id ORDER BY pos) AS at FROM li)
SELECT s.id, trim(regexp_extract(h.line, '^##\s+(.+)$', 1)) AS section, trim(regexp_extract(s.line, '^[-*]\s+\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$', 1)) AS name,
  trim(regexp_extract(s.line, '^[-*]\s+\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$', 2)) AS url, nullif(trim(regexp_extract(s.line, '^[-*]\s+\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$', 3)), '') AS notes
FROM s LEFT JOIN li h ON h.id = s.id AND h.pos = s.at WHERE regexp_matches(s.line, '^[-*]\s+\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$')""")
def llms_parse_entries(spark, d):
    return llmstxt.entries(llmstxt.parse(files(spark, d))).select("id", "section", "name", "url", "notes")


@query(rf"""WITH {_FILES}, s AS (SELECT id, pos, line, count(*) FILTER (regexp_matches(line, '^##\s+.+$')) OVER (PARTITION BY id ORDER BY pos) AS k FROM li)
SELECT id, k AS number, max(CASE WHEN regexp_matches(line, '^##\s+.+$') THEN trim(regexp_extract(line, '^##\s+(.+)$', 1)) END) AS title,
  count(*) FILTER (regexp_matches(line, '^[-*]\s+\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$')) AS n_entries FROM s WHERE k > 0 GROUP BY id, k""")
def llms_parse_sections(spark, d):
    return llmstxt.sections(llmstxt.parse(files(spark, d)))


@query(r"""SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+', '') LIKE '# %' AS raw, doc_id % 3 <> 0 AS headed FROM documents""")
def llms_accept(spark, d):
    body = F.when(C("doc_id") % 3 == 0, C("text")).otherwise(F.concat(F.lit(" \n# T\n"), F.coalesce("text", F.lit(""))))
    t = F.coalesce("text", F.lit(""))
    return docs(spark, d).select("doc_id", llmstxt.valid(t).alias("raw"), (llmstxt.valid(body) & (C("doc_id") % 3 != 0)).alias("headed"))


@query(rf"""WITH {_FILES}, v AS (SELECT fl.id, fl.body, ok.ok AND ltrim(body, E' \n') LIKE '# %' AS good FROM fl JOIN ok USING (id))
SELECT 'https://d' || id || '.org/x' AS url, 'https://d' || id || '.org' AS origin, good AS found, CASE WHEN good AND id % 2 = 0 THEN 'full ' || id END AS "full" FROM v""")
def llms_discover(spark, d):
    f = files(spark, d)
    name = F.concat(F.lit("https://d"), C("id").cast("string"), F.lit(".org"))
    fetched = f.select(F.concat(name, F.lit("/llms.txt")).alias("url"), "body").unionByName(f.filter("id % 2 = 0").select(F.concat(name, F.lit("/llms-full.txt")).alias("url"), F.concat(F.lit("full "), C("id").cast("string")).alias("body")))
    return llmstxt.discover(f.select(F.concat(name, F.lit("/x")).alias("url")), fetched).select("url", "origin", "found", "full")


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN CASE doc_id % 3 WHEN 0 THEN 'Summarise this documentation page in two or three plain sentences.' ELSE 'List the coding rules that these page summaries state or clearly imply.' END || chr(10) || chr(10) || 'Documentation: ' || source || chr(10) || chr(10) || text END AS prompt FROM documents")
def prompt_text(spark, d):
    task = F.when(C("doc_id") % 3 == 0, "summary").when(C("doc_id") % 3 == 1, "rules").otherwise("unknown")
    return docs(spark, d).select("doc_id", enrich.prompt(task, C("source"), C("text")).alias("prompt"))
