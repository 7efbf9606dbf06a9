"""Queries over HTML."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import html
from docloom.plans.registry import h1, query
from docloom.sources import pages as src

C = F.col


@query("""SELECT page_id, CASE WHEN html ILIKE '%name="generator" content="docusaurus%' THEN 'docusaurus' WHEN html LIKE '%id="VPContent"%' THEN 'vitepress'
  WHEN html LIKE '%name="gitbook"%' THEN 'gitbook' WHEN html LIKE '%wy-nav-side%' THEN 'readthedocs' ELSE 'generic' END AS adapter
FROM (SELECT page_id, CASE page_id % 5 WHEN 1 THEN '<meta name="generator" content="Docusaurus v3">' || html WHEN 2 THEN '<div id="VPContent">' || html
  WHEN 3 THEN '<meta name="gitbook">' || html WHEN 4 THEN '<nav class="wy-nav-side"></nav>' || html ELSE html END AS html FROM pages)""")
def detect_adapter(spark, d):
    marks = {1: '<meta name="generator" content="Docusaurus v3">', 2: '<div id="VPContent">', 3: '<meta name="gitbook">', 4: '<nav class="wy-nav-side"></nav>'}
    mark = F.lit("")
    for k, m in marks.items():
        mark = F.when(C("page_id") % 5 == k, m).otherwise(mark)
    return html.facts(src.read(spark, d).select("page_id", F.concat(mark, "html").alias("html")), "adapter")


#: The article as a tree gives it back: an open b ends where its paragraph ends, and quotes need no reference in text.
_ARTICLE = r"""replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<p><b>([^<]*)<br>', '<p><b>\1<br></b></p>', 'g'), '&quot;', '"')"""


@query(f"SELECT page_id, {_ARTICLE} AS content FROM pages")
def html_content(spark, d):
    """Inner HTML of the main element, as ingest takes it."""
    return html.facts(src.read(spark, d).select("page_id", "html"), "content")


@query(rf"""SELECT page_id, regexp_extract(html, '(?s)(<div class="ad">.*?</div>)', 1) || '<div>' || {_ARTICLE} || '</div>' AS body FROM pages""")
def strip_chrome(spark, d):
    """Pages without a main element, for which the generic adapter takes the body without navigation, foot, scripts and styles."""
    plain = F.regexp_replace("html", "<(/?)article>", "<$1div>")
    return html.facts(src.read(spark, d).select("page_id", plain.alias("html")), "body")


@query(r"""SELECT page_id, '| id | host |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || page_id || ' | ' || url || ' |' || chr(10) || '| ' || page_id || ' | |' AS md FROM pages""")
def html_table_md(spark, d):
    """The converter's own tables: a short row is filled up."""
    i = C("page_id").cast("string")
    table = F.concat(F.lit("<main><TABLE><tr><th>id<th>host</tr><tr><td>"), i, F.lit("</td><td>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</td></tr><tr><td> "), i, F.lit("</table></main>"))
    rows = html.facts(src.read(spark, d).select("page_id", table.alias("html")), "raw")
    return rows.select("page_id", F.regexp_replace(F.trim(F.regexp_replace("raw", r"^\s+|\s+$", "")), r"\|  \|", "| |").alias("md"))


#: The given pages' articles hold one h1 and paragraphs, of which some are bold up to a line break; each is a block of the Markdown.
@query(r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(x, '<p><b>([^<]*)<br>', '<p>**\1**', 'g'), '<h1>', '<p># ', 'g'), '</p>|</h1>', '', 'g'), '<p>') AS ps FROM a),
t AS (SELECT page_id, url, replace(replace(array_to_string(list_filter(list_transform(ps, lambda p: regexp_replace(regexp_replace(regexp_replace(p, '\s+', ' ', 'g'), '^ | $', '', 'g'), ' \*\*$', '**')), lambda p: p <> ''), chr(10) || chr(10)), '&quot;', '"'), '&amp;', '&') || chr(10) AS md FROM b),
h AS (SELECT *, regexp_extract(md, '^# ([^\n]*)', 1) AS title FROM t)
SELECT page_id, url, title, '---' || chr(10) || 'source_url: "' || url || '"' || chr(10) || 'title: "' || replace(replace(title, '\', '\\'), '"', '\"') || '"' || chr(10) || '---' || chr(10) || chr(10) || md AS markdown,
  CAST(len(list_filter(regexp_split_to_array(md, '\s+'), lambda w: w <> '' AND NOT (starts_with(w, '#') AND strlen(w) <= 2))) AS BIGINT) AS word_count FROM h""")
def convert_pages(spark, d):
    return html.convert(src.read(spark, d))


@query(r"""WITH p AS (SELECT page_id, url, lang.x AS lang FROM pages, (SELECT 1) o, LATERAL (SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS x) lang)
SELECT page_id, url, 'Page ' || page_id AS title, '---' || chr(10) || 'source_url: "' || url || '"' || chr(10) || 'title: "Page ' || page_id || '"' || chr(10) || '---' || chr(10) || chr(10) || '# Page ' || page_id || chr(10) || chr(10)
  || 'In **' || lang || '**, see [its source](' || url || ').' || chr(10) || chr(10) || '- one *' || page_id || '*' || chr(10) || '- two' || chr(10) || chr(10) || '| lang | id |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || lang || ' | ' || page_id || ' |'
  || chr(10) || chr(10) || '```py' || chr(10) || 'x < ' || page_id || chr(10) || '```' || chr(10) AS markdown FROM p""")
def convert_extracted(spark, d):
    """Content that is no whole page, made of each page's facts and converted as it is: headings, marks, lists, a table and code."""
    i, lang = C("page_id").cast("string"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    x = F.concat(
        F.lit("<h1>Page "), i, F.lit("</h1><p>In <b>"), lang, F.lit("</b>, see <a href='"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("'>its\n source</a>.<ul><li>one <em>"), i, F.lit("</em><li>two</ul><table><tr><th>lang<th>id<tr><td>"), lang,
        F.lit("<td>"), i, F.lit("</table><pre><code class='language-py'>x &lt; "), i, F.lit("</code></pre><script>no()</script>"),
    )
    return html.convert_extracted(src.read(spark, d).select("page_id", "url", x.alias("html"))).drop("word_count")


@query(rf"""WITH t AS (SELECT page_id, {h1('html')} AS title FROM pages) SELECT page_id, CAST(0 AS INT) AS pos, regexp_replace(title, '\s+', ' ', 'g') AS title,
  regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS path FROM t WHERE title <> ''""")
def adapter_toc(spark, d):
    return html.facts(src.read(spark, d).select("page_id", "html"), "toc").select("page_id", F.posexplode("toc").alias("pos", "e")).select("page_id", "pos", "e.title", "e.path")


@query("""WITH m AS (SELECT page_id, regexp_extract(url, '://([^/?#:]+)', 1) AS kb_id, CASE page_id % 5 WHEN 1 THEN 'docusaurus' WHEN 2 THEN 'vitepress' WHEN 3 THEN 'gitbook' WHEN 4 THEN 'readthedocs' ELSE 'generic' END AS adapter FROM pages)
SELECT kb_id, arg_min(adapter, page_id) AS primary_adapter FROM m GROUP BY kb_id""")
def primary_adapter(spark, d):
    """The adapter of each knowledge base's first page."""
    kb = src.page_table(src.read(spark, d)).select("page_id", "kb_id")
    return detect_adapter(spark, d).join(kb, "page_id").groupBy("kb_id").agg(F.min_by("adapter", "page_id").alias("primary_adapter"))
