"""Queries over URLs, pages, links and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import html, urls
from docloom.operators import crawl, diff
from docloom.plans.registry import OLD, PM, h1, host, parent, path, query, raw_path, strip, title_from
from docloom.sources import pages as src

C = F.col


def table(spark: SparkSession, d: str) -> DataFrame:
    return src.page_table(src.read(spark, d))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return html.facts(src.read(spark, d).select("page_id", "html"), "title")


def old(spark: SparkSession, d: str) -> DataFrame:
    """A previous snapshot made from the pages: see the SQL."""
    p = table(spark, d).filter("page_id % 5 <> 0")
    return p.select(
        "kb_id", F.when(C("page_id") % 7 == 3, F.concat("path", F.lit("/gone"))).otherwise(C("path")).alias("path"), "url", "title",
        F.when(C("page_id") % 3 == 0, F.sha2("content_hash", 256)).otherwise(C("content_hash")).alias("content_hash"), F.concat(F.lit("old-"), "page_id").alias("id"),
    )


@query(f"WITH {PM} SELECT * FROM pm")
def page_meta(spark, d):
    return table(spark, d)


def _variant() -> F.col:
    k = C("page_id") % 5
    return (
        F.when(k == 1, F.concat(F.lit("HTTPS://Me@"), F.upper(urls.host(C("url"))), F.lit(":443/")))
        .when(k == 2, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit(".html.html/")))
        .when(k == 3, F.concat(F.regexp_replace("url", r"[?#].*$", ""), F.lit("/?q=a/#frag/")))
        .when(k == 4, F.concat(F.lit("http://"), urls.host(C("url")), F.lit(":8080//docs/docs/A_b c.md")))
        .otherwise(C("url"))
    )


_V = f"""v AS (SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'HTTPS://Me@' || upper({host('url')}) || ':443/' WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '.html.html/'
  WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '/?q=a/#frag/' WHEN 4 THEN 'http://' || {host('url')} || ':8080//docs/docs/A_b c.md' ELSE url END AS url FROM pages)"""
_AUTH = "regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^.*@', '')"
_FULL = f"""lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || CASE WHEN url ILIKE 'https:%' THEN regexp_replace({_AUTH}, ':443$', '') ELSE regexp_replace({_AUTH}, ':80$', '') END"""


def variants(spark, d):
    return src.read(spark, d).select("page_id", _variant().alias("url"))


@query(f"""WITH {_V}, f AS (SELECT page_id, {_FULL} || CASE WHEN regexp_matches(url, '^[A-Za-z]+://[^/?#]*/') THEN '' ELSE '/' END || regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^#]*)', 1) AS u FROM v)
SELECT page_id, CASE WHEN u LIKE '%/' AND length(u) - length(replace(u, '/', '')) > 3 THEN left(u, length(u) - 1) ELSE u END AS normalized FROM f""")
def normalize_url(spark, d):
    return variants(spark, d).select("page_id", urls.normalize_url(C("url")).alias("normalized"))


@query(f"WITH {_V} SELECT page_id, {_FULL} AS origin, {host('url')} AS host FROM v")
def url_origin(spark, d):
    return variants(spark, d).select("page_id", urls.origin(C("url")).alias("origin"), urls.host(C("url")).alias("host"))


@query(f"WITH {_V} SELECT page_id, {path('url')} AS path FROM v")
def url_to_path(spark, d):
    return variants(spark, d).select("page_id", urls.url_to_path(C("url")).alias("path"))


@query(f"WITH {_V}, p AS (SELECT page_id, {path('url')} AS path FROM v) SELECT page_id, {parent('path')} AS parent FROM p")
def parent_path(spark, d):
    return variants(spark, d).select("page_id", urls.parent_path(urls.url_to_path(C("url"))).alias("parent"))


@query(f"WITH {_V}, p AS (SELECT page_id, {path('url')} AS path FROM v) SELECT page_id, {title_from('path')} AS title FROM p")
def title_from_path(spark, d):
    return variants(spark, d).select("page_id", urls.title_from_path(urls.url_to_path(C("url"))).alias("title"))


@query(rf"WITH {_V}, p AS (SELECT page_id, lower({strip(raw_path('url'))}) AS p FROM v) SELECT page_id, regexp_replace(translate(p, ' _', '--'), '[^\p{{L}}\p{{N}}/-]', '', 'g') AS slug FROM p")
def slugify_path(spark, d):
    return variants(spark, d).select("page_id", urls.slugify_path(urls.raw_path(C("url"))).alias("slug"))


@query(rf"SELECT page_id, regexp_replace(regexp_replace(lower({h1('html')}), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM pages")
def slugify_title(spark, d):
    return titles(spark, d).select("page_id", urls.slugify(C("title")).alias("slug"))


@query(rf"SELECT page_id, regexp_replace(replace(lower({h1('html')}), ' ', '-'), '[^\p{{L}}\p{{N}}-]', '_', 'g') AS anchor FROM pages")
def title_anchor(spark, d):
    return titles(spark, d).select("page_id", urls.title_anchor(C("title")).alias("anchor"))


@query(rf"WITH {_V}, p AS (SELECT page_id, regexp_replace({raw_path('url')}, '^/+', '') AS p FROM v) SELECT page_id, regexp_replace(regexp_replace(regexp_replace(p, '^(?:docs/)+', ''), '(?:\.html)+$', ''), '/+$', '') AS path FROM p")
def normalize_doc_path(spark, d):
    return variants(spark, d).select("page_id", urls.normalize_doc_path(urls.raw_path(C("url"))).alias("path"))


_LINKS = """a AS (SELECT page_id AS from_page_id, url, regexp_extract_all(html, '<a\\s[^>]*?href="([^"]*)"', 1) AS hs FROM pages),
f AS (SELECT from_page_id, url, list_filter(hs, lambda h: NOT (starts_with(h, '#') OR starts_with(h, 'javascript:') OR starts_with(h, 'mailto:'))) AS hs FROM a),
l AS (SELECT from_page_id, url, unnest(range(0, len(hs))) AS pos, unnest(hs) AS href FROM f)"""


@query(f"WITH {_LINKS} SELECT from_page_id, pos, href FROM l")
def extract_links(spark, d):
    return src.links(src.read(spark, d)).select("from_page_id", "pos", "href")


@query(f"""WITH {_LINKS} SELECT from_page_id, pos, CASE WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*$', '')
  WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || regexp_replace(href, '#.*$', '') END AS to_url FROM l""")
def resolve_links_rootrel(spark, d):
    return src.links(src.read(spark, d)).select("from_page_id", "pos", "to_url")


@query(f"WITH {_LINKS} SELECT href, count(*) AS n FROM l WHERE from_page_id = 7 GROUP BY href")
def links_for_page(spark, d):
    return src.links(src.read(spark, d).filter("page_id = 7")).groupBy("href").agg(F.count("*").alias("n"))


@query(rf"""WITH p AS (SELECT page_id, {host('url')} AS host, coalesce(nullif({raw_path('url')}, ''), '/') AS p, CASE WHEN page_id % 4 = 0 THEN 'other.example.com' WHEN page_id % 9 = 1 THEN url || '/' ELSE url END AS u FROM pages)
SELECT page_id, page_id % 4 <> 0 AND page_id % 7 <> 2 AND (regexp_full_match(q, '/[^/]*/[^/]*') OR regexp_full_match(q, '/en/.*')) AND NOT regexp_full_match(q, '/fr/1.*') AS inside
FROM (SELECT *, CASE WHEN page_id % 9 = 1 AND NOT contains(u, '?') AND NOT contains(u, '#') THEN p || '/' ELSE p END AS q FROM p)""")
def crawl_scope(spark, d):
    """Pages in the scope of a crawl that began at their own host, or at another; some by another scheme, some with a slash behind."""
    u = F.when(C("page_id") % 9 == 1, F.concat("url", F.lit("/"))).otherwise(C("url"))
    u = F.when(C("page_id") % 7 == 2, F.regexp_replace(u, "^[a-z]+:", "ftp:")).otherwise(u)
    begun = F.when(C("page_id") % 4 == 0, F.lit("other.example.com")).otherwise(urls.host(C("url")))
    return src.read(spark, d).select("page_id", urls.in_scope(u, begun, includes=["/*/*", "/en/**"], excludes=["/fr/1**"]).alias("inside"))


@query(f"""WITH p AS (SELECT page_id, {raw_path('url')} AS p FROM pages) SELECT page_id, regexp_full_match(p, '/[^/]*/.5.*') AS star, regexp_full_match(p, '/.*5') AS deep FROM p""")
def glob_filter(spark, d):
    p = urls.raw_path(C("url"))
    return src.read(spark, d).select("page_id", p.rlike(urls.glob_regex("/*/?5**")).alias("star"), p.rlike(urls.glob_regex("/**5")).alias("deep"))


def _address() -> F.col:
    k = C("page_id")
    return F.concat_ws(".", F.get(F.array(*[F.lit(x) for x in (10, 127, 172, 192, 169, 100, 8, 0, 255)]), (k % 9).cast("int")), (k * 7) % 256, (k * 13) % 256, k % 256)


_IP = "ip AS (SELECT page_id, ([10, 127, 172, 192, 169, 100, 8, 0, 255])[CAST(page_id % 9 AS INT) + 1] AS a, (page_id * 7) % 256 AS b, (page_id * 13) % 256 AS c, page_id % 256 AS d FROM pages)"
_PRIVATE = "(a IN (10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 192 AND b = 0 AND c = 0) OR (a = 0 AND b = 0 AND c = 0 AND d = 0) OR (a = 255 AND b = 255 AND c = 255 AND d = 255))"


@query(f"WITH {_IP} SELECT page_id, {_PRIVATE} AS private FROM ip")
def private_ip(spark, d):
    return src.read(spark, d).select("page_id", urls.private_ip(_address()).alias("private"))


#: Hosts of which each page gets one: its own, its address, or one that must not be fetched.
_HOSTS = ("", "", "localhost", "LOCALHOST", "printer.local", "db.internal", "[::1]", "local.example.org", "internal", "me.localhost")


@query(rf"""WITH {_IP}, u AS (SELECT page_id, ({list(_HOSTS)})[CAST(page_id % 10 AS INT) + 1] AS h, (['http', 'https', 'HTTPS', 'ftp', 'file', 'https', 'http'])[CAST(page_id % 7 AS INT) + 1] AS s, {_PRIVATE} AS own FROM ip)
SELECT page_id, lower(s) NOT IN ('http', 'https') OR CASE WHEN h = '' THEN page_id % 10 = 1 AND own ELSE regexp_full_match(lower(h), 'localhost|\[::1\]|.*\.local|.*\.internal') END AS blocked FROM u""")
def ssrf_filter(spark, d):
    """Which of many kinds of URLs must not be fetched: by scheme, name, suffix or address, with users, ports and queries around them."""
    k = C("page_id")
    pick = lambda xs: F.get(F.array(*[F.lit(x) for x in xs]), (k % len(xs)).cast("int"))
    name = F.when(k % 10 == 0, urls.host(C("url"))).when(k % 10 == 1, _address()).otherwise(pick(_HOSTS))
    u = F.concat(pick(["http", "https", "HTTPS", "ftp", "file", "https", "http"]), F.lit("://"), F.when(k % 3 == 0, F.lit("me:pw@")).otherwise(""), name, F.when(k % 2 == 0, F.lit(":8080")).otherwise(""), F.lit("/a?x=localhost#db.internal"))
    return src.read(spark, d).select("page_id", urls.guarded(u).alias("blocked"))


#: A site made of all pages: page k is /p/k, with its own links and three more; of every 11 one is gone and of every 13 one has moved; a tenth of the links lead nowhere.
_SITE = r"""WITH RECURSIVE n AS (SELECT count(*) AS n, count(*) + count(*) // 10 AS m FROM pages),
h AS (SELECT page_id AS k, CASE WHEN page_id % 11 = 5 THEN 404 WHEN page_id % 13 = 6 THEN 301 ELSE 200 END AS status, (page_id * 3) % n AS moved, [(2 * page_id + 1) % m, (7 * page_id + 3) % m, (2 * page_id + 1) % m] AS dst,
  3 + len(list_filter(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), lambda x: NOT (starts_with(x, '#') OR starts_with(x, 'javascript:') OR starts_with(x, 'mailto:')))) AS n_links FROM pages, n),
j(k, t, hops) AS (SELECT k, k, 0 FROM (SELECT unnest(range(0, (SELECT m FROM n))) AS k) UNION ALL SELECT j.k, h.moved, hops + 1 FROM j JOIN h ON h.k = j.t AND h.status = 301 WHERE hops < 6),
o AS (SELECT j.k, t, hops, CASE WHEN hops > 5 THEN 'too_many_redirects' WHEN h.k IS NULL THEN 'missing' WHEN status <> 200 THEN 'http_error' ELSE 'fetched' END AS outcome, CASE WHEN hops <= 5 THEN status END AS status_code, dst, n_links
  FROM (SELECT k, arg_max(t, hops) AS t, max(hops) AS hops FROM j GROUP BY k) j LEFT JOIN h ON h.k = j.t),
r(k, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT x.dst, x.depth + 1 FROM (SELECT unnest(o.dst) AS dst, r.depth FROM r JOIN o ON o.k = r.k WHERE o.outcome = 'fetched' AND r.depth < 3) x),
v AS (SELECT k, min(depth) AS depth FROM r GROUP BY k)"""


def site(spark, d):
    """Responses (url, status_code, html, location) of the site above."""
    p = src.read(spark, d)
    n = p.count()
    k, m = C("page_id"), n + n // 10
    at = lambda x: F.concat(F.lit("https://site.example.org/p/"), x.cast("string"))
    more = F.concat(*[F.concat(F.lit('<a href="/p/'), ((a * k + b) % m).cast("string"), F.lit('">x</a>')) for a, b in ((2, 1), (7, 3), (2, 1))])
    status = F.when(k % 11 == 5, 404).when(k % 13 == 6, 301).otherwise(200)
    return p.select(at(k).alias("url"), status.alias("status_code"), F.concat("html", more).alias("html"), F.when(status == 301, at((k * 3) % n)).alias("location"))


def crawled(spark, d):
    start = spark.range(1).select(F.lit("https://site.example.org/p/0").alias("url"))
    return crawl.crawl(start, crawl.fetch_from(site(spark, d)), 3, lambda u: urls.in_scope(u, F.lit("site.example.org"), ["/p/*"]))


@query(_SITE + " SELECT 'https://site.example.org/p/' || k AS url, depth, outcome, status_code FROM v JOIN o USING (k)")
def crawl_bfs(spark, d):
    """Every URL of a crawl of three levels: its level, and whether it was fetched or why not."""
    return crawled(spark, d)[0]


@query(_SITE + """, f AS (SELECT depth, n_links FROM v JOIN o USING (k) WHERE outcome = 'fetched')
SELECT count(*) AS pages_fetched, CAST(1 + coalesce(sum(n_links) FILTER (depth < 3), 0) - count(*) AS BIGINT) AS pages_skipped, (SELECT count(*) FROM v JOIN o USING (k) WHERE outcome <> 'fetched') AS n_errors,
  CASE WHEN (SELECT count(*) FROM v JOIN o USING (k) WHERE outcome <> 'fetched') > 0 THEN 'completed_with_errors' ELSE 'completed' END AS status FROM f""")
def crawl_stats(spark, d):
    """The counts that the same crawl keeps as it goes."""
    c = crawled(spark, d)[2]
    return spark.range(1).select(F.lit(c["pages_fetched"]).cast("long").alias("pages_fetched"), F.lit(c["pages_skipped"]).cast("long").alias("pages_skipped"), F.lit(c["errors"]).cast("long").alias("n_errors"), F.lit(c["status"]).alias("status"))


@query("""WITH w AS (SELECT page_id, url FROM pages WHERE page_id % 17 <> 3 UNION ALL SELECT page_id + 1000000, 'https://gone.example.org/' || page_id FROM pages WHERE page_id % 29 = 0)
SELECT w.page_id, w.url, CASE WHEN p.page_id IS NULL THEN 'missing' WHEN p.page_id % 11 = 5 THEN 'http_error' WHEN strlen(p.html) > 5000 THEN 'too_large' ELSE 'fetched' END AS outcome,
  CASE WHEN p.page_id % 11 = 5 THEN 404 WHEN p.page_id IS NOT NULL THEN 200 END AS status_code FROM w LEFT JOIN (SELECT * FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_replace(url, '#.*$', '') ORDER BY page_id % 11 = 5, page_id) = 1) p
  ON regexp_replace(p.url, '#.*$', '') = regexp_replace(w.url, '#.*$', '')""")
def fetch_outcomes(spark, d):
    """Listed URLs against what came back for them: a row each, with what kept a page from being fetched."""
    p = src.read(spark, d)
    first = p.groupBy(F.regexp_replace("url", "#.*$", "").alias("u")).agg(F.min_by("page_id", F.struct(C("page_id") % 11 == 5, "page_id")).alias("page_id"))
    one = p.join(first.select("page_id"), "page_id", "left_semi")
    responses = one.select("url", F.when(C("page_id") % 11 == 5, 404).otherwise(200).alias("status_code"), "html", F.lit(None).cast("string").alias("location"))
    wanted = p.filter("page_id % 17 <> 3").select("page_id", "url").unionByName(p.filter("page_id % 29 = 0").select((C("page_id") + 1000000).alias("page_id"), F.concat(F.lit("https://gone.example.org/"), "page_id").alias("url")))
    return crawl.fetch_listed(wanted, responses, most_bytes=5000).select("page_id", "url", "outcome", "status_code")


_DIFF = """o AS (SELECT kb_id, path, min(content_hash) AS h FROM old GROUP BY ALL),
x AS (SELECT coalesce(o.kb_id, p.kb_id) AS kb_id, coalesce(o.path, p.path) AS path, o.path AS op, p.path AS np, o.h, p.content_hash AS nh FROM o FULL JOIN pm p ON o.kb_id = p.kb_id AND o.path = p.path),
df AS (SELECT kb_id, path, CASE WHEN np IS NULL THEN 'removed' WHEN op IS NULL THEN 'new' WHEN h = nh THEN 'unchanged' ELSE 'changed' END AS status FROM x)"""
_ALL = f"WITH {PM}, {OLD}, {_DIFF} "


def _diff(spark, d, force=False):
    return diff.page_diff(old(spark, d), table(spark, d), force)


@query(_ALL + "SELECT * FROM df")
def page_diff(spark, d):
    return _diff(spark, d)


@query(_ALL + "SELECT kb_id, path, CASE status WHEN 'unchanged' THEN 'changed' ELSE status END AS status FROM df")
def page_diff_force(spark, d):
    return _diff(spark, d, force=True)


@query(_ALL + "SELECT count(*) FILTER (status = 'new') AS added, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'unchanged') AS unchanged, count(*) FILTER (status = 'removed') AS removed FROM df")
def diff_summary(spark, d):
    return diff.summary(_diff(spark, d))


@query(_ALL + "SELECT DISTINCT kb_id, path FROM df WHERE status IN ('new', 'changed')")
def needs_convert(spark, d):
    return diff.needs_convert(_diff(spark, d))


@query(f"WITH {PM}, {OLD} SELECT kb_id, path, id FROM old WHERE NOT EXISTS (SELECT 1 FROM pm WHERE pm.kb_id = old.kb_id AND pm.path = old.path)")
def removed_pages(spark, d):
    return diff.removed(old(spark, d), table(spark, d)).select("kb_id", "path", "id")


@query(f"""WITH {PM}, {OLD}, n AS (SELECT kb_id, path, url, title, content_hash, 'new-' || page_id AS id FROM pm),
u AS (SELECT *, 1 AS new FROM n UNION ALL SELECT kb_id, path, url, title, content_hash, id, 0 FROM old)
SELECT kb_id, path, url, title, content_hash, coalesce(max(CASE WHEN new = 0 THEN id END) OVER (PARTITION BY kb_id, path), id) AS id FROM u QUALIFY row_number() OVER (PARTITION BY kb_id, path ORDER BY new DESC, url DESC, title DESC, content_hash DESC, id DESC) = 1""")
def upsert_pages(spark, d):
    new = table(spark, d).select("kb_id", "path", "url", "title", "content_hash", F.concat(F.lit("new-"), "page_id").alias("id"))
    return diff.upsert(old(spark, d), new, ["kb_id", "path"], ["id"])


@query(f"WITH {PM}, {OLD} SELECT kb_id, path, id FROM old WHERE EXISTS (SELECT 1 FROM pm WHERE pm.kb_id = old.kb_id AND pm.path = old.path)")
def prune_pages(spark, d):
    return diff.prune(old(spark, d), table(spark, d)).select("kb_id", "path", "id")


@query(f"WITH {PM} SELECT kb_id, path, title, url FROM pm ORDER BY kb_id, path")
def list_pages(spark, d):
    """Pages of each knowledge base by path; those that share one, by url and title, so that a listing repeats."""
    return table(spark, d).select("kb_id", "path", "title", "url").orderBy("kb_id", "path", "url", "title")


@query(f"WITH {PM} SELECT kb_id, count(*) AS page_count, sum(content_len) AS bytes FROM pm GROUP BY kb_id ORDER BY kb_id")
def list_kbs(spark, d):
    return table(spark, d).groupBy("kb_id").agg(F.count("*").alias("page_count"), F.sum("content_len").alias("bytes")).orderBy("kb_id")


@query(f"WITH {PM} SELECT page_id, title, content_hash FROM pm WHERE kb_id = 'ththre.example.com' AND path = 'fr/825'")
def get_page(spark, d):
    return table(spark, d).filter("kb_id = 'ththre.example.com' and path = 'fr/825'").select("page_id", "title", "content_hash")


@query(f"""WITH {PM}, s AS (SELECT kb_id, path, page_id % 3 AS source, page_id FROM pm) SELECT kb_id, path, page_id FROM s QUALIFY row_number() OVER (PARTITION BY kb_id ORDER BY source DESC, page_id DESC) = 1""")
def reader_dedup(spark, d):
    s = table(spark, d).select("kb_id", "path", (C("page_id") % 3).alias("source"), "page_id")
    return diff.last_of(s, "kb_id", "source", "page_id").select("kb_id", "path", "page_id")


@query("SELECT CAST(coalesce(max(r_regionkey), 0) AS BIGINT) AS version FROM region")
def schema_version(spark, d):
    """The largest of applied versions (here the keys of region), 0 if there is none."""
    return spark.read.parquet(f"{d}/region.parquet").agg(F.coalesce(F.max("r_regionkey"), F.lit(0)).cast("long").alias("version"))


_VISITED = f"""WITH {_LINKS}, t AS (SELECT from_page_id, CASE WHEN regexp_matches(href, '^https?://') THEN regexp_replace(href, '#.*$', '') WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) || regexp_replace(href, '#.*$', '') END AS u FROM l),
s AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS u FROM pages)"""


@query(_VISITED + """ SELECT u AS node, min(d) AS depth FROM (SELECT u, 0 AS d FROM s UNION ALL SELECT u, 1 FROM t WHERE u IS NOT NULL) GROUP BY u""")
def crawl_links(spark, d):
    """A crawl of one level over the pages' own links."""
    p = src.read(spark, d)
    plain = F.regexp_replace("url", "#.*$", "")
    edges = src.links(p).filter("to_url is not null").join(p.select(C("page_id").alias("from_page_id"), plain.alias("src")), "from_page_id").select("src", C("to_url").alias("dst"))
    return crawl.bfs(p.select(plain.alias("node")), edges, 1)


@query(_VISITED + """ SELECT count(u) AS links, count(u) - count(DISTINCT u) FILTER (u NOT IN (SELECT u FROM s)) AS skipped FROM t""")
def crawl_skipped(spark, d):
    """Links met, and those that lead to a page that is known already: a start or the target of an earlier link."""
    p = src.read(spark, d)
    return crawl.skipped(src.links(p).select(C("to_url").alias("node")), p.select(F.regexp_replace("url", "#.*$", "").alias("node")))
