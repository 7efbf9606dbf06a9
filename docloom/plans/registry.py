"""Registration of queries with their SQL, and SQL fragments that several of them share."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with DuckDB SQL for the same rows."""

    def keep(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return keep


def host(u: str) -> str:
    a = f"regexp_replace(lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', '')"
    return f"nullif(regexp_replace({a}, ':[0-9]*$', ''), '')"


def raw_path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def strip(p: str) -> str:
    x = f"regexp_replace({p}, '^/+', '')"
    for e in ("/", r"\.html", r"\.htm", r"\.md"):
        x = f"regexp_replace({x}, '(?:{e})+$', '')"
    return f"coalesce(nullif({x}, ''), 'index')"


def path(u: str) -> str:
    return strip(raw_path(u))


def title_from(p: str) -> str:
    last = f"regexp_extract({p}, '([^/]*)$', 1)"
    words = rf"list_filter(regexp_split_to_array({last}, '[-_\s]+'), lambda w: w <> '')"
    return f"CASE WHEN {last} = 'index' THEN 'Overview' ELSE array_to_string(list_transform({words}, lambda w: upper(left(w, 1)) || substr(w, 2)), ' ') END"


def parent(p: str) -> str:
    return f"CASE WHEN contains({p}, '/') THEN regexp_extract({p}, '^(.*)/[^/]*$', 1) END"


def h1(x: str) -> str:
    pattern = r"(?s)<h1(?:\s[^>]*)?>(.*?)</h1>"
    t = f"regexp_replace(regexp_extract({x}, '{pattern}', 1), '<[^>]*>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        t = f"replace({t}, '{a}', '{b}')"
    return rf"CASE WHEN regexp_matches({x}, '{pattern}') THEN regexp_replace({t}, '^\s+|\s+$', '', 'g') END"


#: The page table as a common table expression.
PM = f"""pm AS (SELECT page_id, coalesce({host('url')}, 'unknown') AS kb_id, url, {path('url')} AS path, {h1('html')} AS title,
  sha256(coalesce(html, '')) AS content_hash, CAST(strlen(coalesce(html, '')) AS BIGINT) AS content_len, 200 AS status_code FROM pages)"""

#: A previous snapshot: every fifth page is absent, every third has another hash, and every seventh path has gone since.
OLD = """old AS (SELECT kb_id, CASE WHEN page_id % 7 = 3 THEN path || '/gone' ELSE path END AS path, url, title,
  CASE WHEN page_id % 3 = 0 THEN sha256(content_hash) ELSE content_hash END AS content_hash, 'old-' || page_id AS id FROM pm WHERE page_id % 5 <> 0)"""
