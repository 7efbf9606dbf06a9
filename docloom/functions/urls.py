"""URL and path functions as column expressions: all of them stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_PARTS = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host and any port that is not the scheme's own, in lower case, without user data."""
    a = F.lower(F.regexp_replace(F.regexp_extract(url, _PARTS, 1), r"^.*@", ""))
    own = F.when(scheme(url) == "http", F.regexp_replace(a, ":80$", "")).when(scheme(url) == "https", F.regexp_replace(a, ":443$", ""))
    return F.coalesce(own, a)


def host(url: Column) -> Column:
    """Host of an absolute URL, null if there is none; IPv6 hosts keep their brackets."""
    h = F.regexp_replace(authority(url), r":\d*$", "")
    return F.when(h != "", h)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def raw_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def requested_url(url: Column) -> Column:
    """What a server is asked for: without fragment; a trailing slash stays."""
    rest = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    rest = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.concat(origin(url), rest)


def normalize_url(url: Column) -> Column:
    """Without fragment, and without one trailing slash unless that is the whole path."""
    full = requested_url(url)
    slashes = F.length(full) - F.length(F.replace(full, F.lit("/")))
    return F.when(full.endswith("/") & (slashes > 3), F.left(full, F.length(full) - 1)).otherwise(full)


def strip_suffixes(path: Column) -> Column:
    p = F.regexp_replace(path, r"^/+", "")
    for ending in ("/", r"\.html", r"\.htm", r"\.md"):
        p = F.regexp_replace(p, rf"(?:{ending})+$", "")
    return F.when(p == "", "index").otherwise(p)


def url_to_path(url: Column) -> Column:
    """Path of a page: slashes at both ends, then .html, .htm and .md at the end are dropped; ``index`` if nothing is left."""
    return strip_suffixes(raw_path(url))


def parent_path(path: Column) -> Column:
    """All but the last segment; null for a single one."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1))


def title_from_path(path: Column) -> Column:
    """Words of the last segment with capital first letters; the rest of each word stays as it is."""
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    words = F.filter(F.split(last, r"[-_\s]+"), lambda w: w != "")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), " ")
    return F.when(last == "index", "Overview").otherwise(title)


def slugify_path(path: Column) -> Column:
    p = F.lower(strip_suffixes(path))
    return F.regexp_replace(F.translate(p, " _", "--"), r"[^\p{L}\p{N}/-]", "")


def slugify(title: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}]+", "-"), r"^-+|-+$", "")


def title_anchor(title: Column) -> Column:
    """Letters and digits stay, blanks and hyphens become hyphens, all else an underscore; nothing is collapsed."""
    return F.regexp_replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), r"[^\p{L}\p{N}-]", "_")


def normalize_doc_path(path: Column) -> Column:
    p = F.regexp_replace(path, r"^/+", "")
    p = F.regexp_replace(p, r"^(?:docs/)+", "")
    return F.regexp_replace(F.regexp_replace(p, r"(?:\.html)+$", ""), r"/+$", "")


def kb_name(url: Column) -> Column:
    return F.coalesce(host(url), F.lit("unknown"))


def glob_regex(glob: str) -> str:
    """``**`` is anything, ``*`` anything but a slash, ``?`` one character; the whole path must match."""
    out = re.escape(glob).replace(r"\*\*", ".*").replace(r"\*", "[^/]*").replace(r"\?", ".")
    return f"^{out}$"


def private_ip(name: Column) -> Column:
    """Whether a host is a literal address of a loopback, private, link-local, shared or reserved range; names are not."""
    v4 = name.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])$")
    part = lambda i: F.get(F.split(name, r"\."), F.lit(i)).try_cast("int")
    a, b, c = part(0), part(1), part(2)
    inside = (
        a.isin(10, 127) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        | ((a == 100) & b.between(64, 127)) | ((a == 192) & (b == 0) & (c == 0)) | name.isin("0.0.0.0", "255.255.255.255")
    )
    return F.coalesce(F.when(v4, inside).otherwise(name.isin("::1", "::")), F.lit(False))


def guarded(url: Column) -> Column:
    """Whether a URL must not be fetched: not http(s), or its host is local, internal or private."""
    h = host(url)
    bad = private_ip(h) | h.isin("localhost", "127.0.0.1", "[::1]") | h.endswith(".local") | h.endswith(".internal")
    return F.coalesce(~scheme(url).isin("http", "https") | bad, F.lit(True))


def in_scope(url: Column, start_host: Column | str, includes: list[str] = (), excludes: list[str] = ()) -> Column:
    """http(s), the start's host, no exclude matches the path, and an include does if there are any."""
    p = raw_path(url)
    p = F.when(p == "", "/").otherwise(p)
    ok = scheme(url).isin("http", "https") & (host(url) == start_host)
    for g in excludes:
        ok = ok & ~p.rlike(glob_regex(g))
    if includes:
        some = F.lit(False)
        for g in includes:
            some = some | p.rlike(glob_regex(g))
        ok = ok & some
    return F.coalesce(ok, F.lit(False))


def followable(href: Column) -> Column:
    """Links worth resolving: no anchors, scripts or mail addresses."""
    return ~(href.startswith("#") | href.startswith("javascript:") | href.startswith("mailto:"))


def resolve_root_relative(base: Column, href: Column) -> Column:
    """Absolute URL of an absolute or root-relative link, without its fragment; null for other links (see ``resolve_any``)."""
    plain = F.regexp_replace(href, "#.*$", "")
    return F.when(plain.rlike(r"^https?://"), plain).when(plain.startswith("//"), F.concat(scheme(base), F.lit(":"), plain)).when(plain.startswith("/"), F.concat(origin(base), plain))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments."""
    parts = F.split(F.substring(path, 2, 1 << 30), "/")
    last = F.element_at(parts, -1)

    def step(a, x):
        return F.when(x == ".", a).when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.array_append(a, x))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    kept = F.when(last.isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.rlike(r"(?:^|/)\.\.?(?:/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def resolve_any(base: Column, href: Column) -> Column:
    """Absolute URL of any link of a page, without its fragment, by the rules of RFC 3986; null for links of other schemes and empty ones."""
    plain = F.regexp_replace(href, "#.*$", "")
    before = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    own = raw_path(base)
    path, query = F.regexp_extract(plain, r"^([^?]*)", 1), F.regexp_extract(plain, r"(\?.*)$", 1)
    folder = F.regexp_replace(F.when(own == "", "/").otherwise(own), "[^/]*$", "")
    relative = F.concat(before, _without_dots(F.concat(folder, path)), query)
    only_query = F.concat(before, own, query)
    rooted = resolve_root_relative(base, href)
    absolute = plain.rlike("^https?://") | plain.startswith("//")
    rooted = F.when(absolute, rooted).otherwise(F.concat(origin(base), _without_dots(path), query))
    other = plain.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")
    return F.when(absolute | plain.startswith("/"), rooted).when(other | (plain == ""), F.lit(None).cast("string")).when(plain.startswith("?"), only_query).otherwise(relative)
