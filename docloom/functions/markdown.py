"""Markdown clean-up and facts as column expressions.

Lines and code fences are handled inside one row's arrays, so no pass shuffles and none is quadratic:
a text is split at its fence lines, and the parts between them are outside and inside code in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

_FENCE = r"(?m)^[ \t]*```[^\n]*"
# Elements whose tags are dropped outside code.
DROPPED = ("div", "span", "section", "article", "aside", "header", "footer", "figure", "figcaption", "details", "summary")
TRUNCATED = "\n\n[... content truncated for LLM context window ...]"
LIMITS = {"summary": 12000, "description": 8000, "context": 4000}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once for each row, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(md: Column) -> Column:
    """Lines without their ends; a final line end makes no line."""
    return F.split(F.regexp_replace(F.regexp_replace(md, "\r\n", "\n"), r"\n\z", ""), "\n", -1)


def normalize_headings(md: Column) -> Column:
    """All first-level headings but the first go down one level, in code as well."""
    first = lambda rows: F.array_position(F.transform(rows, lambda x: x.rlike(r"^#\s+.+$")), True) - 1
    lower = lambda rows, at: F.transform(rows, lambda x, i: F.when((i > at) & x.rlike(r"^#\s+.+$"), F.regexp_replace(x, r"^#\s+(.+)$", "## $1")).otherwise(x))
    return let(lines(md), lambda rows: let(first(rows), lambda at: F.array_join(lower(rows, at), "\n")))


def clean_blank_lines(md: Column) -> Column:
    return F.regexp_replace(md, r"\n{4,}", "\n\n\n")


def fence_languages(md: Column) -> Column:
    return F.regexp_replace(md, r"(?m)^```(?:language-|lang-|highlight-)([\p{L}\p{N}_]+)", "```$1")


def strip_tags(md: Column) -> Column:
    """Tags of layout elements go outside code; a fence is any line that starts with three backticks after blanks."""
    tag = rf"</?(?:{'|'.join(DROPPED)})(?:\s[^>\n]*)?>"
    parts = lambda x: F.transform(F.split(x, _FENCE, -1), lambda s, i: F.when(i % 2 == 0, F.regexp_replace(s, tag, "")).otherwise(s))
    fences = lambda x: F.concat(F.regexp_extract_all(x, F.lit(_FENCE), F.lit(0)), F.array(F.lit("")))
    return let(F.array_join(lines(md), "\n"), lambda x: F.array_join(F.zip_with(parts(x), fences(x), lambda a, b: F.concat(a, b)), ""))


def resolve_links(md: Column, base: Column) -> Column:
    """Root-relative link targets become absolute; images, anchors, mail and absolute links stay.

    Targets that are relative to the page's own folder are joined with it; dots in them stay.
    """
    origin = F.regexp_extract(base, r"^([a-z]+://[^/?#]+)", 1)
    folder = F.concat(origin, F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^[a-z]+://[^/]+(/(?:.*/)?)?", 1))
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    x = F.regexp_replace(md, F.lit(r"(?<!!)\[([^\]]*)\]\((/[^)/][^)]*|/)\)"), F.concat(F.lit("[$1]("), origin, F.lit("$2)")))
    return F.regexp_replace(x, F.lit(r"(?<!!)\[([^\]]*)\]\((?!https?://|#|mailto:|/|[A-Za-z][A-Za-z0-9+.-]*:)([^)]+)\)"), F.concat(F.lit("[$1]("), folder, F.lit("$2)")))


def trim_lines(md: Column) -> Column:
    return F.array_join(F.transform(lines(md), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), "\n")


def final_newline(md: Column) -> Column:
    return F.concat(F.regexp_replace(md, r"\n+$", ""), F.lit("\n"))


def cleanup(md: Column, base: Column | None = None) -> Column:
    """All passes in their order."""
    x = strip_tags(fence_languages(clean_blank_lines(normalize_headings(md))))
    return final_newline(trim_lines(resolve_links(x, base) if base is not None else x))


def title(md: Column, given: Column | None = None) -> Column:
    found = F.regexp_replace(F.regexp_extract(md, r"(?m)^#[ \t]+(.+)$", 1), r"^\s+|\s+$", "")
    own = F.when(found != "", found).otherwise("Untitled")
    return F.coalesce(given, own) if given is not None else own


def word_count(md: Column) -> Column:
    """Words outside fenced blocks; a hash with at most one more byte is no word."""
    prose = F.regexp_replace(md, r"(?s)```.*?```", "")
    return F.size(F.filter(F.split(prose, r"(?U)\s+"), lambda w: (w != "") & ~(w.startswith("#") & (F.octet_length(w) <= 2)))).cast("long")


def frontmatter(source_url: Column, title_: Column, fetched_at: Column | None = None) -> Column:
    safe = F.replace(F.replace(title_, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    at = F.concat(F.lit('fetched_at: "'), fetched_at, F.lit('"\n')) if fetched_at is not None else F.lit("")
    return F.concat(F.lit('---\nsource_url: "'), source_url, F.lit('"\ntitle: "'), safe, F.lit('"\n'), F.coalesce(at, F.lit("")), F.lit("---\n"))


def truncate(text: Column, most: int) -> Column:
    """Texts of more than ``most`` bytes are cut to as many, or up to three fewer where a character would be split, and get a marker."""
    data = F.encode(text, "UTF-8")
    starts = lambda n: ~F.hex(F.substring(data, n + 1, 1)).between("80", "BF")  # a character begins behind n bytes
    size = F.lit(max(most - 3, 0))
    for n in range(max(most - 2, 0), most + 1):
        size = F.when(starts(n), n).otherwise(size)
    cut = F.decode(F.substring(data, F.lit(1), size), "UTF-8")
    return F.when(F.octet_length(text) > most, F.concat(cut, F.lit(TRUNCATED))).otherwise(text)
