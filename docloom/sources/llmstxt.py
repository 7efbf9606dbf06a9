"""llms.txt files: validation and parsing, line by line inside each file's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import urls
from docloom.functions.markdown import lines

MOST_BYTES = 10 << 20
LINK = r"^[-*]\s+\[([^\]]+)\]\(([^)]+)\)(?::\s*(.+))?$"


def valid(body: Column) -> Column:
    """Whether a fetched body is an llms.txt: a first-level heading comes first, and it is not too large."""
    return F.coalesce(F.regexp_replace(body, r"^\s+", "").startswith("# ") & (F.octet_length(body) <= MOST_BYTES), F.lit(False))


def discover(starts: DataFrame, files: DataFrame) -> DataFrame:
    """url, origin, found, body and full of each start (url), from files (url, body) that were fetched.

    A start is found if the llms.txt of its origin is valid; full is the llms-full.txt beside it, if any.
    """
    s = starts.select("url", urls.origin(F.col("url")).alias("origin"))
    at = lambda name: F.regexp_extract("url", rf"^(.*)/{name}$", 1)
    first = files.filter(F.col("url").endswith("/llms.txt") & valid(F.col("body"))).groupBy(at(r"llms\.txt").alias("origin")).agg(F.min("body").alias("body"))
    full = files.filter(F.col("url").endswith("/llms-full.txt")).groupBy(at(r"llms-full\.txt").alias("origin")).agg(F.min("body").alias("full"))
    got = s.join(first, "origin", "left").join(full, "origin", "left")
    return got.select("url", "origin", F.col("body").isNotNull().alias("found"), "body", F.when(F.col("body").isNotNull(), F.col("full")).alias("full"))


def _trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def parse(files: DataFrame, id_col: str = "id", body_col: str = "body") -> DataFrame:
    """id, ok, title, summary and rows of each file; the rows after the head are (pos, line), trimmed and not blank.

    A file whose first line with text is no first-level heading is not ok and has no rows. Leading
    quote lines after the heading are the summary, joined by blanks; null if there are none.
    """
    rows = F.filter(F.transform(lines(F.col(body_col)), _trimmed), lambda x: x != "")
    f = files.select(F.col(id_col).alias("id"), F.coalesce(rows, F.array().cast("array<string>")).alias("rows"))
    f = f.withColumn("ok", F.coalesce(F.get("rows", F.lit(0)).rlike(r"^#\s+.+$"), F.lit(False)))
    f = f.withColumn("rest", F.slice("rows", F.lit(2), F.greatest(F.size("rows"), F.lit(1))))
    f = f.withColumn("quotes", F.array_position(F.transform("rest", lambda x: ~x.rlike(r"^>\s*.+$")), True))
    n = F.when(F.col("quotes") > 0, F.col("quotes") - 1).otherwise(F.size("rest"))
    quotes = F.transform(F.slice("rest", F.lit(1), n.cast("int")), lambda x: _trimmed(F.regexp_extract(x, r"^>\s*(.+)$", 1)))
    body = F.transform(F.slice("rest", (n + 1).cast("int"), F.greatest(F.size("rest"), F.lit(1))), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    return f.select(
        "id", "ok", F.when(F.col("ok"), _trimmed(F.regexp_extract(F.col("rows")[0], r"^#\s+(.+)$", 1))).alias("title"),
        F.when(F.col("ok") & (n > 0), F.array_join(quotes, " ")).alias("summary"), F.when(F.col("ok"), body).otherwise(F.array().cast("array<struct<pos:int,line:string>>")).alias("rows"),
    )


def entries(parsed: DataFrame) -> DataFrame:
    """id, pos, section (null before the first one), name, url and notes of every link line."""
    head = lambda x: x["line"].rlike(r"^##\s+.+$")
    where = F.filter("rows", head)
    p = parsed.select("id", where.alias("heads"), F.explode(F.filter("rows", lambda x: x["line"].rlike(LINK))).alias("r"))
    above = F.filter("heads", lambda h: h["pos"] < F.col("r.pos"))
    section = _trimmed(F.regexp_extract(F.get(above, F.size(above) - 1)["line"], r"^##\s+(.+)$", 1))
    part = lambda k: _trimmed(F.regexp_extract("r.line", LINK, k))
    return p.select("id", F.col("r.pos").cast("long").alias("pos"), section.alias("section"), part(1).alias("name"), part(2).alias("url"), F.when(part(3) != "", part(3)).alias("notes"))


def sections(parsed: DataFrame) -> DataFrame:
    """id, section number (from 1), title and number of links of every section, empty ones too."""
    marks = F.filter("rows", lambda x: x["line"].rlike(r"^##\s+.+$"))
    p = parsed.select("id", "rows", marks.alias("marks")).select("id", "rows", "marks", F.posexplode("marks").alias("k", "m"))
    until = F.coalesce(F.get("marks", F.col("k") + 1)["pos"], F.lit(1 << 30))
    n = F.size(F.filter("rows", lambda x: (x["pos"] > F.col("m.pos")) & (x["pos"] < until) & x["line"].rlike(LINK)))
    return p.select("id", (F.col("k") + 1).cast("long").alias("number"), _trimmed(F.regexp_extract("m.line", r"^##\s+(.+)$", 1)).alias("title"), n.cast("long").alias("n_entries"))
