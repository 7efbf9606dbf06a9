"""Main text of pages by site template removal.

Every page is parsed once to blocks of text and to the element subtrees that hold them. A subtree has two hashes: one of
all it holds, and a frame: its place, tags and classes without its text, for menus and adverts whose words change from
page to page. Spark counts the hashes on each host, and how much text every place of the host holds. Subtrees that recur on
many pages of their host go. The places that hold most of the host's text, and elements that say that they are the article, are
what a template surrounds: nothing in them goes by its count but repeated lists of links and, outside articles, repeated small containers. Elements that name themselves chrome
(menus, forms, reader comments and the like) go on every host, as a host of few pages has no counts.

Hashes of 64 bits are taken for equal content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import urls
from docloom.functions.dom import BARRIERS, BLOCKS, ENDS
from docloom.functions.events import START, TEXT, OpenTags, attributes, events

from .common import cut, freed, table, tune

#: A subtree is of the template if it is on so many pages of the host, on so large a share of them, and beside so many different texts.
LEAST, SHARE = 3, 0.3
#: A place is the main one of the place around it if it holds so large a share of its text on the whole host.
MOST = 0.5
#: Template hashes of all hosts that travel to every task at most (8 bytes each); beyond it, pages and hosts meet by a salted shuffle.
SENT, SALTS = 1 << 20, 32

# Elements that end a block of text, those that can hold others, and those whose text is never shown as text.
BLOCK = frozenset(BLOCKS | {"body", "caption", "center", "dd", "details", "dir", "dt", "fieldset", "figcaption", "figure", "hgroup", "html", "legend", "li", "menu", "optgroup", "option", "search", "summary", "tbody", "td", "tfoot", "th", "thead", "tr", "dialog"})
CONTAINER = frozenset({"address", "article", "aside", "body", "center", "details", "dialog", "div", "fieldset", "figure", "footer", "form", "header", "html", "main", "menu", "nav", "search", "section", "table", "tbody", "td", "tr", "ul", "ol"})
HIDDEN = frozenset({"script", "style", "iframe", "xmp", "noembed", "noframes", "title", "textarea"})
DROPPED = frozenset({"noscript", "template", "svg", "select", "button", "object", "canvas", "audio", "video", "datalist"})
# Tags, roles and words of classes and ids by which an element names itself chrome, and words that make a class speak of what is around.
CHROME_TAGS = frozenset({"nav", "aside", "footer", "dialog", "menu", "search"})
CHROME_ROLES = frozenset({"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "menu", "menubar", "toolbar", "form"})
CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter subscribe share sharing social related comment comments commentlist disqus respond pagination pager".split()
)
AROUND_WORDS = frozenset("banner notice notices masthead footer header popup modal overlay toolbar widget search login signup topbar".split())
WRAPPER_WORDS = frozenset("with has no without content main page wrapper wrap container layout body site app root open".split())
PLAIN_TAGS = frozenset({"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "dl", "dt", "dd", "html", "body", "figcaption", "caption"})

_P, TABLE_PARTS = frozenset({"p"}), frozenset({"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"})

#: Of an element: it is an article, is chrome by name (strongly or weakly), holds an article, has more text in links than outside, can hold others.
_ZONE, _STRONG, _WEAK, _HOLDER, _LINKS, _CONTAINER = 1, 2, 4, 8, 16, 32
_COLUMNS = ("exact", "frame", "slot", "parent", "first", "last", "flags", "chars")
_SIGNED = 1 << 63
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_DIGITS = re.compile(r"\d+")


def _hash(x: str) -> int:
    """64 bits, as Spark's long; never zero, which stands for no hash."""
    h = xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"))
    return (h - (_SIGNED << 1) if h >= _SIGNED else h) or 1


def _chrome(tag: str, a: dict[str, str], inside: bool) -> int:
    """How an element names itself chrome: not, weakly (unless it holds the main text), or strongly. ``inside``: it lies in an article."""
    if tag in ("html", "body"):
        return 0
    if tag in CHROME_TAGS:
        return _STRONG
    if tag == "form" or tag == "header" and not inside:
        return _WEAK
    if not a:
        return 0
    if a.get("role", "").lower() in CHROME_ROLES:
        return _STRONG
    out = 0
    if tag not in PLAIN_TAGS or tag in ("p", "table", "li", "h2", "h3", "h4"):
        for name in [*a.get("class", "").split(), a.get("id", "")]:
            words = {w.lower() for w in _WORD.findall(name)}
            if words & CHROME_WORDS or not inside and words & AROUND_WORDS:
                if words & WRAPPER_WORDS:
                    out = out or _WEAK
                else:
                    return _STRONG
    return out


def scan(html: str, roles: bool = True) -> tuple[list[str], np.ndarray]:
    """Blocks of text of a page, and its elements that hold any: a row each of ``_COLUMNS``, in document order.

    ``first`` and ``last`` bound an element's blocks; ``chars`` counts its text outside links and chrome. Without ``roles`` no
    element is known by its name.
    """
    blocks: list[str] = []
    rows: list[list] = []
    run: list[str] = []
    tags = OpenTags(frozenset(BARRIERS | {"td", "th", "caption"}))
    # Of each open element: row (-1: not one), what it holds, frames of its children, slot, text outside links, text in links, is it dropped.
    path: list[list] = [[-1, [], [], 0, 0, 0, False]]
    dropped = linked = 0  # open dropped elements; depth at which a link is open
    zones = chromes = 0  # open articles; open chrome
    state: list[tuple[int, int]] = []

    def flush() -> None:
        if run:
            x = " ".join("".join(run).split())
            run.clear()
            if x:
                blocks.append(x)
                top = path[-1] if not path[-1][6] else next(e for e in reversed(path) if not e[6])
                top[1].append(x)

    def shut(depth: int) -> None:
        nonlocal dropped, linked, zones, chromes
        while len(tags.tags) > depth:
            tag = tags.tags[-1]
            tags.cut(len(tags.tags) - 1)
            row, holds, frames, _, plain, links, drop = path.pop()
            if drop:
                dropped -= 1
                continue
            zones, chromes = state.pop()
            r = rows[row]
            r[5] = len(blocks)
            # The frame's place and the classes are in the slot; the exact hash has the tag and the classes.
            r[0] = _hash(f"{r[8]}\0" + "\0".join(holds))
            r[1] = _hash(f"{r[2]}\0" + "\0".join(map(str, frames))) if tag in CONTAINER else 0
            r[7] = plain
            if links > plain:
                r[6] |= _LINKS
            up = path[-1]
            up[1].append(f"<{r[0]}>")
            mine = _hash(f"{r[8]}\0" + "\0".join(map(str, frames)))
            if not up[2] or up[2][-1] != mine:
                up[2].append(mine)
            if not r[6] & (_STRONG | _WEAK):
                up[4] += plain
            up[5] += links
        if linked > len(path):
            linked = 0

    skip = None
    for kind, tag, x in events(html):
        if skip is not None:
            if kind == TEXT:
                continue
            skip = None
        if kind == TEXT:
            if not dropped:
                run.append(x)
                n = len(x.strip())
                path[-1][5 if linked else 4] += n
        elif kind == START:
            if tag in HIDDEN:
                skip = tag
            elif tag in DROPPED or dropped and tag in BLOCK and tag != "hr":
                path.append([-1, [], [], path[-1][3], 0, 0, True])
                tags.push(tag)
                dropped += 1
            elif tag in BLOCK:
                if tag in ("html", "body") and tags.last(tag) >= 0 or dropped:
                    continue
                flush()
                if tag in BLOCKS:
                    d = tags.near(_P)
                    if d >= 0:
                        shut(d)
                for _ in ENDS.get(tag, ()):
                    d = tags.near(ENDS[tag])
                    if d >= 0:
                        shut(d)
                if tag == "hr":
                    continue
                a = attributes(x) if "=" in x else {}
                kinds = _DIGITS.sub("#", f"{tag}.{' '.join(sorted(a.get('class', '').split()))}#{a.get('id', '')}") if a else tag
                slot = _hash(f"{path[-1][3]}>{kinds}")
                flags = _chrome(tag, a, zones > 0) if roles else 0
                state.append((zones, chromes))
                if tag in ("article", "main") or a.get("role", "").lower() == "main":
                    if not chromes and not flags & _STRONG and roles:
                        flags |= _ZONE
                        zones += 1
                        for r in (e[0] for e in path):
                            if r >= 0:
                                rows[r][6] |= _HOLDER
                if flags & _STRONG:
                    chromes += 1
                if tag in CONTAINER:
                    flags |= _CONTAINER
                parent = next((e[0] for e in reversed(path) if not e[6]), -1)
                rows.append([0, 0, slot, parent, len(blocks), 0, flags, 0, kinds])
                path.append([len(rows) - 1, [], [], slot, 0, 0, False])
                tags.push(tag)
            elif tag == "br":
                run.append(" ")
            elif tag == "a" and not linked:
                linked = len(path)
        elif tag in BLOCK or tag in DROPPED:
            d = tags.last(tag)
            if tag in ("html", "body"):
                continue
            if tag in BLOCK and (d < 0 or not path[d + 1][6]):
                flush()
            if d >= 0 and (tag in TABLE_PARTS or d > max(map(tags.last, ("td", "th", "caption")))):
                shut(d)
        elif tag == "a":
            linked = 0
    flush()
    shut(0)
    out = np.array([r[:8] for r in rows if r[5] > r[4]] or np.zeros((0, 8)), np.int64).reshape(-1, 8)
    if len(out) < len(rows):  # parents by their new places; an empty element holds no others that are not
        place = {k: n for n, k in enumerate(k for k, r in enumerate(rows) if r[5] > r[4])}
        out[:, 3] = [place.get(int(p), -1) for p in out[:, 3]]
    return blocks, out


_ROOT = _hash("slot 0")


def _in_zone(e: np.ndarray) -> np.ndarray:
    """Which elements lie in an article (not the article itself)."""
    out = np.zeros(len(e), bool)
    for k, p in enumerate(e[:, 3].tolist()):
        out[k] = p >= 0 and (out[p] or e[p, 6] & _ZONE)
    return out


def _text(e: np.ndarray) -> int:
    """Characters of a page outside links and chrome."""
    return int(e[(e[:, 3] < 0) & (e[:, 6] & (_STRONG | _WEAK) == 0), 7].sum())


def _counted(e: np.ndarray) -> list[tuple[int, int, int]]:
    """(hash, slot around it or 0, characters or -1) of one page, each hash once: of subtrees to be counted, and of places with their text."""
    inside = _in_zone(e)
    seen: dict[int, tuple[int, int, int]] = {_ROOT: (_ROOT, _hash("slots"), _text(e))} if len(e) else {}
    for k, r in enumerate(e.tolist()):
        if not inside[k] or r[6] & _CONTAINER and r[6] & _LINKS:
            seen.setdefault(r[0], (r[0], 0, -1))
        if r[6] & _CONTAINER and not inside[k]:
            seen.setdefault(r[1], (r[1], 0, -1))
            if not r[6] & (_STRONG | _WEAK):
                around = int(e[r[3], 2]) if r[3] >= 0 else 0
                at = _hash(f"slot {r[2]}")
                seen[at] = (at, _hash(f"slot {around}"), seen.get(at, (0, 0, 0))[2] + r[7])
    return list(seen.values())


def kept_blocks(blocks: list[str], e: np.ndarray, template: frozenset[int], mains: frozenset[int]) -> list[str]:
    """The blocks that are left of a page when template and chrome are gone."""
    n = len(e)
    if not n:
        return blocks
    flags = e[:, 6].tolist()
    parent, slots = e[:, 3].tolist(), e[:, 2].tolist()
    total = _text(e)
    # The main path from the root: places that hold most of the host's text, as far as they contain one another.
    main = [False] * n
    for k in range(n):
        up = parent[k]
        main[k] = bool(flags[k] & _CONTAINER) and not flags[k] & (_STRONG | _WEAK) and _hash(f"slot {slots[k]}") in mains and (up < 0 or main[up])
    holder = [bool(f & _HOLDER) for f in flags]
    deepest = list(main)
    for k in range(n - 1, -1, -1):
        if parent[k] >= 0 and (main[k] or holder[k] or flags[k] & _ZONE):
            holder[parent[k]] = True
            deepest[parent[k]] = False
    zone = [bool(f & _ZONE) or d for f, d in zip(flags, deepest)]
    inside, article = [False] * n, _in_zone(e).tolist()
    gone = np.zeros(len(blocks) + 1, np.int64)
    exact, frame = e[:, 0].tolist(), e[:, 1].tolist()
    for k in range(n):
        up = parent[k]
        inside[k] = up >= 0 and (inside[up] or zone[up])
        f = flags[k]
        if f & _STRONG:
            away = not f & _HOLDER
        elif f & _WEAK and not holder[k] and not zone[k]:
            away = not f & _CONTAINER or e[k, 7] <= MOST * (total + int(e[k, 7]))
        elif zone[k] or holder[k]:
            away = False
        elif inside[k]:
            # Without an article of its own a page's main place may hold its foot: there what recurs goes, but for headings, paragraphs and the like, and most of the text.
            small = f & _LINKS or not article[k] and e[k, 7] < MOST * total
            away = bool(f & _CONTAINER and small) and exact[k] in template
        else:
            away = exact[k] in template or frame[k] in template
        if away:
            gone[e[k, 4]] += 1
            gone[e[k, 5]] -= 1
    lost = np.cumsum(gone)[: len(blocks)]
    return [x for x, g in zip(blocks, lost.tolist()) if not g]


_PARSED = "page_id long, url string, host long, blocks array<string>, elements binary, counted array<struct<key:long,around:long,chars:long>>, mark long"
_KINDS = pa.list_(pa.struct([("key", pa.int64()), ("around", pa.int64()), ("chars", pa.int64())]))


def parsed(pages: DataFrame, roles: bool = True) -> DataFrame:
    """page_id, url, host (its hash; null for pages without one), blocks, elements, hashes to be counted, and one bit of 64 for the page's own text."""
    name = urls.host(F.col("url"))
    df = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.when(name.isNotNull(), F.xxhash64(name)).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, elements, counted, marks = [], [], [], []
            for x in b.column(3).to_pylist():
                blocks, e = scan(x, roles)
                zone = [r for r in e.tolist() if r[6] & _ZONE]
                own = str(zone[0][0]) if zone else "\n".join(blocks)
                marks.append(1 << (xxhash.xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) % 63))
                texts.append(blocks)
                elements.append(e.tobytes())
                counted.append([{"key": k, "around": a, "chars": c} for k, a, c in _counted(e)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array(texts, pa.list_(pa.string())), pa.array(elements, pa.binary()), pa.array(counted, _KINDS), pa.array(marks, pa.int64())], names=["page_id", "url", "host", "blocks", "elements", "counted", "mark"])

    return df.mapInArrow(freed(run), _PARSED)


def sites(read: DataFrame) -> DataFrame:
    """host, template (hashes of recurring subtrees) and mains (places that hold most of the text around them) of parsed pages.

    Counts of one host and hash come from partial counts, so a host of a third of all pages is dealt over its hashes. A host's
    template has at most 1 / SHARE times as many hashes as its pages have on average.
    """
    one = read.filter("host is not null").select("host", "mark", F.explode("counted").alias("c")).select("host", "mark", "c.key", "c.around", "c.chars")
    each = cut(one.groupBy("host", "key").agg(F.count("*").alias("n"), F.bit_or("mark").alias("texts"), F.max("around").alias("around"), F.sum("chars").alias("chars")).filter(F.col("n") >= F.when(F.col("around") == 0, LEAST).otherwise(1)), "template-counts")
    size = read.filter("host is not null").groupBy("host").agg(F.count("*").alias("pages")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    often = each.filter((F.col("around") == 0) & (F.bit_count("texts") >= LEAST)).withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(size, ["host", "salt"]).filter(F.col("n") >= SHARE * F.col("pages"))
    places = each.filter("around <> 0")
    around = places.select("host", F.col("key").alias("around"), F.col("chars").alias("whole"))
    mains = places.join(around, ["host", "around"]).filter((F.col("chars") >= MOST * F.col("whole")) & (F.col("chars") > 0))
    both = often.select("host", F.col("key").alias("t"), F.lit(None).cast("long").alias("m")).unionByName(mains.select("host", F.lit(None).cast("long").alias("t"), F.col("key").alias("m")))
    return both.groupBy("host").agg(F.collect_list("t").alias("template"), F.collect_list("m").alias("mains"))


def main_text(pages: DataFrame, roles: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    Null and empty html give an empty text. Rows that repeat give rows that repeat; a null id stays null; a page without a host
    loses chrome that names itself only. Pages of any length and depth are read whole. Further columns, whatever their names, are not read. An
    empty table gives no rows.
    """
    tune(pages.sparkSession)
    read = cut(parsed(pages, roles), "template-pages")
    site = cut(sites(read), "template-sites")
    amount = site.agg(F.coalesce(F.sum(F.size("template") + F.size("mains")), F.lit(0))).first()[0]
    rows = read.select("page_id", "url", "host", "blocks", "elements")
    if amount <= SENT:
        met = rows.join(F.broadcast(site), "host", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        met = rows.withColumn("salt", salt).join(site.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            out = []
            host, blocks, elements, template, mains = (b.column(i) for i in range(2, 7))
            for k in range(b.num_rows):
                h = host[k].as_py()
                if last[0] != (h,):
                    last = ((h,), (frozenset(template[k].as_py() or ()), frozenset(mains[k].as_py() or ())))
                out.append("\n\n".join(kept_blocks(blocks[k].as_py(), np.frombuffer(elements[k].as_py(), np.int64).reshape(-1, 8), *last[1])))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    got = met.select("page_id", "url", "host", "blocks", "elements", "template", "mains").mapInArrow(freed(run), "page_id long, url string, text string")
    return got.withColumn("n_chars", F.length("text").cast("long"))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))


#: The given pages have one article each, of headings and paragraphs whose text holds no markup but b and br; its references are these.
_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1) AS x FROM pages),
p AS (SELECT page_id, url, list_transform(regexp_split_to_array(x, '</?(?:p|h[1-6])>'), lambda t: regexp_replace(regexp_replace(regexp_replace(t, '</?(?:b|br)>', ' ', 'g'), '\s+', ' ', 'g'), '^ | $', '', 'g')) AS ts FROM a),
t AS (SELECT page_id, url, array_to_string(list_filter(ts, lambda t: t <> ''), chr(10) || chr(10)) AS x FROM p),
d AS (SELECT page_id, url, replace(replace(replace(replace(replace(x, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&') AS text FROM t)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d
"""

QUERIES = {"op11_main_text": op11_main_text}
ORACLES = {"op11_main_text": _SQL}
