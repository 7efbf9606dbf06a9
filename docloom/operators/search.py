"""Full-text search over titles and paths, ranked by BM25.

Postings are a table (page_id, col, pos, token); a query is parsed to phrases and a boolean
expression over them. Each phrase is counted by its postings (adjacent tokens meet by an equi join),
counts are gathered in one aggregation by page, and the expression filters that. Statistics cover the
index that is searched: all pages, or those of one knowledge base.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import text

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
COLUMNS = ("title", "path")


class QueryError(ValueError):
    """The query text is no search expression."""


@dataclass
class Phrase:
    tokens: list[str]
    prefix: bool = False
    first: bool = False
    columns: tuple[str, ...] = COLUMNS


@dataclass
class Near:
    phrases: list[Phrase]
    within: int = 10


@dataclass
class Node:
    """and, or, not, or a leaf whose number points into the query's leaves."""

    kind: str
    parts: list = field(default_factory=list)
    leaf: int = -1


_LEX = re.compile(r'\s*(?:("(?:[^"]|"")*")|([^\W]+)|([(){}:*^+,-]))', re.UNICODE)


def _fold(word: str) -> list[str]:
    return re.findall(r"[^\W_]+", word.lower().translate(str.maketrans(text.MARKED, text.PLAIN)))


class Parser:
    """Recursive descent: adjacent phrases bind tighter than NOT, NOT than AND, AND than OR."""

    def __init__(self, query: str) -> None:
        self.items: list[str] = []
        at = 0
        query = query.rstrip()
        while at < len(query):
            m = _LEX.match(query, at)
            if not m or m.end() == at:
                raise QueryError(f"unexpected character in query: {query[at:].strip()[:1]!r}")
            self.items.append(m.group(m.lastindex))
            at = m.end()
        self.at = 0
        self.leaves: list[Phrase | Near] = []

    def peek(self, k: int = 0) -> str | None:
        return self.items[self.at + k] if self.at + k < len(self.items) else None

    def take(self, want: str | None = None) -> str:
        x = self.peek()
        if x is None or (want is not None and x != want):
            raise QueryError(f"expected {want or 'a term'}, found {x or 'the end'}")
        self.at += 1
        return x

    def parse(self) -> Node:
        if not self.items:
            raise QueryError("the query is empty")
        node = self.either()
        if self.peek() is not None:
            raise QueryError(f"unexpected {self.peek()!r}")
        return node

    def _chain(self, word: str, kind: str, below) -> Node:
        parts = [below()]
        while self.peek() == word:
            self.take()
            parts.append(below())
        return parts[0] if len(parts) == 1 else Node(kind, parts)

    def either(self) -> Node:
        return self._chain("OR", "or", self.both)

    def both(self) -> Node:
        return self._chain("AND", "and", self.without)

    def without(self) -> Node:
        node = self.run()
        while self.peek() == "NOT":
            self.take()
            node = Node("not", [node, self.run()])
        return node

    def run(self) -> Node:
        parts = [self.term(COLUMNS)]
        while (x := self.peek()) is not None and x not in ("AND", "OR", "NOT", ")"):
            parts.append(self.term(COLUMNS))
        return parts[0] if len(parts) == 1 else Node("and", parts)

    def _columns(self) -> tuple[str, ...] | None:
        start, drop = self.at, self.peek() == "-"
        if drop:
            self.at += 1
        if self.peek() == "{":
            self.take()
            names = []
            while self.peek() not in ("}", None):
                names.append(self.take().strip('"'))
            self.take("}")
        elif self.peek() is not None and re.fullmatch(r"\w+|\".*\"", self.peek()) and self.peek(1) == ":":
            names = [self.take().strip('"')]
        else:
            self.at = start
            return None
        self.take(":")
        if unknown := set(names) - set(COLUMNS):
            raise QueryError(f"no such column: {sorted(unknown)[0]}")
        return tuple(c for c in COLUMNS if (c in names) != drop)

    def term(self, columns: tuple[str, ...]) -> Node:
        if (own := self._columns()) is not None:
            return self.term(tuple(c for c in columns if c in own))
        if self.peek() == "(":
            self.take()
            first = len(self.leaves)
            node = self.either()
            self.take(")")
            for leaf in self.leaves[first:]:
                for p in leaf.phrases if isinstance(leaf, Near) else [leaf]:
                    p.columns = tuple(c for c in p.columns if c in columns)
            return node
        if self.peek() == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases, within = [], 10
            while self.peek() not in (")", ",", None):
                phrases.append(self.phrase(columns))
            if self.peek() == ",":
                self.take()
                n = self.take()
                if not n.isdigit():
                    raise QueryError("NEAR wants a number")
                within = int(n)
            self.take(")")
            return self._leaf(Near(phrases, within) if len(phrases) > 1 else phrases[0])
        return self._leaf(self.phrase(columns))

    def _leaf(self, leaf: Phrase | Near) -> Node:
        self.leaves.append(leaf)
        return Node("leaf", leaf=len(self.leaves) - 1)

    def phrase(self, columns: tuple[str, ...]) -> Phrase:
        first = self.peek() == "^"
        if first:
            self.take()
        words: list[str] = []
        while True:
            x = self.take()
            if not (x[0] == '"' or re.fullmatch(r"\w+", x)) or x in ("AND", "OR", "NOT"):
                raise QueryError(f"unexpected {x!r}")
            words += _fold(x[1:-1].replace('""', '"') if x[0] == '"' else x)
            if self.peek() != "+":
                break
            self.take()
        prefix = self.peek() == "*"
        if prefix:
            self.take()
        return Phrase(words, prefix, first, columns)


def parse(query: str) -> tuple[Node, list[Phrase | Near]]:
    p = Parser(query)
    return p.parse(), p.leaves


def _length() -> Column:
    return sum((F.size(text.tokens(F.col(c))) for c in COLUMNS[1:]), F.size(text.tokens(F.col(COLUMNS[0]))))


def postings(pages: DataFrame) -> DataFrame:
    """page_id, col, pos, token and len (tokens of the page) of titles and paths, and kb_id where pages have it: ids are unique in a knowledge base only."""
    col = lambda c: F.struct(F.lit(c).alias("col"), text.tokens(F.col(c)).alias("tokens"))
    own = [c for c in ("kb_id", "page_id") if c in pages.columns]
    p = pages.select(*own, F.array(*[col(c) for c in COLUMNS]).alias("cs"))
    n = F.aggregate("cs", F.lit(0), lambda a, c: a + F.size(c["tokens"]))
    p = p.select(*own, n.alias("len"), F.explode("cs").alias("c"))
    return p.select(*own, "len", F.col("c.col").alias("col"), F.posexplode("c.tokens").alias("pos", "token"))


def statistics(pages: DataFrame) -> DataFrame:
    """kb_id, n (pages, those without any token too) and total (tokens of all) of each knowledge base."""
    return pages.groupBy("kb_id").agg(F.count("*").alias("n"), F.sum(_length().cast("long")).alias("total"))


def _places(index: DataFrame, phrase: Phrase) -> DataFrame:
    """page_id, len, col and pos of each start of a phrase: only postings of its tokens are read."""
    if not phrase.tokens:
        return index.select("page_id", "len", "col", "pos").limit(0)
    here = index.filter(F.col("col").isin(*phrase.columns)) if phrase.columns else index.limit(0)
    last = len(phrase.tokens) - 1
    is_ = lambda k: F.col("token").startswith(phrase.tokens[k]) if phrase.prefix and k == last else F.col("token") == phrase.tokens[k]
    found = here.filter(is_(0)).select("page_id", "len", "col", "pos")
    if phrase.first:
        found = found.filter("pos = 0")
    for k in range(1, last + 1):
        found = found.join(here.filter(is_(k)).select("page_id", "col", (F.col("pos") - k).alias("pos")), ["page_id", "col", "pos"])
    return found


def _counts(index: DataFrame, leaf: Phrase | Near) -> DataFrame:
    """page_id, len and number of hits of a phrase, or of all phrases of a group that stand near enough."""
    if isinstance(leaf, Phrase):
        return _places(index, leaf).groupBy("page_id").agg(F.max("len").alias("len"), F.count("*").alias("f"))
    near = None
    for p in leaf.phrases:
        at = _places(index, p).withColumn("end", F.col("pos") + len(p.tokens))
        if near is None:
            near = at.select("page_id", "len", "col", F.col("pos").alias("lo"), F.col("end").alias("first_end"), F.col("pos").alias("hi"))
        else:
            near = near.join(at.drop("len"), ["page_id", "col"]).filter(F.greatest("hi", "pos") - F.when(F.col("pos") < F.col("lo"), F.col("end")).otherwise(F.col("first_end")) <= leaf.within)
            near = near.select("page_id", "len", "col", F.least("lo", "pos").alias("lo"), F.when(F.col("pos") < F.col("lo"), F.col("end")).otherwise(F.col("first_end")).alias("first_end"), F.greatest("hi", "pos").alias("hi"))
    return near.groupBy("page_id").agg(F.max("len").alias("len"), F.countDistinct("col", "lo", "hi").alias("f"))


def _holds(node: Node) -> Column:
    if node.kind == "leaf":
        return F.col(f"f{node.leaf}") > 0
    a = [_holds(x) for x in node.parts]
    out = a[0]
    for x in a[1:]:
        out = out & x if node.kind == "and" else out | x if node.kind == "or" else out & ~x
    return out


def scores(index: DataFrame, pages: DataFrame, query: str, stats: DataFrame | None = None) -> DataFrame:
    """page_id and score of every page that matches; lower is better, as scores are negative.

    pages: title and path of all indexed pages, those without any token too; read only where ``stats`` (one row: n and total) does not give
    their number and size. Lengths are in the postings, so of the index only those of the words asked for are read.
    """
    node, leaves = parse(query)
    counts = None
    for i, leaf in enumerate(leaves):
        one = _counts(index, leaf).select("page_id", "len", *[(F.col("f") if i == k else F.lit(0).cast("long")).alias(f"f{k}") for k in range(len(leaves))])
        counts = one if counts is None else counts.unionByName(one)
    hits = counts.groupBy("page_id").agg(F.max("len").alias("len"), *[F.sum(f"f{k}").alias(f"f{k}") for k in range(len(leaves))])
    if stats is None:
        stats = pages.agg(F.count("*").alias("n"), F.sum(_length().cast("long")).alias("total"))
    whole = stats.select("n", (F.col("total") / F.col("n")).alias("mean"))
    found = hits.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"df{k}") for k in range(len(leaves))])
    d = hits.filter(_holds(node)).crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(found))  # one row of statistics each
    total = F.lit(0.0)
    for k in range(len(leaves)):
        idf = F.log((F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        f = F.col(f"f{k}").cast("double")
        total = total + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return d.select("page_id", (-total).alias("score"))


def search(pages: DataFrame, query: str, limit: int = 10, kb_id: str | None = None, index: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """page_id, kb_id, path, title and score of the best pages; ties go to the smaller page_id. The limit is held within 1 and 50.

    With ``kb_id``, only its pages are the index, for statistics too. ``index`` holds the postings of the pages and ``stats`` their number and size
    (n and total), if they are stored.
    """
    if kb_id is not None:
        pages = pages.filter(F.col("kb_id") == kb_id)
        index = index.join(pages.select("page_id"), "page_id", "left_semi") if index is not None else None
    idx = index if index is not None else postings(pages)
    out = scores(idx, pages, query, stats).join(pages.select("page_id", "kb_id", "path", "title"), "page_id")
    return out.select("page_id", "kb_id", "path", "title", F.round("score", 6).alias("score")).orderBy("score", "page_id").limit(min(max(limit, 1), 50))
