"""A small document tree on the event stream: implied end tags, selectors, text and Markdown. Nothing here recurses, so pages may nest as deep as they like."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

from docloom.functions.events import END, START, OpenTags, attributes, events

# Elements without content, and elements that end an open one of the listed kinds.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
ENDS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th"}
ENDS = {k: frozenset(v.split()) for k, v in ENDS.items()}
BARRIERS = frozenset({"table", "ul", "ol", "dl", "div", "section", "article", "main", "body", "html", "select"})
SKIPPED = {"script", "style", "nav", "iframe", "noscript", "svg"}


@dataclass(eq=False)
class Element:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: Element | None = None

    def walk(self) -> Iterator[Element]:
        todo = [self]
        while todo:
            e = todo.pop()
            yield e
            todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            if isinstance(e, str):
                out.append(e)
            else:
                todo.extend(reversed(e.children))
        return "".join(out)

    def inner(self) -> str:
        """The element's content as HTML."""
        out: list[str] = []
        todo: list = [(c, self.tag) for c in reversed(self.children)]
        while todo:
            x, inside = todo.pop()
            if inside is None:  # an end tag
                out.append(x)
            elif isinstance(x, str):
                out.append(x if inside in ("script", "style") else _html.escape(x, quote=False))
            else:
                out.append(f"<{x.tag}{''.join(f' {k}="{_html.escape(v)}"' for k, v in x.attrs.items())}>")
                if x.tag not in VOID:
                    todo.append((f"</{x.tag}>", None))
                    todo.extend((c, x.tag) for c in reversed(x.children))
        return "".join(out)


_P = frozenset({"p"})


def steps(html: str) -> Iterator[tuple[int, str, str]]:
    """(depth, tag, attributes as written) of every element and (depth, "", text) of every text, in page order.

    The depth is the number of elements that are open around it, so one that is not greater than before ends others.
    """
    tags = OpenTags(BARRIERS)

    def close(depth: int) -> None:
        if depth >= 0:
            tags.cut(depth)

    for kind, tag, x in events(html):
        if kind == START:
            if tag in BLOCKS:
                close(tags.near(_P))
            if tag in ENDS:
                for _ in ENDS[tag]:
                    close(tags.near(ENDS[tag]))
            yield len(tags.tags), tag, x
            if tag not in VOID:
                tags.push(tag)
        elif kind == END:
            close(tags.last(tag))
        else:
            yield len(tags.tags), "", x


def parse(html: str) -> Element:
    """The tree of a page, in one pass."""
    root = Element("#document")
    path = [root]
    for depth, tag, x in steps(html):
        del path[depth + 1 :]
        if tag:
            e = Element(tag, attributes(x) if x else {}, parent=path[-1])
            path[-1].children.append(e)
            path.append(e)
        else:
            path[-1].children.append(x)
    return root


def title(html: str) -> str | None:
    """Text of the first h1, trimmed; null if there is none. Reads no further than the element."""
    inside, out = -1, []
    for depth, tag, x in steps(html):
        if inside < 0:
            inside = depth if tag == "h1" else -1
        elif depth <= inside:
            break
        elif not tag:
            out.append(x)
    return "".join(out).strip() if inside >= 0 else None


_STEP = re.compile(r'([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[^\]]+\])*)')
_TEST = re.compile(r'([.#])([\w-]+)|\[([\w-]+)(?:([*^$]?=)"?([^"\]]*)"?)?\]')


def _matches(e: Element, step: str) -> bool:
    m = _STEP.fullmatch(step)
    if not m:
        raise ValueError(f"unknown selector: {step}")
    if m[1] and e.tag != m[1].lower():
        return False
    for kind, name, attr, op, value in _TEST.findall(m[2]):
        if kind == "." and name not in e.attrs.get("class", "").split():
            return False
        if kind == "#" and e.attrs.get("id") != name:
            return False
        if attr:
            have = e.attrs.get(attr.lower())
            if have is None or (op == "=" and have != value) or (op == "*=" and value not in have) or (op == "^=" and not have.startswith(value)) or (op == "$=" and not have.endswith(value)):
                return False
    return True


def select(root: Element, selector: str) -> list[Element]:
    """Elements in document order that match a list of descendant selectors (tag, .class, #id, [attribute])."""
    paths = [s.split() for s in selector.split(",")]

    def fits(e: Element, steps: list[str]) -> bool:
        if not _matches(e, steps[-1]):
            return False
        k, up = len(steps) - 2, e.parent
        while k >= 0 and up is not None:
            k -= _matches(up, steps[k])
            up = up.parent
        return k < 0

    return [e for e in root.walk() if e.tag[0] != "#" and any(fits(e, p) for p in paths)]


def first(root: Element, selector: str) -> Element | None:
    return next(iter(select(root, selector)), None)


def drop(root: Element, selector: str) -> None:
    """Take the elements that match out of the tree, each parent's in one go."""
    gone = set(map(id, select(root, selector)))
    for e in [root, *root.walk()] if gone else []:
        if any(id(c) in gone for c in e.children):
            e.children = [c for c in e.children if id(c) not in gone]


def _own(root: Element, tags: tuple[str, ...]) -> list[Element]:
    """Elements of the tags below a root, but none inside another of them or inside a table in between."""
    out, todo = [], list(reversed(root.children))
    while todo:
        e = todo.pop()
        if isinstance(e, Element):
            if e.tag in tags:
                out.append(e)
            elif e.tag != "table":
                todo.extend(reversed(e.children))
    return out


def table_rows(table: Element) -> tuple[list[list[str]], bool]:
    """Cells of each row, header cells if the row has any, and whether the first row has header cells. A table inside a cell is text."""
    rows, headed = [], False
    for k, tr in enumerate(_own(table, ("tr",))):
        cells = _own(tr, ("td", "th"))
        heads = [c for c in cells if c.tag == "th"]
        headed |= k == 0 and bool(heads)
        rows.append([" ".join(c.text().split()) for c in heads or cells])
    return rows, headed


def table_markdown(rows: list[list[str]], headed: bool) -> str:
    """A Markdown table; without header cells the first row is header and data both."""
    rows = [r for r in rows if r]
    if not rows:
        return ""
    wide = max(map(len, rows))
    line = lambda r: "| " + " | ".join(r + [""] * (wide - len(r))) + " |"
    body = rows[1:] if headed else rows
    return "\n".join([line(rows[0]), line(["---"] * wide), *map(line, body)])


#: Lists and quotes that lie deeper than this in others are not indented further.
MOST_NESTED = 40


def _run(step: Generator) -> str:
    """The result of a function that yields the calls it would make of itself and gets their results."""
    calls, got = [step], None
    while calls:
        try:
            calls.append(calls[-1].send(got))
            got = None
        except StopIteration as done:
            calls.pop()
            got = done.value
    return got


def markdown(root: Element) -> str:
    """Markdown of an element's content."""
    return _run(_markdown(root, 0))


def _markdown(root: Element, nested: int) -> Generator:
    out = yield _block(root, nested)
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def _inline(children: list, nested: int) -> Generator:
    out = []
    for c in children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag in SKIPPED:
            continue
        elif c.tag in ("b", "strong", "i", "em"):
            mark, x = "**" if c.tag in ("b", "strong") else "*", (yield _inline(c.children, nested)).strip()
            out.append(f"{mark}{x}{mark}" if x else "")
        elif c.tag == "code":
            out.append(f"`{c.text()}`")
        elif c.tag == "a" and c.attrs.get("href"):
            out.append(f"[{(yield _inline(c.children, nested)).strip()}]({c.attrs['href']})")
        elif c.tag == "img":
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs.get('src', '')})")
        elif c.tag == "br":
            out.append("\n")
        elif c.tag in BLOCKS:
            out.append(f"\n\n{(yield _block(c, nested))}\n\n")
        else:
            out.append((yield _inline(c.children, nested)))
    return "".join(out)


def _block(e: Element, nested: int) -> Generator:
    if e.tag in SKIPPED:
        return ""
    if re.fullmatch("h[1-6]", e.tag):
        return f"\n\n{'#' * int(e.tag[1])} {(yield _inline(e.children, nested)).strip()}\n\n"
    if e.tag == "pre":
        code = first(e, "code")
        kind = next((c for c in ((code or e).attrs.get("class", "")).split() if c.startswith(("language-", "lang-", "highlight-"))), "")
        return f"\n\n```{kind}\n{e.text().strip(chr(10))}\n```\n\n"
    if e.tag == "table":
        return f"\n\n{table_markdown(*table_rows(e))}\n\n"
    if e.tag == "hr":
        return "\n\n---\n\n"
    if e.tag == "blockquote" and nested < MOST_NESTED:
        x = yield _markdown(Element("div", children=e.children), nested + 1)
        return "\n\n" + "\n".join(f"> {y}" if y else ">" for y in x.split("\n")) + "\n\n"
    if e.tag in ("ul", "ol") and nested < MOST_NESTED:
        out, n = [], 0
        for c in e.children:
            if isinstance(c, Element) and c.tag == "li":
                n += 1
                mark = f"{n}. " if e.tag == "ol" else "- "
                x = yield _markdown(Element("div", children=c.children), nested + 1)
                out.append(mark + ("\n" + " " * len(mark)).join(x.split("\n")))
        return "\n\n" + "\n".join(out) + "\n\n"
    if any(isinstance(c, Element) and (c.tag in BLOCKS or c.tag in ("body", "li")) for c in e.children) or e.tag in ("html", "body", "#document"):
        out, run = [], []
        for c in [*e.children, None]:
            if c is None or (isinstance(c, Element) and (c.tag in BLOCKS or c.tag in ("html", "body", "head", "li"))):
                if run:
                    out.append(f"\n\n{(yield _inline(run, nested)).strip()}\n\n")
                    run = []
                if c is not None and c.tag != "head":
                    out.append((yield _block(c, nested)))
            else:
                run.append(c)
        return "".join(out)
    return f"\n\n{(yield _inline(e.children, nested)).strip()}\n\n"
