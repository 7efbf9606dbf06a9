"""HTML as a stream of events, in one pass and linear time whatever the markup: the base of the tree, of titles and links.

The stream follows the public HTML standard where it names tokens: quotes count in values only, an unclosed comment
or tag takes the rest of the page, the text of raw elements holds no markup, and ``</`` before no letter is a comment.
Scripts inside comments inside scripts are not told apart.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.entities import html5

START, END, TEXT = 0, 1, 2

# Elements whose text is no markup; in those of the second set references are decoded.
RAW = frozenset({"script", "style", "xmp", "iframe", "noembed", "noframes"})
ESCAPABLE = frozenset({"title", "textarea"})

_S = r"[\t\n\f\r ]"
_ATTRIBUTE = rf"""[^\t\n\f\r />][^\t\n\f\r />=]*+(?:{_S}*+={_S}*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^\t\n\f\r >]++|(?=>))|(?!{_S}*+=))"""
_TAG = re.compile(rf"(/?+)([a-zA-Z][^\t\n\f\r />]*+)((?:[\t\n\f\r /]++|{_ATTRIBUTE})*+)>")
_PAIR = re.compile(rf"""([^\t\n\f\r />][^\t\n\f\r />=]*+)(?:{_S}*+={_S}*+(?:"([^"]*+)"|'([^']*+)'|([^\t\n\f\r >"'][^\t\n\f\r >]*+))?)?""")
_COMMENT_END = re.compile(r"--!?>")
_RAW_END = {t: re.compile(rf"</{t}(?=[\t\n\f\r />])", re.I) for t in RAW | ESCAPABLE}
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;?)")


def events(html: str) -> Iterator[tuple[int, str, str]]:
    """(START, tag, attributes as written), (END, tag, "") and (TEXT, "", text) of a page, in its order; text is decoded."""
    at, size, held = 0, len(html), 0  # text from held to at is not given yet
    find, tag_at, decode = html.find, _TAG.match, _html.unescape
    while True:
        at = find("<", at)
        if at < 0 or at + 1 >= size:
            break
        c = html[at + 1]
        if c.isascii() and c.isalpha() or c == "/" and html[at + 2 : at + 3].isascii() and html[at + 2 : at + 3].isalpha():
            m = tag_at(html, at + 1)
            if at > held:
                x = html[held:at]
                yield TEXT, "", decode(x) if "&" in x else x
            if m is None:  # the page ends inside the tag
                return
            at = held = m.end()
            tag = m[2].lower()
            if m[1]:
                yield END, tag, ""
                continue
            yield START, tag, m[3]
            if tag in _RAW_END:
                end = _RAW_END[tag].search(html, at)
                stop = end.start() if end else size
                if stop > at:
                    yield TEXT, "", decode(html[at:stop]) if tag in ESCAPABLE else html[at:stop]
                at = held = stop
            elif tag == "plaintext":
                if size > at:
                    yield TEXT, "", html[at:]
                return
        elif c in "!?/":
            if at > held:
                x = html[held:at]
                yield TEXT, "", decode(x) if "&" in x else x
            if html.startswith("!--", at + 1):
                short = next((k for k in (">", "->") if html.startswith(k, at + 4)), None)
                end = _COMMENT_END.search(html, at + 4) if short is None else None
                at = at + 4 + len(short) if short else end.end() if end else size
            else:
                end = find(">", at + 2)
                at = size if end < 0 else end + 1
            held = at
        else:
            at += 1
    if size > held:
        x = html[held:]
        yield TEXT, "", decode(x) if "&" in x else x


def _value(m: re.Match) -> str:
    """A reference inside an attribute: one without a semicolon stays as it is before a letter, a digit or an equals sign."""
    name = m[1]
    if name[0] == "#" or name[-1] == ";" and name in html5:
        return _html.unescape(m[0])
    after = m.string[m.end() : m.end() + 1]
    return html5[name] if name in html5 and after != "=" else m[0]


def attributes(written: str) -> dict[str, str]:
    """Attributes of a start tag by their lower-case names; of repeated ones the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _PAIR.findall(written):
        v = a or b or c
        out.setdefault(name.lower(), _REFERENCE.sub(_value, v) if "&" in v else v)
    return out


class OpenTags:
    """The open elements of a page by their tags; every question and change takes the time of what it closes."""

    def __init__(self, barriers: frozenset[str]) -> None:
        self.tags: list[str] = []
        self.where: dict[str, list[int]] = {}
        self.barriers, self.at_barriers = barriers, []

    def push(self, tag: str) -> None:
        self.where.setdefault(tag, []).append(len(self.tags))
        if tag in self.barriers:
            self.at_barriers.append(len(self.tags))
        self.tags.append(tag)

    def cut(self, depth: int) -> None:
        """Close all elements from a depth on."""
        while len(self.tags) > depth:
            tag = self.tags.pop()
            self.where[tag].pop()
            if tag in self.barriers:
                self.at_barriers.pop()

    def last(self, tag: str) -> int:
        """Depth of the last open element of a tag; -1 if there is none."""
        at = self.where.get(tag)
        return at[-1] if at else -1

    def near(self, tags: frozenset[str]) -> int:
        """Depth of the last open element of the tags that no barrier follows; -1 if there is none."""
        at = max(map(self.last, tags))
        return at if at > (self.at_barriers[-1] if self.at_barriers else -1) else -1


def hrefs(html: str) -> list[str]:
    """Targets of all ``a`` elements in document order, trimmed."""
    out = []
    for kind, name, x in events(html):
        if kind == START and name == "a" and "href" in x.lower():
            v = attributes(x).get("href")
            if v is not None:
                out.append(v.strip(" \t\r\n\f"))
    return out
