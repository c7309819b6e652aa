"""Leaf blocks of web pages, in one pass over the markup, in time proportional to it.

A block is a run of text between two borders of block elements; inline elements
leave no trace but the share of linked text. Each block knows the tags, classes,
ids and roles of the elements around it as a set of hashed bits, and the tag it
stands in.
"""

from __future__ import annotations

import re
import zlib
from html import unescape
from typing import NamedTuple

#: Bits of a path, and buckets of the tag a block stands in.
PATH, TAGS = 384, 24

# Fixed values of the markup language: names of elements.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul noscript template svg object canvas audio video map".split()
)
#: What is in these is no text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes".split())
NEVER = frozenset("noscript template select svg object canvas audio video".split())
VOID = frozenset(["hr"])
#: These end a paragraph that is still open.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: An element of the first kind ends an open one of the second, unless one of the third was opened after it.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_QUOTED_END = re.compile(r"""(?:[^>"']|"[^"]*+"|'[^']*+')*+>""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+|[^\W\d_]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}


class Block(NamedTuple):
    text: str
    path: int
    tag: int
    linked: float


def bit(token: str) -> int:
    """Two bits for each token, so that hardly any two share both."""
    code = zlib.crc32(token.encode())
    return 1 << (code % PATH) | 1 << ((code >> 12) * 2654435761 % (1 << 32) % PATH)


def tag_bucket(name: str) -> int:
    return zlib.crc32(b"tag " + name.encode()) % TAGS


def element_bits(name: str, attributes: str) -> int:
    """Bits of an element: its name, the words of its class, id and role, those words' first four letters, and whether it is hidden."""
    out = bit(name)
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = m[2] or m[3] or m[4] or ""
        if key in ("class", "id", "role"):
            for part in _PART.findall(value):
                word = part.lower()
                out |= bit("." + word)
                if len(word) > 4:
                    out |= bit("." + word[:4] + "~")
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            out |= bit("!hidden")
    return out


class _Page:
    """The open block elements and the block that is being read."""

    def __init__(self, cache: dict[tuple[str, str], int]) -> None:
        self.cache = cache
        self.stack: list[tuple[str, int]] = []
        self.places: dict[str, list[int]] = {}
        self.never = 0
        self.link = False
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[Block] = []

    def text(self, raw: str) -> None:
        if raw and not self.never:
            if "&" in raw:
                raw = unescape(raw)
            self.parts.append(raw)
            if self.link:
                self.linked += len("".join(raw.split()))

    def flush(self) -> None:
        if not self.parts:
            return
        text = " ".join("".join(self.parts).split())
        if text:
            name, path = self.stack[-1] if self.stack else ("", 0)
            self.blocks.append(Block(text, path, tag_bucket(name), min(1.0, self.linked / max(1, len(text) - text.count(" ")))))
        self.parts, self.linked = [], 0

    def pop_to(self, place: int) -> None:
        while len(self.stack) > place:
            name, _ = self.stack.pop()
            self.places[name].pop()
            self.never -= name in NEVER

    def nearest(self, names: tuple[str, ...]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def start(self, name: str, attributes: str) -> None:
        self.flush()
        if name in ENDS_P and self.stack and self.stack[-1][0] == "p":
            self.pop_to(len(self.stack) - 1)
        if name in ENDS:
            same, border = ENDS[name]
            place = self.nearest(same)
            if place > self.nearest(border):
                self.pop_to(place)
        if name in VOID:
            return
        bits = self.cache.get((name, attributes))
        if bits is None:
            if len(self.cache) > 4096:
                self.cache.clear()
            bits = self.cache[name, attributes] = element_bits(name, attributes)
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, bits | (self.stack[-1][1] if self.stack else 0)))
        self.never += name in NEVER

    def end(self, name: str) -> None:
        self.flush()
        self.link = False
        if self.places.get(name):
            self.pop_to(self.places[name][-1])


def blocks(html: str, cache: dict[tuple[str, str], int] | None = None) -> list[Block]:
    """The blocks of a page in their order; damaged markup is read as far as it goes, and an unended tag or comment takes the rest."""
    page = _Page({} if cache is None else cache)
    done = at = 0  # text before ``done`` is read; the next sign is looked for from ``at``
    quotes = True
    while True:
        lt = html.find("<", at)
        if lt < 0:
            page.text(html[done:])
            break
        m = _NAME.match(html, lt)
        if m is None:
            follows = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2) + 3  # the shortest comment shares its signs
                found = end > lt + 2
            elif follows in ("!", "?", "/"):
                end = html.find(">", lt) + 1
                found = end > lt
            else:
                at = lt + 1  # a sign of its own
                continue
            page.text(html[done:lt])
            if not found:
                break
            done = at = end
            continue
        page.text(html[done:lt])
        gt = html.find(">", m.end())
        if gt < 0:
            break
        if quotes and ('"' in (attributes := html[m.end() : gt]) or "'" in attributes):
            one, two = attributes.count('"'), attributes.count("'")
            if one % 2 or two % 2 or one and two:
                whole = _QUOTED_END.match(html, m.end())
                if whole:
                    gt = whole.end() - 1
                else:
                    quotes = False  # quotes are not balanced to the end: from here on, every tag ends with the first sign
        done = at = gt + 1
        name = m[1].lower()
        if html[lt + 1] == "/":
            if name in BLOCK:
                page.end(name)
            elif name == "a":
                page.link = False
            continue
        if name in BLOCK:
            page.start(name, html[m.end() : gt])
        elif name in RAW:
            closing = _RAW_END[name].search(html, done)
            if closing is None:
                break
            done = at = closing.start()
        elif name == "br":
            page.text(" ")
        elif name == "a":
            page.link = True
    page.flush()
    return page.blocks
