"""Leaf blocks of a web page: runs of text between block-level tags.

A block knows its text and the tags, class and id words above it.  The reader
goes once over the page, copes with unclosed and crossed tags, and takes time
in proportion to the page.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Element names of HTML.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose content is skipped: of the first kind nothing but the end
#: tag is markup, and without one the rest of the page belongs to them.
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp".split())
SILENT = RAW | frozenset("template select button svg math canvas audio video object".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the key closes an open element of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: Elements that such a closing does not reach beyond.
FENCE = frozenset("ul ol dl table menu dir".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=]*)\s*(=?)\s*")
_BARE = re.compile(r"[^\s>]*")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Block:
    """A leaf block: text, the tag that holds it, words of its element's class
    and id, all marks above it, number of the element around that, share of
    link text."""

    text: str
    tag: str
    own: tuple
    above: tuple
    parent: int
    linked: float


def _attributes(page: str, at: int, missing: set) -> tuple[dict, int]:
    """Attributes from ``at`` on, and the place behind the tag.  A quote that
    is never closed ends with the next ``>``."""
    out = {}
    while True:
        m = _ATTRIBUTE.match(page, at)
        name, at = m[1].lower(), m.end()
        value = ""
        if m[2]:
            quote = page[at:at + 1]
            end = -1
            if quote in ('"', "'") and quote not in missing:
                end = page.find(quote, at + 1)
                if end < 0:
                    missing.add(quote)
            if end >= 0:
                value, at = page[at + 1:end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        if name:
            out.setdefault(name, value)
        if at >= len(page) or page[at] == ">":
            return out, at + 1
        if not name and not m[2]:  # a stray sign
            at += 1


def marks_of(name: str, attributes: dict) -> tuple:
    """Words of class, id and role, lower-case."""
    said = " ".join(attributes.get(a, "") for a in ("class", "id", "role", "itemprop"))
    return tuple(sorted({w.lower() for w in _WORD.findall(said)})) if said.strip() else ()


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in page order; none for null and empty pages."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple] = []  # (name, words, number)
    open_names: Counter = Counter()
    above: Counter = Counter()
    numbers = 0
    parts: list[str] = []
    links: list[int] = []  # indexes of the parts inside a link
    linked = 0
    missing: set = set()

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            inside = " ".join("".join(parts[i] for i in links).split())
            name, words = stack[-1][:2] if stack else ("body", ())
            parent = stack[-2][2] if len(stack) > 1 else 0
            out.append(Block(text, name, words, tuple(above), parent, min(1.0, len(inside) / len(text))))
        parts.clear()
        links.clear()

    def push(name, words):
        nonlocal numbers
        numbers += 1
        marks = ["t:" + name, *("k:" + w for w in words)]
        if stack:
            marks.append(f"b:{stack[-1][0]}>{name}")
        above.update(marks)
        stack.append((name, words, numbers, marks))
        open_names[name] += 1

    def pop():
        name, _, _, marks = stack.pop()
        open_names[name] -= 1
        for mark in marks:
            above[mark] -= 1
            if not above[mark]:
                del above[mark]

    def add(text):
        if text:
            if linked:
                links.append(len(parts))
            parts.append(html.unescape(text) if "&" in text else text)

    at = 0
    while True:
        low = page.find("<", at)
        if low < 0:
            add(page[at:])
            break
        add(page[at:low])
        nxt = page[low + 1:low + 2]
        if page.startswith("<!--", low):
            end = page.find("-->", low + 4)
            if end < 0:
                break
            at = end + 3
        elif nxt in ("!", "?"):
            end = page.find(">", low)
            if end < 0:
                break
            at = end + 1
        elif nxt == "/":
            m = _NAME.match(page, low + 2)
            end = page.find(">", low)
            if end < 0:
                break
            at = end + 1
            name = m[0].lower() if m else ""
            if name == "a":
                linked = 0
            elif name == "br":
                add(" ")
            elif name in BLOCK:
                flush()
                if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
                    name = stack[-1][0]  # any heading's end tag ends a heading
                if open_names[name]:
                    while stack[-1][0] != name:
                        pop()
                    pop()
        elif m := _NAME.match(page, low + 1):
            name = m[0].lower()
            attributes, at = _attributes(page, m.end(), missing)
            if name in SILENT:
                end = None
                if name not in missing and page[at - 2:at] != "/>":
                    end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                    if end is None:
                        missing.add(name)
                if end is not None:
                    at = page.find(">", end.end()) + 1 or len(page)
                elif name in RAW and page[at - 2:at] != "/>":
                    break
            elif name == "a":
                linked = 1
            elif name == "br":
                add(" ")
            elif name in BLOCK:
                flush()
                if stack and (stack[-1][0] == "p" or name in HEADINGS and stack[-1][0] in HEADINGS):
                    pop()  # a paragraph holds no block, a heading no heading
                closes = CLOSES.get(name, ())
                if any(open_names[c] for c in closes):
                    for depth in range(len(stack) - 1, -1, -1):
                        if stack[depth][0] in closes:
                            while len(stack) > depth:
                                pop()
                        elif stack[depth][0] in FENCE:
                            break
                if name not in VOID:
                    push(name, marks_of(name, attributes))
        else:
            add("<")
            at = low + 1
    flush()
    return out
