"""Leaf blocks of a page: runs of text between block-level tags, with what stands above them.

A forgiving reader for pages as they are: unclosed and misnested tags, upper
case, attributes in any quoting, comments, raw-text elements. It keeps a stack
of open elements; a paragraph ends where another block begins, list items and
table cells end where the next one begins, and an end tag closes what was
opened inside it. Every step costs the same at any depth of nesting.

Defined cases: a null or empty page has no blocks; white space of any kind
between words is one space, and a block without words is none; character
references are decoded piece by piece, so a tag inside one leaves it as it
stands; a tag that is never closed reaches to the end; an end tag without a
start is passed over; text outside all elements is a block too; pages of any
length and depth are read whole.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not text of the page.
RAW = frozenset("script style noscript template textarea title svg iframe object canvas".split())
#: What a start tag closes if it is open, up to one of the second set.
CLOSES = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_PARAGRAPH = (frozenset({"p"}), frozenset({"td", "th", "li", "div", "article", "section", "button"}))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)")
_NAMED = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


#: Elements inside a line: they are no place of their own.
INLINE = frozenset("a b i em strong span u small font code".split())


class Element:
    """An open element: its parent, the features that no element above it has, and the two nearest tags that are not inline.

    Pages are trees of these, so a block costs the same however deep it lies.
    """

    __slots__ = ("parent", "fresh", "inner")

    def __init__(self, parent: Element | None, fresh: tuple[str, ...], tag: str):
        self.parent, self.fresh = parent, fresh
        above = parent.inner if parent else ()
        self.inner = above if tag in INLINE else (*above[-1:], tag)

    def features(self) -> list[str]:
        """Features of this element and all above it, and of the place."""
        out, at = self.place(), self
        while at is not None:
            out += at.fresh
            at = at.parent
        return out

    def place(self) -> list[str]:
        return [f"leaf={self.inner[-1] if self.inner else ''}", f"path={'/'.join(self.inner)}"]


ROOT = Element(None, (), "a")


class Block(NamedTuple):
    text: str
    above: Element
    linked: int  # characters inside links


class Stack:
    """The open elements, with the places of each tag, so that nothing is ever searched through."""

    def __init__(self) -> None:
        self.elements: list[tuple[str, str, Element]] = []
        self.places: dict[str, list[int]] = {}
        self.worn: dict[str, int] = {}  # open elements that have a name

    def top(self) -> Element:
        return self.elements[-1][2] if self.elements else ROOT

    def open(self, tag: str) -> bool:
        return bool(self.places.get(tag))

    def push(self, tag: str, words: str) -> None:
        fresh = [] if self.open(tag) else [f"in={tag}"]
        for w in words.split():
            if not self.worn.get(w):
                fresh.append(f"named={w}")
            self.worn[w] = self.worn.get(w, 0) + 1
        self.places.setdefault(tag, []).append(len(self.elements))
        self.elements.append((tag, words, Element(self.top(), tuple(fresh), tag)))

    def close(self, tags: frozenset, until: frozenset = frozenset()) -> None:
        """Close the innermost of ``tags`` and all inside it, unless one of ``until`` is open within it."""
        last = max((self.places[t][-1] for t in tags if self.open(t)), default=-1)
        if last < 0 or last < max((self.places[t][-1] for t in until if self.open(t)), default=-1):
            return
        while len(self.elements) > last:
            tag, words, _ = self.elements.pop()
            self.places[tag].pop()
            for w in words.split():
                self.worn[w] -= 1


def names(attributes: str) -> str:
    """Words of the class, id and role of a tag, folded and joined by spaces."""
    if "=" not in attributes:
        return ""
    found = " ".join(a or b or c for a, b, c in _NAMED.findall(attributes))
    return " ".join(dict.fromkeys(w.lower() for w in _PARTS.findall(found)))


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    stack = Stack()
    parts: list[str] = []
    linked = 0
    at, end = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, stack.top(), min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            # a reference ends with its piece of text: one that a tag parts is none
            raw = page[at:lt]
            parts.append(html.unescape(raw) if "&" in raw else raw)
            if stack.open("a"):
                linked += lt - at
        if lt >= end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 4)
            at = end if close < 0 else close + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            close = page.find(">", lt)
            at = end if close < 0 else close + 1
            continue
        tag = _TAG.match(page, lt) or _LOOSE_TAG.match(page, lt)
        if not tag:
            parts.append("<")
            at = lt + 1
            continue
        at = tag.end()
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCK:
                flush()
            stack.close(frozenset({name}))
            continue
        if name in RAW:
            if not tag[3].rstrip().endswith("/"):
                close = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(page, at)
                at = end if close is None else close.end()
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES:
                stack.close(*CLOSES[name])
            elif name not in ("html", "body", "head"):
                stack.close(*_PARAGRAPH)
        if name == "br":
            parts.append(" ")
        if name in VOID or tag[3].endswith("/"):
            continue
        if name == "body":
            stack.close(frozenset({"head"}))
        stack.push(name, names(tag[3]))
    flush()
    return out
