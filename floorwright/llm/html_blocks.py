"""Leaf blocks of a page: text between block-level tags, with the path of tags above it. One pass over the whole html."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

#: Elements that end a block of text, elements without content of their own, and elements never shown.
BLOCK = frozenset("address article aside blockquote body button center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav noscript ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript iframe svg math object canvas head title".split())
#: Elements that the start of another closes.
CLOSED_BY = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_QUOTE = re.compile(r"[\"'>]")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|aria-label|hidden|style|itemprop)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|$)", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
#: Elements that belong in head; any other that is shown closes a head left open.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript object script style template title head html".split())
#: Elements beyond which the start of an element closes none.
_BARRIER = frozenset("table ul ol dl select div article section".split())
#: Which elements the start of one closes.
_CLOSES = {tag: [t for t, closing in CLOSED_BY.items() if tag in closing] for tag in frozenset().union(*CLOSED_BY.values())}
_PLAIN = re.compile(r"[a-z0-9]+")


@dataclass(eq=False)
class Node:
    """An open element of a path: its tag with its class and id words ("div.ad"), the element around it, and which of its
    words the path hadn't before. Blocks share nodes, so a page's paths take memory in proportion to its tags."""

    name: str
    parent: Node | None
    words: tuple[str, ...]


@dataclass
class Block:
    text: str
    node: Node | None
    links: int  # characters inside <a>

    @property
    def path(self) -> tuple[str, ...]:
        """Names from the root."""
        out, at = [], self.node
        while at:
            out.append(at.name)
            at = at.parent
        return tuple(reversed(out))

    @property
    def words(self) -> list[str]:
        """The distinct words of the path, from the root."""
        out, at = [], self.node
        while at:
            out.append(at.words)
            at = at.parent
        return [w for own in reversed(out) for w in own]


def chain(names: tuple[str, ...]) -> Node | None:
    """A path of these names."""
    at, seen = None, set()
    for name in names:
        new = tuple(w for w in dict.fromkeys(name.split(".")) if w not in seen)
        seen.update(new)
        at = Node(name, at, new)
    return at


def _tag_end(page: str, at: int, none_after: dict[str, int]) -> tuple[int, int]:
    """(end of the attributes, place after the tag) of a tag whose name ends at `at`.

    A quote without its other half is a character like any other, so that a broken tag ends with its own bracket; where a
    kind of quote has no more halves is remembered, so that many broken tags are read in one pass.
    """
    while True:
        m = _QUOTE.search(page, at)
        if not m:
            return len(page), len(page)
        c, at = m[0], m.end()
        if c == ">":
            return at - 1, at
        if at < none_after[c]:
            other = page.find(c, at)
            if other < 0:
                none_after[c] = at
            else:
                at = other + 1


def _name(tag: str, attrs: str) -> tuple[str, bool]:
    """The tag with its class and id words, and whether its own attributes hide it; a class of that name is only a word."""
    if not attrs or attrs.isspace():
        return tag, False
    words, hidden = [], False
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
            words.append("hidden")
            hidden = True
        elif key != "style":
            words += _PLAIN.findall(value.lower())
    return ".".join([tag, *words]), hidden


def blocks(page: str) -> list[Block]:
    """All leaf blocks of the page in order, hidden elements left out. Character references are decoded.

    Time and memory are in proportion to the page, whatever it holds: deep nesting, tags that never close, lone quotes.
    """
    out: list[Block] = []
    open_: list[tuple[str, Node | None, tuple[str, ...], bool]] = []  # (tag, path, its words, hidden)
    count: Counter[str] = Counter()  # open elements by tag
    held: Counter[str] = Counter()  # words on the path
    places: dict[str, list[int]] = {t: [] for t in CLOSED_BY}  # where elements that a start closes are open, and where barriers are
    barriers: list[int] = []
    none_after = {'"': len(page), "'": len(page)}
    parts: list[str] = []
    links = hidden = in_link = 0

    def end() -> None:
        nonlocal links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, open_[-1][1] if open_ else None, links))
            parts.clear()
        links = 0

    def close(k: int) -> None:
        """Closes open_[k] and all inside it."""
        nonlocal hidden, in_link
        for t, _, words, gone in reversed(open_[k:]):
            if t in places:
                places[t].pop()
            elif t in _BARRIER:
                barriers.pop()
            hidden -= gone
            in_link -= t == "a"
            count[t] -= 1
            held.subtract(words)
        del open_[k:]

    def text(raw: str) -> None:
        nonlocal links
        if raw and not hidden:
            shown = html.unescape(raw) if "&" in raw else raw
            parts.append(shown)
            if in_link:
                links += len(shown)

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        text(page[at:lt])
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
            elif page.startswith("<![CDATA[", lt):
                stop = page.find("]]>", lt)
                text(page[lt + 9 : n if stop < 0 else stop])
                at = n if stop < 0 else stop + 3
            else:
                stop = page.find(">", lt)
                at = n if stop < 0 else stop + 1
            continue
        named = _NAME.match(page, lt + 1 + (nxt == "/"))
        if not named:  # a bracket that begins no tag is text
            text("<")
            at = lt + 1
            continue
        tag = named[0].lower()
        stop, at = _tag_end(page, named.end(), none_after)
        attrs = page[named.end() : stop]
        if nxt == "/":
            if count[tag]:
                k = len(open_) - 1
                while open_[k][0] != tag:
                    k -= 1
                if tag in BLOCK or any(t in BLOCK for t, *_ in open_[k:]):
                    end()
                close(k)
            continue
        if tag not in IN_HEAD and open_ and open_[-1][0] == "head":
            close(len(open_) - 1)
        if tag in BLOCK:
            end()
        elif tag == "br":
            text(" ")
        inner = -1
        for t in _CLOSES.get(tag, ()):
            if places[t] and places[t][-1] > inner:
                inner = places[t][-1]
        if inner >= 0 and (not barriers or inner > barriers[-1]):
            close(inner)
        if tag in VOID or attrs.endswith("/") and tag in HIDDEN:
            continue
        name, gone = _name(tag, attrs)
        gone = gone or tag in HIDDEN
        node, words = open_[-1][1] if open_ else None, ()
        if tag in BLOCK or "." in name:
            words = tuple(dict.fromkeys(name.split(".")))
            node = Node(name, node, tuple(w for w in words if not held[w]))
            held.update(words)
        if tag in places:
            places[tag].append(len(open_))
        elif tag in _BARRIER:
            barriers.append(len(open_))
        open_.append((tag, node, words, gone))
        count[tag] += 1
        hidden += gone
        in_link += tag == "a"
        if tag in _RAW_END:
            over = _RAW_END[tag].search(page, at)
            if tag == "textarea" and over:
                text(page[at : over.start()])
            at = over.end() if over else n
            if tag in BLOCK:
                end()
            close(len(open_) - 1)
    end()
    return out
