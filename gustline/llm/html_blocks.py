"""Cutting a page into leaf blocks: the text between block-level tags, with the
path of open tags above it."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Element groups of the HTML standard.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
                   "samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe".split())  # without an end tag, up to the page's end
NO_TEXT = frozenset("svg canvas object select template".split())  # without an end tag, only the tag itself
# an opening tag of the key closes an open one of these, up to the nearest of the stops
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
          "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

TAG = re.compile(r"""<(?:!--(?P<comment>)|(?P<other>[!?])|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*))""")
ATTRS = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
MARKS = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[a-z]+")


@dataclass(slots=True)
class Block:
    """Text (references decoded, white space as one space) and where it stood:
    ``path`` names the open tags, outermost first, and the words of their
    class, id and role; ``linked`` is the length of the text inside links."""
    text: str
    path: tuple[tuple[str, tuple[str, ...]], ...]
    linked: int


def _tag_end(page: str, at: int) -> int:
    """The place behind the > that ends the tag whose inside starts at ``at``;
    -1 if the page ends first."""
    m = ATTRS.match(page, at)
    if m:
        return m.end()
    end = page.find(">", at)  # a quote that is never closed
    return end + 1 if end >= 0 else -1


def _ends(page: str, name: str) -> dict[int, int]:
    """Places behind the opening tags of an element and behind their end tags;
    an end tag closes the nearest one open, unclosed ones are left out."""
    out, opened = {}, []
    for m in re.compile(f"<(/?){re.escape(name)}(?=[\\s/>])", re.I).finditer(page):
        end = _tag_end(page, m.end())
        if m[1]:
            if opened:
                out[opened.pop()] = end if end >= 0 else len(page)
        elif end >= 0 and page[end - 2:end] != "/>":
            opened.append(end)
    return out


def blocks(page: str) -> list[Block]:
    """Leaf blocks with text, in page order. Comments, declarations, scripts,
    styles and other raw elements give none; drawings, templates and choices
    give none up to their end tag. A tag cut off by the page's end is no
    text."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = links = 0
    where: tuple = ()
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            out.append(Block(joined, where, min(linked, len(joined))))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked, where
        if piece:
            if not text or not where:
                where = tuple(stack)
            text.append(piece)
            if links:
                linked += len(piece)

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        if text or not page[at:m.start()].isspace():
            add(page[at:m.start()])
        if m["comment"] is not None:
            end = page.find("-->", m.end())
            at = end + 3 if end >= 0 else n
            continue
        at = _tag_end(page, m.end())
        if at < 0:
            break
        if m["other"]:
            continue
        name, closing = m["name"].lower(), bool(m["close"])
        if name not in INLINE and name != "br":
            flush()
        if name == "br":
            add(" ")
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag doesn't close blocks
            links = sum(t == "a" for t, _ in stack)
            continue
        if name in VOID or page[at - 2:at] == "/>":
            continue
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}(?![a-z0-9-])", re.I).search(page, at)
            if not end:
                break
            at = _tag_end(page, end.end())
            if at < 0:
                break
            continue
        if name in NO_TEXT:
            if name not in ends:
                ends[name] = _ends(page, name)
            at = ends[name].get(at, at)
            continue
        if name not in INLINE:
            closed, stops = CLOSES.get(name, (set(), set()))
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in closed:
                    del stack[k:]
                elif stack[k][0] not in INLINE and stack[k][0] in stops or not closed and stack[k][0] not in INLINE:
                    break
        marks = [a or b or c for a, b, c in MARKS.findall(page[m.end():at - 1])] if at - m.end() > 1 else []
        stack.append((name, tuple(WORDS.findall(" ".join(marks).lower()))))
        links += name == "a"
    flush()
    return out
