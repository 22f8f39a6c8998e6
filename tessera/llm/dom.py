"""A small, forgiving HTML tree of block elements and the text blocks in them."""

from __future__ import annotations

import bisect
import html
import re

# quotes count behind an equals sign only; one that never closes is a character like others. Nothing backtracks.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)(?:>|\Z)", re.DOTALL)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"']+))")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

#: Element names of the HTML standard by their role. What stands in raw ones is
#: code, a graphic, another page, the page's title or a notice to those without scripts;
#: formulas and the text inside ``object``, ``audio`` and ``video`` count as text.
RAW = frozenset("script style template noscript iframe svg canvas title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd nav header footer aside form fieldset legend label button select option textarea table caption thead tbody tfoot tr td th figure figcaption blockquote pre address details summary hr dialog menu".split()
)
_CLOSES_P = BLOCK - {"html", "head", "body", "label", "button", "select", "option", "textarea"}
#: An open element of these ends when one of its own row starts, up to the named holder.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Node:
    """An element, or (tag ``#text``) a run of inline content between block borders."""

    __slots__ = ("tag", "parent", "children", "tokens", "mark", "text", "chars", "link_chars", "inline")

    def __init__(self, tag: str, parent: Node | None, tokens: tuple[str, ...] = (), mark: str | None = None):
        self.tag, self.parent, self.tokens, self.mark = tag, parent, tokens, mark
        self.children: list[Node] = []
        self.text, self.chars, self.link_chars, self.inline = "", 0, 0, 0
        if parent is not None:
            parent.children.append(self)


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(source)}


def _tokens(found: dict[str, str]) -> tuple[str, ...]:
    words = " ".join(found[k] for k in ("class", "id", "role", "itemprop", "aria-label", "rel") if k in found)
    return tuple(w.lower() for w in _SPLIT.split(words) if w)


def parse(source: str) -> Node:
    """The tree of a page; ``text`` of its ``#text`` leaves is decoded, with single spaces, and not empty.

    Time grows with the page's length, whatever its depth: ``places`` knows where in the
    stack of open elements those of each tag stand.
    """
    root = Node("#root", None)
    open_ = [root]
    places: dict[str, list[int]] = {}
    parts: list[str] = []
    links: list[str] = []
    in_link = inline = 0

    def flush() -> None:
        nonlocal inline
        text = " ".join("".join(parts).split())
        if text:
            leaf = Node("#text", open_[-1])
            leaf.text, leaf.chars, leaf.inline = text, len(text), inline
            leaf.link_chars = min(leaf.chars, len("".join(links)))
        parts.clear()
        links.clear()
        inline = 0

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            links.append(text)

    def close(place: int) -> None:
        while len(open_) > place:
            places[open_.pop().tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        if m[1] is None:
            continue
        tag, closing = m[1].lower(), source[m.start() + 1] == "/"
        if at == size and source[-1] != ">":
            continue  # cut off inside a tag
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.IGNORECASE).search(source, at)
            at = end.end() if end else size
            continue
        if tag not in BLOCK:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag == "br":
                parts.append(" ")
            inline += not closing
            continue
        flush()
        in_link = 0
        if closing:
            if places.get(tag):
                close(places[tag][-1])
            continue
        if tag in _CLOSES_P and places.get("p") and places["p"][-1] > innermost(("td", "th", "table", "button")):
            close(places["p"][-1])
        if tag in _SIBLINGS:
            ends, holders = _SIBLINGS[tag]
            holder = innermost(holders)
            outermost = [known[k] for known in (places.get(t, []) for t in ends) if (k := bisect.bisect_right(known, holder)) < len(known)]
            if outermost:
                close(min(outermost))
        found = attributes(m[2]) if "=" in m[2] else {}
        node = Node(tag, open_[-1], _tokens(found) if found else (), found.get("data-k"))
        if tag not in VOID:  # a slash does not close a block element in HTML
            places.setdefault(tag, []).append(len(open_))
            open_.append(node)
    flush()
    return root


def preorder(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(reversed(node.children))
    return order
