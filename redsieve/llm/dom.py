"""A block tree of an HTML page: elements that aren't inline, with the text that stands directly in them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

#: Fixed values of the HTML standard: elements within a line, elements without content, and what an element closes when it opens.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: An element doesn't close those outside the nearest of these.
HOLDERS = frozenset("ul ol dl table select article aside section main nav header footer div form body html td th blockquote".split())
_KEEP_P = frozenset("html head body".split())
_P = ("p", "h1", "h2", "h3", "h4", "h5", "h6")
#: What may open in a head without ending it; other elements, and text, end it. The rest of a head's elements have no node.
_IN_HEAD = frozenset("html head noframes noscript".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(script|style|template|textarea|title|iframe)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*?(?:>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)|</?[a-zA-Z][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_HINT = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    hints: list[str]
    letters: int = 0
    linked: int = 0
    label: int = 0


@dataclass
class Tree:
    """nodes: parents come before children. blocks: node and text of each run, in page order, white space made single."""

    nodes: list[Node] = field(default_factory=list)
    blocks: list[tuple[int, str]] = field(default_factory=list)


def parse(page: str) -> Tree:
    """Never fails: tags that aren't closed are closed where their holder ends, end tags of nothing are skipped, and a tag that
    the page cuts off is dropped."""
    tree = Tree([Node("#root", -1, [])])
    open_ = [0]
    places: dict[str, list[int]] = {}  # of open elements by tag, in open_
    holders = [0]  # places of open holders
    run: list[str] = []
    linked, link_depth = 0, False

    def push(node: Node) -> None:
        tree.nodes.append(node)
        places.setdefault(node.tag, []).append(len(open_))
        if node.tag in HOLDERS:
            holders.append(len(open_))
        open_.append(len(tree.nodes) - 1)

    def leave(place: int) -> None:
        """Closes the element at ``place`` and all within."""
        while len(open_) > place:
            places[tree.nodes[open_.pop()].tag].pop()
        while holders[-1] >= place > 0:
            holders.pop()

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            run.append(raw)
            if link_depth:
                linked += len(raw)

    def leave_head() -> None:
        if tree.nodes[open_[-1]].tag == "head":
            leave(len(open_) - 1)

    def flush() -> None:
        nonlocal linked, link_depth
        if run:
            words = " ".join(html.unescape("".join(run)).split())
            if words:
                leave_head()
                node = tree.nodes[open_[-1]]
                node.letters += len(words)
                node.linked += min(linked, len(words))
                tree.blocks.append((open_[-1], words))
            run.clear()
        linked, link_depth = 0, False

    def close(tags: tuple[str, ...]) -> None:
        """Closes the nearest open element of these, unless a holder that isn't one stands within it."""
        place = max((places[t][-1] for t in tags if places.get(t)), default=0)
        if place and place >= holders[-1]:
            leave(place)

    at, unseen = 0, False  # unseen: within the noscript of a head, whose content a browser doesn't show
    for m in _TOKEN.finditer(page):
        tag = m[3]
        if unseen:
            at = m.end()
            unseen = not tag or (m[2] + tag).lower() not in ("/noscript", "/head", "body")
            if unseen or tag.lower() == "noscript":
                continue
            at = m.start()
        text(page[at : m.start()])
        at = m.end()
        if not tag:
            if m[0][:2] not in ("<!", "<?"):
                run.append(" ")  # a script or the like is no part of a word
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                link_depth = not m[2]
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            else:
                run.append(" ")
            continue
        flush()
        if tag == "noscript" and not m[2] and tree.nodes[open_[-1]].tag == "head":
            unseen = True
            continue
        if m[2]:
            if places.get(tag):
                leave(places[tag][-1])
            continue
        if tag not in _IN_HEAD:
            leave_head()
        if tag not in _KEEP_P:
            close(_P)
        if tag in CLOSES:
            close(CLOSES[tag])
        hints = [w for h in _HINT.findall(m[4]) for w in _NAME.findall("".join(h).lower())] if m[4] else []
        push(Node(tag, open_[-1], hints))
    if not unseen:
        text(page[at:])
    flush()
    return tree
