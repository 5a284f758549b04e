"""HTML extraction by a tree-structured graphical model over the blocks of a page.

Each block is content or not. Parent and child are tied by a potential, and each block has one from what it shows: its element,
the words of its class, id and role, how much text stands in it and how much of that is linked. Messages go up from the leaves
and down from the root (sum-product), which gives the exact marginal of every block; the text of blocks with a marginal over one
half is the page's. The potentials are counts over labelled pages, which labelled_pages() makes by rule: layouts of many kinds
whose parts are known to be content or not.

Defined results: a null or empty html gives an empty text, as does a page without content. Pages are taken one by one, so repeated
rows do no harm; a very deep or long page takes time in proportion. An empty table gives an empty one."""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redsieve.llm.dom import Node, Tree, parse

#: Labelled pages that the model learns from, and what a count is increased by.
TRAINING_PAGES = 800
SMOOTHING = 0.05
#: What text features weigh next to element and hints: many blocks of a kind mustn't outvote what holds them.
TEXT_WEIGHT = 0.3

#: Elements whose text is never shown.
HIDDEN = frozenset(("head", "title"))


def _bins(node: Node) -> list[str]:
    n = node.letters
    if not n:
        return ["text:none"]
    share = node.linked / n
    return [f"text:{'short' if n < 25 else 'middle' if n < 120 else 'long'}", f"link:{'none' if share < 0.05 else 'some' if share < 0.6 else 'most'}"]


def _features(node: Node) -> tuple[list[str], list[str]]:
    return [f"tag:{node.tag}", *(f"hint:{h}" for h in dict.fromkeys(node.hints))], _bins(node)


@dataclass
class Model:
    """Log potentials: odds of content for each feature, and the tie of parent and child by (parent, child)."""

    odds: dict[str, float]
    tie: tuple[tuple[float, float], tuple[float, float]]

    def evidence(self, node: Node) -> float:
        shown, text = _features(node)
        return sum(self.odds.get(f, 0.0) for f in shown) + TEXT_WEIGHT * sum(self.odds.get(f, 0.0) for f in text)

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content of each block. Parents come before their children, so no recursion is needed."""
        (t00, t01), (t10, t11) = self.tie
        own = [self.evidence(n) for n in nodes]  # log odds; only ratios matter
        own[0] = -20.0  # the page itself
        up = own[:]  # log odds of content from the subtree
        message = [0.0] * len(nodes)
        for v in range(len(nodes) - 1, 0, -1):
            r = up[v]
            # log of what the parent hears if it is content, less that if it isn't
            message[v] = _log_sum(t10, t11 + r) - _log_sum(t00, t01 + r)
            up[nodes[v].parent] += message[v]
        out = [0.0] * len(nodes)
        belief = up[:]
        for v in range(len(nodes)):
            if v:
                rest = belief[nodes[v].parent] - message[v]  # the parent without this subtree
                belief[v] = up[v] + _log_sum(t01, t11 + rest) - _log_sum(t00, t10 + rest)
            out[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, belief[v]))))
        return out


def _log_sum(a: float, b: float) -> float:
    high = max(a, b)
    return high + math.log1p(math.exp(min(a, b) - high))


def train(trees: list[Tree]) -> Model:
    """From trees whose nodes are labelled."""
    seen, features, ties = Counter(), Counter(), Counter()
    for tree in trees:
        for node in tree.nodes[1:]:
            shown, text = _features(node)
            seen[node.label] += 1
            features.update((f, node.label) for f in shown + text)
            ties[tree.nodes[node.parent].label, node.label] += 1
    rate = lambda f, y: math.log((features[f, y] + SMOOTHING) / (seen[y] + 2 * SMOOTHING))
    odds = {f: rate(f, 1) - rate(f, 0) for f in {f for f, _ in features}}
    tie = tuple(tuple(math.log((ties[p, c] + 1) / (ties[p, 0] + ties[p, 1] + 2)) for c in (0, 1)) for p in (0, 1))
    return Model(odds, tie)


#: Hints of parts that aren't content, by the element they stand on, and of those that are.
_OTHER = {
    "nav": ("nav", "menu", "navigation", "topnav", "breadcrumb", "pagination", "toc"),
    "header": ("header", "masthead", "site-header", "top", "logo", "branding"),
    "footer": ("footer", "site-footer", "copyright", "legal", "bottom", "colophon"),
    "aside": ("sidebar", "aside", "widget", "related", "recommended", "popular", "trending", "tags", "author-bio"),
    "div": ("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "cookie", "notice", "consent", "popup", "modal", "alert", "share", "social", "newsletter", "subscribe", "skip"),
    "form": ("form", "search", "login", "signup", "contact", "newsletter"),
    "section": ("comments", "comment", "comment-list", "replies", "responses", "discussion", "reviews", "disqus"),
}
_CONTENT = ("content", "article", "post", "entry", "story", "main", "body", "text", "article-body", "post-content", "entry-content", "page")


def labelled_pages(n: int = TRAINING_PAGES, seed: int = 11) -> Iterator[Tree]:
    """Pages in many layouts; the nodes of their trees are labelled by the part that they were made as."""
    r = random.Random(seed)
    words = lambda a, b: " ".join(f"{r.choice('bdfghklmnprst')}{r.choice('aeiou')}{r.choice(('', 'n', 'r', 'st'))}" for _ in range(r.randint(a, b)))

    def attribute(hint: str) -> str:
        return f' {r.choice(("class", "id", "class"))}="{hint}"' if hint else ""

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(r.randint(2, 8))) + "</ul>"

    def prose(a: int, b: int) -> str:
        out = ""
        for _ in range(r.randint(a, b)):
            kind = r.random()
            if kind < 0.8:
                body = words(4, 60) + "."
                if r.random() < 0.2:
                    body += f' <a href="/x">{words(1, 3)}</a> {words(2, 9)}.'
                out += f"<p>{body}" + ("</p>" if r.random() < 0.8 else "")
            elif kind < 0.87:
                out += f"<h{r.choice('23')}>{words(2, 7)}</h2>"
            elif kind < 0.93:
                out += "<ul>" + "".join(f"<li>{words(3, 20)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
            elif kind < 0.96:
                out += f"<blockquote><p>{words(8, 40)}.</p></blockquote>"
            else:
                out += f"<pre>{words(4, 20)}</pre>" if r.random() < 0.5 else f"<table><tr><td>{words(1, 4)}<td>{words(1, 6)}</table>"
        return out

    def other(tag: str) -> str:
        hint = r.choice((*_OTHER[tag], ""))
        element = tag if r.random() < 0.6 or not hint else r.choice(("div", "section", "div"))
        if not hint and element == "div":
            hint = "ad"
        kind = r.random()
        if tag == "form" and r.random() < 0.7:
            body = f'<label>{words(1, 3)}</label><input name="q"><button>{words(1, 2)}</button>'
        elif tag == "section" or kind < 0.3:
            body = "".join(f"<div class=comment><p>{words(3, 50)}.</p></div>" if tag == "section" and r.random() < 0.5 else f"<p>{words(4, 60)}.</p>" for _ in range(r.randint(1, 8)))
        elif kind < 0.65:
            body = links()
        else:
            body = words(2, 30)
        if r.random() < 0.4:
            h = r.choice("1234" if tag == "header" else "2234")
            body = f"<h{h}>{words(1, 5)}</h{h}>{body}"
        if tag == "section" and element == "section" and not hint:
            hint = "comments"
        return f"<{element}{attribute(hint)}>{body}</{element}>"

    def parts(tags: tuple[str, ...], chance: float) -> str:
        return "".join(other(t) for t in tags if r.random() < chance)

    for _ in range(n):
        style = r.random()
        tag, hint = ("article", "") if style < 0.4 else ("article", r.choice(_CONTENT)) if style < 0.55 else ("main", r.choice((*_CONTENT, ""))) if style < 0.7 else (r.choice(("div", "section")), r.choice(_CONTENT))
        inner = (f"<h1>{words(2, 10)}</h1>" if r.random() < 0.8 else "") + prose(1, 12)
        within = [f"<{MARK}>{other(t)}</{MARK}>" for t in ("div", "aside", "form", "section") if r.random() < 0.15]
        inner += "".join(within) + (prose(0, 3) if within else "")
        content = f"<{tag}{attribute(hint)}>" + inner + f"</{tag}>"
        if r.random() < 0.3:
            content = f"<div{attribute(r.choice(('wrapper', 'container', 'page', 'layout')))}>{other('nav')}<{ARTICLE}>{content}</{ARTICLE}></div>"
        else:
            content = f"<{ARTICLE}>{content}</{ARTICLE}>"
        yield _labelled(f"<html><head><title>{words(2, 6)}</title></head><body>{parts(('header', 'nav', 'div', 'form'), 0.6)}{content}{parts(('section', 'aside', 'div', 'footer', 'form'), 0.6)}</body></html>")


#: Elements that only tell _labelled() where content begins and ends.
MARK, ARTICLE = "x-other", "x-content"


def _labelled(page: str) -> Tree:
    tree = parse(page)
    inside, place, kept = [0], [0], Tree([tree.nodes[0]])
    for node in tree.nodes[1:]:
        label = {ARTICLE: 1, MARK: 0}.get(node.tag, inside[node.parent])
        inside.append(label)
        if node.tag in (MARK, ARTICLE):
            place.append(place[node.parent])
            continue
        place.append(len(kept.nodes))
        kept.nodes.append(Node(node.tag, place[node.parent], node.hints, node.letters, node.linked, label))
    return kept


def main_text(page: str, model: Model) -> str:
    tree = parse(page)
    hidden = [n.tag in HIDDEN for n in tree.nodes]
    for v, node in enumerate(tree.nodes[1:], 1):
        hidden[v] |= hidden[node.parent]
    p = model.marginals(tree.nodes)
    return "\n".join(text for v, text in tree.blocks if p[v] > 0.5 and not hidden[v])


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars: a row per page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train(list(labelled_pages())))  # as large as the labelled pages' vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [main_text(h or "", m) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    out = pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
