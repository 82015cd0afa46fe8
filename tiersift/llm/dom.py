"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Nodes are the elements of a page that are not inline. Each has a weight for being content from its features
(tag, words of its class and id, length, links, paragraphs), and each pair of parent and child a potential by
the kind of the child. Sum-product messages go up from the leaves and down from the root, which gives exact
marginals; text whose nearest node has a marginal of at least 0.5 is content. Weights are trained in numpy, by
the gradient of the exact log likelihood, on pages that a generator makes and labels (``labelled_pages``).

Messages of all pages of a batch are passed together, a depth of the trees at a time.

Defined results: null and empty html, and pages without content, give empty text; a null url stays null;
unclosed and stray tags are taken as browsers do in the main (a new block ends an open paragraph); repeated rows
get equal results; an empty table gives an empty result; other columns are not read. Nothing is capped: a page is
read whole, and trees of any depth are walked without recursion.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import limit_batches

#: Elements by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title".split())
#: Elements whose text is not the page's, passed over if they are closed; left open, they are nodes like any other.
ASIDE = set("noscript template iframe svg select option button".split())
INLINE = set("a math mi mn mo mrow ms mtext abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TAGS = "body div article section main p h1 h2 h3 h4 ul ol li dl dt dd table tr td th blockquote pre figure figcaption nav header footer aside form address details menu fieldset".split()
#: Words in classes, ids and roles, by what they hint at.
HINTS = {
    "boiler": "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies copyright disclaimer footer gdpr header hero legal links login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion promoted related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget alert complementary contentinfo".split(),
    "comments": "comment comments commentlist discussion disqus replies reply respond responses".split(),
    "content": "article articlebody body content entry main post story text prose".split(),
}
#: A tag whose quoted values may hold ">", one whose may not, and what else "<" begins.
_strict = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_loose = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_begin = re.compile(r"<(?=[a-zA-Z!?/])")
_attributes = re.compile(r"""\b(class|id|role|aria-label|hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_parts = re.compile(r"[a-z]+|[A-Z][a-z]*")
_space = re.compile(r"[\s ]+")
#: Kinds of child in the potentials between parent and child.
KINDS = 4
N_FEATURES = 1 + len(TAGS) + 1 + 3 + 3 + 5 + 4 + 3
#: Nodes a depth, in the mean, below which they are passed one by one; nodes that go through the model together.
FEW_NODES, HELD_NODES = 6, 20_000


class Node:
    __slots__ = ("tag", "parent", "hints", "above", "chars", "linked", "index")

    def __init__(self, tag: str, parent: Node | None, hints: tuple[bool, ...], index: int):
        self.tag, self.parent, self.hints, self.index = tag, parent, hints, index
        self.above = tuple(a or b for a, b in zip(parent.above, parent.hints)) if parent else (False,) * 3
        self.chars = self.linked = 0


def hints_of(attributes: str) -> tuple[bool, ...]:
    return _hints(attributes) if len(attributes) > 200 else _short_hints(attributes)


def _hints(attributes: str) -> tuple[bool, ...]:
    words = {w.lower() for m in _attributes.finditer(attributes) for w in _parts.findall(m[2] or m[3] or m[4] or "")}
    return tuple(not words.isdisjoint(HINTS[k]) for k in ("boiler", "comments", "content"))


_short_hints = lru_cache(4096)(_hints)


class Open:
    """The open elements of a page, each with the block around it; where a tag is open last is known without a walk."""

    def __init__(self, root: Node):
        self.names, self.nodes, self.blocks = ["body"], [root], [0]
        self.places: dict[str, list[int]] = {}

    def last(self, tag: str) -> int:
        """Where a tag was opened last, or 0: the root is not closed."""
        found = self.places.get(tag)
        return found[-1] if found else 0

    def push(self, tag: str, node: Node, block: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.names))
        if block:
            self.blocks.append(len(self.names))
        self.names.append(tag)
        self.nodes.append(node)

    def cut(self, to: int) -> tuple[int, bool]:
        """Closes what was opened from place ``to`` on; the number of links among it, and whether a block was."""
        links = 0
        for name in reversed(self.names[to:]):
            self.places[name].pop()
            links += name == "a"
        del self.names[to:], self.nodes[to:]
        block = self.blocks[-1] >= to
        while self.blocks[-1] >= to:
            self.blocks.pop()
        return links, block


def ends_of(tag: str, page: str) -> dict[int, int]:
    """Where each element of a tag that is closed ends, by the end of its start tag; one walk over the page.

    An option's end tag may be left out: it ends before the next option and where its list does.
    """
    found: dict[int, int] = {}
    started: list[int] = []
    names = f"{tag}|optgroup|select|datalist" if tag == "option" else tag
    for m in re.compile(rf"<(/?)({names})(?=[\s/>])[^>]*>", re.I).finditer(page):
        own = m[2].lower() == tag
        if tag == "option" and started and not (own and m[1]):
            found[started.pop()] = m.start()
        if own and m[1]:
            if started:
                found[started.pop()] = m.end()
        elif own and not m[0].endswith("/>"):
            started.append(m.end())
    return found


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """(nodes, parents first; blocks (node, text) in page order). The time grows with the page's length, whatever is in it."""
    nodes = [Node("body", None, (False,) * 3, 0)]
    tree = Open(nodes[0])
    blocks: list[tuple[int, str]] = []
    held: list[str] = []
    links, at, n, linked = 0, 0, len(page), 0
    in_head, token, last = False, _strict, page.rfind(">")
    ends: dict[str, dict[int, int]] = {}

    def flush() -> None:
        nonlocal linked
        text = _space.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            node = tree.nodes[-1]
            blocks.append((node.index, text))
            node.chars += len(text)
            node.linked += min(linked, len(text))
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        if tree.blocks[-1] >= to:
            flush()
        links -= tree.cut(to)[0]

    def say(text: str) -> None:
        nonlocal linked
        if text and not in_head:
            text = entities.unescape(text)
            held.append(text)
            linked += len(text) if links else 0

    def aside(tag: str) -> dict[int, int]:
        if tag not in ends:
            ends[tag] = ends_of(tag, page)
        return ends[tag]

    while at < n:
        m = _begin.search(page, at)
        if not m or m.start() > last and not page.startswith("<!--", m.start()):
            say(page[at:])  # no tag ends after this
            break
        begin = m.start()
        say(page[at:begin])
        if page[begin + 1] in "!?" or page[begin + 1] == "/" and not page[begin + 2 : begin + 3].isalpha():
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                at = end + 3 if end >= 0 else n
            else:
                at = page.find(">", begin) + 1
            continue
        m = token.match(page, begin)
        if not m:
            token = _loose  # a quote is left open up to the page's end: from here on quotes hold no ">"
            m = token.match(page, begin)
        if not m:  # "<" before a letter beyond ASCII
            say("<")
            at = begin + 1
            continue
        at = m.end()
        ending, tag, attributes = m[1], m[2].lower(), m[3]
        if ending:
            if tag == "head":
                in_head = False
            elif tag not in ("html", "body"):
                place = tree.last(tag)
                if place and not (tag in INLINE and place < tree.blocks[-1]):
                    close(place)
                elif tag == "p":
                    flush()
            continue
        if tag == "head":
            in_head = True
        elif tag == "body":
            in_head = False
        elif tag == "html":
            pass
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
                end = page.find(">", end.end()) if end else -1
                at = end + 1 if end >= 0 else n
        elif tag in ASIDE and (attributes.endswith("/") or at in aside(tag)):
            if not attributes.endswith("/"):
                at = ends[tag][at]
        elif in_head and tag not in ("meta", "link", "base"):
            in_head = False
            at = begin
        elif tag in ("br", "wbr"):
            held.append(" " if tag == "br" else "")
        elif tag in VOID:
            if tag == "hr":
                flush()
        elif tag in INLINE:
            tree.push(tag, tree.nodes[-1], False)
            links += tag == "a"
        else:
            flush()
            if tag in CLOSES_P and tree.names[tree.blocks[-1]] == "p":
                close(tree.blocks[-1])
            elif tag in SAME:
                place = max(map(tree.last, SAME[tag]))
                if place > max(map(tree.last, SCOPE[tag])):
                    close(place)
            while tree.names[-1] in INLINE and tree.names[-1] != "a":
                tree.cut(len(tree.names) - 1)  # formatting that is left open ends with its block
            node = Node(tag, tree.nodes[-1], hints_of(attributes), len(nodes))
            nodes.append(node)
            tree.push(tag, node, True)
    flush()
    return nodes, blocks


_tag_number = {t: i for i, t in enumerate(TAGS)}
SECTIONS = set("nav header footer aside form menu fieldset".split())


@lru_cache(4096)
def _own_features(tag: str, hints: tuple[bool, ...], above: tuple[bool, ...]) -> tuple[int, ...]:
    """The kind of a node's edge, the numbers of the features that don't depend on its text, and room for the others."""
    at = 1 + len(TAGS)
    kind = 1 if tag in SECTIONS or hints[0] or hints[1] else 2 if hints[2] or tag in ("article", "main") else 3 if tag == "div" or tag == "section" else 0
    marks = [at + 1 + k if on else N_FEATURES for k, on in enumerate((*hints, *above))]
    return kind, 1 + _tag_number[tag] if tag in _tag_number else at, *marks, *[N_FEATURES] * 4


def features(nodes: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the numbers of each node's features, filled up with N_FEATURES, parents, kinds of the edges to them) of one page's nodes."""
    x = np.array([_own_features(e.tag, e.hints, e.above) for e in nodes], np.int16)
    kinds, x[:, 0] = x[:, 0].astype(np.int64), 0
    parents = [e.parent.index if e.parent else -1 for e in nodes]
    chars, linked, paragraphs = [e.chars for e in nodes], [e.linked for e in nodes], [int(e.tag == "p") for e in nodes]
    own = np.array(chars)
    for i in range(len(nodes) - 1, 0, -1):
        p = parents[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        paragraphs[p] += paragraphs[i]
    parents, chars, linked, paragraphs = map(np.array, (parents, chars, linked, paragraphs))
    at = 1 + len(TAGS) + 7
    x[:, 8] = at + np.digitize(own, (1, 25, 80, 250))
    x[:, 9] = at + 5 + np.digitize(linked / np.maximum(chars, 1), (0.05, 0.3, 0.7))
    x[:, 10] = at + 9 + np.digitize(paragraphs, (1, 3))
    return x, parents, kinds


def weighed(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The sum of the weights of each node's features."""
    return np.append(w, 0.0)[x].sum(1)


def joined(pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Pages as one forest: (features, parents, kinds, the nodes of each depth)."""
    starts = np.cumsum([0, *[len(p[0]) for p in pages]])
    x, kinds = np.concatenate([p[0] for p in pages]), np.concatenate([p[2] for p in pages])
    parents = np.concatenate([np.where(p[1] < 0, -1, p[1] + s) for p, s in zip(pages, starts)])
    depth = [0] * len(x)
    for i, p in enumerate(parents.tolist()):
        if p >= 0:
            depth[i] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return x, parents, kinds, np.split(order, np.cumsum(np.bincount(depth))[:-1])


def _log_sum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def sum_product(unary: np.ndarray, pair: np.ndarray, parents: np.ndarray, kinds: np.ndarray, levels: list[np.ndarray], with_edges: bool = True) -> tuple[np.ndarray, np.ndarray | None, float]:
    """(marginals of being content, marginals of the edges [node, parent's state, own state], log of the partition sum).

    unary: score of the content state of each node; pair: [kind, parent's state, own state]. Trees that are deeper than
    broad are passed node by node, as a depth of few nodes costs more than its nodes.
    """
    n = len(unary)
    if not with_edges and n < FEW_NODES * len(levels):
        return _by_node(unary, pair, parents, kinds, np.concatenate(levels).tolist(), len(levels[0]))
    up = np.zeros((n, 2))
    up[:, 1] = unary
    message = np.zeros((n, 2))  # from a node to its parent, by the parent's state
    for level in reversed(levels[1:]):
        message[level] = np.logaddexp(pair[kinds[level], :, 0] + up[level, :1], pair[kinds[level], :, 1] + up[level, 1:])
        for state in (0, 1):
            np.add.at(up[:, state], parents[level], message[level, state])
    down, edges = np.zeros((n, 2)), np.zeros((n, 2, 2)) if with_edges else None
    for level in levels[1:]:
        p = parents[level]
        without = up[p] + down[p] - message[level]  # all that the parent knows but from this child
        both = without[:, :, None] + pair[kinds[level]]
        down[level] = np.logaddexp(both[:, 0], both[:, 1])
        if with_edges:
            edge = both + up[level][:, None, :]
            edge = np.exp(edge - edge.max((1, 2), keepdims=True))
            edges[level] = edge / edge.sum((1, 2), keepdims=True)
    belief = up + down
    total = np.logaddexp(belief[:, 0], belief[:, 1])
    return np.exp(belief[:, 1] - total), edges, float(total[levels[0]].sum())


def _by_node(unary: np.ndarray, pair: np.ndarray, parents: np.ndarray, kinds: np.ndarray, order: list[int], roots: int) -> tuple[np.ndarray, None, float]:
    """sum_product() without edges, a node at a time. order: parents first."""
    potentials, parents, kinds = pair.tolist(), parents.tolist(), kinds.tolist()
    n = len(order)
    no, yes = [0.0] * n, unary.tolist()  # what is known from below
    to_no, to_yes = [0.0] * n, [0.0] * n
    for i in reversed(order[roots:]):
        (a, b), (c, d) = potentials[kinds[i]]
        to_no[i], to_yes[i] = _log_sum(a + no[i], b + yes[i]), _log_sum(c + no[i], d + yes[i])
        no[parents[i]] += to_no[i]
        yes[parents[i]] += to_yes[i]
    for i in order[roots:]:  # a parent's is whole by now
        (a, b), (c, d), p = *potentials[kinds[i]], parents[i]
        x, y = no[p] - to_no[i], yes[p] - to_yes[i]
        no[i] += _log_sum(x + a, y + c)
        yes[i] += _log_sum(x + b, y + d)
    no, yes = np.array(no), np.array(yes)
    total = np.logaddexp(no, yes)
    return np.exp(yes - total), None, float(total[order[:roots]].sum())


def labelled_pages(count: int = 400, seed: int = 3) -> list[tuple[str, str]]:
    """(html, main text) of made-up pages of many layouts: the training set's labels are known by construction."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chance = lambda p: rng.random() < p

    def words(k: int) -> str:
        return " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(rng.integers(2, 10)))) for _ in range(k))

    def prose(low: int = 4, high: int = 60) -> str:
        return " ".join(words(int(rng.integers(3, 15))).capitalize() + pick(".", ".", ".", "!", "?", ", etc.") for _ in range(max(1, int(rng.integers(low, high)) // 9)))

    def links() -> str:
        return "<ul>" + "".join(f'<li><a href="/{words(1)}">{words(int(rng.integers(1, 4)))}</a></li>' for _ in range(int(rng.integers(2, 9)))) + "</ul>"

    def boiler() -> str:
        inner = pick(links(), f"<p>{prose(3, 40)}</p>", prose(3, 30), f"<h3>{words(2)}</h3>" + pick(links(), f"<p>{prose()}</p>"), f"<div>{words(3)}</div><p>{prose()}</p><p>{prose()}</p>")
        name = pick(*HINTS["boiler"])
        name = name if chance(0.6) else pick(f"{name}-box", f"site-{name}", f"{name} {words(1)}")
        kind = int(rng.integers(6))
        if kind == 0:
            return f"<nav>{inner if chance(0.3) else links()}</nav>"
        if kind == 1:
            return f"<aside{pick('', f' class="{name}"')}>{inner}</aside>"
        if kind == 2:
            return f'<form action="/"><label>{words(2)}</label><p>{prose(3, 12)}</p><div>{words(3)}</div></form>'
        if kind == 3:
            return f'<div {pick("class", "id")}="{pick("comments", "comment-list", "replies", "discussion")}"><h3>{words(1)}</h3>' + "".join(f'<div class="comment"><p>{prose()}</p></div>' for _ in range(int(rng.integers(1, 5)))) + "</div>"
        tag = pick("div", "section")
        return f'<{tag} {pick("class", "id", "role")}="{name}">{inner}</{tag}>'

    made = []
    for _ in range(count):
        main, body = [], []

        def add(text: str, markup: str, tag: str, main: list = main, body: list = body) -> None:
            main.append(text)
            body.append(f"<{tag}>{markup}" + ("" if tag == "p" and chance(0.15) else f"</{tag}>"))

        if chance(0.8):
            t = words(int(rng.integers(2, 9)))
            add(t, t, pick("h1", "h1", "h2"))
        long = chance(0.1)  # articles of many, mostly short paragraphs
        for _ in range(int(rng.integers(14, 120) if long else rng.integers(1, 14))):
            kind = rng.random() * (0.78 if long else 1)
            if kind < 0.72:
                t = prose(2, 90) if chance(0.3 if long else 0.85) else words(int(rng.integers(1, 4))).capitalize() + "."
                add(t, t.replace(" ", ' <a href="/x">', 1).replace(".", "</a>.", 1) if chance(0.1) and " " in t and "." in t else t, "p")
            elif kind < 0.82:
                t = words(int(rng.integers(1, 6)))
                add(t, t, pick("h2", "h3"))
            elif kind < 0.9:
                items = [prose(2, 20) for _ in range(int(rng.integers(2, 5)))]
                main += items
                body.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif kind < 0.95:
                t = prose()
                add(t, t, pick("blockquote", "pre", "figcaption"))
            else:
                body.append(boiler())
        shell = rng.random()
        inner = "".join(body)
        if shell < 0.55:
            inner = f"<article>{inner}</article>"
        elif shell < 0.7:
            inner = f"<main>{inner}</main>"
        else:
            inner = f'<div {pick("class", "id")}="{pick(*HINTS["content"])}{pick("", "-body", " wide")}">{inner}</div>'
        if chance(0.3):
            inner = pick("<main>{}</main>", '<div class="wrap">{}</div>', '<div id="page">{}</div>').format(inner)
        head = "".join(boiler() for _ in range(int(rng.integers(0, 4)))) + pick("", f"<header>{pick(f'<h1>{words(2)}</h1>', f'<p>{prose(3, 15)}</p>', '')}{links()}</header>")
        foot = "".join(boiler() for _ in range(int(rng.integers(0, 4)))) + pick("", f"<footer>{pick(prose(), links(), f'<p>{prose()}</p>')}</footer>", f"<footer>{prose()}</footer>")
        made.append((f"<html><head><title>{words(3)}</title></head><body>{head}{inner}{foot}</body></html>", "\n".join(main)))
    return made


class Extractor:
    def __init__(self):
        self.w, self.pair = np.zeros(N_FEATURES), np.zeros((KINDS, 2, 2))

    def fit(self, pages: list[tuple[str, str]], rounds: int = 150, rate: float = 0.15, decay: float = 1e-4) -> Extractor:
        """Trains on (html, main text). A node is content if its own blocks are, or else most text below it."""
        made, labels = [], []
        for page, main in pages:
            nodes, blocks = parse(page)
            lines, good, all_ = main.split("\n"), np.zeros(len(nodes)), np.zeros(len(nodes))
            lines = {_space.sub(" ", x).strip() for x in lines}
            for i, text in blocks:
                good[i] += len(text) * (text in lines)
                all_[i] += len(text)
            own, own_all = good.copy(), all_.copy()
            for i in range(len(nodes) - 1, 0, -1):
                good[nodes[i].parent.index] += good[i]
                all_[nodes[i].parent.index] += all_[i]
            made.append(features(nodes))
            labels.append(np.where(own_all > 0, 2 * own > own_all, 2 * good > all_))
        x, parents, kinds, levels = joined(made)
        y = np.concatenate(labels).astype(int)
        child = np.flatnonzero(parents >= 0)
        seen = np.zeros_like(self.pair)
        np.add.at(seen, (kinds[child], y[parents[child]], y[child]), 1)
        first, second = ({"w": np.zeros_like(self.w), "pair": np.zeros_like(self.pair)} for _ in range(2))
        for t in range(1, rounds + 1):
            marginal, edges, _ = sum_product(weighed(x, self.w), self.pair, parents, kinds, levels)
            hoped = np.zeros_like(self.pair)
            for k in range(KINDS):
                hoped[k] = edges[child[kinds[child] == k]].sum(0)
            grads = {"w": np.bincount(x.ravel(), np.repeat(y - marginal, x.shape[1]), N_FEATURES + 1)[:-1] / len(x) - decay * self.w, "pair": (seen - hoped) / len(x) - decay * self.pair}
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                getattr(self, k)[...] += rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def extract(self, pages: list[str | None]) -> list[str]:
        """The main text of each page; pages go through the model together up to HELD_NODES nodes."""
        out: list[str] = []
        waiting, held = [], 0
        for k, page in enumerate(pages):
            waiting.append(parse(page or ""))
            held += len(waiting[-1][0])
            if held >= HELD_NODES or k == len(pages) - 1:
                x, parents, kinds, levels = joined([features(nodes) for nodes, _ in waiting])
                marginal, _, _ = sum_product(weighed(x, self.w), self.pair, parents, kinds, levels, False)
                at = 0
                for nodes, blocks in waiting:
                    out.append("\n".join(text for i, text in blocks if marginal[at + i] >= 0.5))
                    at += len(nodes)
                waiting, held = [], 0
        return out


@lru_cache(1)
def trained() -> Extractor:
    """The extractor trained on labelled_pages(), once a process."""
    return Extractor().fit(labelled_pages())


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    limit_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # a few hundred weights
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = shared.value.extract(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
