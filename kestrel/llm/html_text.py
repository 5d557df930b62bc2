"""Operator 1: main-text extraction with a tree-structured graphical model.

Method.  A page becomes a tree of its elements.  Each node is content or not; its potential is
log-linear in its tag, its class, id and role words, and the text and link share below it; an edge
potential couples parent and child.  Upward and downward sum-product messages, carried out level
by level for many pages at once, give exact marginals.  Weights and edge potentials are trained
by the exact likelihood gradient on labelled pages (``labelled_pages``: pages of many layouts
whose content elements are marked).  The text of the nodes more likely content than not is the
page's main text.

Text: character references are decoded; a block's white space becomes one space; blocks follow
in page order with one space between; nothing is dropped or cut otherwise.

Defined results: a null or empty page, or one without content, gives the empty text; unclosed,
misnested and cut-off markup is read as browsers do in the common cases, and a tag cut off by the
end of the page is not text; script, style, textarea, title, iframe, noscript and xmp are raw text
and not the page's, and so are titles, descriptions and annotations inside svg and math; all other
elements, svg, math, object, select and template among them, are nodes the model judges, an
unclosed select ends before the next block, and an unclosed template is judged as any element; rows that repeat give the same text; an empty table gives an empty
result.  Only page_id, url and html are read.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import text_slices

BITS = 14
LABEL = "data-y"
# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in "script style textarea title noscript iframe xmp".split()}
FOREIGN = frozenset(("svg", "math"))
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())       # HTML again, in svg and math
SILENT = frozenset("script style title desc metadata annotation annotation-xml".split())           # not shown, in svg and math
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th "
    "thead tr ul".split())
ENDS_P = BLOCK - frozenset("body button caption dd dt head html legend li option tbody td tfoot th thead tr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var".split())
BREAKOUT = BLOCK | frozenset("b big br code em embed i img meta nobr ruby s small span strike strong sub sup tt u var".split())  # ends svg and math
# A start tag on the left ends an open element of the first set unless one of the second lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)),
    "option": (("option",), ("select",)), "body": (("head",), ("html",)),
}
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/a-zA-Z][^>]*+\Z|[^<]++|<""", re.S | re.I)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+")
SCOPES = frozenset(("template", "foreignobject"))       # no start tag inside ends an element outside
SELF_CLOSED = re.compile(r"""(?<!=)(?:\A|[\s"'/]|[\s"'/][^\s"'=/]+|\A[^\s"'=/]+)/\Z""")


@dataclass
class Forest:
    """Element trees of many pages: parents (-1: root), depths, feature lists, text lengths, text runs."""

    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    keys: list[tuple[int, ...]] = field(default_factory=list)
    own: list[int] = field(default_factory=list)        # characters of the node's own text
    linked: list[int] = field(default_factory=list)     # of those, inside a link
    label: list[int] = field(default_factory=list)
    runs: list[list[tuple[int, str]]] = field(default_factory=list)    # by page: (node, text), node -1: block border


def _hash(s: str) -> int:
    h = 1469598103934665603
    for c in s.encode():
        h = ((h ^ c) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return (h ^ (h >> 31)) % ((1 << BITS) - 64) + 64        # the first 64 stand for sizes


@lru_cache(maxsize=20_000)
def _tag_features(tag: str, attrs: str) -> tuple[tuple[int, ...], int | None]:
    """Hashed features of a start tag, and the label it carries (in labelled pages)."""
    found, label = [_hash("<" + tag)], None
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == LABEL:
            label = int(value)
        elif name in ("class", "id", "role", "itemprop"):
            found += [_hash("." + w) for w in NAME.findall(value.lower())]
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.append(_hash("!hidden"))
    return tuple(dict.fromkeys(found)), label


def add_page(forest: Forest, html: str | None) -> None:
    """Parse one page into the forest."""
    parent, depth, runs = forest.parent, forest.depth, []
    forest.runs.append(runs)

    def open_(tag: str, attrs: str) -> None:
        keys, label = _tag_features(tag, attrs)
        _, up, foreign, silent = stack[-1] if stack else ("", -1, False, False)
        stack.append((tag, len(parent), tag in FOREIGN or foreign and tag not in HTML_INSIDE, silent or foreign and tag in SILENT))
        parent.append(up)
        depth.append(depth[up] + 1 if up >= 0 else 0)
        forest.keys.append(keys)
        forest.own.append(0)
        forest.linked.append(0)
        forest.label.append(label if label is not None else forest.label[up] if up >= 0 else 0)

    def close(i: int, named: bool = False) -> None:
        """End the elements from place ``i`` of the stack on; ``named``: the first by its own end tag."""
        nonlocal links
        for t, node, _, _ in stack[i + named:]:
            if t == "template":
                forest.keys[node] = ()              # never closed: what follows it is not its content
        links -= sum(x[0] == "a" for x in stack[i:])
        del stack[i:]

    stack: list[tuple[str, int, bool, bool]] = []
    open_("#page", "")
    links = 0
    html = html or ""
    tokens = TOKEN.finditer(html)
    while (m := next(tokens, None)) is not None:
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] == "<" and len(text) > 1 or stack[-1][3]:
                continue                            # comments, declarations, cut-off tags, text not shown
            if "&" in text:
                text = html_lib.unescape(text)
            node = stack[-1][1]
            runs.append((node, text))
            if not text.isspace():
                forest.own[node] += len(text)
                if links:
                    forest.linked[node] += len(text)
            continue
        tag = tag.lower()
        if tag in RAW and not m[1] and not stack[-1][2]:
            end = RAW[tag].search(html, m.end())
            tokens = TOKEN.finditer(html, end.end() if end else len(html))
            continue
        block = tag in BLOCK
        if block or tag == "br":
            runs.append((-1, " "))
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i, True)
                    break
                if tag in INLINE and stack[i][0] in BLOCK:
                    break                           # a format left open around a block ends with the block
            continue
        if stack[-1][2] and tag in BREAKOUT:
            close(next(i + 1 for i in range(len(stack) - 1, -1, -1) if not stack[i][2]))
        if tag in VOID:
            continue
        stops = ENDS.get(tag)
        if tag in ENDS_P:
            stops = (("p",), ("td", "th", "button", "caption", "object"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "select":
                    close(i)
                if i >= len(stack) or stack[i][0] not in ("option", "optgroup"):
                    break
        if stops:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in stops[0]:
                    close(i)
                    if tag not in ENDS or tag in ("li", "option", "body"):
                        break
                elif i < len(stack) and (stack[i][0] in stops[1] or stack[i][0] in SCOPES):
                    break
        foreign = stack[-1][2] or tag in FOREIGN
        open_(tag, m[3])
        links += tag == "a"
        if foreign and SELF_CLOSED.search(m[3]):
            close(len(stack) - 1, True)
    close(1)


class Tree:
    """Arrays of a forest, with its nodes in order of depth."""

    def __init__(self, forest: Forest):
        self.parent = np.array(forest.parent, np.int64)
        depth = np.array(forest.depth, np.int64)
        order = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, (depth.max() if len(depth) else 0) + 2))
        self.levels = np.split(order, cuts[:-1]) if len(depth) else []
        text, link = np.array(forest.own, np.float64), np.array(forest.linked, np.float64)
        for nodes in self.levels[:0:-1]:
            text += np.bincount(self.parent[nodes], weights=text[nodes], minlength=len(text))
            link += np.bincount(self.parent[nodes], weights=link[nodes], minlength=len(text))
        size = np.minimum(np.log2(text + 1).astype(int), 15)
        share = np.where(text > 0, np.minimum((4 * link / np.maximum(text, 1)).astype(int), 3), 4)
        n = [len(k) for k in forest.keys]
        self.node = np.concatenate([np.repeat(np.arange(len(n)), n), np.arange(len(n)), np.arange(len(n))]).astype(np.int64)
        self.feature = np.concatenate([np.fromiter((f for k in forest.keys for f in k), np.int64, sum(n)), size, 16 + share]).astype(np.int64)
        self.size = len(n)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights=weights[self.feature], minlength=self.size)

    def marginals(self, unary: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum-product: probability of content at every node, and expected label pairs over the edges."""
        up = np.stack([np.zeros(self.size), unary])             # own potential and messages from below
        sent = np.zeros((2, self.size))
        for nodes in self.levels[:0:-1]:
            for a in (0, 1):
                sent[a, nodes] = np.logaddexp(edge[a, 0] + up[0, nodes], edge[a, 1] + up[1, nodes])
                up[a] += np.bincount(self.parent[nodes], weights=sent[a, nodes], minlength=self.size)
        full = up.copy()
        pairs = np.zeros((2, 2))
        for nodes in self.levels[1:]:
            above = full[:, self.parent[nodes]] - sent[:, nodes]
            joint = [[above[a] + edge[a, b] + up[b, nodes] for b in (0, 1)] for a in (0, 1)]
            total = np.logaddexp(np.logaddexp(joint[0][0], joint[0][1]), np.logaddexp(joint[1][0], joint[1][1]))
            for a in (0, 1):
                for b in (0, 1):
                    pairs[a, b] += np.exp(joint[a][b] - total).sum()
            for b in (0, 1):
                full[b, nodes] = up[b, nodes] + np.logaddexp(above[0] + edge[0, b], above[1] + edge[1, b])
        return 1 / (1 + np.exp(np.clip(full[0] - full[1], -500, 500))), pairs


@dataclass
class ContentModel:
    weights: np.ndarray
    edge: np.ndarray

    def main_texts(self, pages: list[str | None]) -> list[str]:
        forest = Forest()
        for html in pages:
            add_page(forest, html)
        if not pages:
            return []
        tree = Tree(forest)
        content = (tree.marginals(tree.unary(self.weights), self.edge)[0] > 0.5).tolist()
        return [" ".join("".join([t if n < 0 or content[n] else " " for n, t in runs]).split()) for runs in forest.runs]


def labelled_pages(count: int = 600, seed: int = 7) -> list[str]:
    """Pages of many layouts; content elements carry ``data-y="1"``, what is not content inside them ``data-y="0"``."""
    rng = np.random.default_rng(seed)
    pick = lambda *xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(pick("ka", "lo", "mi", "ren", "st", "ou", "ti", "be", "dor", "qu") for _ in range(rng.integers(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    items = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.integers(2, 9))) + "</ul>"
    filler = lambda: pick(words(2, 14), f"<p>{words(2, 30)}</p>", items(), link() + " " + link(), f"<h3>{words(1, 5)}</h3>" + items())

    def part() -> str:
        """One block of an article."""
        kind = rng.integers(12)
        if kind < 6:
            return f"<p>{words(1, 90)}</p>"
        if kind == 6:
            return f"<p><b>{words(1, 40)}<br><p>{words(1, 60)}</p>"
        if kind == 7:
            return f"<{(h := pick('h2', 'h3'))}>{words(1, 8)}</{h}>"
        if kind == 8:
            return "<ul>" + "".join(f"<li>{words(1, 14)}</li>" for _ in range(rng.integers(2, 6))) + "</ul>"
        if kind == 9:
            return f"<blockquote><p>{words(5, 40)}</p></blockquote>"
        if kind == 10:
            return f"<table><tr><th>{word()}<td>{words(1, 5)}</table>" if rng.random() < 0.5 else f"<pre>{words(3, 30)}</pre>"
        return f"<p>{words(3, 30)} {link()} <em>{words(1, 6)}</em> {words(1, 30)}</p><figure><img src=x><figcaption>{words(2, 9)}</figcaption></figure>"

    def aside() -> str:
        """Something that is not part of the article, as found around and inside it."""
        name = pick("ad", "ads", "advert", "advertisement", "banner", "sponsor", "promo", "share", "social", "related", "newsletter", "cookie",
                    "notice", "consent", "popup", "modal", "breadcrumb", "sidebar", "widget", "comments", "comment", "replies", "subscribe",
                    "menu", "nav", "footer", "copyright", "login", "search", "tags", "pagination", "disqus", "alert", "toolbar")
        body = filler()
        if name in ("comments", "comment", "replies", "disqus"):
            body = "".join(f'<div class="comment"><b>{word()}</b><p>{words(3, 60)}</p></div>' for _ in range(rng.integers(1, 6)))
        return pick(f'<div class="{name}" {LABEL}="0">{body}</div>', f'<div id="{name}" {LABEL}="0">{body}</div>',
                    f'<section class="{name}" {LABEL}="0">{body}</section>', f'<aside {LABEL}="0">{body}</aside>',
                    f'<aside class="{name}" {LABEL}="0">{body}</aside>', f'<form {LABEL}="0">{words(1, 6)}<label>{words(1, 4)}</label><button>{word()}</button></form>',
                    f'<nav {LABEL}="0">{items()}</nav>', f'<div role="{pick("complementary", "navigation", "banner", "contentinfo", "search")}" {LABEL}="0">{body}</div>')

    def embedded() -> str:
        """An element with content of its own kind, in an article."""
        return (lambda: f"<p>{words(1, 30)} <math><mi>{words(1, 3)}</mi><mo>=</mo><mrow><mn>{words(1, 3)}</mn></mrow></math> {words(1, 30)}</p>",
                lambda: f"<math><mi>{words(1, 6)}</mi></math>",
                lambda: f"<object data=x>{words(2, 20)}</object>",
                lambda: f"<object><p>{words(2, 40)}</p></object>",
                lambda: "<svg class='i'/>",
                lambda: f"<figure><svg><g><text>{words(1, 4)}</text><path d='M0'/></g></svg><figcaption>{words(2, 9)}</figcaption></figure>",
                lambda: f'<select {LABEL}="0">' + "".join(f"<option>{words(1, 4)}</option>" for _ in range(rng.integers(1, 6))) + "</select>",
                lambda: f'<template {LABEL}="0"><p>{words(2, 40)}</p><div>{words(1, 9)}</div></template>')[rng.integers(8)]()

    pages = []
    for _ in range(count):
        inner = [f"<h1>{words(2, 10)}</h1>"] if rng.random() < 0.8 else []
        inner += [part() for _ in range(rng.integers(1, 12))]
        for _ in range(rng.integers(0, 4)):
            if rng.random() < 0.8:
                inner.insert(int(rng.integers(len(inner) + 1)), aside())
        inner = "".join(inner)
        name = pick("content", "article", "post", "entry", "story", "main", "text", "body", "post content", "entry content", "article body")
        kind = rng.integers(8)
        if kind < 4:
            body = f'<article {LABEL}="1">{inner}</article>'
        elif kind == 4:
            body = f'<main>{aside() if rng.random() < 0.4 else ""}<article class="{name}" {LABEL}="1">{inner}</article>{aside() if rng.random() < 0.4 else ""}</main>'
        elif kind == 5:
            body = f'<main {LABEL}="1">{inner}</main>'
        elif kind == 6:
            body = f'<div id="{pick("wrap", "page", "container")}"><div class="{name}" {LABEL}="1">{inner}</div></div>'
        else:
            body = f'<div class="{name}" {LABEL}="1"><div>{inner}</div></div>'
        head = pick(f"<nav>{items()}</nav>", f"<header><h2>{words(1, 4)}</h2><nav>{items()}</nav></header>", f"<header>{words(1, 8)}</header><nav>{items()}</nav>")
        foot = pick(f"<footer>&copy; {words(2, 12)}</footer>", f"<footer><p>{words(3, 20)}</p>{items()}</footer>", f'<div class="footer">{filler()}</div>')
        around = [aside() if rng.random() < 0.5 else f'<div class="{pick("ad", "ads", "banner")}">{words(3, 30)}</div>' for _ in range(rng.integers(0, 3))]
        side = f"<aside>{filler()}</aside>" if rng.random() < 0.3 else ""
        body = f"{head if rng.random() < 0.9 else ''}{''.join(around)}{body}{side}{foot if rng.random() < 0.9 else ''}"
        pages.append(f"<!DOCTYPE html><html><head><title>{words(2, 8)}</title></head><body>{body}</body></html>" if rng.random() < 0.8 else body)
    for _ in range(count // 5):
        inner = [f"<h1>{words(2, 10)}</h1>"] + [part() if rng.random() < 0.7 else embedded() for _ in range(rng.integers(3, 12))]
        inner = "".join(inner + [aside()] * (rng.random() < 0.4))
        pages.append(f'<body><nav>{items()}</nav><main {LABEL}="1">{inner}</main><footer>{words(2, 12)}</footer></body>')
    return pages


def train(pages: list[str], rounds: int = 150) -> ContentModel:
    """Maximum likelihood on labelled pages, by exact gradients and Adam."""
    forest = Forest()
    for html in pages:
        add_page(forest, html)
    tree = Tree(forest)
    y = np.array(forest.label)
    edges = np.nonzero(tree.parent >= 0)[0]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[tree.parent[edges]], y[edges]), 1)
    size = 1 << BITS
    gold = np.bincount(tree.feature, weights=y[tree.node], minlength=size)
    theta, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, rounds + 1):
        p, pairs = tree.marginals(tree.unary(theta[:size]), theta[size:].reshape(2, 2))
        grad = np.concatenate([gold - np.bincount(tree.feature, weights=p[tree.node], minlength=size), (seen - pairs).ravel()])
        grad = grad / len(pages) - 4e-4 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta += 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return ContentModel(theta[:size], theta[size:].reshape(2, 2))


def extract_main_text(pages: DataFrame, model: ContentModel | None = None) -> DataFrame:
    """(page_id, url, text) of every page; the model is trained on ``labelled_pages`` unless given."""
    kept = model or train(labelled_pages())

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html", 2 << 20):
                texts = kept.main_texts(part.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(run, "page_id long, url string, text string"))
