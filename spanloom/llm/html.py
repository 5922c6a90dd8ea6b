"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded over the tree.

A page becomes a tree of block elements; inline elements are part of the block
around them, and scripts, styles and controls are no text. Each node gets
features of its tag, attribute tokens, subtree (text, link and node density),
depth, ancestors and siblings. Boosted trees give the probability that a node
belongs to the article. Decoding picks the likeliest labels under which every
path from the root goes outside -> inside -> excluded and never back, so no node
contradicts its ancestors or descendants.

The trees are fitted here, on at most `sample_pages` pages (those whose hash is
lowest among pages of at most `sample_chars` characters): on pages with an ``article`` or ``main`` element as they are, and on
the same blocks of text set in random other layouts whose nodes are known.

Defined cases: null and blank html give the empty text; unclosed and stray tags
are repaired as browsers do for blocks and paragraphs, in time linear in the
page, however deep or broken it is; a control or drawing that is not closed ends
at the next part of the page; with no page to learn
from, or none with both kinds of node, the layouts alone are learned from; equal
pages give equal texts; nothing of a page is cut, however long; of equally likely
labels the earlier of outside, inside, excluded is taken; other columns, of any
name, play no part.
"""

from __future__ import annotations

import bisect
import html as _html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

# Fixed values of HTML: elements without content, inline elements, and elements whose content is not text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr hr picture source".split())
SILENT = frozenset("script style noscript template title textarea select button svg iframe object canvas math".split())
RAW = frozenset("script style title textarea iframe".split())
BODY = frozenset("article main section nav header footer aside p h1 h2 h3 h4 h5 h6 table ul ol".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

TAG_GROUPS = ["article main", "nav menu", "header", "footer", "aside", "form fieldset", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl", "li dt dd", "table tbody thead tr td th", "blockquote pre figure figcaption", "body html head"]
TOKEN_GROUPS = [
    "article content post entry story main body text prose page-content post-body articlebody",
    "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "ad ads advert adverts advertisement sponsor sponsored promo promotion banner adsense adslot dfp",
    "comment comments reply replies disqus discussion respond commentlist responses",
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup paywall",
    "sidebar side widget related recommended recommendations share sharing social tags more trending popular author-box",
    "header masthead footer copyright legal colophon topbar bottom site-info logo search login complementary contentinfo",
]
_TAG = {t: k for k, g in enumerate(TAG_GROUPS) for t in g.split()}
_TOKEN = {t: k for k, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ENDS = re.compile(r"[>\"']")
_NAMED = re.compile(r"""\b(class|id|role|x-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_END_OF = {name: re.compile(rf"</{name}[^>]*(?:>|\Z)", re.I) for name in RAW}
_PARTS = re.compile(r"[a-z]+(?:-[a-z]+)*")


def _attributes(raw: str, cache: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """(bits of the token groups, what x-main says or -1: it counts in layouts made here alone)."""
    if raw not in cache:
        bits, label = 0, -1
        for name, *values in _NAMED.findall(raw):
            value = next((v for v in values if v), "").lower()
            if name.lower() == "x-main":
                label = int(value) if value in ("0", "1") else -1
                continue
            for token in _PARTS.findall(value.replace("_", "-")):
                for part in {token, *token.split("-")}:
                    if part in _TOKEN:
                        bits |= 1 << _TOKEN[part]
        if len(cache) > 50_000:
            cache.clear()
        cache[raw] = bits, label
    return cache[raw]


class Markup:
    """Finds the markup of a text, in time linear in it: where a quote, comment or tag is not closed, that is looked for once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.none: set[str] = set()  # what does not come again before the end

    def find(self, what: str, pos: int) -> int:
        if what in self.none:
            return -1
        at = self.text.find(what, pos)
        if at < 0:
            self.none.add(what)
        return at

    def tag_end(self, pos: int) -> int:
        """Place of the > that ends a tag whose name ends at pos: the first one outside quotes, or else the first one at all."""
        at = pos
        while True:
            m = _ENDS.search(self.text, at)
            if not m:
                return -1
            if m[0] == ">":
                return m.start()
            shut = self.find(m[0], m.end())
            if shut < 0:  # a quote that never ends is none
                return self.find(">", m.end())
            at = shut + 1

    def next(self, pos: int) -> tuple[int, int, str, bool, str]:
        """(start, end, name, closing, attributes) of the next markup; comments and the like have no name; start is -1 at the end."""
        text = self.text
        while True:
            at = self.find("<", pos)
            if at < 0:
                return -1, len(text), "", False, ""
            if text.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(text), "", False, ""
            closing = text.startswith("</", at)
            name = _NAME.match(text, at + 1 + closing)
            if name:
                end = self.tag_end(name.end())
                if end >= 0:
                    return at, end + 1, name[0].lower(), closing, text[name.end() : end]
            elif text.startswith(("<!", "<?"), at):
                end = self.find(">", at)
                if end >= 0:
                    return at, end + 1, "", False, ""
            pos = at + 1  # a plain <


class Page:
    """Nodes in page order (parent before child) and the pieces of text between block borders.

    Of a silent element that is closed nothing is text, whatever stands in it; one that is not closed ends where the page goes
    on. Marks are read only where `marked` says that the page is a layout made here.
    """

    def __init__(self, source: str | None, cache: dict, marked: bool = False) -> None:
        self.parent, self.depth, self.tag, self.bits, self.label = [-1], [0], [_TAG["body"]], [0], [-1]
        self.pieces: list[tuple[int, int, str, bool]] = []  # node, block, raw text, in a link
        stack: list[tuple[str, int]] = [("html", 0)]  # open elements and the node that holds their text
        where: dict[str, list[int]] = {}  # places in the stack of the open elements of each name
        blocks = [0]  # places of block elements in the stack
        block = links = silent = pos = 0
        text = source or ""
        markup = Markup(text)
        ends: dict[str, tuple[list[int], list[int], list[int]]] = {}

        def outer() -> int:
            """Place of the outermost silent element that is open."""
            return min(where[n][0] for n in SILENT if where.get(n))

        def shuts(at: int) -> bool:
            """Whether the element at this place of the stack is closed further on: its end tags, less new start tags, are enough."""
            name = stack[at][0]
            if name not in ends:
                tags = [(m.start(), -1 if m[1] else 1) for m in re.finditer(rf"<(/?){name}(?=[\s/>])[^<>]*", text, re.I) if m[1] or not m[0].endswith("/")]
                level = np.cumsum([d for _, d in tags]) if tags else np.zeros(0, np.int64)
                ends[name] = [x for x, _ in tags], [0, *level.tolist()], np.minimum.accumulate(level[::-1])[::-1].tolist()
            places, level, least = ends[name]
            k = bisect.bisect_left(places, pos)
            return k < len(places) and least[k] - level[k] <= -len(where[name])

        def push(name: str, node: int) -> None:
            nonlocal links, silent
            where.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, node))
            links += name == "a"
            silent += name in SILENT

        def cut(at: int) -> None:
            nonlocal links, silent
            while len(stack) > at:
                name, _ = stack.pop()
                where[name].pop()
                links -= name == "a"
                silent -= name in SILENT
            while blocks[-1] >= at:
                blocks.pop()

        def last(*names: str) -> int:
            return max((where[n][-1] for n in names if where.get(n)), default=0)

        while pos < len(text):
            start, end, name, closing, attrs = markup.next(pos)
            stop = start if start >= 0 else len(text)
            if stop > pos and not silent:
                self.pieces.append((stack[-1][1], block, text[pos:stop], links > 0))
            if start < 0:
                break
            pos = end
            if not name:
                continue
            if closing:
                at = last(name)
                if silent and at < outer() and shuts(outer()):
                    continue
                if name == "p" and not at:
                    block += 1
                if at and not (name in INLINE and blocks[-1] > at):
                    block += blocks[-1] >= at
                    cut(at)
                continue
            if name in RAW:  # the text up to the element's own end tag
                shut = _END_OF[name].search(text, pos) if f"</{name}" not in markup.none else None
                if shut is None:
                    markup.none.add(f"</{name}")
                pos = shut.end() if shut else len(text)
                if name != "title" and not silent:
                    self.pieces.append((stack[-1][1], block, " ", links > 0))
                continue
            if name in SILENT:
                if not silent:
                    self.pieces.append((stack[-1][1], block, " ", links > 0))
                if not attrs.endswith("/"):
                    push(name, stack[-1][1])
                continue
            if name in INLINE or name in VOID:
                if name in ("br", "hr") and not silent:
                    self.pieces.append((stack[-1][1], block, " ", links > 0))
                if name not in VOID:
                    push(name, stack[-1][1])
                continue
            if silent and shuts(outer()):
                if not attrs.endswith("/"):
                    push(name, stack[-1][1])
                continue
            if silent and name in BODY:
                cut(outer())
            block += 1
            shut = 0
            if name in CLOSES_P:
                shut = last("p")
            elif name in ("li", "td", "th", "tr", "dt", "dd", "option"):
                same = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th")}.get(name, (name,))
                shut = last(*same)
                if shut < last("ul", "ol", "table", "dl", *(("tr",) if name != "tr" else ())):
                    shut = 0
            if shut:
                cut(shut)
            bits, label = _attributes(attrs, cache)
            self.parent.append(stack[-1][1])
            self.depth.append(self.depth[stack[-1][1]] + 1)
            self.tag.append(_TAG.get(name, len(TAG_GROUPS)))
            self.bits.append(bits)
            self.label.append(label if marked else -1)
            if not attrs.endswith("/"):
                push(name, len(self.parent) - 1)

    def text(self, inside: np.ndarray) -> str:
        blocks, last = [], None
        for node, block, raw, _ in self.pieces:
            if inside[node]:
                if last != (node, block):
                    blocks.append([])
                    last = node, block
                blocks[-1].append(raw)
        joined = (" ".join(_html.unescape("".join(b)).split()) for b in blocks)
        return " ".join(b for b in joined if b)


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(features, parent or -1, depth, first node of each page) over the nodes of all pages."""
    first = np.concatenate(([0], np.cumsum([len(p.parent) for p in pages]))).astype(np.int64)
    parent = np.concatenate([np.array(p.parent) + f for p, f in zip(pages, first)])
    parent[first[:-1]] = -1
    n = len(parent)
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    tag = np.concatenate([np.array(p.tag) for p in pages])
    bits = np.concatenate([np.array(p.bits) for p in pages])
    own, linked, stops = np.zeros(n), np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first):
        for node, _, raw, link in p.pieces:
            size = len(raw) if not raw.isspace() else 0
            own[f + node] += size
            if link:
                linked[f + node] += size
            elif size:
                stops[f + node] += raw.count(".") + raw.count(",")
    depth = np.concatenate([np.array(p.depth) for p in pages])
    by_depth = np.argsort(depth, kind="stable")
    order = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)  # level by level
    whole, link_all, stop_all, nodes, longest = own.copy(), linked.copy(), stops.copy(), np.ones(n), own.copy()
    for now in reversed(order[1:]):
        for x in (whole, link_all, stop_all, nodes):
            np.add.at(x, parent[now], x[now])
        np.maximum.at(longest, parent[now], longest[now])
    above = np.zeros(n, np.int64)  # token and tag groups of the ancestors
    for now in order[1:]:
        up = parent[now]
        above[now] = above[up] | bits[up] | (1 << (tag[up] + 8))
    kids = np.bincount(parent[parent >= 0], minlength=n)
    up = np.maximum(parent, 0)
    same = np.where(parent >= 0, kids[up], 1)
    rank = np.zeros(n)
    by_parent = np.lexsort((np.arange(n), parent))
    begin = np.concatenate(([True], parent[by_parent][1:] != parent[by_parent][:-1]))
    rank[by_parent] = np.arange(n) - np.maximum.accumulate(np.where(begin, np.arange(n), 0))
    before = np.zeros(n)
    before[by_parent[1:]] = np.where(begin[1:], 0, whole[by_parent[:-1]])
    rank[first[:-1]] = before[first[:-1]] = 0
    sibling_text = np.where(parent >= 0, whole[up] - own[up], whole)
    total = np.maximum(whole[first[:-1]][page], 1)
    log = np.log1p
    columns = [(tag == k) for k in range(len(TAG_GROUPS) + 1)]
    columns += [bits >> k & 1 for k in range(len(TOKEN_GROUPS))]
    columns += [above >> k & 1 for k in range(len(TOKEN_GROUPS))]
    columns += [above >> (8 + k) & 1 for k in range(len(TAG_GROUPS) - 1)]
    # the same by kind: regions that are never, or often, the article
    never = sum(1 << (8 + k) for k in range(1, 6)) | sum(1 << k for k in range(1, len(TOKEN_GROUPS)))
    often = 1 << 8 | 1
    self_bits = bits | 1 << (tag + 8)
    columns += [(x & m) > 0 for m in (never, often) for x in (self_bits, above, self_bits | above)]
    columns += [depth, log(own), log(whole), log(longest), log(stop_all), link_all / np.maximum(whole, 1), whole / total, whole / nodes, stop_all / np.maximum(whole, 1) * 100, log(nodes), kids, same, rank / np.maximum(same, 1), log(before), whole / np.maximum(sibling_text, 1), log(np.maximum(sibling_text - whole, 0) / np.maximum(same - 1, 1)), log(own[up])]
    return np.column_stack(columns).astype(np.float64), parent, depth, first


def decode(p: np.ndarray, parent: np.ndarray, depth: np.ndarray, weight: np.ndarray, leave: float = 5.0) -> np.ndarray:
    """inside or not: the best labels with outside -> inside -> excluded on every path.

    A node counts by its weight; to exclude a part of what is inside costs `leave`, so that a doubt about a short block doesn't.
    """
    p = np.clip(p, 1e-4, 1 - 1e-4)
    yes, no = weight * np.log(p), weight * np.log(1 - p)
    best = np.stack((no, yes, no))  # outside, inside, excluded; then with the children's best
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    for now in reversed(levels[1:]):
        out, ins, exc = best[:, now]
        np.add.at(best[0], parent[now], np.maximum(out, ins))
        np.add.at(best[1], parent[now], np.maximum(ins, exc - leave))
        np.add.at(best[2], parent[now], exc)
    state = np.zeros(len(p), np.int8)
    roots = levels[0]
    state[roots] = np.where(best[1, roots] > best[0, roots], 1, 0)
    for now in levels[1:]:
        up = state[parent[now]]
        out, ins, exc = best[:, now]
        state[now] = np.where(up == 0, np.where(ins > out, 1, 0), np.where(up == 1, np.where(exc - leave > ins, 2, 1), 2))
    return state == 1


def labels(pages: list[Page]) -> np.ndarray:
    """Of training pages: what the nearest marked ancestor says, or an article or main element where nothing is marked."""
    out = []
    for p in pages:
        y = [0] * len(p.parent)
        marked = any(x >= 0 for x in p.label)
        for k in range(1, len(p.parent)):
            y[k] = p.label[k] if p.label[k] >= 0 else y[p.parent[k]]
            if not marked:
                y[k] = 0 if p.bits[k] & 0b1111110 else 1 if p.tag[k] == 0 else y[p.parent[k]]
        out += y
    return np.array(out, np.int64)


def layout(article: list[str], other: list[str], r: random.Random) -> str:
    """A page in a random layout, its regions marked with x-main. `other` are texts of menus, notices and the like."""
    esc = _html.escape
    said = lambda: esc(r.choice(other) if other else "Read more")
    word = lambda: esc((r.choice(other).split() or ["Home"])[0] if other else "Home")
    links = lambda n: "".join(f'<li><a href="/{k}">{word()}</a></li>' for k in range(n))
    def mark(group: int, extra: str = "") -> str:
        token = r.choice(TOKEN_GROUPS[group].split())
        token = r.choice([token, f"{token}-box", f"site-{token}", f"{token} clearfix", f"main-{token}" if group else token])
        return f'{r.choice(["class", "id"])}="{token}"{extra}' if r.random() < 0.9 else extra

    def off(tag: str, group: int, inner: str) -> str:
        return f'<{tag} {mark(group)} x-main="0">{inner}</{tag}>'

    extras = {
        "nav": lambda: off(r.choice(["nav", "div", "ul"]), 1, f"<ul>{links(r.randint(3, 9))}</ul>"),
        "ad": lambda: off(r.choice(["div", "aside", "section", "p"]), 2, said()),
        "comments": lambda: off(r.choice(["section", "div", "ol"]), 3, "".join(f'<{t} class="{r.choice(["comment", "reply", "item", "response"])}"><p>{said()}</p></{t}>' for t in r.choices(["div", "article", "li"], k=r.randint(1, 4)))),
        "notice": lambda: off(r.choice(["div", "section", "aside"]), 4, f"<p>{said()}</p>" + ("<button>OK</button>" if r.random() < 0.5 else "")),
        "side": lambda: off(r.choice(["aside", "div", "section"]), 5, f"<h3>{word()}</h3>" + (f"<ul>{links(r.randint(2, 6))}</ul>" if r.random() < 0.6 else f"<p>{said()}</p>")),
        "form": lambda: f'<form x-main="0" action="/s"><label>{word()}</label><input name="q"><p>{said()}</p></form>',
        "plain_aside": lambda: f'<aside x-main="0"><p>{said()}</p></aside>',
    }
    head = f'<{(t := r.choice(["header", "div"]))} {mark(6)} x-main="0"><h2>{word()}</h2>{extras["nav"]() if r.random() < 0.5 else f"<p>{said()}</p>"}</{t}>'
    foot = f'<{(t := r.choice(["footer", "footer", "div"]))} {mark(6) if t == "div" or r.random() < 0.4 else ""} x-main="0">&copy; {said()}</{t}>'
    body, tag = [], r.choice(["p", "p", "p", "div"])
    for k, text in enumerate(article):
        shut = "" if tag == "p" and r.random() < 0.1 else f"</{tag}>"
        text = esc(text)
        if k == 0 and r.random() < 0.8:
            body.append(f"<h1>{text}</h1>")
        elif r.random() < 0.08:
            body.append("<ul>" + "".join(f"<li>{esc(x)}</li>" for x in re.split(r"(?<=\.) ", text)[:6] or [text]) + "</ul>")
        elif r.random() < 0.06:
            body.append(f"<blockquote><p>{text}</p></blockquote>")
        elif r.random() < 0.06:
            body.append(f"<h2>{' '.join(text.split()[:6])}</h2>")
        else:
            body.append(f"<{tag}>{'<b>' if r.random() < 0.1 else ''}{text}{'<br>' if r.random() < 0.1 else ''}{shut}")
        if r.random() < 0.07:
            body.append(extras[r.choice(["ad", "notice", "side", "form", "plain_aside"])]())
    if r.random() < 0.3:
        body.append(extras[r.choice(["comments", "side", "form"])]())
    form = r.choice(["article", "article", "main", "div", "div", "section", "td"])
    inner = "".join(body)
    core = f'<article x-main="1">{inner}</article>' if form == "article" else f'<{form} {mark(0) if form in ("div", "section") else ""} x-main="1">{inner}</{form}>' if form != "td" else f'<table><tr><td x-main="1" {mark(0)}>{inner}</td></tr></table>'
    if r.random() < 0.3:
        core = f'<div class="{r.choice(["wrapper", "container", "row", "page"])}">{core}{extras["side"]() if r.random() < 0.5 else ""}</div>'
    around = [extras[k]() for k in r.sample(sorted(extras), r.randint(0, 3))]
    after = [extras[k]() for k in r.sample(sorted(extras), r.randint(0, 3))]
    top = [head] * (r.random() < 0.7) + [extras["nav"]()] * (r.random() < 0.7)
    return "<html><head><title>" + said() + "</title></head><body>" + "".join([*top, *around, core, *after]) + (foot if r.random() < 0.9 else "") + "</body></html>"


def _arrays(model: object) -> list[tuple[np.ndarray, ...]]:
    """Each tree as (feature or -1, threshold, left, right, value); its values carry the tree's weight."""
    out = []
    for tree, weight in zip(model.trees, model.treeWeights):
        nodes: list[list] = []

        def add(node: object) -> int:
            k = len(nodes)
            nodes.append([-1, 0.0, k, k, node.prediction() * weight])
            if node.numDescendants():
                split = node.split()
                nodes[k][:2] = [split.featureIndex(), split.threshold()]
                nodes[k][2] = add(node.leftChild())
                nodes[k][3] = add(node.rightChild())
            return k

        add(tree._call_java("rootNode"))
        out.append(tuple(np.array(x) for x in zip(*nodes)))
    return out


def probability(trees: list[tuple[np.ndarray, ...]], x: np.ndarray) -> np.ndarray:
    margin = np.zeros(len(x))
    for feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), np.int64)
        while True:
            f = feature[at]
            move = np.flatnonzero(f >= 0)
            if not len(move):
                break
            here = at[move]
            at[move] = np.where(x[move, f[move]] <= threshold[here], left[here], right[here])
        margin += value[at]
    return 1 / (1 + np.exp(-2 * margin))


def learn(pages: DataFrame, html_col: str = "html", sample_pages: int = 250, sample_chars: int = 200_000, layouts: int = 3, trees: int = 20, depth: int = 5, seed: int = 4) -> list[tuple[np.ndarray, ...]]:
    """Boosted trees as arrays; at most sample_pages pages of at most sample_chars characters each reach the driver."""
    spark = pages.sparkSession
    # a share of the hashes that holds some four times the sample: no task sends the driver more than its part of that
    share = min(1.0, 4 * sample_pages / max(1, pages.count()))
    some = pages.select(F.col(html_col).cast("string").alias("h")).withColumn("k", F.xxhash64("h"))
    some = some.filter((F.length("h") <= sample_chars) & (F.col("k") <= min(2**63 - 1, int(share * 2**64) - 2**63))).dropDuplicates(["k"]).orderBy("k").limit(sample_pages)
    sources = sorted({r.h for r in some.collect()})
    cache: dict = {}
    parsed = [Page(s, cache) for s in sources]
    r = random.Random(seed)
    articles, other = [], []
    for p in parsed:
        y = labels([p])
        for inside, to in ((True, articles), (False, other)):
            blocks: dict[tuple, str] = {}
            for node, block, raw, _ in p.pieces:
                if bool(y[node]) == inside:
                    blocks[node, block] = blocks.get((node, block), "") + raw
            texts = [t for t in (" ".join(_html.unescape(b).split()) for b in blocks.values()) if t]
            to.append(texts) if inside else to.extend(texts)
    articles = [a for a in articles if a] or [["A short story", "It has a first sentence, which is not short at all. It has a second sentence, and an end."], ["Another text of blocks", "This is the second block, which is longer than the first one is.", "And this is the third one, with a comma and an end."]]
    other = other or ["Home", "Contact us", "All rights reserved.", "This offer ends soon, so act today and save."]
    made = [layout(a if r.random() < 0.6 else a[: r.randint(1, 6)], other + [t for b in r.sample(articles, min(3, len(articles))) for t in b[:2]], r) for a in articles for _ in range(layouts)]
    made += [layout(articles[k % len(articles)], other, r) for k in range(max(0, 200 - len(made)))]
    taught = [p for p in parsed if 0 in p.tag] + [Page(m, cache, marked=True) for m in made]
    x, y = features(taught)[0], labels(taught)
    frame = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, label double").repartition(4)
    frame = frame.select(array_to_vector("x").alias("features"), "label").cache()
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxBins=64).fit(frame)
    frame.unpersist()
    return _arrays(model)


def extract_texts(trees: list[tuple[np.ndarray, ...]], sources: list, cache: dict | None = None) -> list[str]:
    pages = [Page(s, {} if cache is None else cache) for s in sources]
    if not pages:
        return []
    x, parent, depth, first = features(pages)
    weight = np.log2(2 + np.expm1(x[:, -16]))  # of a node's own text
    inside = decode(probability(trees, x), parent, depth, weight)
    return [p.text(inside[a:b]) for p, a, b in zip(pages, first[:-1], first[1:])]


def extract(pages: DataFrame, trees: list[tuple[np.ndarray, ...]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row."""
    schema = T.StructType([T.StructField("page_id", pages.schema[id_col].dataType), T.StructField("url", pages.schema[url_col].dataType), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in batches:
            sources = b.column(2).to_pylist()
            for i, j in chunks(sources, lambda t: len(t or ""), 1_000_000):
                texts = extract_texts(trees, sources[i:j], cache)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, schema)


def learn_and_extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages, learn(pages))
