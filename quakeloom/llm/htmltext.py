"""Main text of web pages by a tree-structured graphical model over DOM blocks.

A page becomes a tree of block elements, with a leaf for each run of text between block boundaries.
Every node is content, boilerplate or a frame that may hold both. Its tag, class and id words, length,
share of link text, siblings built alike and place towards the headline give evidence; potentials between parent and child make labels run in
families: what lies in boilerplate stays boilerplate, a frame opens into either. Messages passed
from the leaves up and from the root down (sum-product, exact on a tree) give each leaf's marginal,
and leaves that are more likely content are the text. Evidence and potentials are counted on
labelled pages.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .textops import slices

# fixed values of HTML: elements without an end, elements that hold no text of the page, elements that
# flow within a line, and what each start tag closes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("head script style template noscript iframe object svg math canvas audio video button select textarea option datalist dialog".split())
RAW = frozenset("script style textarea title template noscript iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tbody",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",), "option": ("option",)}
FENCES = frozenset("table td th ul ol dl body html article section div".split())

#: What an implied end tag may end, and so is looked up by its nearest open element.
TRACKED = frozenset(t for ends in CLOSES.values() for t in ends) | {"p"}
#: A whole tag: quotes count after an equals sign only. It never backtracks, so a tag costs its length.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
_RAW_END = {t: re.compile(rf"</{t}[\s/>]", re.I) for t in RAW}
_NAMES = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose link share tells more than that of others.
LISTS = frozenset("ul ol li".split())
_LABEL = "data-label"
LIMIT = 9.0


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    text: str | None = None
    linked: int = 0
    label: int = 2
    shape: tuple[str, ...] = ()  # what the whole page tells about an element


@dataclass(slots=True)
class Block:
    """An open element that breaks text, and the inline elements that are open within it."""

    tag: str  # with a leading ! if it is hidden
    node: int
    near: dict[str, int]  # nearest open element of each tracked tag that an implied end may reach
    silent: bool = False
    inline: list[str] = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=dict)


class Tree:
    """Builds the nodes of a page tag by tag. Every step costs a constant or is paid for by an element that it
    closes, so a page costs its length, however it nests."""

    def __init__(self):
        self.nodes = [Node("root", -1)]
        self.open = [Block("root", 0, {})]
        self.names: dict[str, int] = {}  # open blocks by tag
        self.run: list[str] = []
        self.links = self.linked = self.silent = 0

    def text(self, piece: str) -> None:
        if piece and not self.silent:
            piece = html.unescape(piece) if "&" in piece else piece
            self.run.append(piece)
            if self.links:
                self.linked += len(piece)

    def flush(self) -> None:
        if self.run:
            text = " ".join("".join(self.run).split())
            self.run.clear()
            if text:
                at = self.open[-1].node
                self.nodes.append(Node("text", at, (), text, self.linked, self.nodes[at].label))
        self.linked = 0

    def push(self, tag: str, node: int, silent: bool = False) -> None:
        near = self.open[-1].near
        if tag in FENCES:
            near = {k: v for k, v in near.items() if k in ("tr", "td", "th")} if tag in ("td", "th") else {}
        if tag in TRACKED:
            near = {**near, tag: len(self.open)}
        self.open.append(Block(tag, node, near, silent))
        self.silent += silent
        tag = tag.lstrip("!")
        self.names[tag] = self.names.get(tag, 0) + 1

    def close(self, to: int) -> None:
        """Ends all open blocks from number ``to`` on."""
        if to < len(self.open):
            self.flush()
        while len(self.open) > to:
            block = self.open.pop()
            self.links -= block.counts.get("a", 0)
            self.silent -= block.silent
            self.names[block.tag.lstrip("!")] -= 1

    def end(self, tag: str) -> None:
        block = self.open[-1]
        if tag in INLINE and block.counts.get(tag):
            while True:
                last = block.inline.pop()
                block.counts[last] -= 1
                self.links -= last == "a"
                if last == tag:
                    return
        if tag in INLINE:
            if block.tag == "!" + tag:
                self.close(len(self.open) - 1)
        elif self.names.get(tag):
            to = len(self.open) - 1
            while self.open[to].tag.lstrip("!") != tag:
                to -= 1
            self.close(to)

    def start(self, tag: str, attrs: str) -> None:
        if tag == "br":
            self.run.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        if tag == "body" and self.names.get("head"):
            self.close(next(k for k in range(len(self.open) - 1, 0, -1) if self.open[k].tag.lstrip("!") == "head"))
        near = self.open[-1].near
        if near and (tag in P_CLOSERS or tag in CLOSES):
            ended = max([near.get(t, 0) for t in CLOSES.get(tag, ())] + [near.get("p", 0) if tag in P_CLOSERS else 0])
            if ended:
                self.close(ended)
        hidden = bool(attrs) and _HIDDEN.search(attrs) is not None
        block = self.open[-1]
        if tag in INLINE and not hidden:
            block.inline.append(tag)
            block.counts[tag] = block.counts.get(tag, 0) + 1
            self.links += tag == "a"
            return
        self.flush()
        if tag in SILENT or hidden:
            self.push(tag if tag in SILENT else "!" + tag, block.node, True)
            return
        names = tuple(w.lower() for x in _NAMES.findall(attrs) for w in _WORD.findall(x[1] or x[2] or x[3])) if attrs else ()
        label = self.nodes[block.node].label
        if attrs and _LABEL in attrs:
            label = int(f'{_LABEL}="1"' in attrs)  # a frame unless it is marked
        self.nodes.append(Node(tag, block.node, names, None, 0, label))
        self.push(tag, len(self.nodes) - 1)


def parse(page: str) -> list[Node]:
    """Block elements and text leaves in page order, each after its parent; the first is the root.

    A tag, comment or raw element without an end takes the rest of the page with it, as in browsers."""
    tree, at, look, size = Tree(), 0, 0, len(page)
    while (lt := page.find("<", look)) >= 0:
        mark = page[lt + 1 : lt + 3]
        if not (mark[:1] in ("!", "?", "/") or (mark[:1].isascii() and mark[:1].isalpha())):
            look = lt + 1  # a character of the text
            continue
        tree.text(page[at:lt])
        m = None
        if mark[0].isalpha() or (mark[0] == "/" and mark[1:].isascii() and mark[1:].isalpha()):
            m = _TAG.match(page, lt)
            at = m.end() if m else size
        else:
            end, skip = (page.find("-->", lt + 2), 3) if page.startswith("<!--", lt) else (page.find("]]>", lt), 3) if page.startswith("<![CDATA[", lt) else (page.find(">", lt), 1)
            at = end + skip if end >= 0 else size
        if m and m[1]:
            tree.end(m[2].lower())
        elif m and (tag := m[2].lower()) in RAW:
            end = _RAW_END[tag].search(page, at)
            at = page.find(">", end.start()) + 1 if end else size
            at = at or size
        elif m:
            tree.start(tag, m[3])
        look = at
    tree.text(page[at:])
    tree.close(1)
    tree.flush()
    nodes = tree.nodes
    if any(n.tag == "form" for n in nodes):
        nodes = without_forms(nodes)
    shape(nodes)
    return nodes


def _sizes(nodes: list[Node]) -> tuple[list[int], list[int]]:
    """Code points of text, and of linked text, in each node's subtree."""
    size, linked = [len(n.text or "") for n in nodes], [n.linked for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
        linked[nodes[k].parent] += linked[k]
    return size, linked


def without_forms(nodes: list[Node]) -> list[Node]:
    """The nodes outside of forms. A form around a headline or an article and half of the page's text is a wrapper,
    as some site software writes it, and stays."""
    size, _ = _sizes(nodes)
    main = [n.tag in ("h1", "article", "main") for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        main[nodes[k].parent] |= main[k]
    out, place = [nodes[0]], [0] + [-1] * (len(nodes) - 1)
    for k, n in enumerate(nodes[1:], 1):
        if place[n.parent] >= 0 and (n.tag != "form" or (main[k] and 2 * size[k] >= size[0])):
            n.parent, place[k] = place[n.parent], len(out)
            out.append(n)
    return out


def shape(nodes: list[Node]) -> None:
    """Features of elements that need no names: how much text and link text they hold, how many siblings are built
    like them and of how many blocks each, what a list follows, and where they lie towards the first top heading."""
    size, linked = _sizes(nodes)
    leaves, top = [int(n.text is not None) for n in nodes], [n.tag == "h1" for n in nodes]
    first = next((k for k, n in enumerate(nodes) if n.tag == "h1"), len(nodes))
    for k in range(len(nodes) - 1, 0, -1):
        leaves[nodes[k].parent] += leaves[k]
        top[nodes[k].parent] |= top[k]
    like: dict[tuple, int] = {}
    for n in nodes[1:]:
        if n.text is None:
            key = n.parent, n.tag, n.names
            like[key] = like.get(key, 0) + 1
    before: dict[int, str] = {}  # what the latest child of each element is
    for k, n in enumerate(nodes[1:], 1):
        last, before[n.parent] = before.get(n.parent, "none"), n.tag
        if n.text is None:
            twins, many = min(like[n.parent, n.tag, n.names], 4), min(leaves[k], 4)
            where = "none" if first == len(nodes) else "holds" if top[k] else "before" if k < first else "after"
            share = min(4, round(4 * linked[k] / size[k])) if size[k] else 5
            n.shape = f"share {n.tag if n.tag in LISTS else ''} {share}", f"size {min(size[k].bit_length(), 14) // 2}", f"head {where}"
            if n.tag in ("ul", "ol"):
                n.shape += (f"follows {last} {share > 2}",)
            if twins > 1:
                n.shape += (f"like {n.tag} {min(twins, 3)} {many} {share > 2}",)


def evidence(node: Node) -> Iterator[str]:
    """The features of a node."""
    if node.text is None:
        yield f"tag {node.tag}"
        for w in set(node.names):
            yield f"name {w}"
        yield from node.shape
    else:
        n = len(node.text)
        yield f"length {min(n.bit_length(), 10)}"
        yield f"links {min(4, round(4 * node.linked / n))}"
        yield f"end {node.text[-1] in '.!?:;…。»”'}"


BOILERPLATE, CONTENT, FRAME = range(3)


@dataclass
class TreeModel:
    """Log likelihoods of features under each label, and the chances of a child's label by its parent's."""

    features: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    under: tuple[tuple[float, float, float], ...] = ((0.98, 0.01, 0.01), (0.02, 0.97, 0.01), (0.5, 0.2, 0.3))

    def own(self, node: Node) -> tuple[float, float, float]:
        a = b = c = 0.0
        for f in evidence(node):
            x = self.features.get(f)
            if x is not None:
                a += x[0]
                b += x[1]
                c += x[2]
        top = max(a, b, c)
        return math.exp(max(a - top, -60.0)), math.exp(max(b - top, -60.0)), math.exp(max(c - top, -60.0))

    def marginals(self, nodes: list[Node]) -> list[float]:
        """Chance of being content for each node; the root is a frame."""
        (t00, t01, t02), (t10, t11, t12), (t20, t21, t22) = self.under
        size = len(nodes)
        below = [self.own(n) for n in nodes]
        up = [(1.0, 1.0, 1.0)] * size
        for k in range(size - 1, 0, -1):  # leaves to root: children come after their parents
            x, y, z = below[k]
            m0, m1, m2 = t00 * x + t01 * y + t02 * z, t10 * x + t11 * y + t12 * z, t20 * x + t21 * y + t22 * z
            up[k] = m0, m1, m2
            p = nodes[k].parent
            a, b, c = below[p]
            a, b, c = a * m0, b * m1, c * m2
            total = a + b + c
            below[p] = (a / total, b / total, c / total) if total else (1.0, 1.0, 1.0)
        belief = [(0.0, 0.0, 1.0)] * size
        for k in range(1, size):  # root to leaves
            (p0, p1, p2), (u0, u1, u2) = belief[nodes[k].parent], up[k]
            r0, r1, r2 = p0 / u0, p1 / u1, p2 / u2
            x, y, z = below[k]
            x, y, z = x * (r0 * t00 + r1 * t10 + r2 * t20), y * (r0 * t01 + r1 * t11 + r2 * t21), z * (r0 * t02 + r1 * t12 + r2 * t22)
            total = x + y + z
            belief[k] = (x / total, y / total, z / total) if total else (1 / 3, 1 / 3, 1 / 3)
        return [b[CONTENT] for b in belief]

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes = parse(page)
        return " ".join(n.text for n, p in zip(nodes, self.marginals(nodes), strict=True) if n.text is not None and p > 0.5)


def train(pages: Iterable[str], smooth: float = 0.1) -> TreeModel:
    """Counts on labelled pages: ``data-label="1"`` marks an element as content, ``"0"`` as boilerplate,
    what lies inside takes the label over, and what is outside is a frame."""
    seen: dict[str, list[int]] = {}
    totals, pairs = [0, 0, 0], [[0.5] * 3 for _ in range(3)]
    for page in pages:
        nodes = parse(page)
        for node in nodes[1:]:
            totals[node.label] += 1
            pairs[nodes[node.parent].label][node.label] += 1
            for f in evidence(node):
                seen.setdefault(f, [0, 0, 0])[node.label] += 1
    per: dict[str, list[int]] = {}
    for f, n in seen.items():
        kind = per.setdefault(f.split(" ")[0], [0, 0, 0])
        for j in range(3):
            kind[j] += n[j]
    features = {}
    for f, n in seen.items():
        kind = f.split(" ")[0]
        base = totals if kind == "name" else per[kind]
        little = smooth / 100 if kind == "name" else smooth  # a name that one label never has tells much
        logs = [math.log((n[j] + little) / (base[j] + 1.0)) for j in range(3)]
        top = max(logs)
        features[f] = tuple(max(x - top, -LIMIT) for x in logs)
    return TreeModel(features, tuple(tuple(x / sum(row) for x in row) for row in pairs))


#: Names that sites give to what is around an article, in several languages.
NAMES_OFF = tuple(
    "ad ads advert advertisement sponsored promo banner cookie cookie-notice consent notice alert sidebar widget menu navbar nav breadcrumb "
    "breadcrumbs related share social newsletter subscribe popup modal footer copyright header masthead comments comment comment-list replies "
    "disqus tags meta login search pagination toolbar disclaimer "
    "kommentare kommentar werbung anzeige hinweis seitenleiste fusszeile kopfzeile verwandte "
    "commentaires commentaire publicite avis pied entete partager abonnement "
    "comentarios comentario publicidad anuncio aviso pie cabecera compartir relacionados "
    "commenti pubblicita condividi reacties reageer advertentie komentarze reklama outbrain taboola".split()
)


def labelled_pages(count: int = 1200, seed: int = 7) -> Iterator[str]:
    """Labelled pages composed from common layouts, with words that mean nothing; two of five have no names at all."""
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choices("abcdefghilmnoprstu", k=r.randint(1, 9))) for _ in range(max(1, n)))
    sentence = lambda n: words(n).capitalize() + r.choice(("." * 8) + "?!")
    prose = lambda: " ".join(sentence(r.randint(1, 18)) for _ in range(r.choice((1, 1, 2, 3, 6, 10))))
    links = lambda n: "".join(f'<li><a href="/{k}">{words(r.randint(1, 3))}</a></li>' for k in range(n))
    heading = lambda: "<h{0}>{1}</h{0}>".format(r.choice((2, 2, 3, 3, 4, 5)), words(r.randint(1, 3)))
    site = lambda: "<{0}>{1}</{0}>".format("h1" if r.random() < 0.1 else "div", words(2))
    off = f'{_LABEL}="0"'

    def boilerplate(nameless: bool = False) -> str:
        text = sentence(r.randint(2, 14))
        name = r.choice(NAMES_OFF)
        where = "" if nameless else r.choice((f'class="{name}"', f'id="{name}"', f'class="box {name}"'))
        tag = r.choice(("div", "div", "section", "aside"))
        if nameless:  # only what a block is made of tells
            return r.choice(
                (
                    f"<nav {off}><ul>{links(r.randint(3, 9))}</ul></nav>",
                    f"<{tag} {off}><ul>{links(r.randint(3, 9))}</ul></{tag}>",
                    f"<{tag} {off}>{heading()}<ul>{links(r.randint(3, 6))}</ul></{tag}>",
                    f"<{tag} {off}>" + " | ".join(f'<a href="/{k}">{words(1)}</a>' for k in range(r.randint(3, 7))) + f"</{tag}>",
                    f"<footer {off}><p>{text}</p></footer>",
                    f"<aside {off}><p>{text}</p></aside>",
                    comments("", r.random() < 0.5),
                )
            )
        return r.choice(
            (
                f"<nav {off}><ul>{links(r.randint(3, 9))}</ul></nav>",
                f"<header {off}>{site()}<ul>{links(4)}</ul></header>",
                f"<footer {off}>{text}</footer>",
                f"<footer {off}><p>{text}</p></footer>",
                f"<aside {off}>{heading()}<p>{text}</p></aside>",
                f"<aside {off}><ul>{links(5)}</ul></aside>",
                f"<div {where} {off}>{text}</div>",
                f"<div {where} {off}><p>{prose()}</p></div>",
                f"<div {where} {off}><p>{text}</p><p>{prose()}</p></div>",
                f"<section {where} {off}>{heading()}<p>{prose()}</p></section>",
                f"<ul {where} {off}>{links(5)}</ul>",
                f"<p {where} {off}>{text}</p>",
                f"<div {where} {off}>{heading()}{''.join(f'<p>{sentence(r.randint(3, 14))}</p>' for _ in range(r.randint(1, 4)))}</div>",
                f"<{tag} {where} {off}>{''.join(f'<p>{prose()}</p>' for _ in range(r.randint(1, 2)))}</{tag}>",
                comments(where, r.random() < 0.5),
            )
        )

    def comments(where: str, listed: bool) -> str:
        outer, inner = ("ol", "li") if listed else ("div", r.choice(("div", "article")))
        head = r.choice(("", heading(), f"<h2>{r.randint(1, 40)} {words(1)}</h2>"))
        author = lambda: r.choice((f"<div>{words(2)}</div>", f'<div><a href="/u">{words(1)}</a> {words(2)}</div>', f"<p><b>{words(1)}</b></p>"))
        one = lambda: f"<{inner}>{author()}<p>{prose()}</p>{r.choice(('', f'<div><a href=/r>{words(1)}</a></div>'))}</{inner}>"
        return f"<div {where} {off}>{head}<{outer}>{''.join(one() for _ in range(r.randint(2, 6)))}</{outer}></div>"

    def content() -> str:
        kind = r.random()
        if kind < 0.68:
            return f"<p>{prose()}</p>"
        if kind < 0.76:
            return f"<h{r.randint(2, 4)}>{words(r.randint(1, 8))}</h2>"
        if kind < 0.79:
            return f"<blockquote><p>{prose()}</p></blockquote>"
        if kind < 0.84:
            return f"<ul>{''.join(f'<li>{sentence(r.randint(2, 9))}</li>' for _ in range(r.randint(1, 6)))}</ul>"
        if kind < 0.87:
            return f"<p>{sentence(5)}</p><ul>{''.join(f'<li><a href=/x>{words(r.randint(2, 7))}</a></li>' for _ in range(r.randint(1, 3)))}</ul>"
        if kind < 0.9:
            return f"<table><tr><td>{words(2)}</td><td>{words(1)}</td></tr></table>"
        if kind < 0.94:
            return f'<p>{sentence(6)} <a href="/x">{words(3)}</a> {sentence(5)}</p>'
        return f"<div>{prose()}</div>" if kind < 0.97 else f"<figure><figcaption>{sentence(6)}</figcaption></figure>"

    for _ in range(count):
        nameless = r.random() < 0.4
        tag, name = r.choice((("article", ""), ("article", ""), ("article", 'class="post"'), ("main", ""), ("div", 'class="content"'), ("div", 'id="main-content"'), ("div", 'class="article-body"'), ("section", 'class="entry-content"'), ("div", 'class="post-body"'), ("div", 'class="story text"')))
        if nameless:
            tag, name = r.choice(("article", "main", "div", "div", "section", "td")), ""
        top = "" if r.random() < 0.1 else f"<h1>{words(r.randint(2, 10))}{r.choice(('', '.'))}</h1>"
        inner = [top, *(content() for _ in range(r.randint(1, 14)))]
        if r.random() < 0.4:
            inner.insert(r.randint(1, len(inner)), boilerplate(nameless))
        if r.random() < 0.1:
            inner = [f"<div>{''.join(inner)}</div>"]
        body = "".join(inner)
        main = f'<{tag} {name} {_LABEL}="1">{body}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{r.choice(('', f'<td {off}>{links(5)}</td>'))}{main}</tr></table>"
        if r.random() < 0.3:
            kind = "" if nameless else f"class={r.choice(('container', 'wrapper', 'page'))}"
            main = f"<div {kind}>{main}{boilerplate(nameless) if r.random() < 0.5 else ''}</div>"
        before, after = ("".join(boilerplate(nameless) for _ in range(r.randint(0, 3))) for _ in range(2))
        yield f"<html><head><title>{words(4)}</title></head><body>{before}{main}{after}</body></html>"


_models: dict[tuple[int, int], TreeModel] = {}


def default_model(count: int = 1200, seed: int = 7) -> TreeModel:
    if (count, seed) not in _models:
        _models[count, seed] = train(labelled_pages(count, seed))
    return _models[count, seed]


def extract_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """``pages`` (html, any more columns) with ``text`` and ``n_chars`` in code points.

    A null or empty html gives an empty text. White space inside a block is one space, blocks are
    joined by one space. Columns of the input called text or n_chars are replaced."""
    pages = pages.drop("text", "n_chars")
    names = [f.name for f in pages.schema.fields]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields)
    model = model or default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "html", 4 << 20):
                text = [model.extract(x) for x in b.column(names.index("html")).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], [*names, "text", "n_chars"])

    return pages.mapInArrow(run, f"{ddl}, text string, n_chars long")
