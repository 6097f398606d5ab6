"""Main text of web pages by gradient-boosted trees over the nodes of the page.

Every element of a page becomes a row of features: its tag and attribute words, its depth
and place among its siblings, the density of text in its subtree, and what its ancestors
say. Boosted trees (Spark ML) give each element's log odds of belonging to the article.
Decoding is hierarchical: a dropped element drops all its descendants, so of all choices
without contradictions between ancestors and descendants the most likely one is taken,
which a dynamic programme over the tree finds.

The trees are fitted on elements of known role: in a sample of at most ``fit_pages`` of the
pages given (those with the lowest hash of the id), elements under landmarks such as
``article``, ``nav`` or ``footer``; and pages of ``TEMPLATES`` layouts composed here, whose
landmarks are often missing, so that the other features have to tell. Every page is
extracted, from its whole html.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import scratch_path, settle

FIT_PAGES = 400
TEMPLATES = 700
TREES, DEPTH = 20, 5
PAGES_AT_ONCE = 64

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSED_BY = {
    "p": BLOCKS - {"html", "head", "body", "option", "legend", "caption", "tr", "td", "th", "tbody", "thead", "tfoot"},
    "li": frozenset({"li"}),
    "dt": frozenset({"dt", "dd"}),
    "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}),
    "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option"}),
    "head": frozenset({"body"}),
}
SILENT = frozenset("script style template noscript iframe svg math object canvas".split())

# Words of tags, classes and ids, by what they usually mark.
MARKS = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs topbar toolbar tabs pagination pager",
    "head": "header head masthead branding logo title",
    "foot": "footer foot copyright colophon legal imprint",
    "side": "aside sidebar side rail widget related recommended popular tags share social",
    "notice": "cookie cookies consent notice banner alert popup modal overlay newsletter subscribe signup gdpr",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion teaser",
    "form": "form search login register input button select textarea fieldset option label",
    "comment": "comment comments reply replies discussion disqus respond commentlist reviews",
    "article": "article main content post entry story body text page blog",
}
_MARK_OF = {word: kind for kind, words in MARKS.items() for word in words.split()}
KINDS = list(MARKS)
TAGS = ["p", "div", "section", "ul", "ol", "li", "a", "table", "td", "span", "b", "h1", "h2", "h3", "blockquote", "pre"]
_WORD = re.compile(r"[a-z]+")


@dataclass(eq=False)
class Node:
    """An element with its children: elements and texts in page order."""

    tag: str
    words: frozenset[str]
    parent: Node | None
    depth: int
    children: list[Node | str] = field(default_factory=list)
    truth: int = -1


class _Builder(HTMLParser):
    """The tree of a page; unclosed and misplaced tags are repaired as browsers would, by and large."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#page", frozenset(), None, 0)
        self.at = self.root

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self._open(tag):
            return
        for name, closers in CLOSED_BY.items():
            if tag in closers and (inside := self._open(name, stop=tag)):
                self.at = inside.parent
        if tag == "br":
            self.at.children.append(" ")
            return
        marks = " ".join(value or "" for name, value in attrs if name in ("class", "id", "role", "itemprop", "aria-label"))
        node = Node(tag, frozenset(_WORD.findall(marks.lower())), self.at, self.at.depth + 1)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent or self.root

    def _open(self, tag: str, stop: str = "") -> Node | None:
        """The innermost open element of a tag; lists and tables keep theirs to themselves."""
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            if tag != stop and node.tag in ("table", "ul", "ol", "dl", "td", "th", "select") and tag in CLOSED_BY and tag != "p":
                return None
            node = node.parent
        return node

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if data:
            self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def elements(root: Node) -> list[Node]:
    """All elements, parents before children, in page order."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


# Features -----------------------------------------------------------------------------------


def _marks(node: Node) -> set[str]:
    tag = frozenset() if node.tag in ("html", "body") else {node.tag}
    return {_MARK_OF[w] for w in (node.words | tag) if w in _MARK_OF}


def features(nodes: list[Node]) -> np.ndarray:
    """One row of numbers for each element of a page."""
    index = {id(node): i for i, node in enumerate(nodes)}
    n = len(nodes)
    chars, links, tags, stops, blocks, own = (np.zeros(n) for _ in range(6))
    for i in range(n - 1, -1, -1):
        node = nodes[i]
        for child in node.children:
            if isinstance(child, str):
                size = len(child.split()) and len(child.strip())
                own[i] += size
                chars[i] += size
                stops[i] += child.count(".") + child.count(",") + child.count("!") + child.count("?")
            else:
                j = index[id(child)]
                for total in (chars, links, stops, blocks):
                    total[i] += total[j]
                tags[i] += tags[j] + 1
        if node.tag == "a":
            links[i] = chars[i]
        if node.tag in SILENT:
            chars[i] = own[i] = stops[i] = 0
        blocks[i] += node.tag == "p"
    rows = []
    above: list[set[str]] = [set() for _ in range(n)]
    # For each element, its place among its parent's elements, their number, and those of its tag.
    beside = [(0, 1, 1)] * n
    for node in nodes:
        inner = [c for c in node.children if isinstance(c, Node)]
        alike = Counter(c.tag for c in inner)
        for k, c in enumerate(inner):
            beside[index[id(c)]] = (k, len(inner), alike[c.tag])
    for i, node in enumerate(nodes):
        mine = _marks(node)
        parent = index[id(node.parent)] if node.parent is not None else -1
        above[i] = (above[parent] if parent >= 0 else set()) | mine
        place, siblings, alike = beside[i]
        rows.append(
            [
                node.depth, place, place / siblings, siblings, alike, alike / siblings,
                math.log1p(chars[i]), math.log1p(own[i]), chars[i] / (tags[i] + 1), links[i] / max(1.0, chars[i]),
                stops[i] / max(1.0, chars[i]), math.log1p(tags[i]), math.log1p(blocks[i]),
                chars[i] / max(1.0, chars[0]), chars[i] / max(1.0, chars[parent] if parent >= 0 else 1.0),
                links[parent] / max(1.0, chars[parent]) if parent >= 0 else 0.0,
                float(node.tag in SILENT or node.tag == "head"),
                *(float(kind in mine) for kind in KINDS),
                *(float(kind in above[i]) for kind in KINDS),
                *(float(node.tag == tag) for tag in TAGS),
            ]
        )
    return np.array(rows, np.float64)


# Known roles --------------------------------------------------------------------------------

_OUT = frozenset({"menu", "foot", "side", "notice", "advert", "form", "comment"})
_OUT_TAGS = frozenset("nav footer aside form header head".split()) | SILENT


def landmark_roles(nodes: list[Node]) -> None:
    """Set ``truth`` where a landmark tells: 1 in or above the article, 0 in what is not, else -1."""
    for node in nodes:
        parent = node.parent.truth if node.parent is not None else -1
        if parent == 0 or node.tag in _OUT_TAGS or (node.tag != "body" and _marks(node) & _OUT):
            node.truth = 0
        elif parent == 1 or node.tag in ("article", "main"):
            node.truth = 1
    for node in reversed(nodes):
        if node.truth == -1 and any(isinstance(c, Node) and c.truth == 1 for c in node.children):
            node.truth = -2  # above the article
    for node in nodes:
        node.truth = 1 if node.truth == -2 else node.truth


def _sentence(rng: random.Random, words: list[str], least: int, most: int) -> str:
    picked = [rng.choice(words) for _ in range(rng.randint(least, most))]
    for i in range(5, len(picked) - 1, 7):
        picked[i] += ","
    return " ".join(picked).capitalize() + "."


class _Layout:
    """A page with known roles: content marked by the element attribute ``data-in``."""

    def __init__(self, seed: int) -> None:
        self.rng = random.Random(seed)
        letters = "etaoinshrdlucmfwypvbgk"
        self.words = ["".join(self.rng.choice(letters) for _ in range(self.rng.randint(2, 9))) for _ in range(300)]

    def text(self, least: int = 5, most: int = 25, sentences: int = 5) -> str:
        return " ".join(_sentence(self.rng, self.words, least, most) for _ in range(self.rng.randint(1, sentences)))

    def short(self) -> str:
        return _sentence(self.rng, self.words, 1, 8)

    def links(self, least: int = 3, most: int = 9) -> str:
        return "".join(f'<li><a href="/{i}">{self.rng.choice(self.words)}</a></li>' for i in range(self.rng.randint(least, most)))

    def _named(self, kind: str) -> str:
        word = self.rng.choice(MARKS[kind].split())
        name = self.rng.choice([word, f"{word}-{self.rng.choice(self.words)}", f"site-{word}"])
        return f'{self.rng.choice(["class", "id"])}="{name}"'

    def boilerplate(self) -> str:
        r = self.rng
        plain = r.random() < 0.15  # nothing but the text tells
        return r.choice(
            [
                lambda: f"<nav><ul>{self.links()}</ul></nav>",
                lambda: f"<div {self._named('menu') if not plain else ''}><ul>{self.links()}</ul></div>",
                lambda: f"<header><h1>{self.short()}</h1><p>{self.short()}</p></header>",
                lambda: f"<div {self._named('head')}><a href='/'>{self.short()}</a></div>",
                lambda: f"<footer>&copy; {self.short()}</footer>",
                lambda: f"<footer><p>{self.text(3, 12, 2)}</p><ul>{self.links()}</ul></footer>",
                lambda: f"<div {self._named('foot')}><p>{self.short()}</p></div>",
                lambda: f"<aside><h3>{self.short()}</h3><ul>{self.links()}</ul></aside>",
                lambda: f"<aside><p>{self.text(3, 15, 2)}</p></aside>",
                lambda: f"<div {self._named('side')}><h3>{self.short()}</h3><p>{self.text(3, 15, 2)}</p></div>",
                lambda: f"<div {self._named('notice')}>{self.text(4, 18, 2)} <button>{r.choice(self.words)}</button></div>",
                lambda: f"<div {self._named('notice')}><p>{self.text(4, 18, 2)}</p></div>",
                lambda: f"<div {self._named('advert')}>{self.text(3, 15, 2)}</div>",
                lambda: f"<section {self._named('advert')}><p>{self.text(3, 15, 2)}</p></section>",
                lambda: f"<form><label>{self.short()}</label><input name='q'><button>{r.choice(self.words)}</button></form>",
                lambda: f"<div {self._named('form')}><p>{self.short()}</p><input><button>{r.choice(self.words)}</button></div>",
                lambda: f"<div {self._named('comment')}>"
                + "".join(f"<div><b>{r.choice(self.words)}</b><p>{self.text(4, 15, 3)}</p></div>" for _ in range(r.randint(1, 5)))
                + "</div>",
                lambda: f"<section {self._named('comment')}><h2>{self.short()}</h2><ol>"
                + "".join(f"<li><p>{self.text(4, 15, 3)}</p></li>" for _ in range(r.randint(1, 5)))
                + "</ol></section>",
                lambda: f"<script>var a='{r.choice(self.words)}';</script>",
                lambda: f"<style>p{{margin:{r.randint(0, 9)}}}</style>",
            ]
        )()

    def paragraph(self) -> str:
        r = self.rng
        return r.choices(
            [
                lambda: f"<p>{self.text()}</p>",
                lambda: f"<p><b>{self.text()}<br>",
                lambda: f"<p>{self.short()}</p>",
                lambda: f"<p>{self.text()} <a href='/x'>{self.short()}</a> {self.short()}</p>",
                lambda: f"<h2>{self.short()}</h2>",
                lambda: f"<ul>{''.join(f'<li>{self.text(3, 12, 2)}</li>' for _ in range(r.randint(2, 6)))}</ul>",
                lambda: f"<blockquote><p>{self.text()}</p></blockquote>",
                lambda: f"<div>{self.text()}</div>",
                lambda: f"<table><tr><td>{self.short()}</td><td>{self.short()}</td></tr></table>",
                lambda: f"<pre>{self.text()}</pre>",
                lambda: f"<figure><img src='a'><figcaption>{self.short()}</figcaption></figure>",
            ],
            [10, 3, 3, 3, 2, 2, 1, 2, 1, 1, 1],
        )[0]()

    def page(self) -> str:
        r = self.rng
        body = []
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 12])):
            body.append(self.paragraph())
            if r.random() < 0.08:
                inside = r.choice(["advert", "notice", "side"])
                body.append(f"<div {self._named(inside)}>{self.text(3, 15, 2)}</div>")
        head = f"<h1>{self.short()}</h1>" if r.random() < 0.8 else ""
        tag, marks = r.choice(
            [("article", ""), ("article", ""), ("main", ""), ("div", ""), ("section", ""), ("td", "")]
            + [("div", self._named("article")), ("section", self._named("article"))]
        )
        content = f"<{tag} {marks} data-in='1'>{head}{''.join(body)}</{tag}>"
        if tag == "td":
            content = f"<table><tr>{content}</tr></table>"
        for _ in range(r.randint(0, 2)):
            content = f"<div>{content}</div>"
        before = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        after = "".join(self.boilerplate() for _ in range(r.randint(0, 4)))
        return (
            f"<html><head><title>{self.short()}</title><style>p{{}}</style></head>"
            f"<body>{before}{content}{after}</body></html>"
        )


class _Marked(_Builder):
    """Keeps the mark of the content element; the features never see it."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        if any(name == "data-in" for name, _ in attrs):
            self.at.truth = 1


def layout_nodes(seed: int) -> list[Node]:
    """The elements of a composed page with their roles."""
    builder = _Marked()
    builder.feed(_Layout(seed).page())
    builder.close()
    nodes = elements(builder.root)
    inside = [node for node in nodes if node.truth == 1]
    for node in nodes:
        node.truth = 0
    for top in inside:
        up: Node | None = top.parent
        while up is not None:
            up.truth, up = 1, up.parent
        top.truth = 1
        for node in elements(top)[1:]:
            out = node.tag in _OUT_TAGS or (node.tag in ("div", "section") and _marks(node) & _OUT)
            node.truth = 0 if out or node.parent.truth == 0 else 1
    return nodes


def _known(nodes: list[Node]) -> Iterator[tuple[float, list[float]]]:
    for node, row in zip(nodes, features(nodes).tolist(), strict=True):
        if node.truth in (0, 1):
            yield float(node.truth), row


# Model --------------------------------------------------------------------------------------


@dataclass
class Trees:
    """Boosted trees as full binary trees of one depth."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        tree = np.arange(len(self.feature))[None, :]
        at = np.zeros((len(x), len(self.feature)), np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1]
        for _ in range(int(math.log2(inner + 1))):
            at = 2 * at + 1 + (x[rows, self.feature[tree, at]] > self.threshold[tree, at])
        return self.leaf[tree, at - inner].sum(axis=1)


def _full(nodes: dict[int, dict], weight: float, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inner = (1 << depth) - 1
    feature, threshold, leaf = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(inner + 1)

    def fill(place: int, node: dict) -> None:
        if place >= inner:
            leaf[place - inner] = weight * node["prediction"]
        elif node["left"] < 0:
            fill(2 * place + 1, node)
        else:
            feature[place], threshold[place] = node["feature"], node["threshold"]
            fill(2 * place + 1, nodes[node["left"]])
            fill(2 * place + 2, nodes[node["right"]])

    fill(0, nodes[0])
    return feature, threshold, leaf


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES, id_col: str = "page_id", html_col: str = "html") -> Trees:
    """Fit the trees on at most ``fit_pages`` of ``pages`` and on the composed layouts."""
    spark = pages.sparkSession
    sample = (
        pages.select(pages[id_col].cast("string").alias("id"), pages[html_col].cast("string").alias("html"))
        .filter("html IS NOT NULL")
        .orderBy(F.xxhash64("id"), "id")
        .limit(fit_pages)
    )

    def from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for html in batch.column("html").to_pylist():
                nodes = elements(parse(html))
                landmark_roles(nodes)
                yield _rows(_known(nodes))

    def from_layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column("id").to_pylist():
                yield _rows(_known(layout_nodes(seed)))

    schema = "label double, features array<double>"
    known = sample.mapInArrow(from_pages, schema).unionByName(spark.range(TEMPLATES).mapInArrow(from_layouts, schema))
    rows = settle(known, "elements").select("label", array_to_vector("features").alias("features"))
    booster = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=32, minInstancesPerNode=5)
    return _exported(spark, booster.fit(rows.coalesce(4)))


def _rows(known: Iterator[tuple[float, list[float]]]) -> pa.RecordBatch:
    labels, rows = [], []
    for label, row in known:
        labels.append(label)
        rows.append(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(labels, pa.float64()), pa.array(rows, pa.list_(pa.float64()))], names=["label", "features"]
    )


def _exported(spark: SparkSession, model) -> Trees:
    """The model's trees from its saved form (a few hundred nodes)."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    found: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").selectExpr("treeID", "nodeData.*").collect():
        threshold = row["split"]["leftCategoriesOrThreshold"]
        found.setdefault(row["treeID"], {})[row["id"]] = {
            "prediction": row["prediction"],
            "left": row["leftChild"],
            "right": row["rightChild"],
            "feature": row["split"]["featureIndex"],
            "threshold": threshold[0] if threshold else 0.0,
        }
    full = [_full(found[i], weight, DEPTH) for i, weight in enumerate(model.treeWeights)]
    return Trees(*(np.array(part) for part in zip(*full, strict=True)))


# Decoding and text --------------------------------------------------------------------------


def decode(nodes: list[Node], margin: np.ndarray) -> list[bool]:
    """The most likely choice of kept elements in which nothing dropped holds anything kept."""
    keep = -np.logaddexp(0, -2 * margin)
    drop = -np.logaddexp(0, 2 * margin)
    index = {id(node): i for i, node in enumerate(nodes)}
    best_keep, best_drop = keep.copy(), drop.copy()
    for i in range(len(nodes) - 1, -1, -1):
        for child in nodes[i].children:
            if isinstance(child, Node):
                j = index[id(child)]
                best_keep[i] += max(best_keep[j], best_drop[j])
                best_drop[i] += best_drop[j]
    kept = [False] * len(nodes)
    for i, node in enumerate(nodes):
        inside = node.parent is None or kept[index[id(node.parent)]]
        kept[i] = bool(inside and best_keep[i] >= best_drop[i] and node.tag not in SILENT)
    return kept


def text_of(nodes: list[Node], kept: list[bool]) -> str:
    """The text of the kept elements: white space folded within blocks, blocks joined by newlines."""
    chosen = {id(node) for node, keep in zip(nodes, kept, strict=True) if keep}
    blocks: list[str] = []
    piece: list[str] = []

    def close() -> None:
        folded = " ".join("".join(piece).split())
        if folded:
            blocks.append(folded)
        piece.clear()

    stack: list[tuple[Node | str, bool]] = [(nodes[0], False)]
    while stack:
        item, ends = stack.pop()
        if isinstance(item, str):
            piece.append(item)
            continue
        block = item.tag in BLOCKS
        if ends:
            close()
            continue
        if id(item) not in chosen:
            if block:
                close()
            continue
        if block:
            close()
            stack.append((item, True))
        stack += [(child, False) for child in reversed(item.children)]
    close()
    return "\n".join(blocks)


def texts_of(pages: list[str], trees: Trees) -> list[str]:
    """The main texts of some pages, scored together."""
    each = [elements(parse(html)) for html in pages]
    margins = trees.margin(np.concatenate([features(nodes) for nodes in each]))
    at, out = 0, []
    for nodes in each:
        out.append(text_of(nodes, decode(nodes, margins[at : at + len(nodes)])))
        at += len(nodes)
    return out


def extract(
    pages: DataFrame, trees: Trees, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row.

    A null html is an empty page, whose text is empty; ids and urls pass through, null or
    not, repeated or not. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES_AT_ONCE):
                some = batch.slice(at, PAGES_AT_ONCE)
                texts = texts_of(some.column("html").to_pylist(), trees)
                sizes = pa.array([len(text) for text in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column("page_id"), some.column("url"), pa.array(texts, pa.string()), sizes],
                    names=["page_id", "url", "text", "n_chars"],
                )

    rows = pages.select(
        pages[id_col].cast("long").alias("page_id"),
        pages[url_col].cast("string").alias("url"),
        F.coalesce(pages[html_col].cast("string"), F.lit("")).alias("html"),
    )
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
