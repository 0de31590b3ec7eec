"""Main text of web pages: flat text blocks, described by themselves, their neighbours and what encloses them, and judged by a decision tree."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that don't end a block of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose content isn't text of the page.
SKIPPED = frozenset("script style noscript template svg math iframe object canvas title textarea select button audio video".split())
#: Elements without content.
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold what is beside the text; a header counts unless it is an article's.
BESIDE = frozenset("nav aside footer form header dialog menu".split())
WITHIN = frozenset(("article", "main"))
#: Words in an element's class, id, role or label that tell what is beside the text; the weak ones don't count beside a word of WITHIN_WORDS.
BESIDE_WORDS = frozenset(
    "ad ads advert advertisement advertising adbox sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert comment comments commentlist disqus reply replies respond sidebar side rail "
    "menu nav navbar navigation breadcrumb breadcrumbs share sharing social related recommended recommendations footer contentinfo complementary masthead topbar copyright legal disclaimer newsletter subscribe "
    "subscription signup login popup modal overlay widget pagination pager toolbar search form hidden".split()
)
#: Beginnings of such words.
BESIDE_STEMS = ("ads", "advert", "sponsor", "promo", "cookie", "comment", "sidebar", "navbar", "footer", "newsletter", "breadcrumb", "related", "recommend", "social", "sharing", "popup")
WEAK_WORDS = frozenset("header tags meta foot top bottom".split())
WITHIN_WORDS = frozenset("article post entry content story main body text".split())
#: Phrases of notices.
PHRASES = re.compile(r"©|cookie|all rights reserved|privacy policy|terms of (?:use|service)|advertisement|subscribe", re.I)

KINDS = {"p": 1, "blockquote": 1, "pre": 1, **{f"h{i}": 2 for i in range(1, 7)}, "li": 3, "dt": 3, "dd": 3, "td": 4, "th": 4, "caption": 4, "figcaption": 4}
#: Features of a block, in order: of itself, its neighbours and what encloses it.
FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "place", "beside_hint", "in_article", "kind", "sentence", "phrase", "container_share")
#: Blocks that the tree is trained on at most, and its depth.
TRAINING_BLOCKS, DEPTH = 4000, 8

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[/!?]?[a-zA-Z](?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+>|[/!?]?[a-zA-Z][^>]*(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Tag(NamedTuple):
    name: str
    closing: bool
    hint: int  # -1: beside the text; 1: within; 0: doesn't say


def _hint(tag: str) -> int:
    words: set[str] = set()
    if re.search(r"\s(?:hidden|aria-hidden\s*=\s*[\"']?true)\b", tag) or re.search(r"display\s*:\s*none", tag):
        return -1
    for name, value in _ATTRIBUTE.findall(tag):
        if name.lower() in ("class", "id", "role", "aria-label"):
            words |= {w.lower() for w in _WORD.findall(value)}
    if words & BESIDE_WORDS or any(w.startswith(BESIDE_STEMS) for w in words):
        return -1
    if words & WITHIN_WORDS:
        return 1
    return -1 if words & WEAK_WORDS else 0


@lru_cache(1 << 14)
def _parsed(tag: str) -> Tag | None:
    found = re.match(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)", tag)
    if not found:
        return None
    name = found[2].lower()
    return Tag(name, bool(found[1]), 0 if found[1] or name in INLINE or name in ("html", "body") else _hint(tag))


class Open(NamedTuple):
    """An open element: its place (2 and 1 within the text by element or hint, -2 and -1 beside it), what any around it say, and its container."""

    name: str
    place: int
    beside: int
    article: int
    container: int


class Block(NamedTuple):
    text: str
    linked: int
    kind: int
    at: Open


def _entered(tag: Tag, around: Open, number: int) -> Open:
    beside_tag = tag.name in BESIDE and not (tag.name == "header" and around.article)
    place = -2 if beside_tag else 2 if tag.name in WITHIN and tag.hint >= 0 else tag.hint or around.place
    container = around.container if tag.name in KINDS or tag.name in ("tr", "tbody", "thead", "tfoot") else number
    return Open(tag.name, place, max(around.beside, int(tag.hint < 0)), max(around.article, int(tag.name in WITHIN)), container)


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order: character references decoded, white space as one space. Elements that aren't closed end with what encloses them."""
    page = page or ""
    out: list[Block] = []
    stack = [Open("", 0, 0, 0, 0)]
    pieces: list[str] = []
    linked, in_link, at, number = 0, False, 0, 0

    def end() -> None:
        nonlocal linked
        text = " ".join("".join(pieces).split())
        pieces.clear()
        if text:
            out.append(Block(text, linked, KINDS.get(stack[-1].name, 0), stack[-1]))
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            pieces.append(text)
            if in_link:
                linked += len(text.split())

    for found in iter(lambda: _TAG.search(page, at), None):
        add(page[at : found.start()])
        at = found.end()
        tag = _parsed(found[0])
        if tag is None:
            continue
        name = tag.name
        if name in INLINE:
            if name == "a":
                in_link = not tag.closing
            continue
        if name == "br":
            pieces.append(" ")
            continue
        end()
        if tag.closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if depth:
                del stack[depth:]
            in_link = False
        elif name in SKIPPED:
            close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            if close:
                at = close.end()
            elif name in ("script", "style"):
                at = len(page)
        elif name not in EMPTY:
            if stack[-1].name == "p" or name in KINDS and KINDS[name] in (1, 2) and stack[-1].name in KINDS and KINDS[stack[-1].name] == 2:
                stack.pop()
            if name == "li":
                depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ("li", "ul", "ol")), 0)
                if depth and stack[depth].name == "li":
                    del stack[depth:]
            number += 1
            stack.append(_entered(tag, stack[-1], number))
    add(page[at:])
    end()
    return out


def described(found: list[Block]) -> np.ndarray:
    """FEATURES of a page's blocks, a row a block; beyond the first and last there are blocks of no words."""
    n = len(found)
    words = np.array([b.text.count(" ") + 1 for b in found], float)
    density = np.minimum(1.0, np.array([b.linked for b in found], float) / words) if n else words
    around = lambda x: (np.concatenate([[0.0], x[:-1]]), np.concatenate([x[1:], [0.0]])) if n else (x, x)
    (words_before, words_after), (density_before, density_after) = around(words), around(density)
    free = words * (1 - density)
    places, own = np.unique([b.at.container for b in found], return_inverse=True) if n else (np.empty(0), np.empty(0, int))
    share = np.bincount(own, free, len(places))[own] / max(1.0, free.sum()) if n else words
    told = np.array([(b.at.place, b.at.beside, b.at.article, b.kind, b.text[-1] in ".!?:;…\"»”。", bool(PHRASES.search(b.text[:400]))) for b in found], float).reshape(n, 6)
    return np.column_stack([words, density, words_before, density_before, words_after, density_after, told, share])


#: Labelled page sketches: {n} stands for n words of the main text, [n] for n words beside it. Their blocks are the labelled table.
SKETCHES = (
    "<nav><ul><li><a>[1]</a></li><li><a>[2]</a></li><li><a>[1]</a></li></ul></nav><div class='ad'>[9]</div><article><h1>{9}</h1><p>{30}</p><p>{2}</p><p>{60}</p><p>{1}</p><p><b>{12}</b><br>{20}</p></article><footer>[11]</footer>",
    "<header><a>[3]</a><p>[5]</p></header><main><h1>{7}</h1><p>{45}</p><h2>{4}</h2><p>{80}</p><ul><li>{6}</li><li>{3}</li></ul><p>{25}</p></main><aside><h3>[3]</h3><p>[30]</p><a>[5]</a></aside><footer>[20]</footer>",
    "<div class='header'>[6]</div><div id='menu'><a>[1]</a><a>[1]</a></div><div class='content'><h1>{6}</h1><p>{50}</p><p>{8}</p><p>{40}</p></div><div class='sidebar'><p>[25]</p><p>[7]</p></div><div class='comments'><p>[40]</p><p>[6]</p><p>[25]</p></div><div class='footer'>[14]</div>",
    "<div class='cookie-notice'><p>We use cookies [18]</p></div><div><ul><li><a>[2]</a></li><li><a>[1]</a></li><li><a>[1]</a></li></ul></div><div><h1>{8}</h1><p>{55}</p><p>{70}</p><p>{4}</p><p>{33}</p></div><div><p>© [6]</p></div>",
    "<div><a>[2]</a><a>[2]</a><a>[1]</a></div><div><div><p>{90}</p><p>{65}</p></div><div>{40}</div></div><div><a>[6]</a> <a>[4]</a></div><div>All rights reserved [4]</div>",
    "<header><h1>[3]</h1><nav><a>[1]</a><a>[1]</a></nav></header><article><header><h1>{10}</h1><p>{5}</p></header><section><p>{60}</p><blockquote>{20}</blockquote><p>{9}</p></section><footer><a>[2]</a><p>[6]</p></footer></article><section class='comments'><h2>[2]</h2><article><p>[30]</p></article><article><p>[8]</p></article></section>",
    "<article><h1>{5}</h1><p>{30}</p><div class='ad'>[12]</div><p>{40}</p><aside><p>[15]</p></aside><p>{6}</p><form><label>[4]</label><p>[10]</p></form><p>{22}</p><div class='related'><h3>[2]</h3><a>[7]</a><a>[6]</a></div><div id='comments'><p>[50]</p><p>[3]</p></div></article>",
    "<form><p>[3]</p><label>[2]</label></form><article><p>{35}</p><table><tr><td>{2}</td><td>{1}</td></tr><tr><td>{3}</td><td>{2}</td></tr></table><p>{15} cookie {20}.</p><p>{10} <a>{3}</a> {12}</p><figure><figcaption>{8}</figcaption></figure></article><div role='contentinfo'>[9]</div>",
    "<div id='top'><p>[8]</p></div><article><p>{120}</p><p>{1}</p><p>{1}</p><h2>{3}</h2><p>{14}</p></article><div class='newsletter-signup'><h3>[4]</h3><p>[14]</p></div><div class='share'><a>[1]</a><a>[1]</a></div>",
    "<nav><a>[1]</a></nav><article><h1>{3}</h1></article><footer><p>[30]</p><p>[4]</p></footer>",
    "<div class='wrapper'><div class='post-body'><p>{28}</p><ol><li>{12}</li><li>{9}</li></ol><p>{16}</p></div><div class='post-comments'><ul><li class='comment'><p>[22]</p></li><li class='comment'><p>[5]</p></li></ul></div></div>",
    "<div class='banner'>[7]</div><main><article><h1>{6}</h1><div><p>{44}</p><div><p>{31}</p></div></div></article><section class='recommended'><p>[12]</p><a>[8]</a></section></main><dialog><p>[16]</p></dialog>",
    "<aside><p>[45]</p><p>[60]</p></aside><article><p>{5}</p><p>{3}</p></article><footer><p>[50]</p></footer>",
    "<div><p>{60}</p><p>{20}</p><p>{75}</p></div><ul><li><a>[3]</a></li><li><a>[4]</a></li></ul>",
    "<div class='notice'><p>[25]</p></div><div class='entry-content'><h2>{5}</h2><p>{18}</p><p>{2}</p><p>{55}</p></div><div class='widget'><h3>[2]</h3><p>[20]</p></div><div class='copyright'>© [5]</div>",
    "<p>{40}</p><p>{12}</p><p>{30}</p>",
    "{60}",
    "{3}",
    "<h1>{3}</h1>{5}",
    "<nav><a>[2]</a><a>[1]</a></nav><article><h1>{5}</h1><p>{50}</p><p>{7}</p></article>",
    "<div><h1>{6}</h1><p>{35}</p><p>{3}</p></div>",
    "<h1>{4}</h1><p>{22}</p><ul><li>{5}</li><li>{8}</li></ul><p>{18}</p><div><a>[2]</a> | <a>[2]</a> | <a>[1]</a></div>",
    "<table><tr><td><a>[1]</a></td><td><a>[2]</a></td></tr></table><table><tr><td>{80}</td></tr><tr><td>{50}</td></tr></table><div>© [7]</div>",
    "<div><ul><li><a>[1]</a></li><li><a>[1]</a></li></ul></div><div><p>{70}</p><p>{5} <a>{2}</a> {20}</p><p>{45}</p></div><div><p>We use cookies [12]</p></div>",
    "<section><p>{30}</p><p>{60}</p></section><section><h3>[2]</h3><ul><li><a>[6]</a></li><li><a>[5]</a></li><li><a>[7]</a></li></ul></section>",
    "<article><p>{25}</p><ul><li><a>{3}</a></li><li><a>{4}</a> {6}</li></ul><p><a>{2}</a></p><p>{31}</p></article><div class='social'><a>[1]</a></div>",
    "<div class='page-header'>[4]</div><div class='text'><p>{33}</p><p>{2}</p></div><div class='subscribe'>[10]</div><script>[5]</script>",
    "<main><p>{50}</p><div class='alert'>[12]</div><p>{20}</p><section class='reviews comments'><article><p>[60]</p></article></section></main>",
)


def labelled(most: int = TRAINING_BLOCKS) -> list[tuple[list[float], float]]:
    """The labelled table: features and label of the blocks of all sketches, each at several lengths, up to so many blocks."""
    rows: list[tuple[list[float], float]] = []
    for size in (1.0, 0.3, 2.5, 0.6, 6.0, 1.6, 0.15, 4.0, 1.2, 0.8):
        for shift, sketch in enumerate(SKETCHES):
            fill = lambda word: lambda m, i=iter(range(10**6)): " ".join([word] * max(1, round(int(m[1]) * size * (0.5 + (next(i) * 7 + shift) % 11 / 10)))) + "." * (int(m[1]) > 4)  # noqa: B023, E731
            page = re.sub(r"\[(\d+)\]", fill("beside"), re.sub(r"\{(\d+)\}", fill("within"), sketch))
            found = blocks(page)
            rows += [(x.tolist(), float("within" in b.text)) for x, b in zip(described(found), found, strict=True)]
    return rows[:most]


class Tree(NamedTuple):
    """A decision tree as arrays: a node's feature (-1 for leaves), threshold, children and label."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    label: np.ndarray

    def judge(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        for _ in range(len(self.feature)):
            feature = self.feature[at]
            if (feature < 0).all():
                break
            lower = x[np.arange(len(x)), np.maximum(feature, 0)] <= self.threshold[at]
            at = np.where(feature < 0, at, np.where(lower, self.left[at], self.right[at]))
        return self.label[at] > 0.5


def trained(spark: SparkSession, most: int = TRAINING_BLOCKS) -> Tree:
    """The tree that Spark learns from the labelled table."""
    rows = spark.createDataFrame(labelled(most), "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=DEPTH, maxBins=64, minInstancesPerNode=2, seed=1).fit(rows)
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in model.toDebugString.splitlines()[1:] if x.strip()]
    nodes: list[list[float]] = []

    def read(i: int) -> tuple[int, int]:
        """(number of the node at line i, line after it)"""
        here = len(nodes)
        nodes.append([-1, 0.0, 0, 0, 0.0])
        if lines[i][1].startswith("Predict"):
            nodes[here][4] = float(lines[i][1].split(":")[1])
            return here, i + 1
        found = re.match(r"If \(feature (\d+) <= (\S+)\)", lines[i][1])
        left, i = read(i + 1)
        right, i = read(i + 1)  # after its Else
        nodes[here][:4] = [int(found[1]), float(found[2]), left, right]
        return here, i

    read(0)
    columns = list(zip(*nodes, strict=True))
    return Tree(np.array(columns[0], np.int64), np.array(columns[1]), np.array(columns[2], np.int64), np.array(columns[3], np.int64), np.array(columns[4]))


def main_text(page: str | None, tree: Tree) -> str:
    """Blocks that the tree takes for main text, in the order of the page, joined by a space."""
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b.text for b, kept in zip(found, tree.judge(described(found)), strict=True) if kept)


def extract(pages: DataFrame, tree: Tree | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page: its main text, empty where there is none.

    Pages (page_id, url, html) may have nulls in any column (null html is an empty page), may be repeated (each has its row) and may have further columns, which are
    ignored; markup may be broken anywhere. An empty table gives none. Nothing is shuffled: a task reads its pages one by one, whole. The tree is trained on
    the labelled table (TRAINING_BLOCKS rows at most) unless given, and sent to tasks as a few arrays.
    """
    tree = trained(pages.sparkSession) if tree is None else tree
    shared = pages.sparkSession.sparkContext.broadcast(tuple(tree))

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Tree(*shared.value)
        for batch in batches:
            yield pd.Series([main_text(page, own) for page in batch], dtype=object)

    found = pages.select("page_id", "url", text("html").alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
