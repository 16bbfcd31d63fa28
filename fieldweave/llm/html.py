"""Main text of HTML pages: boosted trees over DOM nodes, decoded as a hierarchy.

Every element is described by its subtree's text density and link share, by the
tokens of its tag and attributes, its depth and its siblings. Gradient-boosted
trees, fitted on a bounded sample of pages, give each element log-odds of
belonging to the article. The decoding picks the set of kept elements with the
greatest sum in which no kept element has a dropped ancestor, so an element and
what contains it never contradict each other.

No page is labelled. The fit's labels come from pages that mark their article
(`article`, `main` or that role): elements in it are wanted, the others are not,
and neither are elements whose own tokens name furniture. Every such page is
learnt from twice, as it is and with all telling tags and tokens taken away, so
that the trees have to find the same article by text density, links, depth and
siblings alone. These make two sets of trees, one for pages with telling tags or
tokens and one for pages without any.

A null or empty page gives an empty text. Broken markup (open or stray tags,
text after the end) is read as browsers do in outline: a block start ends an
open paragraph. Pages of any length and depth take time in proportion. Text is
cut into blocks at block-level tags; `br` and white space become one space. An
element whose gain is zero, a tie, is dropped. Repeated rows get a row each; null
ids pass through; columns called `text` and `n_chars` give way, others stay; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A tag ends at the first > outside quotes; after a tag that has none such, quotes say nothing and any > ends one.
_TAG, _LOOSE = (re.compile(x, re.S) for x in (
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
))
#: A name begins where a run of name characters does and takes all of it, so that no run is read twice.
_ATTR = re.compile(r"""(?<![^\s=/"'>])([^\s=/"'>]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")

# What HTML says about tags, and the names that page furniture goes by.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp svg math".split())
HIDDEN = frozenset("head script style noscript template iframe noembed noframes title textarea svg math select option button object video audio canvas".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body td th tr tbody thead tfoot dd dt li summary figcaption".split()) | frozenset("dd dt li".split())
SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "tr": ("table", "tbody", "thead", "tfoot"), "option": ("select",)}
_CELLS = ("dt", "dd", "td", "th")
_ACROSS_CELLS = frozenset("tr table tbody thead tfoot html body".split())
FURNITURE_TAGS = frozenset("nav header footer aside form menu dialog button label fieldset".split())
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs"
    " header masthead footer foot sidebar side aside widget related recommended popular share sharing social newsletter subscribe signup"
    " cookie cookies consent notice alert warning popup modal overlay comment comments discussion disqus respond reply replies form search"
    " login pagination pager copyright legal disclaimer tags toolbar contentinfo complementary".split()
)
ARTICLE = frozenset("article main content post entry story body text articlebody".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}
FEATURES = (
    "log_chars", "log_words", "density", "link_share", "tags_per_word", "furniture", "furniture_above", "article", "article_above",
    "depth", "heading", "paragraph", "list", "table", "link", "inline", "children", "place", "same_siblings", "share_of_parent",
    "mean_block", "stops", "root", "marked",
)


@dataclass(slots=True)
class Node:
    tag: str
    parent: int
    depth: int
    tokens: frozenset[str] = frozenset()
    chars: int = 0
    words: int = 0
    linked: int = 0
    stops: int = 0
    below: int = 0
    children: list[int] = field(default_factory=list)


def parse(html: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Elements in page order (the first is the page itself), and a stream of (element, text); None ends a block."""
    nodes = [Node("", -1, 0)]
    stream: list[tuple[int, str | None]] = []
    stack = [0]
    open_at: dict[str, list[int]] = {}  # places in the stack by tag, and of all blocks
    at, n, tag_at = 0, len(html), _TAG

    def text(a: int, b: int) -> None:
        if a < b:
            stream.append((stack[-1], html[a:b]))

    def close_to(k: int) -> None:
        for i in stack[k:]:
            if nodes[i].tag in BLOCK:
                stream.append((i, None))
                break
        while len(stack) > k:
            tag = nodes[stack.pop()].tag
            open_at[tag].pop()
            if tag in BLOCK:
                open_at["blocks"].pop()

    def last(*tags: str) -> int:
        """The place of the innermost open element of these tags, or 0."""
        return max((places[-1] for t in tags if (places := open_at.get(t))), default=0)

    while at < n:
        m = tag_at.search(html, at)
        if not m:
            text(at, n)
            break
        text(at, m.start())
        at = m.end()
        found = m.groups()
        if found[1] is None and len(found) > 3:
            if found[4] is not None:
                tag_at = _LOOSE
            found = found[3:]
        closing, name, attributes = found[:3]
        if not name:
            continue
        tag = name.lower()
        if closing:
            k = last(tag)
            if k and (tag in _ACROSS_CELLS or k >= last("td", "th", "table")):
                close_to(k)
            continue
        if tag == "br":
            stream.append((stack[-1], " "))
            continue
        if tag in CLOSES_P:
            k = last("p")
            if k and k == last("blocks"):
                close_to(k)
        if tag in SAME:
            k = last(*(_CELLS if tag in _CELLS else (tag,)))
            if k and k > last(*SAME[tag]):
                close_to(k)
        if tag in BLOCK:
            stream.append((stack[-1], None))
        if tag in VOID:
            continue
        tokens = {tag}
        for key, *values in _ATTR.findall(attributes) if attributes else ():
            if key.lower() in ("class", "id", "role", "itemprop", "aria-label"):
                tokens.update(re.findall("[a-z]+", re.sub("([a-z])([A-Z])", r"\1 \2", "".join(values)).lower()))
        me = len(nodes)
        nodes.append(Node(tag, stack[-1], len(stack), frozenset(tokens)))
        nodes[stack[-1]].children.append(me)
        if attributes.rstrip().endswith("/") and tag in ("svg", "math"):
            continue
        open_at.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            open_at.setdefault("blocks", []).append(len(stack))
        stack.append(me)
        if tag in RAW:
            end = _END[tag].search(html, at)
            text(at, end.start() if end else n)
            at = end.end() if end else n
            close_to(len(stack) - 1)
    return nodes, stream


def describe(nodes: list[Node], stream: list[tuple[int, str | None]], plain: bool = False) -> np.ndarray:
    """One row of FEATURES per element; sums run over subtrees. `plain` sees no telling tag or token."""
    for e in nodes:
        e.chars = e.words = e.linked = e.stops = e.below = 0
    marked = not plain and any(e.tag in FURNITURE_TAGS or e.tokens & FURNITURE or e.tokens & ARTICLE and e.tag not in ("body", "html") for e in nodes)
    blocks = [0] * len(nodes)
    hidden = [False] * len(nodes)
    for i, e in enumerate(nodes):
        hidden[i] = e.tag in HIDDEN or (e.parent >= 0 and hidden[e.parent])
    for i, t in stream:
        if t is None:
            blocks[i] += 1
        elif not hidden[i]:
            e = nodes[i]
            e.chars += len(t)
            e.words += t.count(" ") + 1 if not t.isspace() else 0
            e.stops += t.count(". ") + t.count(", ") + t.endswith((".", "!", "?"))
    for i in range(len(nodes) - 1, 0, -1):
        e, up = nodes[i], nodes[nodes[i].parent]
        if e.tag == "a":
            e.linked = e.chars
        up.chars += e.chars
        up.words += e.words
        up.linked += e.linked
        up.stops += e.stops
        up.below += e.below + 1
        blocks[e.parent] += blocks[i]
    place, same = [0.0] * len(nodes), [0.0] * len(nodes)
    for e in nodes:
        if len(e.children) > 1:
            counts = Counter([nodes[c].tag for c in e.children])
            for k, c in enumerate(e.children):
                place[c] = k / len(e.children)
                same[c] = min(counts[nodes[c].tag], 50) / 50
    furniture, article, out = [0] * len(nodes), [0] * len(nodes), []
    for i, e in enumerate(nodes):
        tag = e.tag
        up = nodes[e.parent] if i else e
        bad = 2 * (tag in HIDDEN) + (0 if plain else len(e.tokens & FURNITURE) + (tag in FURNITURE_TAGS))
        good = len(e.tokens & ARTICLE) if tag not in ("body", "html") and not plain else 0
        above_bad, above_good = (furniture[e.parent], article[e.parent]) if i else (0, 0)
        furniture[i], article[i] = above_bad + bad, above_good + good
        out.append((
            log1p(e.chars), log1p(e.words), e.chars / (e.below + 1), e.linked / (e.chars or 1), e.below / (e.words + 1), min(bad, 3), min(above_bad, 3), min(good, 2), min(above_good, 2),
            min(e.depth, 30), tag in HEADINGS, tag in ("p", "blockquote", "pre"), tag in ("ul", "ol", "li", "dl"), tag in ("table", "tr", "td", "th"), tag == "a", tag not in BLOCK, min(len(e.children), 50), place[i], same[i], e.chars / (up.chars or 1),
            e.chars / (blocks[i] + 1), e.stops / (e.words + 1), tag in ("", "html", "body"), marked,
        ))
    return np.array(out, dtype=np.float32)


def weak_labels(nodes: list[Node]) -> np.ndarray | None:
    """1 for elements of a marked article and what contains it, 0 for others; None without a mark."""
    inside = np.zeros(len(nodes), dtype=bool)
    barred = np.zeros(len(nodes), dtype=bool)
    for i, e in enumerate(nodes[1:], 1):
        barred[i] = barred[e.parent] or bool(e.tokens & FURNITURE) or e.tag in FURNITURE_TAGS or e.tag in HIDDEN
        inside[i] = not barred[i] and (inside[e.parent] or e.tag in ("article", "main") or "main" in e.tokens)
    if not inside.any():
        return None
    wanted = inside.copy()
    for i in range(len(nodes) - 1, 0, -1):
        if wanted[i]:
            wanted[nodes[i].parent] = True
    return wanted.astype(np.float32)


@dataclass(frozen=True)
class Trees:
    """Boosted regression trees of fixed depth as arrays: a feature and a cut per inner node, a value per leaf."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees go down one level at a time."""
        out = np.full(len(x), self.start)
        trees, inner = np.arange(len(self.feature)), self.feature.shape[1]
        for a in range(0, len(x), 4096):
            part = x[a : a + 4096]
            rows = np.arange(len(part))[:, None]
            at = np.zeros((len(part), len(trees)), dtype=np.int64)
            for _ in range(inner.bit_length()):
                at = 2 * at + 1 + (part[rows, self.feature[trees, at]] > self.cut[trees, at])
            out[a : a + 4096] += self.leaf[trees, at - inner].sum(axis=1)
        return out


@dataclass(frozen=True)
class Model:
    """Trees for elements of pages with telling tags or tokens, and for those of others; the last feature tells which."""

    marked: Trees
    plain: Trees

    def score(self, x: np.ndarray) -> np.ndarray:
        out, told = np.empty(len(x)), x[:, -1] > 0
        out[told], out[~told] = self.marked.score(x[told]), self.plain.score(x[~told])
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32) -> Trees:
    """Second-order boosting of the logistic loss on binned features."""
    inner = (1 << depth) - 1
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)
    rate_of = float(np.clip(y.mean(), 0.01, 0.99))
    start = float(np.log(rate_of / (1 - rate_of)))
    raw = np.full(len(y), start)
    features, places, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p) + 1e-6
        at = np.zeros(len(y), dtype=np.int64)
        f, c = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            best = 1e-6
            gs, hs = g[mine].sum(), h[mine].sum()
            for j in range(x.shape[1]) if len(mine) > 1 else ():
                if not len(cuts[j]):
                    continue
                b = binned[mine, j]
                gl = np.cumsum(np.bincount(b, g[mine], len(cuts[j]) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h[mine], len(cuts[j]) + 1))[:-1]
                gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, f[node], c[node] = gain[k], j, cuts[j][k]
            at[mine] = 2 * node + 1 + (x[mine, f[node]] > c[node])
        leaf = np.bincount(at - inner, g, inner + 1) / (np.bincount(at - inner, h, inner + 1) + 1) * rate
        raw += leaf[at - inner]
        features.append(f)
        places.append(c)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(places), np.array(leaves))


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """Which elements are kept: the greatest sum of log-odds with no kept element under a dropped one."""
    best = np.array(odds, dtype=float)
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].parent] += best[i]
    keep = best > 0
    for i in range(1, len(nodes)):
        keep[i] &= keep[nodes[i].parent]
    return keep


def _assembled(nodes: list[Node], stream: list[tuple[int, str | None]], odds: np.ndarray) -> str:
    keep = decode(nodes, odds).tolist()
    for i, e in enumerate(nodes):
        keep[i] = keep[i] and e.tag not in HIDDEN and (i == 0 or keep[e.parent])
    out, block = [], []
    for i, t in [*stream, (0, None)]:
        if t is None:
            if block:
                joined = " ".join(unescape("".join(block)).split())
                if joined:
                    out.append(joined)
                block.clear()
        elif keep[i]:
            block.append(t)
    return "\n".join(out)


def main_texts(pages: Iterable[str], trees: Trees | Model, together: int = 20_000, most: int = 4_000_000) -> Iterator[str]:
    """The main text of each page; elements of many pages are scored at once, of some `most` characters together."""
    waiting, n, size = [], 0, 0

    def flush() -> Iterator[str]:
        odds = trees.score(np.concatenate([x for _, _, x in waiting]))
        at = 0
        for nodes, stream, x in waiting:
            yield _assembled(nodes, stream, odds[at : at + len(x)])
            at += len(x)

    for page in pages:
        nodes, stream = parse(page)
        waiting.append((nodes, stream, describe(nodes, stream)))
        n += len(nodes)
        size += len(page)
        if n > together or size > most:
            yield from flush()
            waiting, n, size = [], 0, 0
    if waiting:
        yield from flush()


def main_text(page: str, trees: Trees | Model) -> str:
    return next(main_texts([page], trees))


def fit(pages: DataFrame, html: str = "html", page_id: str = "page_id", sample_pages: int = 400, sample_nodes: int = 80_000) -> Trees | Model:
    """Trees fitted on about `sample_pages` pages, chosen by a hash of id and page, and at most `sample_nodes` elements, first by that hash."""
    draw = F.xxhash64(*[c for c in (page_id, html) if c in pages.columns]).alias("draw")
    pages = pages.select(F.col(html).alias("html"), draw).filter("html is not null and html <> ''")
    n = pages.count()
    share = min(1.0, sample_pages / max(n, 1))
    picked = pages.filter(F.pmod("draw", F.lit(1 << 30)) < F.lit(share * (1 << 30))).select("html", "draw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, key in zip(b.column(0), b.column(1).to_pylist()):
                nodes, stream = parse(t.as_py())
                y = weak_labels(nodes)
                if y is not None:
                    x = np.vstack([np.column_stack([describe(nodes, stream, plain), y]) for plain in (False, True)]).astype(np.float32)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array(np.arange(n)), pa.array(list(x), pa.list_(pa.float32()))], names=["draw", "place", "row"])

    rows = picked.mapInArrow(run, "draw long, place long, row array<float>").orderBy("draw", "place", "row").limit(sample_nodes).collect()
    if not rows:  # nothing to learn from: furniture out, text in
        f, c = np.array([[FEATURES.index("furniture_above"), 0, 0]]), np.array([[0.5, 0.0, 0.0]])
        return Trees(0.0, f, c, np.array([[1.0, 1.0, -4.0, -4.0]]))
    a = np.array(sorted(r["row"] for r in rows), dtype=np.float32)
    told = a[:, -2] > 0
    plain = boost(a[~told, :-1], a[~told, -1])
    return Model(boost(a[told, :-1], a[told, -1]) if told.any() else plain, plain)


def extract(pages: DataFrame, trees: Trees | Model | None = None, html: str = "html") -> DataFrame:
    """`pages` with `text` and `n_chars`; columns of those names give way, the html stays."""
    trees = trees or fit(pages, html)
    own = [c for c in pages.columns if c not in ("text", "n_chars")]
    schema = pages.select(*own).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = own.index(html)
        for b in batches:
            found = list(main_texts((t.as_py() or "" for t in b.column(at)), trees))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], names=[*own, "text", "n_chars"])

    return pages.select(*own).mapInArrow(run, schema)
