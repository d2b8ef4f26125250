"""Main text of web pages by a tree-structured graphical model.

Each DOM node is content or not. A node's own features (tag, class and id, length of text, and of
containers the share of links) give its potential; a parent and a child share one that depends on
the child's kind. Links are inline nodes like bold text: a paragraph or list item may be all link,
it is the container around it that tells an article from a menu. On
the tree, one upward and one downward pass of sum-product messages give exact marginals; the passes
run over all nodes of a level, of many pages at once. Weights are fitted to labelled pages by
gradient of the likelihood, around prior weights.

Pages label themselves: in those with an <article> or <main>, what stands inside counts as content,
unless it is marked as a menu, notice, form or the like. Half of them are learned with plain <div>s
in place of telling tags, so that pages without such tags can be read as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.common import by_share, unused
from datatrawl.llm.dom import BLOCK, FALLBACK, HIDDEN, RAW, TEXT, Dom, parse
from datatrawl.llm.tokens import slices

SAMPLE_PAGES = 400      # pages that the weights are fitted on, about
SLICE_BYTES = 1 << 20

CONTENT_TAGS = frozenset(("article", "main"))
BOILER_TAGS = frozenset("nav footer aside header form button input menu dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE = frozenset(
    "b i em strong span u small sub sup code mark font q cite abbr time "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover "
    "munderover mmultiscripts mprescripts mtable mtr mtd menclose semantics annotation annotation-xml".split())
NO_TEXT = RAW | HIDDEN | FALLBACK
BOILER_HINT = re.compile(
    r"\b(nav\w*|menus?|header|footer|side-?bar|aside|notices?|cookies?|consent|banner|ads?|advert\w*|promo\w*|"
    r"sponsor\w*|form|comments?|respond|repl(?:y|ies)|disqus|share|sharing|social|related|subscribe|newsletter|"
    r"breadcrumbs?|discussions?|feedback|pop-?up|modal|widget|pager|pagination|login|search|copyright|toolbar)\b")
CONTENT_HINT = re.compile(r"\b(article|content|main|post|entry|story|body|text)\b")

# Kinds of nodes, each with its own parent-child potential.
KINDS = ("page", "content", "boiler", "heading", "paragraph", "item", "list", "inline", "block", "text", "raw")
_KIND = {"p": "paragraph", "pre": "paragraph", "blockquote": "paragraph", "td": "paragraph", "a": "inline",
         "ul": "list", "ol": "list", "li": "item", "dt": "item", "dd": "item", "dl": "list", "#page": "page", TEXT: "text",
         **{t: "content" for t in CONTENT_TAGS}, **{t: "boiler" for t in BOILER_TAGS},
         **{t: "heading" for t in HEADINGS}, **{t: "inline" for t in INLINE}, **{t: "raw" for t in NO_TEXT}}
_KIND = {t: KINDS.index(k) for t, k in _KIND.items()}
_BLOCK_KIND = KINDS.index("block")
RAW_KIND = KINDS.index("raw")
# Kinds that may be all link in an article as in a menu; their surroundings tell.
_UNTOLD = np.isin(KINDS, ("paragraph", "heading", "item"))
_FIXED = np.isin(KINDS, ("list", "item", "inline"))   # kinds whose potential with the parent isn't learned
_INLINE, _TEXT, _LIST, _ITEM = (KINDS.index(k) for k in ("inline", "text", "list", "item"))

# Features: kind; hint of a class or id; text within by size; share of it in links.
N_KINDS = len(KINDS)
HINTS = ("none", "boiler", "content")
SIZES = (0, 1, 20, 80, 300)
LINKS = (0.0, 0.01, 0.4, 0.8)
OFFSETS = np.cumsum([0, N_KINDS, len(HINTS), len(SIZES), len(LINKS) + 1])   # the last: no container


def prior_weights() -> np.ndarray:
    w = np.zeros(OFFSETS[-1])
    w[KINDS.index("content")], w[KINDS.index("boiler")] = 3.0, -4.0
    w[KINDS.index("raw")] = -8.0
    w[OFFSETS[1] + 1], w[OFFSETS[1] + 2] = -4.0, 2.0
    w[OFFSETS[2]:OFFSETS[3]] = (0.0, -0.5, -0.2, 0.2, 0.6)
    w[OFFSETS[3]:OFFSETS[4]] = (0.1, 0.0, -0.5, -1.5, 0.0)
    return w


def prior_pairs() -> np.ndarray:
    """(kind, parent's state, child's state): children mostly follow their parent."""
    one = np.array([[2.0, -1.0], [-0.5, 1.5]])
    pairs = np.repeat(one[None], N_KINDS, 0)
    # A container may begin the content, and what is told apart may end it.
    pairs[KINDS.index("content"), 0] = (0.5, 0.5)
    pairs[KINDS.index("block"), 0] = (1.0, 0.0)
    # What only follows its parent speaks for neither side.
    pairs[_FIXED] = [[2.0, -2.0], [-2.0, 2.0]]
    return pairs


@dataclass
class Forest:
    """The nodes of many pages, parents before children."""

    parent: np.ndarray      # -1 for a page
    kind: np.ndarray
    features: np.ndarray    # (nodes, 4): places in the weights
    levels: list[np.ndarray]
    follows: np.ndarray     # inline nodes, their texts and items: no potential but that with the parent


def forest(doms: list[Dom], plain: set[int] = frozenset()) -> Forest:
    """`plain`: pages of which telling tags and hints are not used."""
    sizes = [len(d.parent) for d in doms]
    begin = np.cumsum([0, *sizes[:-1]]) if doms else np.zeros(0, int)
    total = sum(sizes)
    parent, kind, hint = np.full(total, -1), np.zeros(total, int), np.zeros(total, int)
    chars, links, depth = np.zeros(total), np.zeros(total), np.zeros(total, int)
    for i, (dom, b) in enumerate(zip(doms, begin)):
        p = dom.parent
        level, in_link = [0] * len(p), [False] * len(p)
        kinds = [_KIND.get(t, _BLOCK_KIND) for t in dom.tag]
        if i in plain:
            kinds = [_BLOCK_KIND if KINDS[k] in ("content", "boiler") else k for k in kinds]
        size, linked = [0] * len(p), [0] * len(p)
        for k in range(1, len(p)):
            up = p[k]
            level[k] = level[up] + 1
            in_link[k] = in_link[up] or dom.tag[k] == "a"
            if dom.tag[k] == TEXT:
                size[k] = len(dom.text[k].strip())
                linked[k] = size[k] if in_link[k] else 0
            elif dom.hint[k] and i not in plain:
                hint[b + k] = 1 if BOILER_HINT.search(dom.hint[k]) else 2 if CONTENT_HINT.search(dom.hint[k]) else 0
        for k in range(len(p) - 1, 0, -1):
            size[p[k]] += size[k]
            linked[p[k]] += linked[k]
        here = slice(b, b + len(p))
        parent[here] = np.array(p) + b
        parent[b] = -1
        kind[here], depth[here], chars[here], links[here] = kinds, level, size, linked
    share = links / np.maximum(chars, 1)
    above = np.where(parent >= 0, parent, 0)
    # A list of links is one of an article's own if what is around it is not mostly links.
    within = (kind == _LIST) & (depth > 2) & (share[above] < LINKS[2])
    follows = (kind == _INLINE) | ((kind == _TEXT) & (kind[above] == _INLINE)) | (((kind == _ITEM) | within) & (hint == 0))
    untold = _UNTOLD[kind] | within
    features = np.column_stack([
        kind, OFFSETS[1] + hint, OFFSETS[2] + np.searchsorted(SIZES, chars, "right") - 1,
        OFFSETS[3] + np.where(untold, len(LINKS), np.searchsorted(LINKS, share, "right") - 1)])
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(1, depth.max(initial=0) + 1))
    return Forest(parent, kind, features, np.split(order, cuts), follows)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class PageModel:
    weights: np.ndarray
    pairs: np.ndarray

    def infer(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of each node, and of each node with its parent (nodes, parent, child)."""
        n = len(f.parent)
        own = np.zeros((n, 2))                      # potential, then with all messages from below
        own[:, 1] = np.where(f.follows, 0.0, self.weights[f.features].sum(1))
        up = np.zeros((n, 2))                       # message to the parent
        for nodes in reversed(f.levels[1:]):
            up[nodes] = _lse(self.pairs[f.kind[nodes]] + own[nodes][:, None, :], 2)
            np.add.at(own, f.parent[nodes], up[nodes])
        belief = own.copy()                         # log of the marginal
        if n:
            belief[f.levels[0]] -= _lse(belief[f.levels[0]], 1)[:, None]
        both = np.zeros((n, 2, 2))
        for nodes in f.levels[1:]:
            above = belief[f.parent[nodes]] - up[nodes]
            joint = above[:, :, None] + self.pairs[f.kind[nodes]] + own[nodes][:, None, :]
            joint -= _lse(joint.reshape(len(nodes), 4), 1)[:, None, None]
            belief[nodes] = _lse(joint, 1)
            both[nodes] = np.exp(joint)
        return np.exp(belief), both

    def main_texts(self, pages: list[str]) -> list[str]:
        doms = [parse(p) for p in pages]
        f = forest(doms)
        marginal = self.infer(f)[0][:, 1] if len(f.parent) else np.zeros(0)
        out, begin = [], 0
        for dom in doms:
            out.append(_join(dom, marginal[begin:begin + len(dom.parent)] >= 0.5))
            begin += len(dom.parent)
        return out


def _join(dom: Dom, content: np.ndarray) -> str:
    """Content texts in page order; a block's begin and end are white space, inline tags are not."""
    parts: list[str] = []
    kept = content.tolist()
    path: list[int] = []   # open blocks
    parent, tags, texts = dom.parent, dom.tag, dom.text
    for k in range(1, len(parent)):
        while path and parent[k] < path[-1]:
            path.pop()
            parts.append(" ")
        if tags[k] in BLOCK:
            parts.append(" ")
            path.append(k)
        elif kept[k] and tags[k] == TEXT:
            parts.append(texts[k])
    return " ".join("".join(parts).split())


def self_labels(dom: Dom) -> list[int] | None:
    """1 for nodes within the page's marked content; None for a page without any."""
    state = [0] * len(dom.parent)
    for k in range(1, len(dom.parent)):
        up, tag = dom.parent[k], dom.tag[k]
        boiler = tag in BOILER_TAGS or tag in NO_TEXT or bool(dom.hint[k] and BOILER_HINT.search(dom.hint[k]))
        if boiler or state[up] < 0:
            state[k] = -1
        else:
            state[k] = 1 if state[up] == 1 or tag in CONTENT_TAGS else 0
    return [int(s == 1) for s in state] if 1 in state else None


def fit(pages: list[str], labels: list[list[int]] | None = None, epochs: int = 60, rate: float = 0.1,
        pull: float = 0.02) -> PageModel:
    """Fits the weights to pages, by `labels` of their nodes (as `dom.parse` numbers them) or by
    their own markup. Weights are pulled to the prior, which is all there is without pages."""
    model = PageModel(prior_weights(), prior_pairs())
    doms = [parse(p) for p in pages]
    known = [(d, y) for d, y in zip(doms, labels or map(self_labels, doms)) if y is not None]
    if not known:
        return model
    doms = [d for d, _ in known]
    y = np.concatenate([np.array(s) for _, s in known])
    f = forest(doms, plain=set(range(0, len(doms), 2)))
    child = np.flatnonzero(f.parent >= 0)
    # A page as a whole is never content where there is markup, which tells nothing of pages without.
    told = ~f.follows & (f.parent >= 0)
    seen = np.zeros_like(model.pairs)
    np.add.at(seen, (f.kind[child], y[f.parent[child]], y[child]), 1)
    n = len(doms)
    squares = [np.zeros_like(model.weights), np.zeros_like(model.pairs)]
    start = model.weights.copy(), model.pairs.copy()
    for _ in range(epochs):
        marginal, both = model.infer(f)
        expected = np.zeros_like(seen)
        np.add.at(expected, f.kind[child], both[child])
        expected[_FIXED] = seen[_FIXED]
        g_w = np.zeros_like(model.weights)
        np.add.at(g_w, f.features[told], (y - marginal[:, 1])[told, None])
        for value, grad, first, square in zip((model.weights, model.pairs), (g_w, seen - expected), start, squares):
            grad = grad / n - pull * (value - first)
            square += grad * grad
            value += rate * grad / (np.sqrt(square) + 1e-6)
    return model


def fit_sample(pages: DataFrame, text: str = "html", key: str = "page_id",
               sample_pages: int = SAMPLE_PAGES, most_chars: int = 100_000) -> PageModel:
    """Fits on about `sample_pages` pages of at most `most_chars` characters, chosen by a hash.

    The hash is of key and text, and equal pages count once, whatever their keys. Only the sample
    comes to the driver, of which these two numbers bound the size.
    """
    mark = unused(pages, "sampled_by")
    known = pages.filter(F.length(text) <= most_chars).withColumn(mark, F.xxhash64(key, text))
    n = known.agg(F.approx_count_distinct(mark)).first()[0]
    share = min(1.0, sample_pages / max(1, n))
    picked = known.filter(by_share(F.col(mark), F.lit(share)))
    return fit(sorted(r[0] for r in picked.select(text).distinct().collect()))


def extract(pages: DataFrame, model: PageModel, page_id: str = "page_id", url: str = "url",
            text: str = "html") -> DataFrame:
    """Per row of `pages`: `page_id`, `url`, `text` (main text, empty if none), `n_chars`.

    A null page counts as empty. Repeated rows come out as often as they go in; other columns are
    not read.
    """
    narrow = pages.select(F.col(page_id).alias("id"), F.col(url).alias("url"),
                          F.coalesce(F.col(text), F.lit("")).alias("html"))
    schema = T.StructType([narrow.schema["id"], narrow.schema["url"], T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("html"), SLICE_BYTES):
                texts = model.main_texts(part.to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), batch.column("url").slice(at, len(part)),
                     pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", page_id)
