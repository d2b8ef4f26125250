"""N-gram Jaccard join: links between texts whose word shingle sets overlap enough.

Tokens (shingle hashes) are hashed into groups. A text is a point, its counts by group; the sum of
the smaller coordinates of two points bounds the overlap of their sets, for two boxes of points the
same holds of their upper corners. That is what the R-tree here prunes by.

The tree's upper part lies in the shuffle: sets that may link differ in at most D shingles, so of
more than D finer groups some hold no difference. A cell is one such group with its content; only
points of one cell are compared (see `cell_keys`). Points of a cell are first compared with one of
them, which is linear however large the cell is, and joined to components, in a few rounds; cells
that hold several components after that are searched by R-trees for pairs across components, so no
two members of a group of copies are paired for nothing. Every candidate is verified on the sets.

Texts with equal sets are one node, told apart by a 64-bit hash of the set.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.common import give_back, release, row_key, stage, unused
from datatrawl.llm.components import components
from datatrawl.llm.tokens import drop_encoders, slices

SHINGLE = 3
THRESHOLD = Fraction(9, 10)
NEAR = Fraction(8, 10)  # what near copies on five-word shingles take
GROUPS = 128           # coordinates of a point
MOST_GROUPS = 1024     # of a finer point, which has about as many coordinates as its set has shingles
ROUNDS = 4             # rounds of comparing a cell's points with one of them, before trees
LEAF = 32              # points of an R-tree leaf
BLOCK = 2048           # points of a cell that one task searches; larger cells are cut in blocks
BLOOM_BITS = 1 << 24   # of the filter that the second scan of the texts is thinned with
SLICE_BYTES = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed hash of 64-bit numbers (the finisher of a common generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text (no nulls), sorted within it, and the offsets.

    Words are what stands between ASCII white space, A-Z in lower case. A text of fewer words than
    `shingle` has its whole word sequence as one; without words its set is empty.
    """
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    at = at - at[0]
    known = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in known), np.uint64, len(known))
    codes = coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    if known and "" in known:
        # White space at the ends leaves empty pieces.
        full = codes != known.index("")
        codes, owner = codes[full], owner[full]
    word = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.cumsum(counts) - counts
    spans = np.where(counts == 0, 0, np.maximum(1, counts - shingle + 1))
    total = int(spans.sum())
    text_of = np.repeat(np.arange(len(texts)), spans)
    first = starts[text_of] + np.arange(total) - np.repeat(np.cumsum(spans) - spans, spans)
    value = np.full(total, np.uint64(1))
    end = (starts + counts)[text_of]
    for k in range(shingle):
        # Behind a short text's end nothing is added, so its sequence can't equal a longer one.
        there = first + k < end
        nxt = word[np.where(there, first + k, 0)] if len(word) else value
        value = np.where(there, _mix(value * _GOLD + nxt), value)
    order = np.lexsort((value, text_of))
    value, text_of = value[order], text_of[order]
    if total:
        fresh = np.ones(total, bool)
        fresh[1:] = (value[1:] != value[:-1]) | (text_of[1:] != text_of[:-1])
        value, text_of = value[fresh], text_of[fresh]
    sizes = np.bincount(text_of, minlength=len(texts))
    return value, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


@functools.cache
def _bands(threshold: Fraction, most: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends of size bands, and how many shingles two linked sets of a band may differ in."""
    ends = [0]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * 5 // 4))
    # |A| + |B| - 2 |A and B| is at most (1 - t) / (1 + t) of |A| + |B|.
    differ = [int((1 - threshold) / (1 + threshold) * 2 * e) for e in ends]
    return np.array(ends), np.array(differ)


def cell_keys(hashes: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """The cells of one set (sorted hashes): any two linked, unequal sets share one.

    The band of the larger set settles the number of groups, so a set that may be the smaller one
    also goes by the next bands that its partners may lie in. Of D + m groups, two linked sets
    share m at least; each leaves out its m - 1 smallest groups, which tell little, and the largest
    that both share is still among the rest: it has m - 1 shared ones before it in either.
    """
    ends, differ = _bands(threshold)
    n = len(hashes)
    if not n:
        return np.zeros(0, np.uint64)
    low, high = np.searchsorted(ends, [n, int(n / threshold)])
    keys = []
    for band in range(low, high + 1):
        if not differ[band]:
            continue   # only equal sets link
        spare = 2 + int(differ[band]) // 3
        groups = int(differ[band]) + spare
        group = ((hashes >> np.uint64(32)) * np.uint64(groups) >> np.uint64(32)).astype(np.int64)
        first = np.searchsorted(group, np.arange(groups))
        size = np.diff(np.append(first, n))
        held = np.flatnonzero(size)
        content = np.zeros(groups, np.uint64)
        content[held] = np.add.reduceat(_mix(hashes), first[held])
        told = np.argsort(size, kind="stable")[spare - 1:]
        name = np.uint64(band) << np.uint64(40) | told.astype(np.uint64)
        keys.append(_mix(_mix(content[told] + _GOLD) + name * _GOLD))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def points(hashes: np.ndarray, offsets: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """(sets, groups): how many hashes of each set fall in each group."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    place = owner * groups + (hashes % np.uint64(groups)).astype(np.int64)
    return np.bincount(place, minlength=(len(offsets) - 1) * groups).reshape(-1, groups).astype(np.int32)


def may_link(a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """By the points `a` and `b` (broadcast over the last axis): could the sets link?"""
    overlap = np.minimum(a, b).sum(-1)
    union = a.sum(-1) + b.sum(-1) - overlap
    return overlap * threshold.denominator >= union * threshold.numerator


def fine_points(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Counts of each set in 128 to MOST_GROUPS groups (a power of two), by its size, as 16-bit numbers."""
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        groups = min(MOST_GROUPS, max(GROUPS, 1 << max(0, b - a - 1).bit_length()))
        count = np.bincount((hashes[a:b] & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
        out.append(np.minimum(count, 65535).astype("<u2").tobytes() if count.max(initial=0) <= 65535 else b"")
    return out


def folded(point: bytes, groups: int) -> np.ndarray:
    """The point in fewer groups: those that fall together are summed."""
    return np.frombuffer(point, "<u2").astype(np.int32).reshape(-1, groups).sum(0)


def may_link_finely(fine: list[bytes], a: np.ndarray, b: np.ndarray, threshold: Fraction = THRESHOLD) -> np.ndarray:
    """`may_link` of the points `a` and `b` (places in `fine`), each pair in as many groups as both have."""
    size = np.array([len(p) // 2 for p in fine], np.int64)
    groups = np.minimum(size[a], size[b])
    out = np.ones(len(a), bool)     # without a point nothing is ruled out
    for g in np.unique(groups[groups > 0]).tolist():
        at = np.flatnonzero(groups == g)
        need = np.unique(np.concatenate([a[at], b[at]]))
        x = np.stack([folded(fine[k], g) for k in need.tolist()])
        for part in np.array_split(at, max(1, len(at) * g >> 22)):
            i, j = np.searchsorted(need, a[part]), np.searchsorted(need, b[part])
            out[part] = may_link(x[i], x[j], threshold)
    return out


class RTree:
    """A packed R-tree over points: sorted tiles, boxes by level, the root last."""

    def __init__(self, x: np.ndarray, label: np.ndarray) -> None:
        self.order = self._tiles(x, np.arange(len(x)))
        self.x, self.label = x[self.order], label[self.order]
        size = self.x.sum(1)
        starts = np.arange(0, len(x), LEAF)
        # Of a box: upper corner, smallest set, and its one label or -1.
        level = [np.maximum.reduceat(self.x, starts), np.minimum.reduceat(size, starts),
                 self._one(np.minimum.reduceat(self.label, starts), np.maximum.reduceat(self.label, starts))]
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), LEAF)
            same = self._one(np.minimum.reduceat(level[2], starts), np.maximum.reduceat(level[2], starts))
            level = [np.maximum.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts), same]
            self.levels.append(level)

    @staticmethod
    def _one(least: np.ndarray, most: np.ndarray) -> np.ndarray:
        return np.where(least == most, least, -1)

    @staticmethod
    def _tiles(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows in tile order: cut at the median of the widest coordinate, again and again."""
        todo, out = [rows], []
        while todo:
            rows = todo.pop()
            if len(rows) <= LEAF:
                out.append(rows)
                continue
            wide = int(np.ptp(x[rows], axis=0).argmax())
            rows = rows[np.argsort(x[rows, wide], kind="stable")]
            half = (len(rows) // 2 + LEAF - 1) // LEAF * LEAF
            todo += [rows[half:], rows[:half]]
        return np.concatenate(out) if out else rows

    def pairs(self, other: RTree, threshold: Fraction = THRESHOLD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (in each tree's input) of points that may link and have different labels."""
        num, den = threshold.numerator, threshold.denominator

        def open_(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray) -> np.ndarray:
            overlap = np.minimum(a[0][i], b[0][j]).sum(1)
            # Linked sets overlap in t / (1 + t) of their sizes' sum at least.
            least = a[1][i] + b[1][j]
            same = (a[2][i] == b[2][j]) & (a[2][i] >= 0)
            return (overlap * (num + den) >= least * num) & ~same

        deep = max(len(self.levels), len(other.levels)) - 1
        i, j = np.zeros(1, int), np.zeros(1, int)
        for k in range(deep, -1, -1):
            a, b = self.levels[min(k, len(self.levels) - 1)], other.levels[min(k, len(other.levels) - 1)]
            keep = open_(a, i, b, j)
            i, j = i[keep], j[keep]
            if k:
                i, j = self._descend(self, k, i, j)
                j, i = self._descend(other, k, j, i)
        for p, q in zip(i, j):
            one, two = slice(p * LEAF, (p + 1) * LEAF), slice(q * LEAF, (q + 1) * LEAF)
            hit = may_link(self.x[one, None], other.x[None, two], threshold)
            hit &= self.label[one, None] != other.label[None, two]
            u, v = np.nonzero(hit)
            if len(u):
                yield self.order[one][u], other.order[two][v]

    @staticmethod
    def _descend(tree: RTree, level: int, mine: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each box replaced by its children one level below, if the tree has that level."""
        if level >= len(tree.levels):
            return mine, other
        n = len(tree.levels[level - 1][0])
        count = np.minimum(LEAF, n - mine * LEAF)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(mine * LEAF, count) + nth, np.repeat(other, count)


def _indexed(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: Fraction) -> DataFrame:
    """`id`, `h`, `bytes` (of the text), `n`, `node` (null for an empty set), `cells` (of the first row with an id of equal sets in a task)."""
    narrow = docs.select(
        F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("h"), F.octet_length(text).alias("bytes"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        seen: set[int] = set()
        for batch in batches:
            for at, run in slices(batch.column("text"), SLICE_BYTES):
                hashes, offsets = shingle_sets(run, shingle)
                sizes, nodes = np.diff(offsets), node_names(hashes, offsets)
                ids = batch.column("id").slice(at, len(run))
                # A row without an id gives its set no cells, so it may not stand for the set.
                may = (sizes > 0) & ids.is_valid().to_numpy(zero_copy_only=False)
                cells = []
                for i, node in enumerate(nodes.tolist()):
                    fresh = may[i] and node not in seen
                    if fresh and len(seen) < 1 << 18:
                        seen.add(node)
                    cells.append(cell_keys(hashes[offsets[i]:offsets[i + 1]], threshold).view(np.int64) if fresh else None)
                same = [batch.column(c).slice(at, len(run)) for c in ("h", "bytes")]
                yield pa.RecordBatch.from_arrays(
                    [ids, *same, pa.array(sizes), pa.array(nodes, mask=sizes == 0),
                     pa.array(cells, pa.list_(pa.int64()))], ["id", "h", "bytes", "n", "node", "cells"])
            # A worker shares its machine with the executor's own memory.
            give_back()

    return narrow.mapInArrow(index, "id long, h long, bytes int, n long, node long, cells array<long>")


def node_names(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A signed 64-bit name of each set."""
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(hashes + _GOLD), dtype=np.uint64)])
    one = summed[offsets[1:]] - summed[offsets[:-1]]
    return _mix(one + np.diff(offsets).astype(np.uint64) * _GOLD).view(np.int64)


def _bloom(ids: DataFrame) -> np.ndarray:
    """A bit for each id's hash, eight to a byte: BLOOM_BITS in all, however many ids there are."""
    place = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    words = ids.select(F.shiftright(place, 5).alias("word"), F.expr(
        f"shiftleft(1L, cast(pmod(xxhash64(id), {BLOOM_BITS}) & 31 as int))").alias("bit")).groupBy("word").agg(
        F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(BLOOM_BITS >> 5, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return out.view(np.uint8)


def _sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """`node`, `point`, `fine`, `hashes` (bytes) for the nodes of `wanted` (`node`, `id` of one text each).

    A second scan of the texts, thinned in the scan by a filter of fixed size; what passes it by
    chance goes in the join.
    """
    bits = _bloom(wanted)
    place = F.pmod(F.xxhash64("id"), F.lit(BLOOM_BITS))
    narrow = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).filter(
        "id is not null and text is not null").select("id", place.alias("place"), "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            place = batch.column("place").to_numpy()
            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1
            batch = batch.filter(pa.array(hit.astype(bool)))
            for _, run in slices(batch.column("text"), SLICE_BYTES):
                hashes, offsets = shingle_sets(run, shingle)
                at = pa.FixedSizeListArray.from_arrays(pa.array(points(hashes, offsets).ravel()), GROUPS)
                data = hashes.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node_names(hashes, offsets)), at.cast(pa.list_(pa.int32())),
                     pa.array(fine_points(hashes, offsets), pa.binary()),
                     pa.array([data[8 * a:8 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())],
                    ["node", "point", "fine", "hashes"])
            give_back()

    built = narrow.mapInArrow(build, "node long, point array<int>, fine binary, hashes binary")
    # One of the rows of a node: they hold the same set.
    return built.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _bounded(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The `pairs` (`a`, `b`) that the bound on their points leaves."""
    p = sets.select("node", "point")
    both = pairs.join(p.select(F.col("node").alias("a"), F.col("point").alias("pa")), "a").join(
        p.select(F.col("node").alias("b"), F.col("point").alias("pb")), "b")
    total = lambda c: F.aggregate(c, F.lit(0), lambda x, y: x + y)
    overlap = total(F.zip_with("pa", "pb", lambda x, y: F.least(x, y)))
    union = total(F.col("pa")) + total(F.col("pb")) - overlap
    return both.filter(overlap * threshold.denominator >= union * threshold.numerator).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: Fraction) -> DataFrame:
    """The `pairs` (`a`, `b`) whose sets link."""
    s = sets.select("node", "hashes")
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("hashes").alias("ha")), "a").join(
        s.select(F.col("node").alias("b"), F.col("hashes").alias("hb")), "b")
    num, den = threshold.numerator, threshold.denominator

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("ha"), batch.column("hb")):
                x, y = (np.frombuffer(v.as_buffer(), "<u8") for v in (x, y))
                merged = np.concatenate([x, y])
                merged.sort(kind="stable")
                overlap = int((merged[1:] == merged[:-1]).sum())
                good.append(overlap * den >= (len(merged) - overlap) * num)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
            del batch
            give_back()

    return both.mapInArrow(verify, "a long, b long")


def _tree_pairs(members: DataFrame, sets: DataFrame, threshold: Fraction, block: int) -> DataFrame:
    """Pairs (`a` < `b`) of a cell's members with different `component`s that may link.

    Members are (`cell`, `node`, `component`). A cell of more than `block` is cut in blocks, and
    each pair of blocks is a task's work. The trees' pairs are bounded once more by finer points, as
    long texts are all alike in a few groups; what comes out are hardly more pairs than links.
    """
    sizes = members.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    placed = members.join(sizes, "cell").join(sets.select("node", "point", "fine"), "node").withColumn(
        "mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    work = placed.select("cell", "node", "component", "point", "fine", "mine", other.alias("other")).select(
        "cell", "node", "component", "point", "fine", "mine",
        F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))

    def search(rows: pa.Table) -> pa.Table:
        node, component = rows.column("node").to_numpy(), rows.column("component").to_numpy()
        mine, one, two = (rows.column(c).to_numpy() for c in ("mine", "one", "two"))
        x = np.array(rows.column("point").to_pylist(), np.int32).reshape(len(rows), -1)
        label, fine = np.unique(component, return_inverse=True)[1], rows.column("fine").to_pylist()
        here, there = np.flatnonzero(mine == one), np.flatnonzero(mine == two)
        out = [np.zeros((0, 2), np.int64)]
        if len(here) and len(there):
            left, right = RTree(x[here], label[here]), RTree(x[there], label[there])
            pairs = list(left.pairs(right, threshold))
            if pairs:
                u, v = here[np.concatenate([p[0] for p in pairs])], there[np.concatenate([p[1] for p in pairs])]
                near = may_link_finely(fine, u, v, threshold)
                out.append(np.sort(np.column_stack([node[u[near]], node[v[near]]]), axis=1))
        found = np.unique(np.concatenate(out), axis=0)
        if len(node) >= block // 2:
            # What a large search took is not held while others run.
            del out, x, fine, rows
            give_back()
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return work.groupBy("cell", "one", "two").applyInArrow(search, "a long, b long").distinct()


def _shared(cells: DataFrame) -> DataFrame:
    """The distinct rows of `cells` (`cell`, `node`) whose cell holds several nodes.

    Cells are by far the largest table here, and nearly all of them are of one node. So they are
    dealt and sorted once, and no map of them is kept: counts by cell, joined to the cells, would
    take them twice. A cell has a node once for each task that met it at most, and a text of some
    length has hundreds of cells, so a cell of very many nodes is still a small part of them.
    """
    same = Window.partitionBy("cell")
    return cells.select("cell", "node", F.min("node").over(same).alias("x"), F.max("node").over(same).alias("y")).filter(
        "x <> y").select("cell", "node").distinct()


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """`labels` (`node`, `component`) after components have been joined by `links` (`a`, `b`)."""
    of = lambda c, d: labels.select(F.col("node").alias(c), F.col("component").alias(d))
    across = links.join(of("a", "x"), "a").join(of("b", "y"), "b").filter("x <> y").select(
        F.col("x").alias("a"), F.col("y").alias("b"))
    joined = components(across).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return stage(labels.join(joined, "component", "left").select(
        "node", F.coalesce("to", "component").alias("component")))


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """`members` with `component`, of the cells that hold more than one."""
    labelled = members.join(labels, "node")
    several = labelled.groupBy("cell").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter(
        "x <> y").select("cell")
    return stage(labelled.join(several, "cell", "left_semi").select("cell", "node", "component"))


def _classes(docs: DataFrame, doc_id: str, text: str, shingle: int, threshold: Fraction, block: int,
             rounds: int) -> DataFrame:
    """Per row of `docs`: `id`, `h`, `bytes`, `n`, and `first`, the smallest (id, h, bytes) of its component.

    `first` is null for rows without shingles, and for rows without an id whose text no other has.
    """
    wide = stage(_indexed(docs, doc_id, text, shingle, threshold))
    kept = stage(wide.drop("cells"))
    cells = wide.filter("cells is not null and id is not null").select(F.explode("cells").alias("cell"), "node")
    members = stage(_shared(cells))
    # Most cells are of one set only; what is shared is written now.
    release(wide)

    names = stage(kept.filter("node is not null and id is not null").groupBy("node").agg(
        F.min(F.struct("id", "h", "bytes")).alias("first")))
    labels = stage(members.select("node").distinct().withColumn("component", F.col("node")))
    wanted = stage(names.select("node", "first.id").join(labels.select("node"), "node", "left_semi"))
    sets = stage(_sets(docs, wanted, doc_id, text, shingle))

    tried = None
    mixed = members.withColumn("component", F.col("node"))
    for k in range(rounds):
        # Another point of each cell in each round, by a hash of its own.
        pivots = mixed.groupBy("cell").agg(F.min_by(
            F.struct("node", "component"), F.struct(F.xxhash64("node", F.lit(k)), "node")).alias("p"))
        stars = mixed.join(pivots, "cell").filter("component <> p.component").select(
            F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()
        stars = stage(stars if tried is None else stars.join(tried, ["a", "b"], "left_anti"))
        labels = _merged(labels, stage(_verified(_bounded(stars, sets, threshold), sets, threshold)))
        tried = stars if tried is None else tried.union(stars)
        before, mixed = mixed, _mixed(members, labels)
        if k:
            release(before)
        if mixed.isEmpty():
            break
    else:
        # What is left of the links runs across components of one cell.
        rest = _tree_pairs(mixed, sets, threshold, block).join(tried, ["a", "b"], "left_anti")
        labels = _merged(labels, stage(_verified(stage(rest), sets, threshold)))
    release(members)
    release(sets)

    # The component's smallest document names it.
    named = names.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = stage(named.groupBy("component").agg(F.min("first").alias("first")))
    of_node = stage(named.select("node", "component").join(least, "component").select("node", "first"))
    return kept.join(of_node, "node", "left").select("id", "h", "bytes", "n", "first")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                    threshold: Fraction = THRESHOLD, block: int = BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_shingles`, `component_id`.

    A component holds what links reach; its id is the smallest `doc_id` in it. Null, empty and
    wordless texts have no shingles and are alone. Repeated rows come out as often as they go in,
    and so do rows that share a `doc_id` but not the text, each with its text's component. Rows
    with a null `doc_id` link with nothing: their component is that of a text equal to theirs, or
    null. Ids must be whole numbers. Other columns are not read.
    """
    return _classes(docs, doc_id, text, shingle, threshold, block, rounds).select(
        F.col("id").alias(doc_id), F.col("n").alias("n_shingles"),
        F.coalesce("first.id", "id").alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5,
               threshold: Fraction = NEAR) -> DataFrame:
    """`docs` with one document of each component, the one with the smallest id; columns as they are.

    Rows are told apart by id and text: rows that share an id but not the text go only if they are
    copies of something, and of rows that share both one stays. Rows with a null `doc_id` all stay.
    """
    classes = _classes(docs, doc_id, text, shingle, threshold, BLOCK, ROUNDS)
    key = unused(docs, "row_key")
    dropped = classes.filter("id is not null and first <> struct(id, h, bytes)").select(
        F.struct(F.col("id"), F.col("h"), F.col("bytes").alias("n")).alias(key)).distinct()
    keyed = docs.withColumn(key, row_key(F.col(doc_id).cast("long"), F.col(text)))
    with_id = keyed.filter(F.col(doc_id).isNotNull()).join(dropped, key, "left_anti").dropDuplicates([key])
    return with_id.unionByName(keyed.filter(F.col(doc_id).isNull())).select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, list_slice(w, k, least(k + 2, len(w))) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * o >= 90 * (x.n + y.n - o)),
reach AS (
  SELECT a AS doc_id, b AS to_id FROM links
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.to_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles,
       least(w.doc_id, coalesce(min(reach.to_id), w.doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN reach USING (doc_id)
GROUP BY w.doc_id
"""
