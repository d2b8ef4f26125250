"""Near-duplicate vectors of one label by a forest of random-projection trees.

Equal vectors of a label are one point that stands for all of them. Points of a label are split by
trees: at a node, points are projected on a random direction and cut at the median; points close to
the cut go to both sides (spill), so that a near pair is seldom parted, and several trees of other
directions catch those that one parts. Cuts are the quantiles of a sample of each node's points,
taken in the task that fits it; all points run through the trees. What a few levels leave too large
is split again in the next round. Points are compared within leaves, by exact cosines.

A leaf gives no pairs, only who belongs together, so its output is linear in its points. Links are
counted afterwards within the components, where all of a point's links lie: a component around a
point that holds all others so closely that every two must link is counted by its size; others are
compared, in blocks if they are large.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datatrawl.llm.common import by_share, stage
from datatrawl.llm.components import components

THRESHOLD = 0.93
TREES = 4
LEAF = 512        # points of a leaf, about; one of more than twice as many is split again
LEVELS = 6        # splits of one round
SAMPLE = 4096     # points of a node, on average, that its cuts are fitted to
SPILL = 0.5       # of the usual difference of two linked points' projections
WIDEST = 0.12     # share of a node's points, on either side of the cut, that may go to both
BLOCK = 1024      # points of a component that are compared as one block
ROUNDS = 60


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of length 1, in doubles."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(vec_id: str, vector: str, label: str) -> Column:
    """True for rows that may link: id, label and vector given, no component null or not finite, not all zero."""
    v = F.col(vector)
    whole = F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    some = F.exists(v, lambda e: e != 0)
    return F.coalesce(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & v.isNotNull() & whole & some, F.lit(False))


@functools.lru_cache(maxsize=256)
def directions(seed: int, dim: int, levels: int = LEVELS) -> np.ndarray:
    """A direction for each inner node of a tree, the root first, children of k at 2k + 1 and 2k + 2."""
    return np.random.default_rng(seed & (2**63 - 1)).standard_normal(((1 << levels) - 1, dim)) / math.sqrt(dim)


def fit_cuts(x: np.ndarray, seed: int, total: float, leaf: int, margin: float, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray]:
    """Of each inner node the lowest projection that goes right and the highest that goes left.

    `x` is a sample of `total` points. A node of few enough points, by its share of the sample, or
    one whose points have one projection, isn't split: its cuts are NaN.
    """
    way = directions(seed, x.shape[1], levels)
    low, high = np.full(len(way), np.nan), np.full(len(way), np.nan)
    held: dict[int, np.ndarray] = {0: np.arange(len(x))}
    for k in range(len(way)):
        rows = held.pop(k, None)
        if rows is None or len(rows) < 8 or len(rows) / len(x) * total <= leaf:
            continue
        at = x[rows] @ way[k]
        least, cut, most = np.quantile(at, [0.5 - WIDEST, 0.5, 0.5 + WIDEST])
        if at.max() - at.min() <= 1e-12:
            continue
        low[k], high[k] = max(cut - margin, least), min(cut + margin, most)
        held[2 * k + 1], held[2 * k + 2] = rows[at <= high[k]], rows[at >= low[k]]
    return low, high


def route(x: np.ndarray, low: np.ndarray, high: np.ndarray, way: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of `x` and the tree node (numbered on below the inner ones) each of them comes to."""
    rows, nodes = [], []
    todo = [(0, np.arange(len(x)))]
    while todo:
        k, held = todo.pop()
        if not len(held):
            continue
        if k >= len(way) or np.isnan(low[k]):
            rows.append(held)
            nodes.append(np.full(len(held), k))
            continue
        at = x[held] @ way[k]
        todo += [(2 * k + 1, held[at <= high[k]]), (2 * k + 2, held[at >= low[k]])]
    return np.concatenate(rows), np.concatenate(nodes)


def _mixed(*numbers: int) -> int:
    """A signed 64-bit number that tells rows of numbers apart."""
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(b"".join(n.to_bytes(8, "little", signed=True) for n in numbers)), "little", signed=True)


def _fitted(opened: DataFrame, trees: int, leaf: int, sample: int, threshold: float) -> DataFrame:
    """`g`, `low`, `high`: the cuts of each group's trees, one tree after another."""
    picked = opened.filter(by_share(F.xxhash64("key", "g"), F.lit(float(sample)) / F.col("n"))).select("g", "n", "v")

    def fit(rows: pa.Table) -> pa.Table:
        g, n = rows.column("g")[0].as_py(), rows.column("n")[0].as_py()
        x = unit_rows(rows.column("v").combine_chunks())
        margin = SPILL * math.sqrt(max(0.0, 2 - 2 * threshold) / x.shape[1])
        cuts = [fit_cuts(x, _mixed(g, t), n, leaf, margin) for t in range(trees)]
        row = {"g": g, "low": np.concatenate([c[0] for c in cuts]).tolist(), "high": np.concatenate([c[1] for c in cuts]).tolist()}
        return pa.Table.from_pylist([row], pa.schema([
            ("g", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))]))

    return picked.groupBy("g").applyInArrow(fit, "g long, low array<double>, high array<double>")


def _routed(opened: DataFrame, models: DataFrame, trees: int) -> DataFrame:
    """`opened` with `g` replaced by the trees' leaves; `flat` if the leaf can't be split any more."""
    kind = opened.schema["v"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inner = (1 << LEVELS) - 1
        for batch in batches:
            groups, which = np.unique(batch.column("g").to_numpy(), return_inverse=True)
            for i, g in enumerate(groups.tolist()):
                at = np.flatnonzero(which == i)
                x = unit_rows(batch.column("v").take(pa.array(at)))
                low, high = (np.array(batch.column(c)[int(at[0])].as_py()) for c in ("low", "high"))
                for t in range(trees):
                    own = slice(t * inner, (t + 1) * inner)
                    rows, nodes = route(x, low[own], high[own], directions(_mixed(g, t), x.shape[1]))
                    place, to = np.unique(nodes, return_inverse=True)
                    names = np.array([_mixed(g, t, k) for k in place.tolist()], np.int64)
                    taken = pa.array(at[rows])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(names[to]), batch.column("kind").take(taken), batch.column("key").take(taken),
                         batch.column("v").take(taken), pa.array(nodes == 0)], ["g", "kind", "key", "v", "flat"])

    joined = opened.join(models, "g").select("g", "kind", "key", "v", "low", "high")
    return joined.mapInArrow(walk, f"g long, kind long, key long, v {kind}, flat boolean")


def leaves(points: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF,
           sample: int = SAMPLE) -> DataFrame:
    """`g`, `kind`, `key`, `v`: each of `points` (`kind`, `key`, `v`) in the leaves of its kind's trees.

    A kind of few points is one leaf. Points that no projection parts, such as multiples of one
    vector, are dealt over leaves that all hold one of them.
    """
    now = points.select(F.col("kind").alias("g"), "kind", "key", "v", F.lit(False).alias("flat"))
    done: list[DataFrame] = []
    for k in range(ROUNDS):
        sizes = now.groupBy("g").agg(F.count("*").alias("n"))
        large = stage(sizes.filter(F.col("n") > 2 * leaf))
        done.append(now.join(large, "g", "left_anti").drop("flat"))
        opened = now.join(large, "g")
        if large.isEmpty():
            break
        flat = opened.filter("flat")
        part = F.floor(F.col("n") / leaf).cast("int")
        named = lambda place: F.xxhash64("g", place)
        first = flat.groupBy("g", "n").agg(F.min_by(F.struct("kind", "key", "v"), "key").alias("p"))
        done.append(flat.select(named(F.pmod("key", part)).alias("g"), "kind", "key", "v"))
        done.append(first.select("g", "p", F.explode(F.sequence(F.lit(0), part - 1)).alias("place")).select(
            named(F.col("place").cast("long")).alias("g"), "p.kind", "p.key", "p.v"))
        split = opened.filter("not flat")
        grown = trees if k == 0 else 1
        now = stage(_routed(split, stage(_fitted(split, grown, leaf, sample, threshold)), grown))
    else:
        raise RuntimeError(f"leaves are still too large after {ROUNDS} rounds")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def joined_by_links(x: np.ndarray, kind: np.ndarray, threshold: float) -> np.ndarray:
    """For each row the first row that links of the given rows reach from it."""
    linked = (x @ x.T >= threshold) & (kind[:, None] == kind[None, :])
    np.fill_diagonal(linked, True)
    first = np.arange(len(x))
    while True:
        new = np.where(linked, first[None, :], len(x)).min(axis=1)
        new = new[new]
        if (new == first).all():
            return first
        first = new


def _edges(cells: DataFrame, threshold: float) -> DataFrame:
    """(`a`, `b`): each point with the first of those that links within its leaf reach."""

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        key, at = np.unique(rows.column("key").to_numpy(), return_index=True)
        x = unit_rows(rows.column("v").combine_chunks().take(pa.array(at)))
        first = joined_by_links(x, rows.column("kind").to_numpy()[at], threshold)
        more = np.flatnonzero(first != np.arange(len(first)))
        return pa.table({"a": key[more], "b": key[first[more]]})

    return cells.groupBy("g").applyInArrow(link, "a long, b long").distinct()


def _compared(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """`key`, `links`: copies of other points that link to each, by comparing within components.

    Components of one block are dealt to tasks by a hash; a larger one is cut in blocks, and each
    pair of its blocks is a task's work.
    """
    blocks = F.ceil(F.col("n") / block).cast("int")
    total = members.count()
    tasks = max(1, math.ceil(total / (2 * block)))
    placed = members.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    work = placed.withColumn("other", other).withColumn("one", F.least("mine", "other")).withColumn(
        "two", F.greatest("mine", "other")).withColumn(
        "task", F.when(F.col("blocks") == 1, F.pmod("component", F.lit(tasks))).otherwise(F.col("component")))
    work = work.withColumn("alone", F.col("blocks") == 1).select(
        "alone", "task", "one", "two", "mine", "component", "key", "copies", "v")

    def count(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        part, mine, one, two, key, copies = (
            rows.column(c).to_numpy() for c in ("component", "mine", "one", "two", "key", "copies"))
        v = rows.column("v").combine_chunks()
        links = np.zeros(len(rows), np.int64)
        order = np.argsort(part, kind="stable")
        for held in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
            # Vectors of one component have one length.
            x = unit_rows(v.take(pa.array(held)))
            here, there = np.flatnonzero(mine[held] == one[held]), np.flatnonzero(mine[held] == two[held])
            near = x[here] @ x[there].T >= threshold
            if one[held[0]] == two[held[0]]:
                np.fill_diagonal(near, False)
                links[held[here]] += near @ copies[held[there]]
            else:
                links[held[here]] += near @ copies[held[there]]
                links[held[there]] += near.T @ copies[held[here]]
        return pa.table({"key": key, "links": links})

    counted = work.groupBy("alone", "task", "one", "two").applyInArrow(count, "key long, links long")
    return counted.groupBy("key").agg(F.sum("links").alias("links"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
                    threshold: float = THRESHOLD, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE,
                    block: int = BLOCK) -> DataFrame:
    """Per row: `vec_id`, `n_links` (other rows linked directly), `component_id`, `kept`.

    Rows of one label link at a cosine of `threshold` or more; vectors of different lengths don't.
    Rows whose id, label or vector is null, whose vector is zero or empty or holds a null or a
    non-finite number link with nothing and are their own component (null and not kept without an
    id). Repeated rows are vectors of their own. Ids may be of any type that has an order; other
    columns are not read. Points are known by 64-bit hashes.
    """
    v = F.col(vector)
    keyed = rows.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), v.alias("v"), F.when(
        usable(vec_id, vector, label), F.xxhash64(F.col(label), v)).alias("key"))
    points = stage(keyed.filter("key is not null").groupBy("key").agg(
        F.first(F.xxhash64("label", F.size("v"))).alias("kind"), F.first("v").alias("v"),
        F.min("id").alias("least"), F.count("*").alias("copies")))
    edges = stage(_edges(leaves(points, threshold, trees, leaf, sample), threshold))
    of = stage(components(edges).select(F.col("node").alias("key"), "component"))

    members = stage(points.join(of, "key"))
    # A component's smallest key is one of its points.
    center = members.filter("key = component").select("component", F.col("v").alias("c"))

    def near_center(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            out = np.zeros(len(batch))
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                x, c = (unit_rows(batch.column(k).take(pa.array(at))) for k in ("v", "c"))
                out[at] = (x * c).sum(1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in ("component", "copies", "least")] + [pa.array(out)], ["component", "copies", "least", "near"])

    least_kind = points.schema["least"].dataType.simpleString()
    far = members.join(center, "component").select("component", "copies", "least", "v", "c").mapInArrow(
        near_center, f"component long, copies long, least {least_kind}, near double")
    whole = stage(far.groupBy("component").agg(
        F.count("*").alias("n"), F.sum("copies").alias("total"), F.min("least").alias("component_id"),
        (2 * F.acos(F.least(F.min("near"), F.lit(1.0))) <= math.acos(threshold) - 1e-9).alias("tight")))
    loose = members.select("key", "component", "copies", "v").join(whole.filter("not tight").select("component", "n"), "component")
    compared = _compared(stage(loose), threshold, block)
    info = stage(points.select("key", "copies", "least").join(of, "key", "left").join(
        whole.select("component", "total", "component_id", "tight"), "component", "left").join(
        compared, "key", "left").select(
        "key", F.when(F.col("tight"), F.col("total") - F.col("copies")).otherwise(F.coalesce("links", F.lit(0))).alias("links"),
        "copies", F.coalesce("component_id", "least").alias("component_id")))
    out = keyed.select("id", "key").join(info, "key", "left")
    return out.select(
        F.col("id").alias(vec_id), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col(vec_id) == F.col("component_id"), F.lit(False)))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT a AS vec_id, b AS to_id FROM links
  UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.to_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a),
m AS (SELECT vec_id, min(to_id) AS least FROM reach GROUP BY vec_id)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m.least, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)
"""
