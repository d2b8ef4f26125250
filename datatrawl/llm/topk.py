"""Exact top-k inner products by a dual-tree search over cover trees.

Queries and candidates are cut in blocks of bounded size, and each pair of blocks is one task. It
indexes both blocks in a cover tree: the points of a node lie within its radius, and its children's
centres lie further apart than the radius that they cover. Both trees are walked together; a pair
of nodes is passed over if the largest product that its radii allow is below the worst k-th score
of the queries under the query node. The best of all blocks are merged in the end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.common import stage

SCALE = 256
QUERY_BLOCK = 2048       # rows of a block, on average
CANDIDATE_BLOCK = 16384
LEAF = 512               # points that are compared as one block of products
NO_ID = np.iinfo(np.int64).max
SHRINK = 1.6             # a node's radius to that which its children cover


class Node:
    """A cover tree node over rows of a matrix. `lone` are its points without a child of theirs."""

    __slots__ = ("center", "norm", "radius", "children", "lone", "points")

    def __init__(self, x: np.ndarray, points: np.ndarray) -> None:
        self.points = points
        self.center = x[points[0]]
        self.norm = math.sqrt(float(self.center @ self.center))
        away = np.sqrt(((x[points] - self.center) ** 2).sum(1))
        # Rounding must not cut off a point at the rim.
        self.radius = float(away.max()) * (1 + 1e-9) + 1e-9
        self.children: list[Node] = []
        self.lone = points
        if len(points) <= LEAF or not away.any():
            return
        cover = float(away.max()) / SHRINK
        lone, left, near = [], points, away
        while len(left):
            inside = near <= cover
            group = left[inside]
            if len(group) == 1:
                lone.append(group)
            else:
                self.children.append(Node(x, group))
            left = left[~inside]
            if len(left):
                near = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(1))
        self.lone = np.concatenate(lone) if lone else points[:0]


class Best:
    """The k best candidates of each query so far: higher scores first, ties to smaller ids.

    Places that aren't taken yet hold NO_ID and the least score there is.
    """

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> None:
        self.q, self.ids, self.k = queries, query_ids, k
        self.least = -np.inf if queries.dtype.kind == "f" else np.iinfo(queries.dtype).min
        self.scores = np.full((len(queries), k), self.least, queries.dtype)
        self.found = np.full((len(queries), k), NO_ID, np.int64)
        self.worst = np.full(len(queries), -np.inf)

    def compare(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """All rows at once: what reaches a row's worst score goes through one sort with what it has."""
        product = self.q[rows] @ x.T
        i, j = np.nonzero((product >= self.worst[rows, None]) & (ids[None, :] != self.ids[rows, None]))
        if not len(i):
            return
        if len(i) > 4 * self.k * len(rows) and product.shape[1] > self.k + 1:
            # Of many, only those that reach the row's k-th best here (one more for the query itself).
            kth = np.partition(product, -(self.k + 1), axis=1)[:, -(self.k + 1)]
            near = product[i, j] >= kth[i]
            i, j = i[near], j[near]
        touched = np.unique(i)
        old = rows[touched]
        row = np.concatenate([i, np.repeat(touched, self.k)])
        score = np.concatenate([product[i, j], self.scores[old].ravel()])
        found = np.concatenate([ids[j], self.found[old].ravel()])
        # The smallest id of equal scores first; what is not taken comes last.
        order = np.lexsort((found, -score, row))
        row = row[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        kept = order[nth < self.k]
        self.scores[old] = score[kept].reshape(-1, self.k)
        self.found[old] = found[kept].reshape(-1, self.k)
        self.worst[old] = np.where(self.found[old, -1] == NO_ID, -np.inf, self.scores[old, -1])


def dual_search(best: Best, queries: Node, x: np.ndarray, ids: np.ndarray, candidates: Node) -> None:
    """Walks both trees and leaves the best of the candidates in `best`."""

    def bound(q: Node, c: Node) -> float:
        top = float(q.center @ c.center) + q.norm * c.radius + c.norm * q.radius + q.radius * c.radius
        return top + 1e-9 * abs(top)

    def visit(q: Node, c: Node) -> None:
        if bound(q, c) < best.worst[q.points].min():
            return
        if not q.children and not c.children:
            for at in range(0, len(c.points), 4096):
                part = c.points[at:at + 4096]
                best.compare(q.points, x[part], ids[part])
        elif not q.children or (c.children and c.radius >= q.radius):
            if len(c.lone):
                best.compare(q.points, x[c.lone], ids[c.lone])
            for child in sorted(c.children, key=lambda n: -bound(q, n)):
                visit(q, child)
        else:
            if len(q.lone):
                for at in range(0, len(c.points), 4096):
                    part = c.points[at:at + 4096]
                    best.compare(q.lone, x[part], ids[part])
            for child in q.children:
                visit(child, c)

    visit(queries, candidates)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.array(vectors.to_pylist(), np.float64) if len(vectors) else np.zeros((0, 0))


def search_block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The k best of `right` for each row of `left`; both have `id` and `v` (whole numbers)."""
    queries, x = _matrix(left.column("v")), _matrix(right.column("v"))
    query_ids, ids = left.column("id").to_numpy(), right.column("id").to_numpy()
    best = Best(queries, query_ids, k)
    if len(ids) and len(query_ids):
        largest = np.abs(queries).max(initial=0) * np.abs(x).max(initial=0) * max(1, x.shape[1])
        if largest >= 2.0 ** 53:
            # Doubles would round: plain comparison in whole numbers.
            best.q = queries.astype(np.int64)
            for at in range(0, len(ids), 4096):
                best.compare(np.arange(len(query_ids)), x[at:at + 4096].astype(np.int64), ids[at:at + 4096])
        else:
            dual_search(best, Node(queries, np.arange(len(query_ids))), x, ids, Node(x, np.arange(len(ids))))
    taken = best.found != NO_ID
    return pa.table({"query_id": np.repeat(query_ids, taken.sum(1)), "vec_id": best.found[taken],
                     "score": best.scores[taken].astype(np.int64)})


def whole_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """`id`, `v` (floor of SCALE times each component), `dim`; one row for rows that repeat both.

    Null ids, null vectors and vectors with a null or non-finite component are left out.
    """
    v = F.col(vector)
    bad = F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e.cast("double")) == float("inf")))
    return (
        rows.filter(F.col(vec_id).isNotNull() & v.isNotNull()).filter(~bad)
        .select(F.col(vec_id).cast("long").alias("id"),
                F.transform(v, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("v"))
        .select("id", "v", F.size("v").alias("dim")).distinct()
    )


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, query_block: int = QUERY_BLOCK,
          candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """`query_id`, `rank` (from 1), `vec_id`, `score` for the rows of `vectors` that `is_query` picks.

    `vectors` as `whole_vectors` gives them. A query meets every row of its dimension but those of
    its own id; with fewer than k candidates it gets all. Ids are expected once: an id with several
    vectors gets the best of all of them. No queries or an empty table: no rows.
    """
    kept = stage(vectors.withColumn("query", F.coalesce(is_query, F.lit(False))))
    sizes = kept.agg(F.count("*").alias("n"), F.count_if("query").alias("q")).first()
    n_query = max(1, math.ceil(sizes["q"] / query_block))
    n_cand = max(1, math.ceil(sizes["n"] / candidate_block))
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    left = kept.filter("query").select(
        "id", "v", "dim", block(n_query).alias("qb"), all_of(n_cand).alias("cb"))
    right = kept.select("id", "v", "dim", block(n_cand).alias("cb"), all_of(n_query).alias("qb"))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("query_id", "vec_id", "score")])
    keys = ("dim", "qb", "cb")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        lambda a, b: search_block(a, b, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
