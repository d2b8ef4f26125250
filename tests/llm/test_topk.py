import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from datatrawl.llm import topk as K

RNG = np.random.default_rng(4)


def brute(rows, k, every):
    out, clean = [], {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            clean[i, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    for q, a in clean:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in clean if c != q and len(a) == len(b))
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(found[:k])]
    return sorted(out)


def rows_of(n, dim, spread):
    centers = RNG.standard_normal((5, dim))
    return [(int(i), (centers[i % 5] + spread * RNG.standard_normal(dim)).astype(float).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_as_by_brute_force(spark, spread):
    rows = rows_of(400, 8, spread) + [(900, None), (901, [1.0, None] + [0.0] * 6), (902, [float("nan")] * 8),
                                      (903, [float("inf")] * 8), (None, [1.0] * 8), (950, [0.5] * 8)]
    rows += [(1000 + i, rows[3][1]) for i in range(150)] + [rows[0], (1200, [1.0, 2.0]), (1203, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(7)).withColumn("v", F.lit(1))
    got = K.top_k(K.whole_vectors(df), F.col("id") % 50 == 0, 5, query_block=7, candidate_block=100).collect()
    assert sorted(map(tuple, got)) == brute(rows, 5, 50)


def test_few_candidates_and_empty_tables(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<float>")
    got = K.top_k(K.whole_vectors(df), F.col("id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 131072), (0, 2, 2, -65536)]
    assert K.top_k(K.whole_vectors(df.limit(0)), F.col("id") % 50 == 0).count() == 0
    assert K.top_k(K.whole_vectors(df), F.lit(False)).count() == 0


def test_trees_cover_and_skip():
    x = np.concatenate([RNG.standard_normal((1300, 16)) + 40 * k for k in range(4)])
    tree = K.Node(x, np.arange(len(x)))

    def check(node):
        assert (np.sqrt(((x[node.points] - node.center) ** 2).sum(1)) <= node.radius).all()
        if node.children:
            below = np.concatenate([node.lone] + [c.points for c in node.children])
            assert sorted(below) == sorted(node.points)
            for c in node.children:
                check(c)

    check(tree)
    seen = []

    class Counting(K.Best):
        def compare(self, rows, part, ids):
            seen.append(len(rows) * len(part))
            super().compare(rows, part, ids)

    best = Counting(x[1300:1340], np.arange(1300, 1340), 3)
    K.dual_search(best, K.Node(x[1300:1340], np.arange(40)), x, np.arange(len(x)), tree)
    assert sum(seen) < 40 * len(x)
    for i in range(40):
        s = x @ x[1300 + i]
        s[1300 + i] = -np.inf
        assert best.found[i].tolist() == np.lexsort((np.arange(len(x)), -s))[:3].tolist()


def test_large_components_are_exact(spark):
    rows = [(0, [3.0e6, 1.0]), (1, [3.0e6, 2.0]), (2, [3.0e6, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = K.top_k(K.whole_vectors(df), F.col("id") == 0, 1).first()
    assert (got.vec_id, got.score) == (2, 256 * 256 * (9 * 10**12 + 3))
