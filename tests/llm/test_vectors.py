import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from datatrawl.llm import vectors as V
from datatrawl.llm.queries import QUERIES
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def brute(rows, t=0.93):
    ok = [i for i, (d, v, l) in enumerate(rows) if d is not None and l is not None and v and any(v)
          and all(x is not None and math.isfinite(x) for x in v)]
    vec = {i: np.array(rows[i][1], np.float32).astype(float) for i in ok}
    vec = {i: x / np.linalg.norm(x) for i, x in vec.items()}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] >= t] for i in ok}
    name = {i: rows[i][0] for i in range(len(rows))}
    again = True
    while again:
        again = False
        for i in ok:
            for j in near[i]:
                if name[j] < name[i]:
                    name[i], again = name[j], True
    return sorted((str((d, len(near.get(i, ())), name[i], d is not None and name[i] == d)) for i, (d, _, _) in enumerate(rows)))


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for name in ("id", "key", "v", "g", "kind", "copies", "n"):
        df = df.withColumn(name, F.lit(1))
    return df


def rows_of(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        base = rng.standard_normal(dim)
        for _ in range(int(rng.choice([1, 1, 1, 3, 40], p=[0.4, 0.3, 0.2, 0.09, 0.01]))):
            out.append((base + rng.choice([0, 0.05, 0.2]) * rng.standard_normal(dim)).tolist())
    chain = [[math.cos(0.3 * k), math.sin(0.3 * k)] + [0.0] * (dim - 2) for k in range(15)]   # each links to the next
    return [(i, v, int(rng.integers(0, 3)) if i % 7 else 0) for i, v in enumerate(out)] + [(9000 + i, v, 5) for i, v in enumerate(chain)]


ODD = [(8000, None, 0), (8001, [0.0] * 16, 0), (8002, [float("nan")] + [1.0] * 15, 0), (8003, [None] + [1.0] * 15, 0),
       (8004, [1.0] * 16, None), (8005, [1.0] * 16, None), (8006, [1.0, 1.0], 0), (8007, [2.0, 2.0], 0), (8008, [], 0),
       (8009, [float("inf")] * 16, 0), (8010, [1e30] * 16, 1), (8011, [1e-30] * 16, 1), (None, [1.0] * 16, 1),
       (8012, [3.0] * 16, 1), (8012, [3.0] * 16, 1)]


def test_as_by_brute_force(spark):
    rows = rows_of(1, 300) + ODD + [(7000 + i, [1.0] + [0.5] * 15, 2) for i in range(60)]
    got = V.near_duplicates(table(spark, rows).repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows)


def test_many_small_leaves_find_nearly_all(spark):
    rows = rows_of(2, 700)
    got = {r.vec_id: r for r in V.near_duplicates(table(spark, rows), leaf=24, sample=200, block=16).collect()}
    want = [eval(r) for r in brute(rows)]  # noqa: S307
    assert sum(r[1] for r in want) * 0.98 <= sum(r.n_links for r in got.values()) <= sum(r[1] for r in want)
    assert np.mean([got[r[0]].component_id == r[2] for r in want]) > 0.98
    assert all(got[r[0]].n_links <= r[1] for r in want)


def test_multiples_that_no_projection_parts(spark):
    rows = [(i, [float(i + 1) * x for x in (1.0, 2.0, 4.0)], 0) for i in range(200)]
    got = V.near_duplicates(table(spark, rows), leaf=8, sample=64, block=32).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(199, 0)} and sum(r.kept for r in got) == 1


def test_spill_keeps_near_pairs_together():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = x + math.sqrt(0.14 / 64) * rng.standard_normal(x.shape)
    y /= np.linalg.norm(y, axis=1)[:, None]
    both = np.concatenate([x, y])
    close = np.flatnonzero((x * y).sum(1) >= 0.93)
    met = np.zeros(len(x), bool)
    for t in range(V.TREES):
        margin = V.SPILL * math.sqrt(0.14 / 64)
        low, high = V.fit_cuts(both, t, len(both), 128, margin)
        rows, nodes = V.route(both, low, high, V.directions(t, 64))
        leaf = [set(nodes[rows == i]) for i in range(len(both))] if t < 2 else None
        if leaf:
            met |= np.array([bool(leaf[i] & leaf[i + len(x)]) for i in range(len(x))])
    assert met[close].mean() > 0.9


@pytest.mark.parametrize("n", [0, 1])
def test_few_rows(spark, n):
    got = V.near_duplicates(table(spark, [(3, [1.0, 2.0], 1)]).limit(n)).collect()
    assert list(map(tuple, got)) == [(3, 0, 3, True)][:n]


def test_whole_rows_of_one_length():
    x = V.unit_rows(pa.array([[3.0, 4.0], [1e300, 0.0], [0.0, -1e-300]]))
    assert np.allclose(x, [[0.6, 0.8], [1, 0], [0, -1]])


def test_query_as_its_sql(spark):
    got = sorted(map(str, map(tuple, QUERIES["op12_near_vectors"](spark, SF).collect())))
    assert got == sorted(map(str, odd.oracle(V.ORACLE, SF)))
