import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from datatrawl.llm import jaccard as J
from datatrawl.llm.components import components
from tests.llm import odd

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def linked(a, b, t=Fraction(9, 10)):
    return bool(a and b) and len(a & b) * t.denominator >= len(a | b) * t.numerator


def brute(rows, size=3, t=Fraction(9, 10)):
    sets = [shingles(x, size) for _, x in rows]
    name = [d for d, _ in rows]
    again = True
    near = [[j for j in range(len(rows)) if i != j and linked(sets[i], sets[j], t)] for i in range(len(rows))]
    while again:
        again = False
        for i in range(len(rows)):
            for j in near[i]:
                if name[j] is not None and (name[i] is None or name[j] < name[i]):
                    name[i], again = name[j], True
    return sorted(str((d, len(s), n)) for (d, _), s, n in zip(rows, sets, name))


def near_copies(seed, base_words, copies, edits, start):
    rng = random.Random(seed)
    base = [f"b{rng.randrange(400)}" for _ in range(base_words)]
    out = []
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((start + i, " ".join(w)))
    return out


def chain(n, words, step, start):
    """Each text overlaps the next enough, but not the one after it."""
    return [(start + i, " ".join(f"c{k}" for k in range(i * step, i * step + words))) for i in range(n)]


@pytest.fixture(scope="module")
def rows():
    out = [r for r in odd.ROWS if r[0] is not None]
    out += near_copies(1, 120, 40, 5, 1000) + near_copies(2, 40, 30, 3, 2000) + near_copies(3, 25, 30, 2, 3000)
    out += chain(12, 150, 6, 4000) + near_copies(4, 700, 15, 25, 5000)
    random.Random(9).shuffle(out)
    return out


def test_components_as_by_brute_force(spark, rows):
    docs = odd.documents(spark, rows).repartition(5)
    assert sorted(str(tuple(r)) for r in J.jaccard_classes(docs, block=6).collect()) == brute(rows)


def test_five_words_and_less_overlap(spark, rows):
    docs = odd.documents(spark, rows)
    got = J.jaccard_classes(docs, shingle=5, threshold=J.NEAR).collect()
    assert sorted(str(tuple(r)) for r in got) == brute(rows, 5, Fraction(8, 10))


def test_one_of_each_component_stays(spark, rows):
    docs = odd.documents(spark, rows + [(None, "no key"), (None, "no key")])
    kept = J.keep_first(docs, shingle=3, threshold=J.THRESHOLD)
    assert kept.columns == docs.columns
    want = [d for d, _ in set(rows)]
    gone = [eval(r)[0] for r in brute(list(set(rows))) if eval(r)[0] != eval(r)[2]]  # noqa: S307
    want = sorted(set(want) - set(gone))
    got = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in got if x is not None) == sorted(want) and got.count(None) == 2


def test_null_keys_and_empty_tables(spark):
    got = J.jaccard_classes(odd.documents(spark, [(None, "a b c d"), (5, "x y z"), (5, "x y z")])).collect()
    assert sorted(map(str, map(tuple, got))) == ["(5, 1, 5)", "(5, 1, 5)", "(None, 2, None)"]
    assert J.jaccard_classes(odd.documents(spark, odd.ROWS).limit(0)).count() == 0


def test_a_row_without_key_does_not_stand_for_its_text(spark):
    first, second = chain(2, 150, 6, 1)
    rows = [(None, first[1]), first, second, (None, second[1])]
    docs = odd.documents(spark, rows).coalesce(1)
    assert sorted(str(tuple(r)) for r in J.jaccard_classes(docs).collect()) == brute(rows)
    kept = J.keep_first(docs, shingle=3, threshold=J.THRESHOLD).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["1", "None", "None"]


def test_only_copies_go(spark):
    texts = [" ".join(f"{x}{i}" for i in range(40)) for x in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (3, texts[1]), (3, None), (3, ""), (2, texts[2]), (1, texts[0] + " end")]
    kept = J.keep_first(odd.documents(spark, rows)).collect()
    got = sorted((r.doc_id, (r.text or "")[:2], r.text is None) for r in kept)
    assert got == [(1, "a0", False), (1, "b0", False), (2, "c0", False), (3, "", False), (3, "", True)]


def test_finer_points_bound_the_overlap():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 100, 400, 420, 900, 5000)]
    sets += [np.unique(np.concatenate([sets[2][40:], sets[3][:30]])), np.unique(np.concatenate([sets[5][300:], sets[4][:200]]))]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    fine = J.fine_points(np.concatenate(sets), offsets)
    assert [len(p) // 2 for p in fine] == [128, 128, 512, 512, 1024, 1024, 512, 1024]
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    may = J.may_link_finely(fine, a, b, J.NEAR)
    for x, y, m in zip(a, b, may):
        overlap = len(np.intersect1d(sets[x], sets[y]))
        linked_ = overlap * 10 >= (len(sets[x]) + len(sets[y]) - overlap) * 8
        assert m or not linked_
    assert may.reshape(len(sets), -1)[2, 3] == False and may.reshape(len(sets), -1)[2, 6]  # noqa: E712


def test_sets(rows):
    texts = [t or "" for _, t in rows]
    hashes, offsets = J.shingle_sets(pa.array(texts))
    assert np.diff(offsets).tolist() == [len(shingles(t)) for t in texts]
    same = J.shingle_sets(pa.array(["A  b\tC d", "a b c d", "a b", "ab"]))
    assert same[0][:2].tolist() == same[0][2:4].tolist()
    assert len(set(same[0][4:].tolist())) == 2


@pytest.mark.parametrize("t", [J.THRESHOLD, J.NEAR])
def test_linked_sets_share_a_cell(t):
    rng = np.random.default_rng(6)
    for _ in range(1500):
        n = int(rng.integers(2, 120))
        base = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, b = np.unique(base[:n]), np.unique(np.concatenate([base[int(rng.integers(0, n // 6 + 1)):n], base[n:n + int(rng.integers(0, n // 6 + 1))]]))
        overlap = len(np.intersect1d(a, b))
        if overlap * t.denominator >= (len(a) + len(b) - overlap) * t.numerator and overlap < max(len(a), len(b)):
            assert set(J.cell_keys(a, t)) & set(J.cell_keys(b, t))


def test_tree_finds_all_pairs():
    rng = np.random.default_rng(8)
    base = rng.poisson(6, (12, J.GROUPS))
    x = np.maximum(0, base[rng.integers(0, 12, 300)] + rng.integers(-1, 2, (300, J.GROUPS)) * (rng.random((300, J.GROUPS)) < 0.1))
    label = rng.integers(0, 40, 300)
    a, b = np.arange(0, 180), np.arange(180, 300)
    found = set()
    for u, v in J.RTree(x[a], label[a]).pairs(J.RTree(x[b], label[b])):
        found.update(zip(a[u].tolist(), b[v].tolist()))
    hit = J.may_link(x[a][:, None], x[b][None]) & (label[a][:, None] != label[b][None])
    assert found == {(int(a[i]), int(b[j])) for i, j in zip(*np.nonzero(hit))} and found


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (205, 200)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(30)}, 200: 200, 205: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_round_of_components_is_one_write(spark, monkeypatch):
    """Each round read its result once more to tell if anything had changed."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    with monkeypatch.context() as m:
        for action in ("first", "head", "collect", "count"):
            m.setattr(type(edges), action, lambda *_: 1 / 0)
        found = components(edges)
    assert {r.component for r in found.collect()} == {0}


def test_cells_are_dealt_once(spark, monkeypatch):
    """The table of all cells, the largest by far, is shuffled and sorted once, and no map of it is kept."""
    plans, stage = [], J.stage

    def seen(df):
        if df.columns == ["cell", "node"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df)

    monkeypatch.setattr(J, "stage", seen)
    docs = spark.createDataFrame(near_copies(6, 60, 8, 3, 0) + chain(4, 80, 3, 100), "doc_id long, text string")
    assert len({r.component_id for r in J.jaccard_classes(docs).collect()}) < 12
    assert plans and plans[0].count("Exchange hashpartitioning") == 1 and "Join" not in plans[0]


def test_shared_cells(spark):
    # Cell 1 holds two nodes, one of them met by two tasks; cell 2 one node, met twice; cell 3 one.
    cells = spark.createDataFrame([(1, 10), (1, 11), (1, 10), (2, 12), (2, 12), (3, -13)], "cell long, node long")
    assert sorted(map(tuple, J._shared(cells).collect())) == [(1, 10), (1, 11)]
