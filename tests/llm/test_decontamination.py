import random
import re

import pytest

from datatrawl.llm import decontamination as D
from tests.llm import odd

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP))


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, content in items:
        v = words(content)
        size = min(window, len(v))
        for k in range(len(v) - size + 1 if v else 0):
            for at in range(len(w) - size + 1):
                if w[at:at + size] == v[k:k + size]:
                    hit.update(range(at, at + size))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(5)
    items = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 14)))) for k in range(12)]
    items += [(50, None), (51, "..."), (52, "É-K kelvin"), (53, "one")]
    rows = list(odd.ROWS) + [(100 + i, "x " * 12 + (rng.choice(items)[1] or "") + ". Z. " + (rng.choice(items)[1] or ""))
                             for i in range(40)]
    rows += [(200, "ÉK KELVIN é-k Kelvin"), (201, "K"), (202, "OſE")]
    return rows, items, odd.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("held, size", [(D.BROADCAST_WINDOWS, D.BROADCAST_BYTES), (7, D.BROADCAST_BYTES),
                                        (D.BROADCAST_WINDOWS, 100)])
def test_hits_as_by_brute_force(case, held, size):
    rows, items, docs, bench = case
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"])
                 for r in D.contamination(docs, bench, broadcast_windows=held, broadcast_bytes=size).collect())
    assert got == sorted((str(d), *brute(t, items)) for d, t in rows)


def test_item_ids_are_not_broadcast(case):
    """A window of all items would else make a row that grows with the benchmark."""
    _, _, docs, bench = case
    grams = D.item_windows(bench).withColumn("gram_id", D.F.lit(1)).drop("items")
    plan = D._probe(docs, grams, [10], "doc_id", "text", 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "items#" not in plan and "collect_set" not in plan


def test_contaminated_documents_go_and_others_stay(case):
    rows, items, docs, bench = case
    kept = D.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(
        str(d) for d, t in rows if not brute(t, items)[1])


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "Clean, text"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "B c d e f g h i j k")], "item_id long, text string")
    assert dict(D.remove_spans(docs, bench).collect()) == {1: "a", 2: "Clean, text", 3: None}


def test_empty_tables(spark, case):
    rows, _, docs, bench = case
    assert D.digest(D.contamination(docs.limit(0), bench)).count() == 0
    clean = D.digest(D.contamination(docs, bench.limit(0))).collect()
    assert len(clean) == len(rows) and not any(r.contaminated for r in clean)
