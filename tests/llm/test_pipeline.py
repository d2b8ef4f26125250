import numpy as np
import pyarrow as pa

import corpus_pipeline as C
from datatrawl.llm import tokens
from datatrawl.llm.common import read_table
from tests.llm.test_decontamination import brute as hits
from tests.llm.test_jaccard import brute as classes
from fractions import Fraction

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = read_table(spark, SF, "documents")
    items = [tuple(r) for r in read_table(spark, SF, "benchmark").select("item_id", "text").collect()]
    columns, sizes = docs.columns, [docs.count()]
    names = [n for n, _ in C.STAGES]
    assert names == ["toxicity", "quality", "near_copies", "decontamination", "packing"]
    for name, step in C.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = C.stage(step(spark, docs, SF))
        assert docs.columns == columns
        after = sorted(r.doc_id for r in docs.collect())
        if name == "near_copies":
            found = [eval(r) for r in classes(before, 5, Fraction(8, 10))]  # noqa: S307
            assert after == sorted(d for d, _, c in found if d == c)
        if name == "decontamination":
            assert after == sorted(d for d, t in before if not hits(t, items)[1])
        sizes.append(len(after))
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    packed = C.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == sizes[-1]


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_yield_small_runs_and_drop_encoders():
    tokens.encoder(tokens.TOKENIZER)
    size = 3 * tokens.SLICE_BYTES // 4
    texts = pa.array(["a" * size, "", "b" * size, "c", "d" * size])
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), texts], ["doc_id", "text"])
    runs = list(tokens.kept_rows(batch, texts, np.array([True, True, False, True, True])))
    assert [r.column("doc_id").to_pylist() for r in runs] == [[0, 1], [3], [4]]
    assert max(r.nbytes for r in runs) < tokens.SLICE_BYTES
    tokens.drop_encoders()
    assert tokens.encoder.cache_info().currsize == 0
