import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from datatrawl.llm import packing as P
from datatrawl.llm import tokens as K
from tests.llm import odd

TEXTS = ["", "  a  b ", "don't we've'll<|endoftext|>x", "abc<|endoftext|>.", "<|startoftext|>. x<|", "É́á b.",
         "İstanbul. KELVIN K.", "á. ́x", "x y z\x85q", "한국어 한.", "a" * 300 + " b",
         "'S it'S. x'.'s", "\x1c\x1d a\x1cb", "日本語のテキスト。123 4.5", "ǅ. ß. ﬁ.", " \x0b\x0c ", "<a|b>. foo<.", "≠ a≠"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(K.tokenizer_path(K.TOKENIZER))


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [1, 5, K.SLICE_BYTES])
def test_counts_as_the_library(library, limit):
    assert K.count_batch(pa.array(TEXTS), limit=limit).tolist() == [len(ids_of(library, t)) for t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    assert K.count_batch(pa.array([text])).tolist() == [len(ids_of(library, text))]
    assert next(P.document_ids(pa.array([text]))).tolist() == ids_of(library, text)


def test_forgetting_words_changes_nothing(library):
    enc = K.WordEncoder(kept=3)
    for text in TEXTS * 2:
        places, _ = enc.split(pa.array([text]))
        assert enc.ids(places).tolist() == ids_of(library, text)


def test_words_of_one_slice_only_are_forgotten(library):
    enc, library_calls = K.WordEncoder(kept=200), []
    encode = enc._encode
    enc._encode = lambda words: library_calls.append(words) or encode(words)
    for i in range(20):
        text = " ".join(["common", "words", *(f"x{i}y{j}" for j in range(50))])
        places, _ = enc.split(pa.array([text]))
        assert enc.ids(places).tolist() == ids_of(library, text)
        assert enc._n <= 300
    assert sum("common" in words for words in library_calls) == 1


def test_the_library_is_called_with_few_words_at_a_time(library):
    enc, sizes = K.WordEncoder(), []
    encode = enc._encode
    enc._encode = lambda words: sizes.append(len(words)) or encode(words)
    text = " ".join(f"v{i}" for i in range(3 * K.CALL_WORDS))
    places, _ = enc.split(pa.array([text]))
    assert max(sizes) <= K.CALL_WORDS and enc.ids(places).tolist() == ids_of(library, text)


def test_count_query(spark, library):
    got = sorted(map(str, map(tuple, K.token_counts(odd.documents(spark, odd.ROWS)).collect())))
    want = [(d, len((t or "").encode()), n := len(ids_of(library, t)), n > 2048) for d, t in odd.ROWS]
    assert got == sorted(map(str, want))
    assert K.token_counts(odd.documents(spark, odd.ROWS).limit(0)).count() == 0


def test_pieces_and_places(spark, library):
    rows = P.packed_sequences(odd.documents(spark, odd.ROWS), capacity=64).collect()
    want = []
    for d, t in odd.ROWS:
        ids = ids_of(library, t) + [P.END_ID]
        want += [(d, k, at, len(ids[at:at + 64]), zlib.crc32(np.array(ids[at:at + 64], "<u4").tobytes()))
                 for k, at in enumerate(range(0, len(ids), 64))]
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    for _, held in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in held:
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert P.packed_sequences(odd.documents(spark, odd.ROWS).limit(0)).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by trying every place for every piece."""
    best = len(lengths)

    def put(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for i, room in enumerate(rooms):
            if room >= lengths[k]:
                put(k + 1, rooms[:i] + [room - lengths[k]] + rooms[i + 1:])
        put(k + 1, rooms + [capacity - lengths[k]])

    put(0, [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=8))
def test_small_cases_are_optimal(lengths):
    bins = P.complete(lengths, 30)
    assert sorted(n for b in bins for n in b) == sorted(lengths)
    assert all(sum(b) <= 30 for b in bins)
    assert len(bins) == fewest(lengths, 30)


def test_cases_of_twelve_to_sixteen_are_optimal():
    assert len(P.complete([21, 52, 34, 27, 22, 24, 23, 42, 55, 27, 35, 35], 100)) == 4
    rng = random.Random(8)
    for _ in range(500):
        lengths = [rng.randint(15, 60) for _ in range(rng.randint(12, 16))]
        bins = P.complete(lengths, 100)
        assert sorted(n for b in bins for n in b) == sorted(lengths) and all(sum(b) <= 100 for b in bins)
        assert len(bins) == P.lower_bound(lengths, 100) or len(bins) == fewest(sorted(lengths, reverse=True), 100), lengths


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=8))
def test_lower_bound_is_one(lengths):
    assert P.lower_bound(lengths, 30) <= fewest(lengths, 30)


def test_gap_to_the_bounds(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.array_join(F.array_repeat(F.lit("one"), (F.col("id") % 37).cast("int")), " ").alias("text"))
    packed = P.packed_sequences(rows, capacity=64)
    gap = P.search_gap(packed, 64).collect()
    assert sum(r.sequences for r in gap) == packed.select("sequence_id").distinct().count()
    assert all(r.bound <= r.sequences <= r.bound + 1 for r in gap)


def test_large_groups_are_near_the_bound():
    rng = random.Random(2)
    lengths = [min(4095, max(1, int(rng.lognormvariate(6.4, 1.2)))) for _ in range(4000)]
    assert len(P.complete(lengths)) <= math.ceil(sum(lengths) / 4096) + 1
    assert len(P.complete([1366] * 900)) == 450
    rng = random.Random(3)
    lengths = [rng.randint(1000, 2600) for _ in range(4096)]
    assert P.lower_bound(lengths, 4096) <= len(P.complete(lengths)) < len(P.best_fit(lengths, 4096))


def test_text_without_white_space_is_whole(spark, library):
    text = "é" * 5000
    assert list(K.text_pieces(text, 100)) == [text]
    assert K.count_batch(pa.array([text]), limit=100).tolist() == [len(ids_of(library, text))]


def test_memory_of_a_batch_is_given_back_behind_it(spark, monkeypatch):
    """Once for each batch of a task, when its texts and ids are gone."""
    given = []
    monkeypatch.setattr(P, "give_back", lambda: given.append(pa.total_allocated_bytes()))
    docs = spark.createDataFrame([(i, "some words here") for i in range(3)], "doc_id long, text string")
    held = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: held.setdefault("cut", f) and self)
    P.pieces(docs)
    before = pa.total_allocated_bytes()
    batches = (pa.RecordBatch.from_pydict({"id": [i], "text": ["some words " * 10_000]}) for i in range(4))
    rows = sum(len(b) for b in held["cut"](batches))
    assert rows >= 4 and len(given) == 4
    assert max(given) < before + 300_000
