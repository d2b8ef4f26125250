import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from datatrawl.llm import periods as P
from tests.llm import odd


def brute_runs(words):
    """Runs by the definition: for each period, stretches of words equal to those a period on."""
    n, out = len(words), set()
    smaller = {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(q % p == 0 for p in smaller.get((i, length), ())):
                smaller.setdefault((i, length), []).append(q)
                out.add((i, length, q))
            i = j + 1
    return sorted((s, n, q) for s, n, q in out)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return [w.decode() for w in words]


def brute_digest(doc_id, words):
    runs = brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)),
            sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def found(texts):
    w, offsets, _ = P.word_ids(pa.array(texts))
    runs = P.runs_of(w, offsets)
    return [[tuple(r[1:]) for r in runs[runs[:, 0] == i].tolist()] for i in range(len(texts))]


def test_single_words_and_neighbours():
    assert found(["a a a a a a", "a a a a a", "x a b a b a b a b y", "", "a b c " * 4 + "a b"]) == [
        [(0, 6, 1)], [], [(1, 8, 2)], [], [(0, 14, 3)]]
    # Two runs of one period that touch, and runs within runs.
    texts = ["a a a a a a b b b b b b", "a b a b a b a b b a b a b a b a", ("a " * 7 + "b ") * 5, "a b " * 4 + "b a " * 4]
    assert found(texts) == [brute_runs(t.split()) for t in texts]


@pytest.mark.parametrize("seed", range(6))
def test_as_by_brute_force(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(150):
        letters = "ab" if rng.random() < 0.4 else "abcd"
        words = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(words))
            base = [rng.choice(letters) for _ in range(rng.randint(1, 12))]
            long = base * rng.randint(2, 9)
            words[at:at] = long[:len(long) - rng.randint(0, len(base) - 1)]
        texts.append(" ".join(words))
        if rng.random() < 0.3:
            texts.append(texts[rng.randrange(len(texts))])
    assert found(texts) == [brute_runs(t.split()) for t in texts]


def test_nested_periods_and_long_texts():
    inner = "a b " * 5 + "c "
    texts = [inner * 9, " ".join(["x"] * 20_000), " ".join(f"w{i % 977}" for i in range(9000)),
             " ".join(f"w{i % 4500}" for i in range(9000))]
    assert found(texts) == [brute_runs(texts[0].split()), [(0, 20_000, 1)], [(0, 9000, 977)], []]


def test_a_nonterminal_is_searched_once():
    rng = random.Random(3)
    text = " ".join(rng.choice("abcdefgh") for _ in range(300))
    w, offsets, _ = P.word_ids(pa.array([text] * 40))
    low, mid, high, which, shift = P.boundaries(w, offsets)
    assert (low < mid).all() and (mid < high).all()
    assert len(low) < len(which) < len(w) and set(which.tolist()) == set(range(len(low)))
    # Every place of a nonterminal holds the same words.
    for rule, move in zip(which.tolist(), shift.tolist()):
        assert (w[low[rule]:high[rule]] == w[low[rule] + move:high[rule] + move]).all()
    # Copies come to few rules: each text is a nonterminal or two in the end.
    alone = len(P.boundaries(*P.word_ids(pa.array([text]))[:2])[0])
    assert len(low) < 2 * alone + 120


def test_operator_and_query(spark):
    rows = [r for r in odd.ROWS if r[0] != 7] + [(20, "go " * 30 + "stop"), (21, "a b c d " * 8)]
    tenth = [d for d in range(100, 400) if zlib.crc32(str(d).encode()) % 10 == 0]
    rows += [(d, " ".join(f"v{i}" for i in range(10 + d % 90))) for d in tenth]
    docs = odd.documents(spark, rows)
    out = P.digest(P.periodic_runs(P.with_planted_runs(docs)))
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(
        str(brute_digest(d, planted(d, t))) for d, t in rows)
    full = {r.doc_id: r for r in P.periodic_runs(docs).collect()}
    assert full[20].collapsed == "go stop" and [tuple(r) for r in full[20].runs] == [(0, 30, 1)]
    assert full[7 if 7 in full else 1].collapsed == "" and full[1].n_words == 0
    assert P.digest(P.periodic_runs(P.with_planted_runs(docs.limit(0)))).count() == 0


def test_whole_table_as_by_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    from datatrawl.llm.queries import QUERIES

    got = QUERIES["op13_runs"](spark, sf).collect()
    short = {d for d, t in rows if len((t or "").split()) < 3000}
    want = [brute_digest(d, planted(d, t)) for d, t in rows if d in short]
    assert sorted(str(tuple(r)) for r in got if r.doc_id in short) == sorted(map(str, want))
    assert len(got) == len(rows) and np.mean([r.n_runs > 0 for r in got]) > 0.02
