import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from datatrawl.llm import prefix_trie as X
from datatrawl.llm.queries import QUERIES
from tests.llm import odd

SF = "/root/testdata/sf0.001"


def rebuilt(rows):
    turns = {}
    for c, t, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = turns.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node with its members, by looking at all prefixes of all conversations."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    words = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
    out = []
    for s, held in members.items():
        below = [u for u in members if u[:len(s)] == s]
        children = lambda u: sum(len(v) == len(u) + 1 and v[:len(u)] == u for v in members)
        ends = ",".join(map(str, sorted(c for c in held if len(convs[c]) == len(s))))
        out.append((min(held), len(s), min(members[s[:-1]]) if s else None, len(held), children(s),
                    sum(children(u) == 0 for u in below), sum((len(members[u]) - 1) * words(u) for u in below),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for name in ("depth", "k1", "words", "one", "rep", "n", "bucket"):
        df = df.withColumn(name, F.lit(1))
    return df


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, 6)):
            rows.append((c * rng.choice([1, 1, 3]), rng.choice([t, t, t, None]), rng.choice(["user", None, "bot"]),
                         rng.choice(["hi", "a b  c", "", None, "x\ty"])))
    return [r for i, r in enumerate(rows) if r[:2] not in {x[:2] for x in rows[:i]}]


def test_as_by_brute_force(spark):
    rows = rows_of(1, 60) + [(None, 0, "user", "no conversation"), (-33, 0, "user", "below zero"), (-20, 1, "user", "base")]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)]    # many of one sequence
    got = X.rebuilt_trie(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rebuilt(rows))


def test_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b c"), (2, 0, "u", "a"), (2, 1, "u", "b c"), (2, 2, "u", "d"),
            (3, 0, "u", "a"), (4, 0, "u", "z")]
    got = sorted(map(tuple, X.prefix_trie(table(spark, rows)).collect()), key=str)
    convs = {}
    for c, _, role, text in rows:
        convs.setdefault(c, []).append((role, text))
    assert got == brute(convs)


def test_long_conversations_and_lists_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(X, "STRETCH", 3)
    rng = random.Random(5)
    rows = [(c, t, "u", rng.choice("ab") if t > 6 else "same") for c in range(12) for t in range(17)]
    rows += [(c, 0, "u", "short") for c in range(100, 125)]
    got = X.rebuilt_trie(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rebuilt(rows))


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (21, None, None, None)]
    got = X.rebuilt_trie(table(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rebuilt(rows))
    assert X.rebuilt_trie(table(spark, rows).limit(0)).count() == 0


def test_query_as_its_sql(spark):
    got = sorted(map(str, map(tuple, QUERIES["op11_prefix_trie"](spark, SF).collect())))
    assert got == sorted(map(str, odd.oracle(X.ORACLE, SF))) and len(got) > 50
