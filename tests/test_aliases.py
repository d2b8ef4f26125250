import random
import re

from datatrawl import fixed
from datatrawl.operators.aliases import FILLERS, org_aliases


def plain(names):
    """main_name of each name, by comparing all with all."""
    forms = "|".join(fixed.LEGAL_FORMS).lower()

    def key(name):
        return re.sub(f" (?:{forms})$", "", re.sub(r"[\W_]+", " ", name.lower()).strip()).strip()

    def sense(name):
        return tuple(w for w in key(name).split() if w not in FILLERS) or tuple(key(name).split(" "))

    senses = {sense(n) for n in names}
    leads = lambda a, b: len(a) > 1 and len(a) < len(b) and b[:len(a)] == a
    edges = set()
    heads = {b: max((a for a in senses if leads(a, b)), key=len, default=None) for b in senses}
    edges |= {(a, b) for b, a in heads.items() if a and list(heads.values()).count(a) == 1}
    for n in names:
        if " " not in key(n) and key(n) and n.startswith(key(n).upper()):
            full = [s for s in senses if len(s) > 2 and "".join(w[0] for w in s) == key(n)]
            edges |= {(sense(n), s) for s in full if len(full) == 1}
    group = {s: s for s in senses}
    for _ in senses:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    return {n: min((m for m in names if group[sense(m)] == group[sense(n)]), key=lambda m: (-len(m), m)) for n in names}


def aliases(spark, docs):
    rows = [(d, n) for d, names in enumerate(docs) for n in names]
    return org_aliases(spark.createDataFrame(rows, "doc_id long, text string"))


def test_names_of_one_organization(spark):
    docs = [["Ohio State University", "OSU", "Ohio State", "OSU", "Acme Inc"],
            ["Ohio State University", "Ohio State Council", "Ohio State", "osu"],
            ["Ohio State University", "Open Street Union Ltd", "OSU"],
            ["Institute of Maps and Data Inc", "Institute for Maps & Data", "IMD", "IMD Ltd"],
            ["The Of", "the", "Ohio University", "University of Ohio"]]
    got = {(r.doc_id, r.name): r.main_name for r in aliases(spark, docs).collect()}
    assert got == {(d, n): m for d, names in enumerate(docs) for n, m in plain(names).items()}
    assert {n for (d, n), m in got.items() if d == 0 and m == "Ohio State University"} == {
        "Ohio State University", "OSU", "Ohio State"}
    assert all(got[1, n] == n for n in docs[1])
    assert got[2, "OSU"] == "OSU"
    assert {got[3, n] for n in docs[3]} == {"Institute of Maps and Data Inc"}
    assert got[4, "University of Ohio"] == "University of Ohio"


def test_classes_as_by_comparing_all_with_all(spark):
    rng = random.Random(11)
    words = ["Alpha", "Beta", "Air", "Bay", "of", "and", "Inc", "&"]
    docs = []
    for _ in range(60):
        names = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 9))}
        names |= {"".join(rng.choice("AB") for _ in range(rng.randint(1, 4))) + rng.choice(["", " Ltd"]) for _ in range(3)}
        docs.append(sorted(names))
    rows = aliases(spark, docs).collect()
    got = {(r.doc_id, r.name): r.main_name for r in rows}
    assert len(rows) == len(got) == sum(map(len, docs))
    assert got == {(d, n): m for d, names in enumerate(docs) for n, m in plain(names).items()}
    assert len(set(got.items())) > len({(d, m) for (d, _), m in got.items()})


def test_odd_rows(spark):
    rows = [(1, None), (None, "Acme Inc"), (1, ""), (1, "..."), (1, "Acme Inc"), (1, "Acme Inc"), (1, "A " * 3000 + "Inc")]
    got = org_aliases(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.name for r in got) == sorted({"", "...", "Acme Inc", "A " * 3000 + "Inc"})
    assert org_aliases(spark.createDataFrame([], "doc_id long, text string")).count() == 0
