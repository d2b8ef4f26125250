import random
import re

from datatrawl.llm import licenses as L
from tests.llm import odd
from tests.llm.test_decontamination import words


def brute(text):
    w = words(text)
    places = [(at, label) for label, phrase in L.BASE for p in [phrase.split()]
              for at in range(len(w)) if w[at:at + len(p)] == p]
    starts = [at for at, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def base(row):
    return row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels


def test_base_places_as_by_brute_force(spark):
    rng = random.Random(3)
    bits = ["GNU General Public License", "gnu general", "public license", "apache license", "MIT", "license",
            "CC BY-NC 4.0", "cc by", "mit license mit license", "version 3", "x", "the"]
    rows = list(odd.ROWS) + [(100 + i, ", ".join(rng.choice(bits) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    got = L.digest(L.scan(odd.documents(spark, rows))).collect()
    assert sorted(str((r.doc_id, *base(r))) for r in got) == sorted(str((d, *brute(t))) for d, t in rows)
    assert all(0 <= r.score <= 1 and (r.score > 0) == bool(r.labels) for r in got)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_finer_labels(spark):
    rows = [(1, "Licensed under the Apache License, Version 2.0."), (2, "licensed under CC BY-NC 4.0"),
            (3, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
                " and associated documentation files"),
            (4, "GNU Lesser General Public License"), (5, "version 3 of nothing"), (6, "the quick brown fox")]
    got = {r.doc_id: r.labels for r in L.digest(L.scan(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {1: "apache,apache-2.0", 2: "cc-by,cc-by-nc", 3: "mit", 4: "lgpl", 5: "", 6: ""}


def labels_by_brute_force(text):
    w, out = words(text), {label for label, phrase in L.BASE if f" {phrase} " in f" {' '.join(words(text))} "}
    for label, template, keys in L.TEMPLATES:
        t = template.split()
        at = [next(i for i in range(len(t)) if t[i:i + len(k.split())] == k.split()) for k in keys]
        for start in range(-len(t), len(w)):
            if all(start + a >= 0 and w[start + a:start + a + len(k.split())] == k.split() for a, k in zip(at, keys)):
                out.add(label)
    return ",".join(sorted(out))


def test_labels_as_by_brute_force(spark):
    rng = random.Random(8)
    texts = ["Apache License Version 2.0 January 2004", "hello Apache License Version 2.0 and more", "version 2.0 apache license",
             "not use this file except in compliance with the license", "Redistribution, source and binary forms",
             "source and binary forms, with or without modification", "general public license version 3", None, "", "the"]
    for _, template, keys in L.TEMPLATES:
        t = template.split()
        for _ in range(6):
            a, b = sorted(rng.randrange(len(t) + 1) for _ in range(2))
            texts.append(" ".join(rng.choice([["licensed", "the"], []]) + t[a:b] + rng.choice([t, ["x"], [], t[:a]])))
        texts += [template, f"under {keys[0]} version {keys[-1]}"]
    # Whatever is rare in the corpus, the labels are the same.
    for extra in ([], ["apache license 2 0"] * 50 + ["licensed under version"] * 3):
        docs = spark.createDataFrame(list(enumerate(texts + extra)), "doc_id long, text string")
        got = {r.doc_id: (r.labels, r.score) for r in L.digest(L.scan(docs)).collect()}
        assert {d: labels for d, (labels, _) in got.items()} == {
            d: labels_by_brute_force(t) for d, t in enumerate(texts + extra)}
        assert all(0 <= score <= 1 and (score > 0) == bool(labels) for labels, score in got.values())
        assert all(got[texts.index(t)][1] == 1 for _, t, _ in L.TEMPLATES)


def test_empty_table(spark):
    assert L.digest(L.scan(odd.documents(spark, odd.ROWS).limit(0))).count() == 0


def test_no_lambda_in_the_word_loop(spark):
    """A lambda there would copy the text for each word."""
    plan = L.scan(odd.documents(spark, odd.ROWS))._jdf.queryExecution().optimizedPlan().toString()
    generate = plan[plan.rindex("Generate posexplode"):] if "Generate posexplode" in plan else ""
    assert generate and not re.search("lambda", plan[:plan.rindex("Generate posexplode")].rsplit("Aggregate", 1)[-1])
