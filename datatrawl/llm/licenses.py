"""Licence scans with a positional index of rare licence words.

Each licence is one or more templates: a run of words with mandatory key phrases at fixed places.
The document frequency of every template word is counted over the whole corpus; the rarest words
(highest IDF) of a template's key phrases are its anchors, so that every place of the key phrases is
found whatever words the corpus makes rare. The rarest word outside them is a witness, which counts
for the score alone. One scan explodes the words of a document and looks each up among these; a
posting gives the template and the word's place in it, and so where the template would begin, which
may lie before the text. The mandatory key phrases, which must lie inside the text, are compared
word by word, and the postings of a template that agree on its beginning are put together. Built-in
expressions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from datatrawl.llm.common import row_key, words

# Phrases whose places are counted, and their labels.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Templates of finer labels: the words, and the key phrases that must stand where they do there.
TEMPLATES = (
    ("gpl-3.0", "gnu general public license version 3", ("general public license", "version 3")),
    ("gpl-2.0", "gnu general public license version 2", ("general public license", "version 2")),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license",
     ("not use this file except", "compliance with the license")),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by", "creative commons attribution", ("creative commons attribution",)),
    ("cc0", "creative commons zero", ("creative commons zero",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files",
     ("hereby granted free of charge", "person obtaining a copy")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met",
     ("source and binary forms", "with or without modification")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with "
            "or without fee is hereby granted",
     ("distribute this software for any purpose", "with or without fee")),
    ("mpl", "mozilla public license", ("mozilla public license",)),
    ("epl", "eclipse public license", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("free and unencumbered software",)),
)
ANCHORS = 3      # rarest words of a template's key phrases that are looked up
WITNESSES = 1    # and of its other words


def _find(phrase: list[str], within: list[str]) -> int:
    return next(i for i in range(len(within)) if within[i:i + len(phrase)] == phrase)


def templates(spark: SparkSession, base=BASE, finer=TEMPLATES) -> DataFrame:
    """`template`, `label`, `base`, `w` (words), `keys`: key phrases with their places, as many in
    each row as the template with most has (others repeat their first)."""
    rows = [(label, True, phrase.split(), [(0, phrase.split())]) for label, phrase in base]
    for label, text, keys in finer:
        w = text.split()
        rows.append((label, False, w, [(_find(k.split(), w), k.split()) for k in keys]))
    most = max(len(keys) for *_, keys in rows)
    return spark.createDataFrame(
        [(n, label, is_base, w, (keys + keys[:1] * most)[:most])
         for n, (label, is_base, w, keys) in enumerate(rows)],
        "template int, label string, base boolean, w array<string>, "
        "keys array<struct<at: int, w: array<string>>>")


def word_frequencies(docs: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """`word`, `df`: the documents of the whole corpus that hold each word of `vocabulary`."""
    # The vocabulary is that of the templates, which the code fixes.
    seen = docs.select(F.explode(F.array_distinct(words(F.col(text)))).alias("word"))
    counted = seen.join(F.broadcast(vocabulary), "word", "left_semi").groupBy("word").agg(
        F.count("*").alias("df"))
    return vocabulary.join(counted, "word", "left").select(
        "word", F.coalesce("df", F.lit(0)).alias("df"))


def anchor_index(docs: DataFrame, known: DataFrame, text: str = "text") -> DataFrame:
    """The postings: `word`, `template`, `at`, `weight` (share of the IDF), and what the template
    holds. Ties of IDF go to the earlier place."""
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    in_key = F.exists("keys", lambda k: (F.col("at") >= k["at"]) & (F.col("at") < k["at"] + F.size(k["w"])))
    places = known.select("*", F.posexplode("w").alias("at", "word")).withColumn("in_key", in_key)
    df = word_frequencies(docs, places.select("word").distinct(), text)
    idf = F.log((F.col("n_docs") + 1.0) / (F.col("df") + 1.0)) + 1.0
    scored = places.join(F.broadcast(df), "word").crossJoin(F.broadcast(n_docs)).withColumn("idf", idf)
    # The templates are fixed in the code, and so is the size of these windows.
    rarest = Window.partitionBy("template", "in_key").orderBy(F.desc("idf"), "at")
    picked = scored.withColumn("nth", F.row_number().over(rarest)).filter(
        F.col("nth") <= F.when(F.col("in_key"), ANCHORS).otherwise(WITNESSES))
    total = F.sum("idf").over(Window.partitionBy("template"))
    return picked.select("template", "label", "base", "keys", "word", "at", (F.col("idf") / total).alias("weight"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base=BASE,
         finer=TEMPLATES) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `found`: structs (label, base, start, share), sorted.

    `start` is the template's first word, below 0 if the text begins within a finer template;
    `share` (0 to 1) the part of the IDF of its anchors and witness that stood in place. Null and wordless texts find nothing; repeated rows are returned as often as they
    occur; other columns are not read.
    """
    known = templates(docs.sparkSession, base, finer)
    n_keys = len(known.first()["keys"])
    # A word may be an anchor of several templates; its first posting stands for the word itself.
    by_word = Window.partitionBy("word").orderBy("template", "at")
    postings = anchor_index(docs, known, text).withColumn("nth", F.row_number().over(by_word))
    postings = postings.withColumnRenamed("at", "anchor_at")
    spread = docs.select(F.col(doc_id).alias("doc"), row_key(F.col(doc_id), F.col(text)).alias("row"),
                         words(F.col(text)).alias("w"))
    spread = spread.select("doc", "row", "w", F.posexplode_outer("w").alias("at", "word"))
    # At most ANCHORS + WITNESSES rows a template, whose number the code fixes.
    met = spread.join(F.broadcast(postings), "word", "left")
    first = F.col("at").isNull() | ((F.col("at") == 0) & (F.coalesce("nth", F.lit(1)) == 1))
    start = F.col("at") - F.col("anchor_at")
    # No lambdas here: they would end the generated loop, and each word would carry the whole text.
    ok = F.col("template").isNotNull()
    for k in range(n_keys):
        key = F.get("keys", F.lit(k))
        here = F.greatest(start + key["at"] + 1, F.lit(1))
        ok = ok & (start + key["at"] >= 0) & (F.slice("w", here, F.size(key["w"])) == key["w"])
    ok = F.coalesce(ok, F.lit(False))
    met = met.filter(first | ok).select(
        "doc", "row", F.size("w").alias("n_words"), first.alias("first"), ok.alias("ok"), "template",
        "label", "base", "weight", "anchor_at", start.alias("start"))
    met = met.select("doc", "row", "n_words", "first", "anchor_at",
                     *[F.when(F.col("ok"), F.col(c)).alias(c)
                       for c in ("template", "label", "base", "weight", "start")])
    places = met.groupBy("doc", "row", "n_words", "template", "label", "base", "start").agg(
        F.sum(F.col("first").cast("int")).alias("firsts"),
        F.countDistinct("anchor_at").alias("agreeing"),
        F.sum("weight").alias("weight_sum"), F.count("*").alias("rows"))
    # Repeated rows of a document meet in one group: each anchor then counts as often.
    share = F.least(F.lit(1.0), F.col("weight_sum") * F.col("agreeing") / F.col("rows"))
    # Where the key phrases stand, all their anchors do.
    found = F.when(F.col("template").isNotNull(), F.struct(
        "label", "base", F.col("start").cast("long").alias("start"), share.alias("share")))
    merged = places.groupBy("doc", "row", "n_words").agg(
        F.sum("firsts").cast("int").alias("copies"),
        F.sort_array(F.collect_list(found)).alias("found"))
    return merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(
        F.col("doc").alias(doc_id), F.col("n_words").cast("long").alias("n_words"), "found")


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns of `scan`. `score` is the best share; 0 if nothing was found."""
    base = F.filter("found", lambda f: f["base"])
    label = lambda found: F.concat_ws(
        ",", F.array_sort(F.array_distinct(F.transform(found, lambda f: f["label"]))))
    starts = F.transform(base, lambda f: f["start"])
    return scanned.select(
        doc_id, "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        label(base).alias("base_labels"), label(F.col("found")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0)), 6)
        .alias("score"))
