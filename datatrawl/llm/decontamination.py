"""Benchmark decontamination: find and remove passages of test items in documents.

A broadcast hash set of normalised word n-grams of the benchmark is probed by every window of
every document; a hit is verified word by word. Built-in expressions only: one scan explodes the
words of a document, hashes the window that begins at each, and joins, all in one generated loop,
so that no window is ever built as a string or shuffled. Only hits and one row for each document
reach the exchange. The ids of a window's items stay out of the broadcast, however many they are: a
hit carries the window's number, and documents with hits are joined with the items of their windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from datatrawl.llm.common import row_key, stage, unused, words

WINDOW = 10
# Windows, and bytes of their words, that one broadcast holds about. A larger benchmark is cut by
# hash in as many slices as it takes, each probed by a scan of its own.
BROADCAST_WINDOWS = 400_000
BROADCAST_BYTES = 64 << 20


def item_windows(items: DataFrame, window: int = WINDOW, item_id: str = "item_id",
                 text: str = "text") -> DataFrame:
    """A row for each distinct window: `key`, `size`, `gram` (its words), `items` (their ids).

    An item of fewer words than `window` is one window; one without words has none.
    """
    n = F.size("w")
    starts = F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))
    grams = (
        items.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w"))
        .filter(n > 0)
        .select("item", "w", F.explode(starts).alias("at"))
        .select("item", F.slice("w", F.col("at") + 1, window).alias("gram"))
    )
    return (
        grams.groupBy("gram").agg(F.collect_set("item").alias("items"))
        .select(F.size("gram").alias("size"), "gram", "items",
                _key([F.get("gram", F.lit(i)) for i in range(window)]).alias("key"))
    )


def _key(parts: list[Column]) -> Column:
    # Nulls are passed over, so a short window and the start of a longer one agree: such a
    # candidate fails the comparison of words.
    return F.xxhash64(*parts)


def _probe(docs: DataFrame, grams: DataFrame, sizes: list[int], doc_id: str, text: str,
           window: int) -> DataFrame:
    """A row for each hit (`span`, `gram_id`) and one without hit for each document's start."""
    spread = docs.select(F.col(doc_id).alias("doc"), row_key(F.col(doc_id), F.col(text)).alias("row"),
                         words(F.col(text)).alias("w"))
    spread = spread.select("doc", "row", "w", F.posexplode_outer("w").alias("at", "word"))
    keys = [
        F.struct(F.lit(size).alias("size"),
                 _key([F.get("w", F.col("at") + i) for i in range(size)]).alias("key"))
        for size in sizes
    ]
    if len(keys) == 1:
        spread = spread.withColumn("probe", keys[0])
    else:
        spread = spread.withColumn("probe", F.explode(F.array(*keys)))
    spread = spread.select("doc", "row", "w", "at", F.col("probe.key").alias("probe_key"),
                           F.col("probe.size").alias("probe_size"))
    hit = ((F.col("probe_key") == F.col("key")) & (F.col("probe_size") == F.col("size"))
           & (F.slice("w", F.col("at") + 1, F.col("size")) == F.col("gram")))
    found = spread.join(F.broadcast(grams), hit, "left")
    first = (F.coalesce("at", F.lit(0)) == 0) & (F.col("probe_size") == sizes[0])
    return found.filter(F.col("gram").isNotNull() | first).select(
        "doc", "row", F.size("w").alias("n_words"), first.alias("first"),
        F.when(F.col("gram").isNotNull(),
               F.struct(F.col("at"), (F.col("at") + F.col("size")).alias("end"))).alias("span"),
        "gram_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, doc_id: str = "doc_id",
                  text: str = "text", item_id: str = "item_id", item_text: str = "text",
                  broadcast_windows: int = BROADCAST_WINDOWS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: `doc_id`, `n_words`, `n_hit`, `items` (sorted ids as text), `spans`.

    `spans` are the occurring windows as word ranges, sorted, overlaps kept. A null or wordless
    document gives zeros and empty lists; a repeated row is returned as often as it occurs; an
    empty benchmark hits nothing. Other columns of `docs` are not read.
    """
    # The numbers hold once they are written.
    numbered = stage(item_windows(items, window, item_id, item_text).withColumn(
        "gram_id", F.monotonically_increasing_id()))
    grams = numbered.drop("items")
    # At most `window` sizes, and the number of windows and bytes of each.
    counts = grams.groupBy("size").agg(
        F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("gram", ""))).alias("bytes")).collect()
    sizes = sorted(r["size"] for r in counts) or [window]
    slices = max(1, math.ceil(sum(r["n"] for r in counts) / broadcast_windows),
                 math.ceil(sum(r["bytes"] for r in counts) / broadcast_bytes))
    probed = None
    for part in range(slices):
        held = grams.filter(F.pmod("key", F.lit(slices)) == part) if slices > 1 else grams
        one = _probe(docs, held, sizes, doc_id, text, window)
        if part:
            one = one.withColumn("first", F.lit(False))
        probed = one if probed is None else probed.union(one)

    # Written, as both the documents and the windows they hold are read from it.
    merged = stage(probed.groupBy("doc", "row").agg(
        F.first("n_words").alias("n_words"),
        F.sum(F.col("first").cast("int")).alias("copies"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.collect_set("gram_id").alias("grams"),
    ))
    held = merged.select("row", F.explode("grams").alias("gram_id")).join(
        numbered.select("gram_id", "items"), "gram_id").groupBy(F.col("row").alias("held_row")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("held_items"))
    merged = merged.join(held, F.col("row").eqNullSafe(F.col("held_row")), "left").withColumn(
        "items", F.coalesce("held_items", F.array().cast("array<string>")))
    # Spans are sorted by their starts: each adds what lies beyond the furthest end so far.
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "spans", start,
        lambda acc, s: F.struct(
            (acc["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(acc["end"], s["at"]))).alias("n"),
            F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"])
    return (
        merged.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        .select(F.col("doc").alias(doc_id), F.col("n_words").cast("long").alias("n_words"),
                covered.cast("long").alias("n_hit"), "items", "spans", "row")
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id",
                        text: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs` without those documents in which a window of `items` occurs; columns as they are.

    Clean rows, null texts and repeated rows among them, all stay.
    """
    bad = (
        contamination(docs, items, window, doc_id, text).filter("n_hit > 0")
        .select(F.col("row").alias(mark := unused(docs, "row"))).distinct()
    )
    return docs.join(bad, row_key(docs[doc_id], docs[text]).eqNullSafe(bad[mark]), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """`docs` with the hit words taken out of the texts; texts without hits stay as they are.

    A changed text is its normalised words that are left, joined by a space.
    """
    hits = contamination(docs, items, window, doc_id, text).filter("n_hit > 0").dropDuplicates(["row"])
    mark, cut = unused(docs, "row"), unused(docs, "cut")
    hits = hits.select(
        F.col("row").alias(mark),
        F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["at"], s["end"] - 1)))).alias(cut))
    joined = docs.join(hits, row_key(docs[doc_id], docs[text]).eqNullSafe(hits[mark]), "left")
    w = words(F.col(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), F.col(cut))
    kept = F.array_join(F.transform(left, lambda i: F.get(w, i)), " ")
    return joined.select(*[
        F.when(F.col(mark).isNull(), F.col(c)).otherwise(kept).alias(c) if c == text else F.col(c)
        for c in docs.columns])


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The contract's columns of `contamination`."""
    return found.select(
        doc_id, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
grams AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size,
         array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') AS gram
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM iw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM grams),
places AS (
  SELECT doc_id, k, size, array_to_string(list_slice(w, k, k + size - 1), ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM dw), sizes
  WHERE k + size - 1 <= len(w)),
hits AS (SELECT doc_id, k, p.size, item_id FROM places p JOIN grams g USING (gram, size)),
hit_words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + size)) AS pos FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
