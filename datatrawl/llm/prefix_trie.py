"""Prefix trie of conversations by whole-sequence collapse.

Turns are hashed where they are read, so only narrow rows are shuffled. A prefix is known by its
depth and two 64-bit numbers, which join the hashes of its turns and their places. Conversations of
one sequence collapse to one weighted sequence with a list of those that end there. A sequence that
is a proper prefix of another is no leaf; the anti-join tells. All else are sums over the prefixes
of distinct sequences, weighted by how many conversations each stands for.

Running values of a conversation are summed in two levels, within stretches of turns and over the
stretches, so a conversation of very many turns spreads over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from datatrawl.llm.common import stage

STRETCH = 4096    # turns of a stretch; conversation ids of a piece of an end list
WORD = r"[^\x20\x09-\x0D]+"
KEY = ("depth", "k1", "k2")


def _running(rows: DataFrame, bucket: Column, order: list[Column], sums: dict[str, str],
             xors: dict[str, str] | None = None) -> DataFrame:
    """`rows` with the running sum or exclusive or, within `conv_id` up to each row, of some columns.

    `sums` and `xors` give the new column's name for each. `rows` is read twice.
    """
    xors = xors or {}
    placed = rows.withColumn("bucket", bucket)
    kinds = [(F.sum, c, new) for c, new in sums.items()] + [(F.bit_xor, c, new) for c, new in xors.items()]
    earlier = Window.partitionBy("conv_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy("conv_id", "bucket").agg(*(f(c).alias(new) for f, c, new in kinds))
    before = per.select("conv_id", "bucket", *(
        F.coalesce(f(new).over(earlier), F.lit(0)).alias(f"before_{new}") for f, _, new in kinds))
    here = Window.partitionBy("conv_id", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(before, ["conv_id", "bucket"])
    total = lambda f, c, new: (
        f(c).over(here) + F.col(f"before_{new}") if f is F.sum else f(c).over(here).bitwiseXOR(F.col(f"before_{new}")))
    return joined.select(*rows.columns, *(total(*k).alias(k[2]) for k in kinds))


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """`conv_id`, `pos` (from 1), `f1`, `f2` (hashes of role and text), `words`; staged.

    Null role and text are empty. Turns are in order of `turn`, null first; ties by their hashes, so
    equal turns are interchangeable. Rows without a conversation are left out.
    """
    says, speaks = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    narrow = stage(rows.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.xxhash64(speaks, says).alias("f1"), F.xxhash64(says, F.lit("second"), speaks).alias("f2"),
        F.regexp_count(says, F.lit(WORD)).cast("long").alias("words"), F.lit(1).cast("long").alias("one")))
    # A null turn comes first, so it is in the first bucket.
    bucket = F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))
    order = [F.asc_nulls_first("turn"), F.asc("f1"), F.asc("f2")]
    return stage(_running(narrow, bucket, order, {"one": "pos"}).select("conv_id", "pos", "f1", "f2", "words"))


def conversation_ids(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.max("pos").alias("n"))


def with_shared_heads(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """All conversations rebuilt: (`conv_id`; turns as `conv_id`, `depth`, `f1`, `f2`, `words`), staged.

    Conversation c begins with the first h turns of conversation c - c % `every` (as many as there
    are), h being the checksum of c modulo `most`, and goes on with its own behind its first h.
    """
    ids = conversation_ids(turns)
    c = F.col("conv_id")
    base = ids.select(c.alias("base"), F.col("n").alias("base_n"))
    info = stage(ids.select("conv_id", (c - c % every).alias("base"), (F.crc32(c.cast("string")) % most).alias("h")).join(
        base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("shared")))
    heads = turns.filter(F.col("pos") < most).withColumnRenamed("conv_id", "base").join(info, "base").filter("pos <= h").select(
        "conv_id", F.col("pos").alias("depth"), "f1", "f2", "words")
    tails = turns.join(info, "conv_id").filter("pos > h").select(
        "conv_id", (F.col("shared") + F.col("pos") - F.col("h")).alias("depth"), "f1", "f2", "words")
    return info.select("conv_id"), stage(heads.unionByName(tails))


def end_lists(ends: DataFrame) -> DataFrame:
    """KEY and `ends_sha256` of the `conv_id`s, ascending and joined by commas, of each key.

    Lists are made in pieces of a range of ids each, many tasks to a list; the pieces of a list then
    pass in order through one checksum, so none is ever held whole.
    """
    pieces = ends.withColumn("piece", F.floor(F.col("conv_id") / STRETCH)).groupBy(*KEY, "piece").agg(
        F.sort_array(F.collect_list("conv_id")).alias("ids")).select(
        *KEY, "piece", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))
    in_order = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if row[:3] == last:
                    state.update(b"," + row[3].encode())
                    continue
                if last is not None:
                    out.append((*last, state.hexdigest()))
                last, state = row[:3], hashlib.sha256(row[3].encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), r)) for r in out], schema)
        if last is not None:
            yield pa.RecordBatch.from_pylist([dict(zip((*KEY, "ends_sha256"), (*last, state.hexdigest())))], schema)

    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])
    return in_order.mapInArrow(check, "depth long, k1 long, k2 long, ends_sha256 string")


def sequences(ids: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collapsed conversations: (`prefixes`, `sequences`, `ends`), the first two staged.

    `sequences` are KEY, `rep` (smallest conversation), `weight`, `total` words; `prefixes` are all
    prefixes of each (the root too) with `before`, the words before their last turn, and the
    parent's `p1`, `p2`; `ends` names each conversation's sequence.
    """
    mixed = turns.withColumn("g1", F.xxhash64("f1", "depth")).withColumn("g2", F.xxhash64("depth", "f2"))
    keyed = stage(_running(mixed.select("conv_id", "depth", "g1", "g2", "words"), F.floor((F.col("depth") - 1) / STRETCH),
                           [F.asc("depth")], {"words": "upto"}, {"g1": "k1", "g2": "k2"}))
    last = keyed.groupBy("conv_id").agg(
        F.max("depth").alias("depth"), F.max_by("k1", "depth").alias("k1"), F.max_by("k2", "depth").alias("k2"),
        F.max("upto").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    ends = stage(ids.join(last, "conv_id", "left").select("conv_id", *(zero(c) for c in (*KEY, "total"))))
    distinct = stage(ends.groupBy(*KEY).agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("weight"), F.max("total").alias("total")))
    held = distinct.select(F.col("rep"), "weight", "total", F.col("depth").alias("whole"))
    parts = keyed.withColumnRenamed("conv_id", "rep").join(held, "rep").select(
        *KEY, F.col("k1").bitwiseXOR(F.col("g1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("p2"),
        (F.col("upto") - F.col("words")).alias("before"), "rep", "weight", "total", "whole")
    none = F.lit(None).cast("long")
    zeros = F.lit(0).cast("long")
    roots = held.select(zeros.alias("depth"), zeros.alias("k1"), zeros.alias("k2"), none.alias("p1"), none.alias("p2"),
                        zeros.alias("before"), "rep", "weight", "total", "whole")
    return stage(parts.unionByName(roots)), distinct, ends


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """A row per node of the conversations' prefix trie.

    `ids` are all conversations (`conv_id`), `turns` their turns (`conv_id`, `depth` from 1, `f1`,
    `f2`, `words`). A node has `conv_id` (the smallest member), `depth`, `parent_conv_id`, `n_convs`,
    `n_children`, `n_leaves`, `saved_tokens` and `ends_sha256`; null is only the root's parent.
    Without conversations there is no node. Ids must be whole numbers.
    """
    parts, whole, ends = sequences(ids, turns)
    tail = F.col("total") - F.col("before")
    nodes = stage(parts.groupBy(*KEY).agg(
        F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.sum(F.col("weight") * tail).alias("said"),
        F.min("p1").alias("p1"), F.min("p2").alias("p2")))

    proper = parts.filter("depth < whole").select(*KEY).distinct()
    leaves = whole.join(proper, list(KEY), "left_anti").select("rep", F.lit(1).alias("leaf"))
    # A node's words count once, for the sequence of its smallest member; that sequence has all
    # nodes below it too, so its own nodes are the last part of its path.
    own = parts.join(nodes.select(*KEY, F.col("conv_id").alias("rep")), [*KEY, "rep"]).groupBy("rep").agg(
        F.min("depth").alias("own_depth"), F.max(tail).alias("own_tail"))
    per_sequence = stage(own.join(leaves, "rep", "left").select(
        "rep", "own_depth", "own_tail", F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")))
    once = F.when(F.col("depth") >= F.col("own_depth"), tail).otherwise(F.col("own_tail"))
    below = parts.join(per_sequence, "rep").groupBy(*KEY).agg(
        F.sum(once).alias("once"), F.sum("leaf").alias("n_leaves"))

    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                           F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(below, list(KEY)).join(children, list(KEY), "left").join(
        parents, ["depth", "p1", "p2"], "left").join(end_lists(ends), list(KEY), "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves", (F.col("said") - F.col("once")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


def prefix_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """The trie (see `trie`) of conversations as they are; other columns are not read."""
    turns = ordered_turns(rows, conv_id, turn, role, text)
    return trie(conversation_ids(turns).select("conv_id"), turns.withColumnRenamed("pos", "depth"))


def rebuilt_trie(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """The trie of the conversations rebuilt by `with_shared_heads`."""
    return trie(*with_shared_heads(ordered_turns(rows, conv_id, turn, role, text)))


# The checksum of a decimal number, bit by bit; 3988292384 is the polynomial, bits reversed.
_CRC32 = """xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT],
    [CAST(ord(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)))"""

ORACLE = rf"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {_CRC32} % 4 AS h, n
      FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)),
j AS (SELECT i.*, least(i.h, coalesce(b.n, 0)) AS shared FROM i LEFT JOIN i b ON b.conv_id = i.base),
r AS (
  SELECT j.conv_id, o.p AS d, o.role, o.text FROM j JOIN o ON o.conv_id = j.base AND o.p <= j.h
  UNION ALL
  SELECT j.conv_id, j.shared + o.p - j.h, o.role, o.text FROM j JOIN o ON o.conv_id = j.conv_id AND o.p > j.h),
k AS (
  SELECT conv_id, d, list([role, text]) OVER (PARTITION BY conv_id ORDER BY d) AS s,
         len(regexp_extract_all(text, '{WORD}')) AS w FROM r
  UNION ALL SELECT conv_id, 0, [], 0 FROM j),
n AS (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w FROM k GROUP BY s, d),
e AS (
  SELECT s, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
  FROM (SELECT conv_id, max_by(s, d) AS s FROM k GROUP BY conv_id) GROUP BY s),
c AS (SELECT s[1:d - 1] AS s, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
t AS (
  SELECT a.s, sum((u.n_convs - 1) * u.w) AS saved, count(*) FILTER (c.s IS NULL) AS n_leaves
  FROM n a JOIN n u ON u.d >= a.d AND u.s[1:a.d] = a.s LEFT JOIN c ON c.s = u.s GROUP BY a.s)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0) AS n_children, t.n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM n JOIN t ON t.s = n.s LEFT JOIN c ON c.s = n.s LEFT JOIN e ON e.s = n.s
LEFT JOIN n p ON p.d = n.d - 1 AND p.s = n.s[1:n.d - 1]
"""
