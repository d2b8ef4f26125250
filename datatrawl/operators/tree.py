"""The element tree of pages as a node table, and lookups in it.

Node ids are in document order and `last_id` is the last descendant, so a subtree is a span.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from datatrawl import schemas
from datatrawl.functions.html_tree import tree_rows
from datatrawl.operators.overlap import overlap_join

_ROWS_PER_BATCH = 20_000
_ARROW_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("node_id", pa.int32()), ("parent_id", pa.int32()),
    ("last_id", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
    ("start", pa.int32()), ("end", pa.int32()), ("text", pa.string()),
])


def _as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    columns[5] = [list(attrs.items()) for attrs in columns[5]]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _ARROW_SCHEMA)], schema=_ARROW_SCHEMA)


def html_tree(pages: DataFrame) -> DataFrame:
    """Node table of pages. HTML nests only loosely, which regular expressions cannot follow."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for page in batch.to_pylist():
                rows.extend(tree_rows(page["page_id"], page["html"] or ""))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield _as_batch(rows)
                    rows = []
        if rows:
            yield _as_batch(rows)

    return pages.select("page_id", "html").mapInArrow(parse, schemas.TREE_NODES)


def ancestors_up(elements: DataFrame, nodes: DataFrame, up: int) -> DataFrame:
    """Add scope_id and scope_last of the ancestor `up` levels above, the root at most."""
    thin = nodes.select("page_id", F.col("node_id").alias("_id"), F.col("parent_id").alias("_up"),
                        F.col("last_id").alias("_last"))
    climbed = elements.withColumn("_at", F.col("node_id"))
    for _ in range(up):
        step = thin.select("page_id", F.col("_id").alias("_at"), "_up")
        climbed = climbed.join(step, ["page_id", "_at"]).withColumn(
            "_at", F.coalesce("_up", "_at")).drop("_up")
    ends = thin.select("page_id", F.col("_id").alias("_at"), "_last")
    return climbed.join(ends, ["page_id", "_at"]).withColumnsRenamed(
        {"_at": "scope_id", "_last": "scope_last"})


def scope_nodes(nodes: DataFrame, elements: DataFrame, up: int = 2) -> DataFrame:
    """All nodes below (and with) the ancestor `up` levels above each element.

    Gives page_id, node_id (the element), scope_id, member_id. Rows grow with the subtrees asked
    for, so pass the elements that are of interest.
    """
    scopes = ancestors_up(elements.select("page_id", "node_id"), nodes, up)
    spans = scopes.select("page_id", "node_id", "scope_id", F.col("scope_id").alias("start"),
                          (F.col("scope_last") + 1).alias("end"))
    members = nodes.select("page_id", F.col("node_id").alias("b_start"),
                           (F.col("node_id") + 1).alias("b_end"),
                           F.col("node_id").alias("member_id"))
    return overlap_join(spans, members, "page_id").select(
        "page_id", "node_id", "scope_id", "member_id")


def nodes_containing(nodes: DataFrame, word: str) -> DataFrame:
    """Elements whose text, with that of their descendants, has the word in any case.

    An element has it if the first occurrence at or after its start ends before its end. That is
    found in one ordered pass over a page's elements and occurrences.
    """
    width = len(word)
    pieces = F.split("text", rf"(?i)\Q{word}\E", -1)
    between = nodes.filter(F.col("node_id") == 0).select(
        "page_id", F.posexplode(pieces).alias("no", "piece"))
    in_order = Window.partitionBy("page_id").orderBy("no").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    ends = F.sum(F.length("piece")).over(in_order) + F.col("no") * width
    is_last = F.lead("no").over(Window.partitionBy("page_id").orderBy("no")).isNull()
    occurrences = between.select("page_id", ends.cast("int").alias("at"), is_last.alias("rest"))
    occurrences = occurrences.filter(~F.col("rest")).select(
        "page_id", "at", F.lit(None).cast("int").alias("node_id"),
        F.lit(None).cast("int").alias("end"), F.col("at").alias("hit"))
    elements = nodes.filter(F.col("node_id") > 0).select(
        "page_id", F.col("start").alias("at"), "node_id", "end",
        F.lit(None).cast("int").alias("hit"))
    from_the_end = Window.partitionBy("page_id").orderBy(F.col("at").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    both = elements.unionByName(occurrences).withColumn("next_hit", F.min("hit").over(from_the_end))
    return both.filter(
        F.col("node_id").isNotNull() & (F.col("next_hit") + width <= F.col("end"))
    ).select("page_id", "node_id")
