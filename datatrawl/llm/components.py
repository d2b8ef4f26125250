"""Connected components of a large edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from datatrawl.llm.common import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One round of star joining. Large: each node's larger neighbours go to its smallest one;
    small: the node and its smaller neighbours do."""
    if larger:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(smallest, "a")
    if larger:
        out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select("b", "m").union(joined.select(F.col("a").alias("b"), "m")).filter(
            F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """`node`, `component` (its smallest node) for the nodes of the edges (`a`, `b`: longs).

    Large and small star rounds alternate until nothing changes; each is written to the shared
    folder, so lineage stays short. Nodes of no edge do not appear.
    """
    now = stage(edges.filter("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(most_rounds):
        # Stars round their smallest nodes stay as they are; a sum of hashes, taken while they are written, tells.
        seen = Observation()
        now = stage(_star(_star(now, True), False).observe(
            seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")))
        state = seen.get
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(leaves.select(F.col("component").alias("node"), "component").distinct())
