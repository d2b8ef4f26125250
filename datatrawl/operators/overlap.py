"""Overlap of spans within a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET = 1024


def _in_buckets(spans: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for every bucket that a span touches; empty spans touch none."""
    first = F.floor(F.col(start) / width)
    last = F.floor((F.col(end) - 1) / width)
    return spans.filter(F.col(start) < F.col(end)).withColumn(
        "_bucket", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, key: str = "doc_id",
                 width: int = BUCKET) -> DataFrame:
    """Pairs of spans of one document that share at least one position.

    `a` has columns start, end; `b` has b_start, b_end; other names must differ but for `key`.
    The join key is document and bucket, so a long document is cut over many tasks. A pair is
    given in the bucket in which its common part begins, hence once.
    """
    pairs = _in_buckets(a, "start", "end", width).join(
        _in_buckets(b, "b_start", "b_end", width), [key, "_bucket"])
    common_start = F.greatest("start", "b_start")
    return pairs.filter(
        (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
        & (F.floor(common_start / width) == F.col("_bucket"))
    ).drop("_bucket")


def as_b(spans: DataFrame, *extra: str, key: str = "doc_id") -> DataFrame:
    """The right side of an overlap join: span columns renamed, `extra` ones prefixed."""
    return spans.select(
        key, F.col("start").alias("b_start"), F.col("end").alias("b_end"),
        *(F.col(c).alias(f"b_{c}") for c in extra))
