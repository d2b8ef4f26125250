"""Consecutive ids without a global sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX_DIGITS = 3


def dense_ids(df: DataFrame, by: list[str], after: Column | None = None,
              id_name: str = "id") -> DataFrame:
    """Number the distinct rows of `df` from `after` + 1, in digest order of `by`.

    The first digits of the digest cut the rows in even and fixed buckets (16^digits of them),
    so each bucket is numbered by itself and shifted by the sizes of the buckets before it.
    The result does not depend on the partitioning, so a lost task can be run again.
    """
    key = F.md5(F.concat_ws("\x01", *(F.coalesce(F.col(c).cast("string"), F.lit("\x02"))
                                      for c in by)))
    keyed = df.withColumn("_digest", key).withColumn(
        "_bucket", F.substring("_digest", 1, PREFIX_DIGITS))
    sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16^PREFIX_DIGITS rows reach this one window.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    in_bucket = Window.partitionBy("_bucket").orderBy("_digest", *by)
    numbered = keyed.withColumn("_rn", F.row_number().over(in_bucket))
    start = F.lit(0) if after is None else after
    return (
        numbered.join(F.broadcast(shifts), "_bucket")
        .withColumn(id_name, (start + F.col("_shift") + F.col("_rn")).cast("bigint"))
        .drop("_digest", "_bucket", "_shift", "_rn")
    )


def highest_id(table: DataFrame, id_name: str = "id") -> Column:
    """The largest id in use, 0 for an empty table, as a scalar subquery."""
    return F.coalesce(
        table.agg(F.max(F.col(id_name).cast("bigint")).alias("m")).scalar(),
        F.lit(0).cast("bigint"))
