"""A join for thin lookups that holds up when one key has a large share of the rows.

Joins of two large tables carry no hint and no salt: adaptive execution splits the partitions of
a hot key, if the join shuffles both sides itself. A side that is an aggregate by the join's key
keeps its own partitioning and can't be split, so such sides are written first (`stage`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def _salt(df: DataFrame, salts: int) -> Column:
    """The same for a row when its task runs again, and different for equal rows of two tasks."""
    columns = [F.col(c) for c in df.columns]
    return F.pmod(F.xxhash64(*columns, F.spark_partition_id()), F.lit(salts)).cast("int")


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner",
                salts: int = SALTS) -> DataFrame:
    """Join where `right` is a thin lookup: each of its rows is there once for every salt.

    Rows of a hot key on the left go to `salts` places. No hint is given, so Spark still
    broadcasts a lookup that is small by its own count.
    """
    spread = left.withColumn("_salt", _salt(left, salts))
    copies = right.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"], how).drop("_salt")
