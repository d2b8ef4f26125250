"""Tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str) -> DataFrame:
    """Store a table cut and sorted by a key, so that joins on it need not shuffle it.

    Pages are wide: keep them by URL, and the page scan moves frontier rows only.
    """
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
     .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, path: str, spread_by: str | None = None) -> DataFrame:
    """Read Parquet. If the files give fewer tasks than there are cores, spread the rows by a key.

    A large table has tasks enough and is not shuffled.
    """
    table = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if spread_by and table.rdd.getNumPartitions() < cores:
        return table.repartition(cores, spread_by)
    return table
