"""Seed files as a stream into a frontier folder."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from datatrawl.sources.seeds import seed_urls_stream


def run_seed_stream(spark: SparkSession, folder: str, out: str, checkpoint: str,
                    used_folder: str | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Append accepted seeds of new files to `out`; for a fixed interval give processingTime."""
    return (
        seed_urls_stream(spark, folder, used_folder).writeStream.format("parquet")
        .option("path", out).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )
