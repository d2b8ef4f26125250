"""Which stored URLs are alive, and what that does to their status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed


def check_urls(tab_url: DataFrame, probes: DataFrame) -> DataFrame:
    """Stored URLs but for the badly reviewed, with `is_active`.

    A URL is active if it answered with a code below 400; no answer or an error is inactive.
    """
    due = tab_url.filter(F.col("status") != fixed.REVIEWED_BAD)
    answers = probes.groupBy("url").agg(
        F.max((F.col("http_code") < 400) & F.col("error").isNull()).alias("_alive"))
    return due.join(answers, "url", "left").select(
        *tab_url.columns, F.coalesce("_alive", F.lit(False)).alias("is_active"))


def next_status(checked: DataFrame) -> DataFrame:
    """Rows whose status changes: url, status (new), old_status."""
    status, alive = F.col("status"), F.col("is_active")
    new = (
        F.when((status == fixed.FROM_EXTRACTOR) & ~alive, fixed.INACTIVE_UNREVIEWED)
        .when((status == fixed.REVIEWED_GOOD) & ~alive, fixed.INACTIVE_REVIEWED)
        .when(status.isin(fixed.INACTIVE_UNREVIEWED, fixed.INACTIVE_REVIEWED) & alive,
              fixed.FROM_EXTRACTOR)
    )
    return checked.select("url", new.alias("status"), status.alias("old_status")).filter(
        F.col("status").isNotNull())


def apply_status(tab_url: DataFrame, changes: DataFrame) -> DataFrame:
    """The table with the new statuses, by URL."""
    new = changes.select("url", F.col("status").alias("_status"))
    return tab_url.join(new, "url", "left").withColumn(
        "status", F.coalesce("_status", "status")).select(*tab_url.columns)
