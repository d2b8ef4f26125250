"""Seed URLs from text files, one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.functions.urls import is_uri


def as_frontier(df: DataFrame, url: Column, source: str, *keep: str) -> DataFrame:
    return df.select(
        *keep, F.lit(None).cast("string").alias("parent_url"), url.alias("url"),
        F.lit(source).alias("source"), F.lit(True).alias("from_queue"))


def accept_seed_lines(lines: DataFrame) -> DataFrame:
    """Lines (column value) that are absolute URLs, as frontier rows. Equal lines stay."""
    return as_frontier(lines.filter(is_uri(F.col("value"))), F.col("value"), fixed.SOURCE_MANUAL)


def reject_seed_lines(lines: DataFrame) -> DataFrame:
    """Lines that are neither empty nor absolute URLs. They do not stop the others."""
    return lines.filter((F.length("value") > 0) & ~is_uri(F.col("value"))).select("value")


def seed_urls(spark: SparkSession, path: str) -> DataFrame:
    return accept_seed_lines(spark.read.text(path))


def seed_urls_stream(spark: SparkSession, folder: str, used_folder: str | None = None) -> DataFrame:
    """Frontier rows of every new file in a folder.

    With `used_folder`, read files move there once their batch is done: it is the log of used
    seeds, and the input folder runs empty.
    """
    reader = spark.readStream.format("text").schema("value STRING")
    if used_folder:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", used_folder)
    return accept_seed_lines(reader.load(folder))
