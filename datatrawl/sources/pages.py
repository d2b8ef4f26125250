"""Fetched content: pages and metadata documents come in as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame


def page_scan(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows with the page behind their URL."""
    return frontier.join(pages, "url")


def page_misses(frontier: DataFrame, pages: DataFrame) -> DataFrame:
    """Frontier rows whose URL could not be fetched."""
    return frontier.join(pages.select("url"), "url", "left_anti")


def metadata_doc_scan(urls: DataFrame, metadata_docs: DataFrame) -> DataFrame:
    """Metadata pages (page_id, url) with their XML."""
    return urls.join(metadata_docs, "url")
