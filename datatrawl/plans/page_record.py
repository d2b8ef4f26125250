"""The result of one extraction per page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl.functions import urls as u
from datatrawl.operators.links import download_links
from datatrawl.operators.markup import feature_links, page_features
from datatrawl.plans.catalogue import page_authors, page_extents
from datatrawl.plans.inputs import Inputs


def _sets(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Values per page; a page's own values fit in a row, as the page did."""
    return rows.groupBy("page_id").agg(F.sort_array(F.collect_set(column)).alias(name))


def page_records(pages: DataFrame, inputs: Inputs, keep=lambda df: df) -> DataFrame:
    """page_id, url, titles, abstract, authors, formats, links, extents; sets are sorted arrays.

    `keep` is applied to what is used more than once and may write it (`stage`), so that the
    markup is read once.
    """
    features = keep(page_features(pages))
    links = _sets(download_links(feature_links(features), inputs.link_probes), "url", "links")
    names = _sets(page_authors(features, inputs, keep), "author", "authors")
    extents = _sets(page_extents(features, inputs), "extent", "extents")
    joined = (
        features.select("page_id", "url", F.sort_array("titles").alias("titles"), "abstract")
        .join(links, "page_id", "left").join(names, "page_id", "left")
        .join(extents, "page_id", "left")
    )
    none = F.array().cast("array<string>")
    formats = F.array_sort(F.array_distinct(F.transform("links", u.link_format)))
    return joined.select(
        "page_id", "url", "titles", "abstract",
        F.coalesce("authors", none).alias("authors"), F.coalesce(formats, none).alias("formats"),
        F.coalesce("links", none).alias("links"), F.coalesce("extents", none).alias("extents"))
