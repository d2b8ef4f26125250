"""Data links, the metadata page, and ids of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.functions import urls as u
from datatrawl.operators.ids import dense_ids, highest_id


def download_links(links: DataFrame, probes: DataFrame) -> DataFrame:
    """Distinct resolved URLs of data sets on each page: page_id, url.

    `links` has page_id, url (of the page) and href. A link counts if its lower-cased target ends
    with a known suffix, or if it holds one (case counts) and was probed as a listed type. Only
    the second kind has to find its probe.
    """
    candidates = links.select(
        "page_id", u.resolve_link(F.col("url"), F.col("href")).alias("target"),
        u.ends_with_download_suffix(F.col("href")).alias("_sure"),
        u.contains_download_suffix(F.col("href")).alias("_maybe"),
    ).filter((F.col("_sure") | F.col("_maybe")) & F.col("target").isNotNull())
    # One row for each pair before the join, as a distinct behind it would keep a hot URL together.
    pairs = candidates.groupBy("page_id", F.col("target").alias("url")).agg(F.max("_sure").alias("_sure"))
    archives = probes.filter(F.col("content_type").isin(*fixed.DOWNLOAD_MIME_TYPES)).select("url")
    sure, probed = pairs.filter("_sure"), pairs.filter("not _sure").join(archives, "url", "left_semi")
    return sure.select("page_id", "url").unionByName(probed.select("page_id", "url"))


def metadata_page(links: DataFrame, probes: DataFrame) -> DataFrame:
    """The first link of a page that speaks of metadata and is XML: page_id, url.

    An anchor speaks of it if its text has `metadata` or `xml` in any case.
    """
    named = F.lower("anchor_text").rlike("metadata|xml")
    candidates = links.filter(named).select(
        "page_id", "ord",
        u.resolve_metadata_link(F.col("url"), F.col("href")).alias("target"))
    xml = probes.filter(F.col("content_type").endswith("/xml")).select(F.col("url").alias("target"))
    hits = candidates.filter(u.is_valid_url(F.col("target"))).join(xml, "target", "left_semi")
    return hits.groupBy("page_id").agg(F.min_by("target", "ord").alias("url"))


def link_formats(downloads: DataFrame) -> DataFrame:
    """Distinct endings of a page's data links: page_id, format."""
    return downloads.select("page_id", u.link_format(F.col("url")).alias("format")).distinct()


def match_known_links(downloads: DataFrame, tab_links: DataFrame) -> DataFrame:
    """Distinct link URLs with the id they have, or `is_new`: url, id, is_new."""
    known = tab_links.select("url", F.col("id").cast("bigint").alias("id"))
    matched = downloads.select("url").distinct().join(known, "url", "left")
    return matched.select("url", "id", F.col("id").isNull().alias("is_new"))


def assign_link_ids(matched: DataFrame, tab_links: DataFrame) -> DataFrame:
    """Give new links the ids after the highest one in use, in digest order."""
    known = matched.filter(~F.col("is_new"))
    fresh = dense_ids(matched.filter("is_new").select("url", "is_new"), ["url"],
                      highest_id(tab_links))
    return known.select("url", "id", "is_new").unionByName(fresh.select("url", "id", "is_new"))


def new_links_only(links: DataFrame) -> DataFrame:
    return links.filter("is_new")


def link_bridge(page_urls: DataFrame, downloads: DataFrame, link_ids: DataFrame) -> DataFrame:
    """One row per page and data link: url_id, link_id.

    `page_urls` maps page_id to url_id. One link may be on a large share of all pages.
    """
    pairs = page_urls.select("page_id", F.col("id").alias("url_id")).join(
        downloads.select("page_id", "url"), "page_id")
    ids = link_ids.select("url", F.col("id").alias("link_id"))
    return pairs.select("url_id", "url").join(ids, "url").select("url_id", "link_id")


def run_counts(links: DataFrame, routed: DataFrame) -> DataFrame:
    """One row of counts: data links, new ones, URLs worked on, sub-pages among them."""
    link_counts = links.agg(F.count(F.lit(1)).alias("n"), F.count_if("is_new").alias("m"))
    counted = routed.agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_if(F.col("outcome") == "store").alias("n_stored"),
        F.count_if(~F.col("from_queue")).alias("n_subpages"))
    return counted.select(
        "*", link_counts.select("n").scalar().alias("n_links"),
        link_counts.select("m").scalar().alias("n_new_links"))
