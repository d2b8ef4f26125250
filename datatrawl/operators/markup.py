"""Structure of pages: tags, links, titles, abstracts. All of it is computed within the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.functions import markup as m


def _cleaned(pages: DataFrame, *keep: str) -> DataFrame:
    return pages.select("page_id", *keep, m.without_noise(F.col("html")).alias("clean"))


def html_nodes(pages: DataFrame) -> DataFrame:
    """Start tags in document order, numbered from 0: page_id, node_id, tag, attrs."""
    rows = _cleaned(pages).select(
        "page_id", F.posexplode_outer(m.start_tag_array(F.col("clean"))).alias("node_id", "raw"))
    return rows.filter(F.col("raw").isNotNull()).select(
        "page_id", "node_id", m.tag_name(F.col("raw")).alias("tag"),
        m.attribute_map(F.col("raw")).alias("attrs"))


def links(pages: DataFrame) -> DataFrame:
    """`a` elements with a target: page_id, url, ord, href, anchor_text."""
    rows = _cleaned(pages, "url").select(
        "page_id", "url", F.posexplode_outer(m.anchor_array(F.col("clean"))).alias("ord", "a"))
    return rows.filter(F.col("a").isNotNull()).select(
        "page_id", "url", "ord", F.col("a.href").alias("href"),
        F.col("a.anchor_text").alias("anchor_text"))


def titles(pages: DataFrame, cap: int = fixed.TITLE_CAP) -> DataFrame:
    """Distinct texts of the first title and h1 elements: page_id, title."""
    arrays = _cleaned(pages).select("page_id", m.title_array(F.col("clean"), cap).alias("t"))
    return arrays.select("page_id", F.explode_outer("t").alias("title"))


def abstracts(pages: DataFrame, min_len: int = fixed.ABSTRACT_MIN_LENGTH) -> DataFrame:
    """The first paragraph of some length: page_id, abstract."""
    return _cleaned(pages).select(
        "page_id", m.abstract_text(F.col("clean"), min_len).alias("abstract"))


def page_features(pages: DataFrame) -> DataFrame:
    """All that needs the markup, in one pass: links, titles, abstract, text and title span.

    The text is that of title and rest laid end to end, so that the title has a span in it.
    """
    parts = _cleaned(pages, "url").withColumn(
        "_around", F.split("clean", r"(?i)<title(?:\s[^<>]*+)?>", 2))
    before = m.flowed_text(F.col("_around")[0])
    rest = F.coalesce(F.get("_around", F.lit(1)), F.lit(""))
    title = m.flowed_text(F.regexp_replace(rest, r"(?is)</title\b.*\z", ""))
    after = m.flowed_text(F.regexp_extract(rest, r"(?is)(</title\b.*)\z", 1))
    texts = parts.select(
        "page_id", "url", m.anchor_array(F.col("clean")).alias("anchors"),
        m.title_array(F.col("clean")).alias("titles"),
        m.abstract_text(F.col("clean")).alias("abstract"),
        before.alias("_before"), title.alias("_title"), after.alias("_after"))
    start = F.length("_before").cast("bigint")
    return texts.select(
        "page_id", "url", "anchors", "titles", "abstract",
        F.concat("_before", "_title", "_after").alias("text"),
        start.alias("title_start"), (start + F.length("_title")).alias("title_end"))


def feature_links(features: DataFrame) -> DataFrame:
    """`links` from features."""
    rows = features.select("page_id", "url", F.posexplode_outer("anchors").alias("ord", "a"))
    return rows.filter(F.col("a").isNotNull()).select(
        "page_id", "url", "ord", F.col("a.href").alias("href"),
        F.col("a.anchor_text").alias("anchor_text"))


def page_documents(pages: DataFrame) -> DataFrame:
    """Pages as documents: doc_id, text, title_start, title_end."""
    return feature_documents(page_features(pages))


def feature_documents(features: DataFrame) -> DataFrame:
    return features.select(F.col("page_id").alias("doc_id"), "text", "title_start", "title_end")
