"""Organizations that publish what a page describes."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl import fixed
from datatrawl.operators import text
from datatrawl.operators.overlap import as_b, overlap_join


def publisher_orgs(sentences: DataFrame, rooted_tokens: DataFrame, orgs: DataFrame,
                   roots: Iterable[str] = fixed.PUBLISH_ROOTS) -> DataFrame:
    """Organizations in sentences with a token of one of the roots: doc_id, author."""
    verbs = rooted_tokens.filter(F.col("root").isin(*roots)).select("doc_id", "start", "end")
    spans = sentences.select("doc_id", "start", "end")
    speaking = overlap_join(verbs, as_b(spans)).select(
        "doc_id", F.col("b_start").alias("start"), F.col("b_end").alias("end")).distinct()
    return overlap_join(speaking, as_b(orgs, "text")).select(
        "doc_id", F.col("b_text").alias("author")).distinct()


def title_orgs(docs: DataFrame, orgs: DataFrame) -> DataFrame:
    """Organizations that overlap the first title: doc_id, author."""
    spans = docs.select("doc_id", F.col("title_start").alias("start"),
                        F.col("title_end").alias("end"))
    return overlap_join(spans, as_b(orgs, "text")).select(
        "doc_id", F.col("b_text").alias("author")).distinct()


def authors(docs: DataFrame, gazetteer: DataFrame, lemmas: DataFrame,
            roots: Iterable[str] = fixed.PUBLISH_ROOTS, include_all: bool = False,
            lengths: list[int] | None = None,
            keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Title organizations, then publishing ones: doc_id, author, rank (0, 1; 2 for all others).

    Only documents in which an organization was found are cut in tokens and sentences. `keep` is
    applied to the organizations, which are used in several places, and may write them.
    """
    orgs = keep(text.organizations(docs, gazetteer, lengths))
    holders = docs.join(orgs.select("doc_id").distinct(), "doc_id", "left_semi")
    roots = list(roots)
    rooted = text.token_roots(text.tokens(holders), lemmas, roots)
    found = title_orgs(docs, orgs).withColumn("rank", F.lit(0)).unionByName(
        publisher_orgs(text.sentences(holders), rooted, orgs, roots).withColumn(
            "rank", F.lit(1)))
    if include_all:
        found = found.unionByName(orgs.select(
            "doc_id", F.col("text").alias("author"), F.lit(2).alias("rank")))
    return found.groupBy("doc_id", "author").agg(F.min("rank").alias("rank"))
