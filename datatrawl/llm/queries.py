"""One query for each corpus operator, with production parameters over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datatrawl.llm import (
    decontamination, html_text, jaccard, language, licenses, packing, periods, prefix_trie, quality, tokens,
    topk, toxicity, vectors)
from datatrawl.llm.common import read_table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_sequences(read_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read_table(spark, sf_dir, "labels")))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_text.extract(pages, html_text.fit_sample(pages))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(read_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, F.col("id") % 50 == 0)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(read_table(spark, sf_dir, "documents")))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.contamination(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(read_table(spark, sf_dir, "conversations"))


def op12_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periods.with_planted_runs(read_table(spark, sf_dir, "documents"))
    return periods.digest(periods.periodic_runs(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_tokens": op5_tokens,
    "op6_html_text": op6_html_text,
    "op7_jaccard": op7_jaccard,
    "op8_topk": op8_topk,
    "op9_licenses": op9_licenses,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_near_vectors": op12_near_vectors,
    "op13_runs": op13_runs,
}

ORACLES: dict[str, str] = {
    "op7_jaccard": jaccard.ORACLE,
    "op8_topk": topk.ORACLE,
    "op10_decontamination": decontamination.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_near_vectors": vectors.ORACLE,
}
