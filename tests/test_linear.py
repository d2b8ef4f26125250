"""Work on one page or text grows with its size, not faster."""

import time

import pytest
from pyspark.sql import functions as F

from datatrawl.functions.html_tree import tree_rows
from datatrawl.functions.markup import attribute_map
from datatrawl.operators import markup as mk
from datatrawl.operators import text as tx

PAGES = {
    "open brackets": lambda n: "<" * n,
    "unclosed scripts": lambda n: "<script>" * (n // 8),
    "unclosed comments": lambda n: "<!--" * (n // 4),
    "tags that never end": lambda n: "<p <a <title " * (n // 13),
}


def seconds(run):
    best = 1e9
    for _ in range(2):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return best


def grows_in_proportion(run_of, n):
    """Twice the size takes at most 2.5 times as long; small times tell nothing."""
    once, twice = seconds(run_of(n)), seconds(run_of(2 * n))
    return twice <= 2.5 * once + 0.5


@pytest.mark.parametrize("kind", list(PAGES))
def test_pages(spark, kind):
    def run_of(n):
        page = spark.createDataFrame([(1, "http://h/a", PAGES[kind](n))], "page_id long, url string, html string")
        return lambda: mk.page_features(page).collect()

    assert grows_in_proportion(run_of, 1_000_000)


def test_open_elements():
    def run_of(n):
        return lambda: list(tree_rows(1, "<ul>" + "<b>" * n + "</i>" * n + "<li></li>" * n))

    assert grows_in_proportion(run_of, 50_000)


def test_names_in_one_text(spark):
    def run_of(n):
        df = spark.createDataFrame([(1, "seen by Acme Data Inc here. " * n)], "doc_id long, text string")
        return lambda: tx.suffix_organizations(df).agg(F.count("*"), F.max("end")).collect()

    assert grows_in_proportion(run_of, 100_000)


def test_one_very_long_name(spark):
    text = "One " * 200_000 + "University"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tx.suffix_organizations(df).first().text == text


def test_words_in_one_text(spark):
    def run_of(n):
        df = spark.createDataFrame([(1, "word " * n)], "doc_id long, text string")
        return lambda: tx.tokens(df).agg(F.count("*"), F.max("end")).collect()

    assert grows_in_proportion(run_of, 300_000)


def test_attributes(spark):
    def run_of(n):
        tag = "<a " + " ".join(f"x{i}='y' x{i}='z'" for i in range(n)) + ">"
        df = spark.createDataFrame([(tag,)], "tag string")
        return lambda: df.select(F.size(attribute_map(F.col("tag")))).collect()

    assert grows_in_proportion(run_of, 50_000)


def test_roots_cost_little_beside_the_words_themselves(spark):
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    docs = spark.range(0, 2_000, 1, 4).select(F.col("id").alias("doc_id"), F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(word, F.lit("ings"))), " ").alias("text"))
    lemmas = spark.createDataFrame([("created", "create")], "form string, root string")
    count = lambda df: seconds(lambda: df.agg(*(F.max(c) for c in df.columns)).collect())
    words = count(tx.tokens(docs))
    roots = count(tx.token_roots(tx.tokens(docs), lemmas))
    assert roots <= 3 * words + 2
