"""Known URLs by a filter, several levels of sub-pages, hot keys."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from datatrawl.operators import frontier as fr
from datatrawl.operators import links as ln
from datatrawl.operators import url_filter as uf
from datatrawl.sources import search as se

FRONTIER = "parent_url string, url string, source string, from_queue boolean"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_filter_has_no_false_misses_and_few_false_hits(spark):
    urls = spark.range(4000).select(F.concat(F.lit("http://h/"), "id").alias("url"))
    parts = [uf.build_filter(urls.filter(F.col("url").endswith(e) == k), words=1 << 12) for e, k in (("7", True), ("7", False))]
    whole = uf.merge_filters(parts[0].unionByName(parts[1]))
    assert sorted(whole.collect()) == sorted(uf.build_filter(urls, words=1 << 12).collect()) and whole.count() <= 1 << 12
    assert uf.with_maybe(urls, whole, words=1 << 12).filter("not _maybe").count() == 0
    others = urls.select(F.concat("url", F.lit("x")).alias("url"))
    assert uf.with_maybe(others, whole, words=1 << 12).filter("_maybe").count() < 200


def test_known_urls_by_filter_are_the_same_and_only_possible_ones_meet_the_table(spark):
    frontier = spark.range(300).select(F.lit(None).cast("string").alias("parent_url"), F.when(
        F.col("id") % 50 != 49, F.concat(F.lit("http://h/"), F.col("id") % 120)).alias("url"), F.lit("s").alias("source"), F.lit(True).alias("from_queue"))
    stored = spark.range(60).select(F.concat(F.lit("http://h/"), F.col("id") * 3).alias("url"))
    filtered = fr.known_urls_anti(frontier, stored, uf.build_filter(stored))
    want = fr.known_urls_anti(frontier, stored)
    assert sorted(map(str, filtered.collect())) == sorted(map(str, want.collect()))
    text = plan(filtered)
    # The join with the table stands on the rows that the filter lets through.
    anti = text[:text.index("LeftAnti")]
    assert "coalesce(" in text and "LeftAnti" in text and "BroadcastHashJoin LeftOuter" in anti + text


def pages(spark, links):
    rows = [(i, url, "") for i, url in enumerate(links)]
    hrefs = [(i, url, h) for i, url in enumerate(links) for h in links[url]]
    return (spark.createDataFrame(rows, "page_id long, url string, html string"),
            spark.createDataFrame(hrefs, "page_id long, url string, href string"))


def test_levels_follow_links_once(spark):
    table, links = pages(spark, {
        "http://h/": ["/a", "/b", "http://o/x"], "http://h/a": ["/c", "/"], "http://h/b": ["/c", "/a"], "http://h/c": ["d", "/b"],
        "http://h/d": ["/e"], "http://h/e": [], "http://o/x": ["/y"], "http://o/y": []})
    seeds = table.filter("page_id in (0, 6)").select(F.lit(None).cast("string").alias("parent_url"), "url", F.lit("s").alias("source"),
                                                     F.lit(True).alias("from_queue"), "page_id")
    levels = {(r.parent_url, r.url): r.level for r in fr.expand(seeds, links, table, depth=10).collect()}
    assert levels == {("http://h/", f"http://h/{p}"): n for p, n in (("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 4))} | {
        ("http://o/x", "http://o/y"): 1}
    one = fr.expand(seeds, links, table, depth=1).drop("level")
    assert sorted(map(str, one.collect())) == sorted(map(str, fr.expand_one_hop(seeds, links, table).collect()))
    assert fr.expand(seeds.limit(0), links, table, depth=3).count() == 0


SKEW = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2000", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}


@pytest.fixture
def skewed(spark):
    old = {k: spark.conf.get(k, None) for k in SKEW}
    for k, v in SKEW.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def hot(spark):
    """A third of the rows have one target; rows come from several tasks, as a split needs."""
    n = F.col("id")
    return spark.range(0, 6000, 1, 8).select(
        n.alias("page_id"), F.concat(F.lit("http://h/p"), n).alias("url"), F.lit("metadata").alias("anchor_text"), F.lit(0).alias("ord"),
        F.when(n % 3 == 0, "http://h/hot.zip.x").otherwise(F.concat(F.lit("http://h/t"), n, F.lit(".zip.x"))).alias("href"))


def test_a_hot_key_is_split(skewed):
    spark, rows = skewed, hot(skewed)
    targets = rows.select(F.col("href").alias("url")).distinct()
    probes = targets.withColumn("content_type", F.lit("application/zip"))
    frontier = rows.select(F.lit(None).cast("string").alias("parent_url"), F.col("href").alias("url"), F.lit("s").alias("source"),
                           F.lit(True).alias("from_queue"))
    moved = targets.withColumn("location", F.concat("url", F.lit("/")))
    for name, df, n in (
            ("expand_urls", se.expand_urls(frontier, moved), 6000), ("download_links", ln.download_links(rows, _written(probes)), 6000),
            ("metadata_page", ln.metadata_page(rows, _written(targets.withColumn("content_type", F.lit("text/xml")))), 6000)):
        assert len(df.collect()) == n, name
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString(), name


def _written(df):
    from datatrawl.session import stage

    return stage(df)


def test_rows_without_a_page_are_spread(spark):
    frontier = spark.range(0, 3000, 1, 4).select(F.lit(None).cast("string").alias("parent_url"), F.concat(F.lit("http://h/"), "id").alias("url"),
                                                 F.lit("s").alias("source"), F.lit(True).alias("from_queue"))
    table = spark.createDataFrame([(0, "http://h/0"), (1, "http://h/1")], "page_id long, url string")
    downloads = spark.createDataFrame([(1, "http://h/f.zip")], "page_id long, url string")
    routed = fr.route(frontier, frontier.limit(0), table, downloads)
    assert {r.outcome: r["count"] for r in routed.groupBy("outcome").count().collect()} == {"unfetchable": 2998, "expand": 1, "store": 1}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "hashpartitioning(page_id" in plan(routed) and "_spread" in plan(routed)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
