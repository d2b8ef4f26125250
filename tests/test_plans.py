"""Plans: what is read, what is shuffled, what is joined."""

import contextlib
import io
import re

from pyspark.sql import functions as F

from datatrawl.checks.queries import QUERIES
from datatrawl.operators import markup as mk
from datatrawl.operators import text as tx
from datatrawl.sources.pages import page_scan
from datatrawl.sources.tables import save_bucketed

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def exchanges(df):
    return len(re.findall(r"^\(\d+\) Exchange", plan(df), re.M))


def test_text_and_markup_do_not_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for df in (tx.tokens(docs), tx.sentences(docs), tx.suffix_organizations(docs), mk.links(pages),
               mk.titles(pages), mk.abstracts(pages), mk.html_nodes(pages), mk.page_features(pages)):
        assert exchanges(df) == 0


def test_columns_are_pruned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(tx.tokens(docs))


def test_no_cross_joins(spark):
    for name in ("route", "download_links", "metadata_page", "expand_one_hop", "overlap_join",
                 "assign_link_ids", "link_bridge", "publisher_orgs", "dedupe_batch"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_bucketed_pages_stay_where_they_are(spark, tmp_path):
    pages = save_bucketed(spark.read.parquet(f"{SF}/pages.parquet"), "pages_by_url", "url", 4,
                          str(tmp_path / "pages"))
    frontier = spark.read.parquet(f"{SF}/pages.parquet").select(
        F.lit(None).cast("string").alias("parent_url"), "url")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = page_scan(frontier, pages)
        assert exchanges(joined) == 1
        assert joined.count() == 50
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE pages_by_url")
