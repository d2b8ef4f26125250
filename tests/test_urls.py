import pytest
from pyspark.sql import functions as F

from datatrawl.functions import numbers
from datatrawl.functions import urls as u
from datatrawl.operators import frontier as fr


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("page, href, expected, standard", [
    ("http://h/a/b/c.html", "x.zip", "http://h/a/x.zip", "http://h/a/b/x.zip"),
    ("http://h/a/b/", "x.zip", "http://h/a/x.zip", "http://h/a/b/x.zip"),
    ("http://h/a/b", "/x", "http://h/x", "http://h/x"),
    ("http://h/a", "x", "http://h/x", "http://h/x"),
    ("http://h/a/b/c", "../x", "http://h/x", "http://h/a/x"),
    ("http://h/a", "../x", "http://h/../x", "http://h/x"),
    ("http://h/a/b/c", "a/./b/../c/", "http://h/a/a/c/", "http://h/a/b/a/c/"),
    ("http://h/a/b/c", "d/..", "http://h/a/", "http://h/a/b/"),
    ("http://h/a/b/c?u=p/q", "x", "http://h/a/b/x", "http://h/a/b/x"),
    ("https://h:8/a/b", "//o/x", "https://o/x", "https://o/x"),
    ("http://h/a/b", " HTTPS://Up/x ", "https://Up/x", "https://Up/x"),
    ("http://h/a/b", "foo:x", None, None),
    ("http://h/a/b", "mailto:a@b", "mailto:a@b", "mailto:a@b"),
    ("http://h/a/b/c", "?q=1#f", "http://h/a/?q=1#f", "http://h/a/b/c?q=1#f"),
    ("http://h/a/b/c", "#f", "http://h/a/b#f", "http://h/a/b/c#f"),
])
def test_resolve(spark, page, href, expected, standard):
    assert one(spark, u.resolve_link(F.col("p"), F.col("h")), p=page, h=href) == expected
    assert one(spark, u.resolve_link(F.col("p"), F.col("h"), True), p=page, h=href) == standard


def test_metadata_link_loses_port(spark):
    got = one(spark, u.resolve_metadata_link(F.col("p"), F.col("h")), p="http://me@h:80/a", h="/m.xml")
    assert got == "http://h/m.xml"


@pytest.mark.parametrize("url, name", [
    ("http://h/a/b.tar.gz", "b"), ("http://h/a/", ""), ("x.zip", None), ("/x", "x")])
def test_name_component(spark, url, name):
    assert one(spark, u.name_component(F.col("v")), v=url) == name


@pytest.mark.parametrize("url, fmt", [
    ("http://h/X.ZIP", "ZIP"), ("http://h/x.zip?a=1", "zip?a=1"), ("nodot", "nodot")])
def test_format(spark, url, fmt):
    assert one(spark, u.link_format(F.col("v")), v=url) == fmt


def test_same_site_is_a_prefix_test_unless_exact(spark):
    df = spark.createDataFrame(
        [("http://h/", "http://h.other/x"), ("http://h/", "http://H/y"), ("http://h/", "https://h/z"),
         ("http://Up/", "http://up/x")], "seed_url string, url string")
    assert {r.url for r in fr.same_site(df).collect()} == {"http://h.other/x", "http://H/y"}
    assert {r.url for r in fr.same_site(df, exact_host=True).collect()} == {"http://H/y", "http://up/x"}


def test_media(spark):
    df = spark.createDataFrame([("http://h/a.JPEG",), ("http://h/a.zip",), ("http://h/a.zip?x",),
                                ("http://h/ajpg",)], "url string")
    assert {r.url for r in fr.not_media(df).collect()} == {"http://h/a.zip?x", "http://h/ajpg"}


@pytest.mark.parametrize("text, ok", [
    ("180.000001", True), ("-180", True), ("180.1", False), (" 12.f\n", True), (".5", True),
    ("5.", True), ("1e2", True), ("1e3", False), ("0x1F", False), ("5L", False), ("NaN", False),
    ("", False), ("+5", False), ("Infinity", False), ("1 2", False)])
def test_coordinate(spark, text, ok):
    assert one(spark, numbers.coordinate(F.col("v")).isNotNull(), v=text) is ok


@pytest.mark.parametrize("line, ok", [
    ("http://h/a b", False), ("http://h/%zz", False), ("http://h/%2f", True), ("h/a", False),
    ("ftp://h/a", True), ("gopher://h/a", False)])
def test_uri(spark, line, ok):
    assert one(spark, u.is_uri(F.col("v")), v=line) is ok


def test_crawl_form(spark):
    rows = spark.createDataFrame([
        ("HTTP://Host:80/Path?q=A#top",), ("https://h.org:443",), ("https://h.org:8443/x#",), ("http://h.org:443/",),
        ("/only/a/path#x",), ("http://h/a",)], "url string")
    assert [r[0] for r in rows.select(u.crawl_form(F.col("url"))).collect()] == [
        "http://host/Path?q=A", "https://h.org", "https://h.org:8443/x", "http://h.org:443/", "/only/a/path", "http://h/a"]
