import random
import re

import pytest

from datatrawl.functions.html_tree import tree_rows
from datatrawl.operators import links as ln
from datatrawl.operators import metadata as md
from datatrawl.operators.tree import html_tree


def starts(spark, *ids):
    df = spark.createDataFrame([(1, i) for i in ids], "doc_id int, id int")
    return sorted(r.id for r in md.spatial_groups(df).collect())


@pytest.mark.parametrize("ids, expected", [
    ((3, 4, 5, 6, 45, 46, 47, 48, 53), [3, 45]), ((3, 4, 5, 6, 7, 8), [3, 4, 5]),
    ((2, 4, 6, 8), [2]), ((3, 4, 5), []), ((1, 2, 3, 5), [])])
def test_spatial_groups(spark, ids, expected):
    assert starts(spark, *ids) == expected


def test_extent_reads_wrapped_values(spark):
    xml = """<?xml version="1.0"?><m><!-- <north>1</north> --><westB><v>1</v></westB>
      <eastB>\n<v>2.5</v>\n</eastB><southB><v>-3</v></southB><northB><v>4</v><n/></northB>
      <north><v>5</v><v>6</v></north></m>"""
    docs = spark.createDataFrame([("u", xml), ("v", "<west>1</west>"), ("w", "")], "url string, xml string")
    assert [tuple(r) for r in md.spatial_extent(docs).collect()] == [
        ("u", "westB: 1;eastB: 2.5;southB: -3;northB: 4")]


def name_of(href):
    match = re.search(r"(?s)^.*/(.*)$", href)
    return None if match is None else match.group(1).split(".")[0].lower()


def expected_metadata(rows, url):
    """The same by loops over one page."""
    text = rows[0][8]
    nodes = {r[1]: r for r in rows}

    def speaks(n):
        return "metadata" in text[nodes[n][6]:nodes[n][7]].lower()

    def pick(element):
        scope = element
        for _ in range(2):
            parent = nodes[scope][2]
            scope = scope if parent is None else parent
        found = None
        for link in range(scope, nodes[scope][3] + 1):
            if "href" not in nodes[link][5]:
                continue
            named = [n for n in range(link, nodes[link][3] + 1) if n and speaks(n)]
            if len(named) == 1:
                found = nodes[named[0]][5].get("href", "")
                continue
            wanted = name_of(nodes[element][5]["href"])
            if wanted is None:
                raise LookupError
            for n in named:
                name = name_of(nodes[n][5].get("href", ""))
                if name is None:
                    raise LookupError
                if name == wanted:
                    found = nodes[n][5].get("href", "")
                    break
        return found

    for n in nodes:
        if nodes[n][5].get("href") == url:
            try:
                found = pick(n)
            except LookupError:
                return None
            if found is not None:
                return found
    return None


def random_page(rng):
    urls = ["http://h/a.zip", "http://h/B.zip", "c.zip", "http://h/d"]
    parts = []
    for _ in range(rng.randrange(3, 25)):
        parts.append(rng.choice([
            "<ul>", "</ul>", "<li>", "<div>", "</div>", "<p>", "<b>metadata</b>", "text",
            f'<a href="{rng.choice(urls)}">get</a>', f'<a href="{rng.choice(urls)}">Metadata</a>',
            '<a href="/m/a.xml">metadata <i>x</i></a>', '<a href="m.xml">Meta<i>data</i></a>',
            '<a href="/m/b.xml"><i>MetaData</i></a>', '<span href="/m/d.txt"><a href="/s">metadata</a>']))
    return "".join(parts)


def test_link_metadata_against_loops(spark):
    rng = random.Random(11)
    pages = [(i, f"http://h/x/{i}", random_page(rng)) for i in range(150)]
    urls = ["http://h/a.zip", "http://h/B.zip", "c.zip", "http://h/d"]
    downloads = spark.createDataFrame([(i, u) for i, _, _ in pages for u in urls],
                                      "page_id long, url string")
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {(r.page_id, r.url): r.metadata_url
           for r in md.link_metadata(downloads, html_tree(df), df).collect()}
    want = {}
    for page_id, _, html in pages:
        rows = list(tree_rows(page_id, html))
        for url in urls:
            want[page_id, url] = expected_metadata(rows, url)
    assert got == want
    assert len({v for v in want.values() if v}) > 4


def test_save_metadata_lines(spark):
    links = spark.createDataFrame(
        [("http://h/a.zip", "m"), ("http://h/b.zip", None), ("http://h/c.zip", "gone")],
        "url string, metadata_url string")
    docs = spark.createDataFrame([("m", "one\r\ntwo\n\nfour\n")], "url string, xml string")
    rows = sorted(md.save_metadata(links, docs).collect())
    assert [(r.line_no, r.line) for r in rows] == [(1, "one"), (2, "two"), (3, ""), (4, "four")]
    assert re.fullmatch(r"[0-9A-F]{40}_a\.txt", rows[0].file_name)


def test_download_links(spark):
    links = spark.createDataFrame(
        [(1, "http://h/p/q", h) for h in ("X.ZIP", "X.ZIP?a=1", "x.zip?a=1", "x.zip?b=1", "x.tar?c", "foo:y.zip")],
        "page_id int, url string, href string")
    probes = spark.createDataFrame(
        [("http://h/x.zip?a=1", "application/zip"), ("http://h/X.ZIP?a=1", "application/zip"),
         ("http://h/x.zip?b=1", "application/zip; charset=binary")], "url string, content_type string")
    assert {r.url for r in ln.download_links(links, probes).collect()} == {
        "http://h/X.ZIP", "http://h/x.zip?a=1"}


def test_metadata_page_is_the_first_that_is_xml(spark):
    links = spark.createDataFrame(
        [(1, "http://h/p", 0, "/a", "Metadata"), (1, "http://h/p", 1, "b", "xml"),
         (1, "http://h/p", 2, "/c", "The METADATA"), (1, "http://h/p", 3, "/d", "metadata")],
        "page_id int, url string, ord int, href string, anchor_text string")
    probes = spark.createDataFrame(
        [("http://h/a", "text/html"), ("b", "text/xml"), ("http://h/c", "application/xml"),
         ("http://h/d", "text/xml")], "url string, content_type string")
    assert [tuple(r) for r in ln.metadata_page(links, probes).collect()] == [(1, "http://h/c")]
