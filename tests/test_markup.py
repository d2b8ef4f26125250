from datatrawl.operators import markup as mk
from datatrawl.operators import tree as tr


def pages(spark, *htmls):
    return spark.createDataFrame(
        [(i, f"http://h/a/{i}", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_title_cap_and_default(spark):
    heads = "".join(f"<h1 class='x'>t{i}</h1>" for i in range(8))
    rows = mk.titles(pages(spark, heads, "<p>no head", "<TITLE>a &amp; <i>b</i></TITLE><h1>a & b</h1>")).collect()
    got = {}
    for r in rows:
        got.setdefault(r.page_id, []).append(r.title)
    assert got == {0: [f"t{i}" for i in range(6)], 1: ["none"], 2: ["a & b"]}


def test_abstract_is_the_first_long_enough(spark):
    html = f"<p>{'a' * 149}</p><p class=x>{'b' * 150}</p><p>{'c' * 400}"
    rows = mk.abstracts(pages(spark, html, "<p>short", "nothing", f"<pre>{'x' * 200}</pre>")).collect()
    assert [r.abstract for r in sorted(rows)] == ["b" * 150, "None found", "None found", "None found"]


def test_links_and_quotes(spark):
    html = """<script>var a='<a href="/s">s</a>';</script><!-- <a href="/c">c</a> -->
      <a class="a>b" href='/one'>One <b>1</b></a><A HREF=/two>Two</A><a name="x">No</a>
      <a data-href="/no" title="href='/no'" href="/three?a=1&amp;b=2">Three"""
    rows = sorted(mk.links(pages(spark, html)).select("ord", "href", "anchor_text").collect())
    assert [(r.ord, r.href, r.anchor_text.strip()) for r in rows] == [
        (0, "/one", "One 1"), (1, "/two", "Two"), (2, "/three?a=1&b=2", "Three")]


def test_a_tag_with_very_many_attributes(spark):
    html = "<a " + " ".join(f"x{i}='y'" for i in range(30000)) + " href='/z'>z</a>"
    assert mk.links(pages(spark, html)).first().href == "/z"


def test_nodes_are_numbered_in_order(spark):
    rows = sorted(mk.html_nodes(pages(spark, '<P ID="a" id="b"><br/><img src=x.png></p>')).collect())
    assert [(r.node_id, r.tag, r.attrs) for r in rows] == [
        (0, "p", {"id": "a"}), (1, "br", {}), (2, "img", {"src": "x.png"})]


def test_tree_recovers_and_finds_words(spark):
    html = "<ul><li>one<li><a href='/m'>Meta<b>data</b></a></ul><p>x<div>METADATA</div><p>y"
    nodes = tr.html_tree(pages(spark, html)).cache()
    tags = {r.node_id: (r.tag, r.parent_id, r.last_id) for r in nodes.collect()}
    assert tags == {0: ("#root", None, 8), 1: ("ul", 0, 5), 2: ("li", 1, 2), 3: ("li", 1, 5),
                    4: ("a", 3, 5), 5: ("b", 4, 5), 6: ("p", 0, 6), 7: ("div", 0, 7), 8: ("p", 0, 8)}
    found = {r.node_id for r in tr.nodes_containing(nodes, "metadata").collect()}
    assert found == {1, 3, 4, 7}
    links = nodes.filter("tag = 'a'")
    members = {r.member_id for r in tr.scope_nodes(nodes, links).collect()}
    assert members == {1, 2, 3, 4, 5}


def test_title_span_points_into_the_text(spark):
    html = "<html><head><meta x><title>Big <i>Data</i></title></head><body>Hello<br>you</body>"
    d = mk.page_documents(pages(spark, html, "<p>no title")).orderBy("doc_id").collect()
    assert d[0].text[d[0].title_start:d[0].title_end].split() == ["Big", "Data"]
    assert d[0].text.split() == ["Big", "Data", "Hello", "you"]
    assert d[1].title_start == d[1].title_end
