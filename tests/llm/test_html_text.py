import html
import itertools
import re
import time

import numpy as np
import pytest

from datatrawl.llm import html_text as H
from datatrawl.llm.common import read_table
from datatrawl.llm.dom import TEXT, parse

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return H.fit_sample(read_table(spark, SF, "pages"))


def article(page):
    inside = re.search(r"(?s)<article>(.*?)</article>", page or "")
    if not inside:
        return ""
    plain = re.sub(r"</?b>", "", inside[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", plain)).split())


def test_articles_of_all_pages(spark, model):
    pages = read_table(spark, SF, "pages")
    got = {r.page_id: r for r in H.extract(pages, model).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == article(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


def test_pages_without_telling_tags(model):
    words = "This is a sentence of the text, and it goes on for a while with more words in it. "
    page = (f"<div class=menu><a href=/>Home</a> <a href=/a>About us</a></div><div class=content><h2>A title</h2><p>{words}"
            f"<p>{words}<ul><li>{words}</ul></div><div id='sidebar'><a href=x>Other posts</a></div>"
            "<form>Your name <input> <button>Send</button></form>"
            f"<div class='comments'><p>{words}</p></div><footer>(c) us</footer>")
    got = model.main_texts([page])[0]
    assert got == " ".join(f"A title {words * 3}".split())


def test_linked_text_of_an_article_stays(model):
    nav = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"
    words = "A sentence of the article that goes on for some more words, as they do."
    inside = {
        "an inline link": f"<p>{words} See <a href=x>this</a> and more text.</p>",
        "a paragraph that is a link": f"<p>{words}</p><p><a href=x>The whole of this paragraph</a></p><p>{words}</p>",
        "a linked item": f"<p>{words}</p><ul><li><a href=x>first item</a></li><li>second item</li></ul>",
        "many short links": "<p>" + " ".join(f"<a href=x{i}>word{i}</a> then" for i in range(20)) + "</p>",
        "more link than text": f"<p><a href=x>{words} {words}</a></p><p>{words}</p><p><a href=y>{words}</a></p>",
    }
    for name, part in inside.items():
        for page in (f"<html><body>{nav}<article><h1>A title</h1>{part}</article><footer><a href=/c>Contact</a> (c) us</footer></body></html>",
                     f"<html><body>{nav}<main>{part}</main><section class='discussion'><p>{words}</p></section></body></html>"):
            want = ("A title " if "<h1>" in page else "") + " ".join(re.sub(r"</?(?:a[^>]*)>", "", part).replace("<", " <").split())
            want = " ".join(re.sub(r"<[^>]*>", " ", want).split())
            assert model.main_texts([page])[0] == want, name


def test_marginals_by_enumeration(model):
    dom = parse("<div><p>Some text here<a href=x>link</a></p><nav>menu</nav></div><p>more words, and more</p>")
    f = H.forest([dom])
    own = np.where(f.follows, 0, model.weights[f.features].sum(1))
    n = len(f.parent)
    total = np.zeros((n, 2))
    for state in itertools.product((0, 1), repeat=n):
        e = sum(own[k] * s for k, s in enumerate(state))
        e += sum(model.pairs[f.kind[k]][state[f.parent[k]], state[k]] for k in range(1, n))
        for k, s in enumerate(state):
            total[k, s] += np.exp(e)
    assert np.allclose(model.infer(f)[0], total / total.sum(1, keepdims=True))


def test_sample_is_bounded_whatever_the_keys(spark, monkeypatch):
    monkeypatch.setattr(H, "fit", list)
    rows = [(None, f"<p>{k}</p>") for k in range(4000)] + [(9, "<p>always the same</p>")] * 2000
    rows += [(8, f"<b>{k}</b>") for k in range(2000)]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(6)
    got = H.fit_sample(pages, sample_pages=300)
    assert 200 < len(got) < 400 and len(set(got)) == len(got)
    assert any("<b>" in p for p in got) and any("<p>" in p for p in got)


def test_reader():
    dom = parse('<p title="a>b">x &eacute;<p>y<br>z<script>if (a<b) "</p>"</script></i><ul><li>1<li>2</ul><!-- <b>no</b> -->&lt;')
    assert [t for t in dom.text if t] == ["x é", "y", "z", "1", "2", "<"]
    assert dom.parent[dom.text.index("2")] != dom.parent[dom.text.index("1")]
    assert [dom.tag[k] for k in range(len(dom.tag)) if dom.tag[k] != TEXT] == ["#page", "p", "p", "br", "script", "ul", "li", "li"]


@pytest.mark.parametrize("tag", [
    "<svg viewBox='0 0 1 1'/>", "<svg><title/><path d=x /><style>a</svg>", "<svg><title>Icon</title><text>no</text></svg>", "<svg><g>",
    "<math/>", "<select><option>no<option>no", "<select name=a><option>no</option></select>", "<object data=x>",
    "<object data=x><p>no</p></object>", "<noscript><img src=x>", "<noscript><p>no</p></noscript>", "<template>",
    "<template><div>no</div><ul><li>no</ul></template>", "<object/>", "<script>no</script>", "<textarea>no</textarea>",
    "<iframe src=x>no</iframe>"])
@pytest.mark.parametrize("outside", [False, True])
def test_only_what_is_in_hidden_elements_is_left_out(model, tag, outside):
    one, two = "This is a sentence of the text.", "And this one comes after it, with more words in it."
    inner = "" if outside else tag
    page = f"<body>{tag if outside else ''}<article><p>{one}</p>{inner}<p>{two}</p></article><p><svg><g/></svg></p></body>"
    assert model.main_texts([page]) == [f"{one} {two}"]


def test_formulas_are_kept(model):
    formula = "<math><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mn>4</mn></mrow></math>"
    assert model.main_texts([f"<article><p>It holds that {formula} here.</p></article>"]) == ["It holds that x2=4 here."]
    assert [t for t in parse("<p>a <object>b<p>c</object> d").text if t] == ["a ", " d"]


@pytest.mark.parametrize("page", ["<svg>" * 30_000 + "<p>", "<math><mi>" * 20_000 + "<p>x", "<object><p>" * 20_000, "<select>" * 30_000,
                                  "<p><noscript>" + "<div>" * 30_000, "<svg><foreignObject>" * 10_000 + "<p>x" * 10_000])
def test_odd_hidden_elements_end_soon(page):
    start = time.process_time()
    parse(page)
    assert time.process_time() - start < 20


@pytest.mark.parametrize("page", ["<" * 200_000, "<b>" * 20_000 + "</i>" * 20_000, '<a href="' * 30_000, "<!--" * 50_000,
                                  "<script>" * 30_000, "<p>x" * 30_000, "<a '" * 30_000 + '"', "</p" * 50_000])
def test_odd_pages_end_soon(model, page):
    start = time.process_time()
    model.main_texts([page])
    assert time.process_time() - start < 20


def test_odd_rows(spark, model):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "   "), (4, None, "plain text of some length, without any tag at all"),
            (4, None, "plain text of some length, without any tag at all"), (None, "u", "<article>a &amp; b <b>c</b>d</article>")]
    from pyspark.sql import functions as F

    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(3)).withColumn("text", F.lit("t"))
    got = sorted((str(r.page_id), r.text) for r in H.extract(pages, model).collect())
    plain = "plain text of some length, without any tag at all"
    assert got == [("1", ""), ("2", ""), ("3", ""), ("4", plain), ("4", plain), ("None", "a & b cd")]
    assert H.extract(pages.limit(0), model).count() == 0
    assert H.fit_sample(pages.limit(0)).main_texts(["<article>x</article>"]) == ["x"]
