import numpy as np
import pyarrow as pa
import pytest

from datatrawl.llm import language, quality, toxicity
from datatrawl.llm import transducers as W
from datatrawl.llm.bytenet import ByteNet, Shape, repeat_flags, text_windows
from datatrawl.llm.common import read_table
from tests.llm import odd

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return read_table(spark, SF, "documents"), read_table(spark, SF, "labels")


def test_gradients_agree_with_differences():
    shape = Shape(window=12, widths=(2, 3), filters=3, stride=2, embed=4, flags=1, classes=3)
    net = ByteNet(shape)
    rng = np.random.default_rng(1)
    x, flags = rng.integers(0, 257, (7, 12)).astype(np.int16), rng.random((7, 12, 1)).astype(np.float32)
    owner, target = np.array([0, 0, 1, 2, 2, 2, 3]), np.array([0, 2, 1, 1])
    net.params = {k: v.astype(np.float64) for k, v in net.params.items()}
    grads = net._gradients(x, flags, owner, target)

    def loss():
        pooled = np.maximum.reduceat(net.pool(x, flags).astype(np.float64), [0, 2, 3, 6], axis=0)
        z = net.logits(pooled)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(4), target]))

    for name, value in net.params.items():
        for at in np.argwhere(np.abs(grads[name]) > 1e-3)[:6]:
            at, step = tuple(at), 1e-3
            value[at] += step
            up = loss()
            value[at] -= 2 * step
            down = loss()
            value[at] += step
            assert (up - down) / (2 * step) == pytest.approx(grads[name][at], rel=0.05, abs=2e-3)


def test_windows_cover_every_byte():
    texts = ["", "abc", "x" * 10, "é" * 9]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    rows, owner, _ = text_windows(data, offsets, 4, 3)
    for i, t in enumerate(texts):
        held = rows[owner == i]
        built = list(held[0]) + [b for r in held[1:] for b in r[1:]]
        assert bytes(b for b in built if b < 256) == t.encode()


def test_flags_of_repeated_words():
    texts = ["ab ab cd", "", "x x", "cd cd\ncd ef", "cd"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = "".join(str(int(f)) for f in repeat_flags(data, offsets))
    assert got == "00011000" + "001" + "00011011000" + "00"


def test_language_on_held_out_documents(tables):
    docs, _ = tables
    model = language.fit(docs)
    found = language.identify(docs, model).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = found[found.held_out & found.lang.notna()]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert found.score.between(0, 1).all()


def test_language_of_odd_rows(spark, tables):
    model = language.fit(tables[0])
    got = language.identify(odd.documents(spark, odd.ROWS), model).collect()
    und = {1, 2, 3, 10}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == und and len(got) == len(odd.ROWS)
    none = language.fit(tables[0].limit(0))
    assert {r.lang_pred for r in language.identify(odd.documents(spark, odd.ROWS), none).collect()} == {"und"}
    assert language.identify(odd.documents(spark, odd.ROWS).limit(0), model).count() == 0


def test_one_language(spark):
    docs = spark.createDataFrame([(k, f"text {k}", "en") for k in range(20)] + [(30, "...", None)],
                                 "doc_id long, text string, lang string")
    got = language.identify(docs, language.fit(docs)).collect()
    assert {(r.lang_pred, r.score) for r in got if r.doc_id < 30} == {("en", 1.0)}
    assert [(r.lang_pred, r.score) for r in got if r.doc_id == 30] == [("und", 0.0)]


def test_language_sample_is_bounded_whatever_the_keys(spark, monkeypatch):
    rows = [(None, f"{k} mot {k * 7} un {k}", "fr") for k in range(6000)]
    rows += [(77, f"{k} word {k * 3} one {k}", "en") for k in range(3000)] + [(5, "always the same", "en")] * 3000
    trained = []
    monkeypatch.setattr(ByteNet, "train", lambda self, x, group, target, **_: trained.append(np.bincount(target)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(6)
    language.fit(docs, sample_docs=200)
    assert all(120 < n < 280 for n in trained[0]) and len(trained[0]) == 2


def test_quality_on_held_out_documents(spark, tables):
    docs, labels = tables
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.quality == held.predicted).mean() > 0.95
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).filter("score >= 0.5").collect()}
    got = quality.score(odd.documents(spark, odd.ROWS), model).collect()
    assert len(got) == len(odd.ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in quality.keep_good(odd.documents(spark, odd.ROWS), model, least=0.0).collect()} == {
        d for d, _ in odd.ROWS}
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).filter("score <> 0.5").count() == 0
    assert quality.score(odd.documents(spark, odd.ROWS).limit(0), model).count() == 0


@pytest.fixture(scope="module")
def toxic(tables):
    return toxicity.fit(*tables)


def test_toxicity_on_held_out_documents(tables, toxic):
    docs, labels = tables
    found = toxicity.score(docs, toxic).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.toxic == held.predicted).mean() > 0.95
    assert held[held.toxic == 1].predicted.mean() > 0.7


def test_clauses(toxic):
    score = lambda t: toxic.weigh(t)[0]
    assert score("You are an idiot.") > 0.5 > score("You are not an idiot.")
    assert score("I will kill you") > 0.5 > score("We kill the process.")
    assert score("He said that you are an idiot.") < score("that you are an idiot.")
    assert score("She was fine. Not so. The idiot came.") > score("Not the idiot.")
    assert score("") == score("Nothing of the kind here.") < 0.5
    assert score("an idiotype") < 0.5


def test_toxicity_of_odd_rows(spark, tables, toxic):
    rows = list(odd.ROWS) + [(77, "You idiot! " * 3000)]
    docs = odd.documents(spark, rows)
    got = toxicity.score(docs, toxic).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.predicted} == {77}
    kept = toxicity.keep_clean(docs, toxic)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 1
    assert toxicity.matched_clauses(docs, toxic).count() == 3000
    bare = toxicity.fit(tables[0], tables[1].limit(0))
    assert bare.weigh("You are an idiot.")[0] > 0.5 > bare.weigh("Hello.")[0]
    assert toxicity.score(docs.limit(0), toxic).count() == 0


def test_composition_is_running_one_after_the_other():
    alphabet = "ihwtnro"
    a, b = W.threat_machine(3), W.target_machine(2.0)
    both = W.compose(a, b, alphabet)
    rng = np.random.default_rng(3)
    for _ in range(200):
        word = [alphabet[k] for k in rng.integers(0, 7, 12)]
        first = W.run(a, word)
        second = W.run(b, [s for s, _ in first])
        assert W.run(both, word) == [(s, f * g) for (_, f), (s, g) in zip(first, second)]


def test_learned_stems_ignore_copies(spark):
    rows = [(f"zug {i} qorblam{i} da {i}", 1) for i in range(40)] + [("immer gleich hier", 1)] * 40
    rows += [(f"zug {i} gut da {i}", 0) for i in range(60)]
    learned = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert "qorblam" in learned.stems and not {"immer", "gleich"} & set(learned.words)
