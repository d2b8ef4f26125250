"""Scores of the three classifiers against plain loops over the same model."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest

from datatrawl.llm import language, quality, toxicity
from datatrawl.llm.bytenet import PAD, ByteNet, Shape, to_rows

LENGTHS = (0, 1, 7, 255, 256, 257, 511, 512, 513, 991, 992, 993, 2100)


def texts(seed):
    """Texts of given numbers of bytes, or some bytes more, with repeated and accented words."""
    rng = np.random.default_rng(seed)
    words = ["data", "data", "Straße", "the", "été", "x", "\n", "map  map"]
    out = []
    for size in LENGTHS:
        text = ""
        while len(text.encode()) < size:
            text += words[rng.integers(len(words))][:size] + " "
        while len(text.encode()) > size and text and text[-1].isascii():
            text = text[:-1]
        out.append(text)
    return out


def trained(shape, seed):
    """A network whose parameters all have moved from their first values."""
    rng = np.random.default_rng(seed)
    net = ByteNet(shape, seed)
    rows = to_rows([rng.bytes(shape.window) for _ in range(40)], shape.window)
    flags = rng.integers(0, 2, (40, shape.window, 1)).astype(np.float32) if shape.flags else None
    net.train(rows, np.arange(40), rng.integers(0, shape.classes, 40), flags, epochs=2, batch=8)
    return net


def plain_pool(net, data, begin, flags):
    shape, params = net.shape, net.params
    widths = np.repeat(shape.widths, shape.filters)
    best = np.full(shape.features, -np.inf)
    for place in range(0, shape.window, shape.stride):
        answer = np.zeros(shape.features)
        for tap in range(max(shape.widths)):
            at = begin + place + tap
            inside = place + tap < shape.window and at < len(data)
            vector = list(params["embed"][data[at] if inside else PAD])
            if shape.flags:
                vector.append(flags[at] if inside else 0.0)
            rows = params["filter"][tap * len(vector):(tap + 1) * len(vector)]
            answer += np.where(tap < widths, np.array(vector) @ rows, 0)
        best = np.maximum(best, answer)
    return np.maximum(best + params["bias"], 0)


def plain_flags(data):
    flags, before = [0.0] * len(data), None
    for word in re.finditer(rb"[^ \t\n\r]+", data):
        if word.group() == before:
            flags[word.start():word.end()] = [1.0] * len(before)
        before = word.group()
    return flags


def begins(data, window, step):
    out = [0]
    while out[-1] + window < len(data):
        out.append(out[-1] + step)
    return out


def test_quality_as_by_plain_loops(monkeypatch):
    monkeypatch.setattr(quality, "SLICE_BYTES", 900)
    net = trained(quality.SHAPE, 3)
    given = texts(5)
    got = quality.QualityModel(net, 0.5).score(pa.array(given))
    for text, found in zip(given, got):
        data = text.encode()
        flags = plain_flags(data)
        pooled = np.max([plain_pool(net, data, b, flags) for b in begins(
            data, quality.SHAPE.window, quality.STEP)], axis=0)
        low, high = pooled @ net.params["dense"] + net.params["out"]
        assert found == pytest.approx(1 / (1 + math.exp(low - high)), abs=1e-4)


def test_language_as_by_plain_loops(monkeypatch):
    monkeypatch.setattr(language, "SLICE_BYTES", 900)
    net = trained(Shape(classes=3), 4)
    langs, given = ["de", "en", "fr"], texts(6)
    names, scores = language.LanguageModel(langs, net).predict(pa.array(given))
    for text, name, score in zip(given, names, scores):
        data, total = text.encode(), np.zeros(3)
        for b in begins(data, net.shape.window, net.shape.window):
            z = plain_pool(net, data, b, None) @ net.params["dense"] + net.params["out"]
            votes = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
            total += votes * max(1, min(net.shape.window, len(data) - b))
        total /= total.sum()
        assert score == pytest.approx(total.max(), abs=1e-4)
        assert total[langs.index(name)] == pytest.approx(total.max(), abs=1e-4)


MODEL = toxicity.ToxicityModel(
    toxicity.Lexicon({"idiot": 4.0, "scum": 3.0, "trash": 2.5}, {"dumb": 3.5, "dumbhe": 6.0, "vermi": 5.0}),
    (-2.0, 1.0, 0.5, 0.4, 0.1), 0.2, 0.4)
GAP = 4  # words that intent, harm, target and negation reach


def weight_of(word):
    if word in MODEL.lexicon.words:
        return MODEL.lexicon.words[word]
    stems = [s for s in MODEL.lexicon.stems if word.startswith(s)]
    return MODEL.lexicon.stems[min(stems, key=len)] if stems else None


def plain_attacks(words):
    """(kind, weight) of the attacks of a clause, by the rules in words and places."""
    intent = harm = negation = None
    target = report = False
    out = []
    for i, word in enumerate(words):
        near = lambda at: at is not None and i - at <= GAP  # noqa: B023, E731
        weight = weight_of(word)
        kind = next((k for k in ("REPORTS", "NEGATIONS", "TARGETS", "INTENT", "HARM")
                     if weight is None and word in getattr(toxicity, k)), None)
        attack = None
        if kind == "INTENT":
            intent, harm = i, None
        elif kind == "HARM" and near(intent) and not near(harm):
            intent, harm = None, i
        elif kind == "TARGETS" and near(harm):
            harm, attack = None, toxicity.THREAT_WEIGHT
        elif kind == "TARGETS":
            target = True
        elif kind == "NEGATIONS":
            negation = i
        elif kind == "REPORTS":
            report = True
        elif weight is not None:
            attack = weight * (toxicity.TARGET_BONUS if target else 1)
        if attack is not None and near(negation):
            out.append(("N", attack * MODEL.negated))
            negation = None
        elif attack is not None:
            out.append(("R", attack * MODEL.reported) if report else ("A", attack))
    return out


def test_toxicity_as_by_plain_loops():
    rng = np.random.default_rng(8)
    vocabulary = ("idiot scum trash dumb dumbhead vermin idiotype will kill hurt you them not never said the a "
                  "map road idiot Über no_idiot Kill YOU").split()
    some = 0
    for _ in range(1500):
        n = int(rng.integers(0, 40))
        text = "".join(vocabulary[rng.integers(len(vocabulary))] + (" ", " ", " ", ", ", ". ", "\n", "!?")[
            rng.integers(7)] for _ in range(n))
        clauses = [plain_attacks(re.findall(r"\w+", c)) for c in re.split(r"[.!?;:\n]", text.lower())]
        clauses = [c for c in clauses if c]
        number = sum(kind == "A" for c in clauses for kind, _ in c)
        sums = [sum(w for _, w in c) for c in clauses]
        features = (min(max(sums), 2 * toxicity.MOST_WEIGHT), math.log1p(sum(sums)), math.log1p(len(sums)),
                    math.log1p(1000 * number / len(text))) if sums else (0, 0, 0, 0)
        z = MODEL.fit[0] + sum(a * b for a, b in zip(MODEL.fit[1:], features))
        score, found = MODEL.weigh(text)
        assert found == number and score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9), text
        some += bool(sums)
    assert 500 < some
