"""Toxicity by a weighted finite-state grammar over clauses.

Insults are known words and stems learned from labels; a clause that holds one, or a word of harm,
is read by the composed grammar of `transducers`. Negated and reported attacks weigh less, aimed
ones more. A logistic fit turns a document's heaviest clause and its attacks into a score.
"""

from __future__ import annotations

import bisect
import functools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm import transducers as W
from datatrawl.llm.common import give_back, held_out, labelled_sample
from datatrawl.llm.tokens import drop_encoders, kept_rows

FOLDS, HELD_OUT = 5, 0
SAMPLE_DOCS = 3000     # labelled documents of each label that stems are learned from, about
LEXICON = 500          # stems kept at most, those with most evidence
STEM_SIZES = (4, 5, 6, 7)
LEAST_EVIDENCE = 30.0  # G-square of a stem
LEAST_WEIGHT = 2.5     # log odds
MOST_WEIGHT = 8.0
KNOWN_WEIGHT = 4.0     # of a known insult that the labels say nothing about
THREAT_WEIGHT = 5.0
TARGET_BONUS = 1.2
NEGATED, REPORTED = 0.1, 0.3   # factors, if the labels say nothing else
# Logistic weights of `features`, if the labels can't give any.
DEFAULT_FIT = (-2.0, 1.0, 0.5, 0.5, 0.0)

# Known words of each class.
INSULTS = ("idiot idiots moron morons loser losers scum clown trash garbage pathetic worthless "
           "disgusting stupid dumb imbecile bastard vermin filth degenerate").split()
HARM = "kill hurt beat destroy shoot stab strangle murder attack smash crush burn".split()
INTENT = "will gonna shall must should going want".split()
TARGETS = "you your yours u he she him her they them these those people everyone all".split()
NEGATIONS = "not no never isn aren wasn don doesn didn nicht kein keine pas jamais nunca".split()
REPORTS = "said says say called quoted wrote claimed alleged reported accused sagte dit dijo".split()

_WORD = re.compile(r"\w+")
_CLAUSE = re.compile(r"[.!?;:\n]")


@dataclass
class Lexicon:
    """`words` maps whole words, `stems` beginnings of words, to weights."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)


@dataclass
class ToxicityModel:
    lexicon: Lexicon
    fit: tuple[float, ...] = DEFAULT_FIT
    negated: float = NEGATED
    reported: float = REPORTED

    @functools.cached_property
    def grammar(self) -> W.Machine:
        return W.clause_grammar(TARGET_BONUS, self.negated, self.reported)

    @functools.cached_property
    def classes(self) -> dict[str, str]:
        known = ((W.REPORT, REPORTS), (W.NEGATION, NEGATIONS), (W.TARGET, TARGETS), (W.INTENT, INTENT),
                 (W.HARM, HARM), (W.INSULT, self.lexicon.words))
        return {w: symbol for symbol, words in known for w in words}

    @functools.cached_property
    def finder(self):
        """Finds the insults and words of harm that make a clause worth reading."""
        import ahocorasick

        found = ahocorasick.Automaton()
        for word in (*self.lexicon.words, *HARM):
            found.add_word(word, (len(word), True))
        for stem in self.lexicon.stems:
            found.add_word(stem, (len(stem), stem in found and found.get(stem)[1] and stem not in self.lexicon.stems))
        found.make_automaton()
        return found

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("finder", "grammar", "classes")}

    def _symbol(self, word: str) -> tuple[str, float]:
        if word in self.lexicon.words:
            return W.INSULT, self.lexicon.words[word]
        for size in self._sizes:
            weight = self.lexicon.stems.get(word[:size])
            if weight is not None:
                return W.INSULT, weight
        return self.classes.get(word, W.OTHER), THREAT_WEIGHT

    @property
    def _sizes(self) -> list[int]:
        return sorted({len(s) for s in self.lexicon.stems})

    def clauses(self, text: str) -> Iterator[tuple[int, int, list[tuple[str, float]]]]:
        """Begin, end and attacks (kind, weight) of each clause of the lower-case `text` with any."""
        bounds, last = None, -1
        for end, (size, whole) in self.finder.iter(text):
            at = end - size + 1
            if at < last or (at and (text[at - 1].isalnum() or text[at - 1] == "_")):
                continue
            if whole and end + 1 < len(text) and (text[end + 1].isalnum() or text[end + 1] == "_"):
                continue
            if bounds is None:
                bounds = [m.start() for m in _CLAUSE.finditer(text)]
            k = bisect.bisect_left(bounds, at)
            begin = bounds[k - 1] + 1 if k else 0
            last = bounds[k] if k < len(bounds) else len(text)
            symbols = [self._symbol(w) for w in _WORD.findall(text, begin, last)]
            attacks = [
                (kind, weight * factor)
                for (kind, factor), (_, weight) in zip(W.run(self.grammar, [s for s, _ in symbols]), symbols)
                if kind in (W.ATTACK, W.NEGATED, W.REPORTED)]
            if attacks:
                yield begin, last, attacks

    def features(self, text: str) -> tuple[tuple[float, ...], int, str]:
        """The document's features, its number of attacks, and their plainest kind ("" if none).

        Features: weight of the heaviest clause, attacks (log), clauses with an attack (log), and
        attacks by the size of the text (log).
        """
        heaviest, number, hit, total, kinds = 0.0, 0, 0, 0.0, set()
        for _, _, attacks in self.clauses(text.lower()):
            weight = sum(w for _, w in attacks)
            heaviest, total, hit = max(heaviest, weight), total + weight, hit + 1
            number += sum(kind == W.ATTACK for kind, _ in attacks)
            kinds.update(kind for kind, _ in attacks)
        if not hit:
            return (0.0, 0.0, 0.0, 0.0), 0, ""
        plainest = next(k for k in (W.ATTACK, W.REPORTED, W.NEGATED) if k in kinds)
        return ((min(heaviest, 2 * MOST_WEIGHT), math.log1p(total), math.log1p(hit),
                 math.log1p(1000 * number / len(text))), number, plainest)

    def weigh(self, text: str) -> tuple[float, int]:
        """Score and number of attacks."""
        features, number, _ = self.features(text)
        z = self.fit[0] + sum(a * b for a, b in zip(self.fit[1:], features))
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z)))), number


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that stand in toxic texts and hardly in others.

    A place counts once for each pair of words around it, so that the words of a copied text don't
    look like a pattern.
    """
    spread = sample.select("toxic", F.split(F.lower("text"), r"[^\p{L}\p{N}_]+").alias("w"))
    spread = spread.select("toxic", "w", F.posexplode("w").alias("at", "word")).filter("word <> ''")
    around = F.xxhash64(F.get("w", F.col("at") - 1), F.lit("/"), F.get("w", F.col("at") + 1))
    # The words of the text end here: with a lambda above, each word would carry all of them.
    spread = spread.select("toxic", "word", around.alias("around"))
    keys = F.array(F.concat(F.lit("="), "word"), *[
        F.when(F.length("word") > n, F.concat(F.lit("^"), F.substring("word", 1, n))) for n in STEM_SIZES])
    places = spread.select("toxic", "around", F.explode(keys).alias("key")).filter("key is not null")
    by_place = places.groupBy("key", "around").agg(F.max("toxic").alias("most"), F.min("toxic").alias("least"))
    counted = by_place.groupBy("key").agg(
        F.sum("most").alias("pos"), F.sum(1 - F.col("least")).alias("neg"))
    totals = {r["toxic"]: r["n"] for r in spread.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p_all, n_all = totals.get(1, 0) + 1.0, totals.get(0, 0) + 1.0
    base = p_all / (p_all + n_all)
    seen = F.col("pos") + F.col("neg")
    rate = F.col("pos") / seen
    evidence = 2 * (F.col("pos") * F.log(rate / base) + F.when(
        F.col("neg") > 0, F.col("neg") * F.log((1 - rate) / (1 - base))).otherwise(0.0))
    weight = F.log((F.col("pos") + 0.5) / p_all) - F.log((F.col("neg") + 0.5) / n_all)
    found = counted.filter("pos >= 4").select("key", "pos", evidence.alias("evidence"), weight.alias("weight")).filter(
        (F.col("evidence") >= LEAST_EVIDENCE) & (F.col("weight") >= LEAST_WEIGHT)
    ).orderBy(F.desc("evidence"), "key").limit(LEXICON).collect()

    rows = {r["key"]: r for r in found}
    text = {k: k[1:] for k in rows}
    # Of beginnings that mean the same places, the longest; of nested ones, the shortest.
    longest = [k for k in rows if k[0] == "=" or not any(
        text[q].startswith(text[k]) and q != k and rows[q]["pos"] >= 0.9 * rows[k]["pos"] for q in rows)]
    stems = [k for k in longest if k[0] == "^"]
    kept = [k for k in longest if not any(text[k].startswith(text[s]) and s != k for s in stems)]
    out = Lexicon()
    for k in kept:
        w = min(MOST_WEIGHT, rows[k]["weight"])
        (out.words if k[0] == "=" else out.stems)[text[k]] = w
    return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> ToxicityModel:
    """Learns stems, the prior, and how much negation and reporting take away.

    Without rows of both labels the known words are all there is.
    """
    known = {w: KNOWN_WEIGHT for w in INSULTS}
    sample, counts = labelled_sample(docs, labels, doc_id, text, label, sample_docs, FOLDS, HELD_OUT)
    if sample is None:
        return ToxicityModel(Lexicon(known))
    sample = sample.withColumnRenamed("label", "toxic")
    share = (counts[1] + 1) / (sum(counts.values()) + 10)
    learned = learn_lexicon(sample)
    model = ToxicityModel(Lexicon({**known, **learned.words}, learned.stems))
    seen: dict[str, list[int]] = {}
    for kind, _, toxic in _examine(sample, model):
        n = seen.setdefault(kind, [0, 0])
        n[0] += 1
        n[1] += toxic
    factors = {W.NEGATED: NEGATED, W.REPORTED: REPORTED}
    for kind, least in factors.items():
        n, toxic = seen.get(kind, (0, 0))
        # Five clean documents are assumed beforehand.
        rate = (toxic + 0.5) / (n + 5.5)
        factors[kind] = min(1.0, max(least, (math.log(rate / (1 - rate)) + 2.5) / KNOWN_WEIGHT))
    model = ToxicityModel(model.lexicon, DEFAULT_FIT, factors[W.NEGATED], factors[W.REPORTED])
    rows = _examine(sample, model)
    x = np.array([f for _, f, _ in rows], float).reshape(len(rows), -1)
    return ToxicityModel(model.lexicon, logistic(x, np.array([t for *_, t in rows]), share),
                         model.negated, model.reported)


def _examine(sample: DataFrame, model: ToxicityModel) -> list[tuple[str, tuple[float, ...], int]]:
    """Kind, features and label of each sampled document: a few numbers for each."""

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[2] for f in found], pa.string()),
                 pa.array([list(f[0]) for f in found], pa.list_(pa.float64())), batch.column("toxic")],
                ["kind", "features", "toxic"])

    rows = sample.mapInArrow(examine, "kind string, features array<double>, toxic int").collect()
    return sorted((r["kind"], tuple(r["features"]), r["toxic"]) for r in rows)


def logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 0.3) -> tuple[float, ...]:
    """Intercept and weights by Newton's method, for a population in which `share` has label 1."""
    scale = x.std(0) + 1e-9
    one = np.column_stack([np.ones(len(x)), x / scale])
    w = np.zeros(one.shape[1])
    penalty = np.diag([1e-6] + [ridge] * x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(one @ w, -30, 30)))
        hessian = (one * (p * (1 - p))[:, None]).T @ one + penalty + 1e-6 * np.eye(len(w))
        step = np.linalg.solve(hessian, one.T @ (y - p) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    sampled = y.mean()
    shift = math.log(share / (1 - share)) - math.log(sampled / (1 - sampled))
    return (float(w[0] + shift), *(float(v) for v in w[1:] / scale))


def score(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: `doc_id`, `held_out`, `score`, `predicted`, `n_attacks`.

    A null text is scored as an empty one, like any text without attacks. Repeated rows come out as often as they go
    in; other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id), FOLDS, HELD_OUT).alias("held_out"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType()), T.StructField("n_attacks", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weighed = [model.weigh(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array([w[0] for w in weighed], pa.float64()),
                 pa.array([w[1] for w in weighed], pa.int64())], schema.names)

    return narrow.mapInArrow(run, schema).select(
        F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "n_attacks")


def matched_clauses(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each clause with attacks: `doc_id`, `begin`, `end` (characters), `clause`, `weight`."""
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("begin", T.LongType()),
                           T.StructField("end", T.LongType()), T.StructField("clause", T.StringType()),
                           T.StructField("weight", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column("text")):
                low = t.as_py().lower()
                for begin, end, attacks in model.clauses(low):
                    rows.append(i)
                    out.append((begin, end, low[begin:end], float(sum(w for _, w in attacks))))
            columns = list(zip(*out)) if out else [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(columns[0], pa.int64()),
                 pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()),
                 pa.array(columns[3], pa.float64())], schema.names)

    return narrow.mapInArrow(run, schema).withColumnRenamed("id", doc_id)


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text", most: float = 0.5) -> DataFrame:
    """`docs` without the rows that score `most` or more; columns and other rows as they are."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            texts = batch.column(place).fill_null("")
            yield from kept_rows(batch, texts, np.array([model.weigh(t.as_py())[0] < most for t in texts], bool))
            del batch, texts
            give_back()

    return docs.mapInArrow(run, docs.schema)
