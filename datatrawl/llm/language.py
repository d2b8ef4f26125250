"""Language ID by a byte convolutional network over fixed-length windows of whole texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.bytenet import PAD, ByteNet, Shape, arrow_bytes, spread_windows, text_windows, to_rows
from datatrawl.llm.common import by_share, held_out, unused
from datatrawl.llm.tokens import slices

UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0
SAMPLE_DOCS = 500      # labelled documents a language that the network is fitted on, about
MOST_LANGUAGES = 200   # values of the language column that are learned at most
SAMPLE_WINDOWS = 4     # windows of each, evenly over its whole text
SLICE_BYTES = 1 << 20  # text whose windows are computed at once


@dataclass
class LanguageModel:
    """`net` is None with one language, which every text then has, or with none: UNKNOWN."""

    langs: list[str]
    net: ByteNet | None

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text (no nulls), and its probability.

        Windows vote with their probabilities, weighted by the bytes that they hold.
        """
        if self.net is None:
            return [*self.langs, UNKNOWN][:1] * len(texts), np.full(len(texts), float(len(self.langs)))
        window = self.net.shape.window
        total = np.zeros((len(texts), len(self.langs)))
        for at, run in slices(texts, SLICE_BYTES):
            data, offsets = arrow_bytes(run)
            rows, owner, _ = text_windows(data, offsets, window, window)
            logits = self.net.logits(self.net.pool(rows)).astype(np.float64)
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            weight = np.maximum(1, (rows != PAD).sum(1))
            first = np.searchsorted(owner, np.arange(len(run)))
            total[at:at + len(run)] = np.add.reduceat(prob * weight[:, None], first, axis=0)
        total /= total.sum(1, keepdims=True)
        best = total.argmax(1)
        return [self.langs[k] for k in best], total[np.arange(len(best)), best]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
        shape: Shape | None = None, sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learns from the rows of `docs` that have a text and a language and are not held out.

    At most about `sample_docs` documents a language are taken, chosen by a hash of the key and the
    text, and SAMPLE_WINDOWS windows of each; only those windows come to the driver. Rows with the
    same key and text are one document, however many there are. Of more than MOST_LANGUAGES values
    of `lang` those with the most documents are learned, ties by name.
    """
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()
                        & ~held_out(F.col(doc_id), FOLDS, HELD_OUT))
    mark = unused(docs, "sampled_by")
    known = known.withColumn(mark, F.xxhash64(doc_id, text))
    by_lang = known.groupBy(F.col(lang).alias("lang")).agg(F.approx_count_distinct(mark).alias("n"))
    counts = {r[0]: r[1] for r in by_lang.orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()}
    known = known.filter(F.col(lang).isin(*counts)) if counts else known
    langs = sorted(counts)
    shape = shape or Shape(widths=(2, 3, 5), classes=max(2, len(langs)))
    if len(langs) < 2:
        return LanguageModel(langs, None)
    share = F.element_at(F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, sample_docs / max(1, counts[k])))]),
                         F.col(lang))
    picked = known.filter(by_share(F.col(mark), share)).select(
        F.col(lang).alias("lang"), F.col(mark).alias("doc"), F.encode(F.col(text), "UTF-8").alias("data"))
    window, most = shape.window, SAMPLE_WINDOWS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, int]] = set()   # no larger than the sample
        for batch in batches:
            names, docs, places, parts = [], [], [], []
            for name, doc, data in zip(*(batch.column(c).to_pylist() for c in ("lang", "doc", "data"))):
                if (name, doc) in seen:
                    continue
                seen.add((name, doc))
                for at in spread_windows(data, window, window, most):
                    names.append(name)
                    docs.append(doc)
                    places.append(at)
                    parts.append(data[at:at + window])
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(docs, pa.int64()), pa.array(places, pa.int64()),
                 pa.array(parts, pa.binary())], ["lang", "doc", "at", "part"])

    # Tasks may hold the same document.
    rows = picked.mapInArrow(cut, "lang string, doc long, at long, part binary").distinct().select(
        "lang", "part").toArrow()
    parts, names = rows.column("part").to_pylist(), rows.column("lang").to_pylist()
    order = sorted(range(len(parts)), key=lambda i: (names[i], parts[i]))  # however rows arrive
    at = {k: i for i, k in enumerate(langs)}
    net = ByteNet(shape)
    target = np.array([at[names[i]] for i in order])
    net.train(to_rows([parts[i] for i in order], window), np.arange(len(order)), target, epochs=6)
    return LanguageModel(langs, net)


def identify(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: `doc_id`, `held_out`, `lang_pred`, `score`.

    A null text, or one without a letter, is UNKNOWN with score 0. Every byte of a text lies in a
    window. Repeated rows come out as often as they go in; other columns are not read.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    narrow = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id), FOLDS, HELD_OUT).alias("held_out"),
                         content.rlike(r"\p{L}").alias("letters"), content.alias("text"))
    schema = T.StructType([
        narrow.schema["id"], T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = model.predict(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"),
                 pa.array([k if ok else UNKNOWN for k, ok in zip(langs, letters)], pa.string()),
                 pa.array(np.where(letters, scores, 0.0))], schema.names)

    return narrow.mapInArrow(predict, schema).withColumnRenamed("id", doc_id)
