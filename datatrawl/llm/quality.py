"""Quality classifier: a byte convolutional network over overlapping chunks of whole documents.

Filters see bytes and a flag for repeated words; their answers are max-pooled over the chunks that
cover a document, and one dense layer turns the pooled answers into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.bytenet import (
    ByteNet, Shape, arrow_bytes, repeat_flags, spread_windows, text_windows, to_rows)
from datatrawl.llm.common import give_back, held_out, labelled_sample
from datatrawl.llm.tokens import drop_encoders, kept_rows, slices

FOLDS, HELD_OUT = 3, 1
SHAPE = Shape(window=512, widths=(2, 3, 5), filters=12, stride=2, flags=1)
STEP = 480            # bytes from one chunk's begin to the next; the rest overlaps
SAMPLE_DOCS = 1500    # labelled documents of each label that the network is fitted on, about
SAMPLE_CHUNKS = 12    # chunks of each, evenly over its whole text
SLICE_BYTES = 1 << 20


@dataclass
class QualityModel:
    """`net` is None if the labelled rows did not show both labels; `share` is that of label 1."""

    net: ByteNet | None
    share: float

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of label 1 for each text (no nulls)."""
        if self.net is None:
            return np.full(len(texts), self.share)
        out = np.zeros(len(texts))
        for at, run in slices(texts, SLICE_BYTES):
            data, offsets = arrow_bytes(run)
            rows, owner, flags = text_windows(data, offsets, SHAPE.window, STEP, repeat_flags(data, offsets))
            first = np.searchsorted(owner, np.arange(len(run)))
            pooled = np.maximum.reduceat(self.net.pool(rows, flags), first, axis=0)
            logits = self.net.logits(pooled).astype(np.float64)
            out[at:at + len(run)] = 1 / (1 + np.exp(np.clip(logits[:, 0] - logits[:, 1], -50, 50)))
        return out


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
        label: str = "quality", sample_docs: int = SAMPLE_DOCS) -> QualityModel:
    """Learns from the labelled documents that are not held out.

    About `sample_docs` documents of each label at most are taken (see `labelled_sample`), and
    SAMPLE_CHUNKS chunks of each; only those come to the driver.
    """
    sample, counts = labelled_sample(docs, labels, doc_id, text, label, sample_docs, FOLDS, HELD_OUT)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    if sample is None:
        return QualityModel(None, share)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs_, names, parts, flags = [], [], [], []
            for name, one in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()):
                data = one.encode()
                flag = repeat_flags(data, np.array([0, len(data)])).astype(np.uint8).tobytes()
                begins = spread_windows(data, SHAPE.window, STEP, SAMPLE_CHUNKS)
                docs_.append(hash_of(data))
                names.append(name)
                parts.append([data[at:at + SHAPE.window] for at in begins])
                flags.append([flag[at:at + SHAPE.window] for at in begins])
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_, pa.int64()), pa.array(names, pa.int32()),
                 pa.array(parts, pa.list_(pa.binary())), pa.array(flags, pa.list_(pa.binary()))],
                ["doc", "label", "parts", "flags"])

    rows = sample.mapInArrow(cut, "doc long, label int, parts array<binary>, flags array<binary>").toArrow()
    # In an order of the content, so that the same sample gives the same network.
    rows = rows.sort_by([("doc", "ascending"), ("label", "ascending")])
    target = rows.column("label").to_numpy().astype(np.int64)
    if len(set(target.tolist())) < 2:
        return QualityModel(None, share)
    parts, flags = rows.column("parts").to_pylist(), rows.column("flags").to_pylist()
    group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    net = ByteNet(SHAPE)
    flag_rows = (to_rows([f for one in flags for f in one], SHAPE.window) == 1).astype(np.float32)
    epochs = int(np.clip(20_000 // max(1, len(target)), 6, 40))
    net.train(to_rows([p for one in parts for p in one], SHAPE.window), group, target, flag_rows[:, :, None],
              epochs=epochs, batch=32)
    return QualityModel(net, share)


def hash_of(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) >> 1


def score(docs: DataFrame, model: QualityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: `doc_id`, `held_out`, `score`, `predicted`.

    A null text is scored as an empty one. Every byte of a text lies in a chunk. Repeated rows come
    out as often as they go in; other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), held_out(F.col(doc_id), FOLDS, HELD_OUT).alias("held_out"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([narrow.schema["id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), pa.array(model.score(batch.column("text")))],
                schema.names)

    return narrow.mapInArrow(run, schema).select(
        F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: QualityModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """`docs` without the rows that score below `least`; columns and other rows as they are."""
    schema = docs.schema
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            texts = batch.column(place).fill_null("")
            yield from kept_rows(batch, texts, model.score(texts) >= least)
            del batch, texts
            give_back()

    return docs.mapInArrow(run, schema)
