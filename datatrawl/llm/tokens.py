"""Token counts by a public tokenizer file, over whole texts.

Texts are encoded in Arrow functions that return lengths only. White space is dropped by the
tokenizer and no token crosses it, so a text may be cut at any of it: a batch is cut in slices of
about as many bytes each, longer texts in pieces at white space, and each distinct word of a slice
goes through the library once. A worker keeps the words it has met, up to a bound.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.common import give_back

TOKENIZER = "word_bpe_49k.json"
SLICE_BYTES = 4 << 20    # text that is encoded at once
KEPT_WORDS = 1_000_000   # words a worker remembers; beyond, it keeps those met in several slices
CALL_WORDS = 4096        # words of one call of the library, whose results are large

# A word that ends in ASCII punctuation after a letter: the tokenizer cuts there. Not with "<",
# which may begin a special token, nor with an apostrophe, which may begin a contraction.
_TAIL = re.compile(r"([^<]*[A-Za-zÀ-ÖØ-öø-ÿ])([!-&(-/:;=-@\[-`{-~]+)")
_SPACE = re.compile(r"[ \t\n\r\x0b\x0c]+")


def tokenizer_path(name: str) -> str:
    """Where the installed tokenizer file lies; a path is returned as it is."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of words as the tokenizer file gives them, without added tokens.

    Every text is a row of words between ASCII white space; its ids are theirs in order. Only for
    tokenizers that drop white space, such as the default.
    """

    def __init__(self, name: str = TOKENIZER, kept: int = KEPT_WORDS) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self._kept = kept
        self._start()

    def _start(self) -> None:
        self._at: dict[str, int] = {}
        self._n = 0
        self._used = 0
        self._starts = np.zeros(1 << 12, np.int64)
        self._sizes = np.zeros(1 << 12, np.int32)
        self._again = np.zeros(1 << 12, bool)
        self._ids = np.zeros(1 << 14, np.uint32)

    def _forget(self) -> None:
        """Drop the words met in one slice only; if that leaves more than half of the bound, all."""
        words = [w for w, k in self._at.items() if self._again[k]]
        if len(words) > self._kept // 2:
            words = []
        ids = [self._ids[(s := self._starts[k := self._at[w]]):s + self._sizes[k]].tolist() for w in words]
        self._start()
        self._add(words, ids)

    def _add(self, words: list[str], ids: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for one in ids for i in one), np.uint32, int(sizes.sum()))
        while self._n + len(words) > len(self._starts):
            self._starts = np.concatenate([self._starts, np.zeros_like(self._starts)])
            self._sizes = np.concatenate([self._sizes, np.zeros_like(self._sizes)])
            self._again = np.concatenate([self._again, np.zeros_like(self._again)])
        while self._used + len(flat) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        here = slice(self._n, self._n + len(words))
        self._sizes[here] = sizes
        self._starts[here] = self._used + np.cumsum(sizes) - sizes
        self._ids[self._used:self._used + len(flat)] = flat
        self._at.update(zip(words, range(self._n, self._n + len(words))))
        self._n += len(words)
        self._used += len(flat)

    def _encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        cut = {w: m.groups() for w in words if (m := _TAIL.fullmatch(w))}
        cut = {w: (a.lower() if a.isascii() else a, b) for w, (a, b) in cut.items()}
        whole = {w for w in words if w not in cut}
        parts = {p for pair in cut.values() for p in pair} | whole
        new = [p for p in parts if p not in self._at]
        for k in range(0, len(new), CALL_WORDS):
            self._add(new[k:k + CALL_WORDS], self._encode(new[k:k + CALL_WORDS]))
        ids = lambda p: self._ids[(s := self._starts[k := self._at[p]]):s + self._sizes[k]].tolist()
        ends = {b: ids(b) for b in {b for _, b in cut.values()}}
        rest = [w for w in cut if w not in self._at]
        for k in range(0, len(rest), CALL_WORDS):
            self._add(rest[k:k + CALL_WORDS], [ids(cut[w][0]) + ends[cut[w][1]] for w in rest[k:k + CALL_WORDS]])

    def lookup(self, words: list[str]) -> np.ndarray:
        """The place of each word; places hold until the next call."""
        if self._n > self._kept:
            self._forget()
        known = self._n
        new = [w for w in words if w not in self._at]
        if new:
            self._learn(new)
        places = np.fromiter(map(self._at.__getitem__, words), np.int64, len(words))
        self._again[places[places < known]] = True
        return places

    def sizes(self, places: np.ndarray) -> np.ndarray:
        return self._sizes[places]

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of the words at `places`, one after another."""
        sizes = self._sizes[places]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        # A worker keeps far fewer than 2^31 ids, and a slice has fewer too.
        shift = (self._starts[places] - (ends - sizes)).astype(np.int32)
        return self._ids[np.repeat(shift, sizes) + np.arange(total, dtype=np.int32)]

    def split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of all words of `texts`, and where each text's begin and end among them."""
        lists = pc.ascii_split_whitespace(texts)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        places = self.lookup(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        return (places[codes] if len(codes) else np.zeros(0, np.int64)), offsets - offsets[0]


@functools.cache
def encoder(name: str) -> WordEncoder:
    """The one encoder of this Python worker for a tokenizer file."""
    return WordEncoder(name)


def drop_encoders() -> None:
    """Give back what encoders keep: for tasks without one, as workers live on behind those that had it."""
    if encoder.cache_info().currsize:
        encoder.cache_clear()
        give_back()


def text_pieces(text: str, limit: int = SLICE_BYTES) -> Iterator[str]:
    """`text` in pieces of about `limit` characters, cut at white space; whole if it has none."""
    at = 0
    while len(text) - at > limit:
        space = _SPACE.search(text, at + limit)
        if space is None:
            break
        yield text[at:space.start()]
        at = space.end()
    yield text[at:]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Runs of `texts` (no nulls) of about `limit` bytes each, with the place of their first.

    A text longer than that is a run by itself.
    """
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > limit:
            yield at, texts.slice(at, i - at)
            at, held = i, 0
        held += int(size)
    if at < len(texts):
        yield at, texts.slice(at)


def kept_rows(batch: pa.RecordBatch, texts: pa.Array, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of `batch` that `keep` names, in runs of about SLICE_BYTES of their `texts` (no nulls).

    In one piece they would be a second batch here, and a third where Spark reads them.
    """
    for at, run in slices(texts):
        yield batch.slice(at, len(run)).filter(pa.array(keep[at:at + len(run)], pa.bool_()))


def count_batch(texts: pa.Array, name: str = TOKENIZER, limit: int = SLICE_BYTES) -> np.ndarray:
    """Tokens of each text (no nulls)."""
    enc = encoder(name)
    out = np.zeros(len(texts), np.int64)
    for at, run in slices(texts, limit):
        if len(run) == 1 and pc.binary_length(run[0]).as_py() > limit:
            for piece in text_pieces(run[0].as_py(), limit):
                places, _ = enc.split(pa.array([piece], pa.large_string()))
                out[at] += int(enc.sizes(places).sum())
        else:
            places, offsets = enc.split(run)
            total = np.concatenate([[0], np.cumsum(enc.sizes(places), dtype=np.int64)])
            out[at:at + len(run)] = total[offsets[1:]] - total[offsets[:-1]]
    return out


def token_counts(docs: DataFrame, limit: int = 2048, doc_id: str = "doc_id", text: str = "text",
                 tokenizer: str = TOKENIZER) -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_bytes` (UTF-8), `n_tokens`, `over_limit`.

    A null text counts as empty (0 bytes, 0 tokens). Repeated rows come out as often as they go in;
    other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([
        narrow.schema["id"], T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.binary_length(texts).cast(pa.int64()),
                 pa.array(count_batch(texts, tokenizer))], ["id", "n_bytes", "n_tokens"])

    counted = narrow.mapInArrow(count, schema)
    return counted.select(F.col("id").alias(doc_id), "n_bytes", "n_tokens",
                          (F.col("n_tokens") > limit).alias("over_limit"))
