"""Text pieces with offsets, computed within the row. Offsets count code points."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl import fixed

_WORD = r"[\p{L}\p{N}]"
_GAP = r"[^\p{L}\p{N}]"
# A block starts with a gap and ends behind a word, so neither lies in two blocks.
WORD_BLOCKS = rf"(?s){_GAP}*+{_WORD}++(?:.{{0,500}}{_WORD}(?!{_WORD}))?"
WORD_PIECES = rf"{_GAP}*{_WORD}+"
CODE_POINTS = 0x110000
RUN = 2048  # blocks that are cut in words at a time
# A lone full stop goes on with the sentence behind an abbreviation, an initial or a letter that
# follows another stop, and before a letter or digit.
_SHORT = rf"(?<={_GAP}(?:{'|'.join(fixed.ABBREVIATIONS)})|^(?:{'|'.join(fixed.ABBREVIATIONS)})|{_GAP}\p{{Lu}}|^\p{{Lu}}|\.\p{{L}})"
_INNER_STOP = rf"(?:{_SHORT}\.(?![.!?])|(?<![.!?])\.(?={_WORD}))"
_SENTENCE = rf"(?:[^.!?]++|{_INNER_STOP})*+[.!?]++[\"')\]]*+[ \t\r\n\f]*+"
SENTENCE_BLOCKS = rf"(?:{_SENTENCE}){{1,64}}|(?s:.)+\z"
SENTENCE_PIECES = rf"{_SENTENCE}|(?s:.)+\z"


def _running(values: Column, start: Column, length, kind: str) -> Column:
    """A struct of the total behind `start` and, for each value, what lies before it."""
    empty = F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("done"))
    return F.aggregate(values, empty, lambda state, v: F.struct(
        (state["at"] + length(v)).alias("at"), F.array_append(state["done"], state["at"]).alias("done")))


def starts(pieces: Column, start: Column) -> Column:
    """Where each of some consecutive pieces begins, the first one at `start`.

    Appending copies an array, so sums run over groups of about the square root of all pieces, and
    over the pieces of each group.
    """
    n = F.size(pieces)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
    groups = F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / width).cast("int"))),
        lambda g: _running(F.slice(pieces, g * width + 1, width), F.lit(0).cast("bigint"), F.length, "bigint"))

    def step(state: Column, group: Column) -> Column:
        here = F.transform(group["done"], lambda at: at + state["at"])
        return F.struct((state["at"] + group["at"]).alias("at"), F.array_append(state["done"], here).alias("done"))

    empty = F.struct(start.cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("done"))
    return F.when(n > 0, F.flatten(F.aggregate(groups, empty, step, lambda state: state["done"]))).otherwise(
        F.array().cast("array<bigint>"))


def with_offsets(df: DataFrame, keep: list[str], pieces: Column, start: Column,
                 name: str = "pieces") -> DataFrame:
    """Columns `keep` and the pieces as an array of (start, text)."""
    found = df.select(*keep, pieces.alias("_text"), start.alias("_from"))
    placed = found.select(*keep, "_text", starts(F.col("_text"), F.col("_from")).alias("_start"))
    return placed.select(*keep, F.arrays_zip(F.col("_start").alias("start"),
                                             F.col("_text").alias("text")).alias(name))


def piece_rows(df: DataFrame, keep: list[str], pieces: Column, start: Column) -> DataFrame:
    """A row per piece: columns `keep` and p(start, text).

    The outer form of explode is used on purpose: the plain one gets a filter on the array's size
    that Spark pushes below the projection, where all pieces would be computed a second time.
    """
    return with_offsets(df, keep, pieces, start).select(
        *keep, F.explode_outer("pieces").alias("p")).filter(F.col("p").isNotNull())


def text_blocks(docs: DataFrame, pattern: str) -> DataFrame:
    """Cut each text in short blocks: doc_id, block_start, block.

    A row per block keeps the running sums of long texts cheap, and spreads one long text over
    tasks if the result is repartitioned.
    """
    blocks = F.regexp_extract_all("text", F.lit(f"({pattern})"), 1)
    return piece_rows(docs, ["doc_id"], blocks, F.lit(0)).select(
        "doc_id", F.col("p.start").alias("block_start"), F.col("p.text").alias("block"))


@functools.cache
def _word_borders() -> np.ndarray:
    """The code points from which on characters are of words, or are not any more, as `_WORD` has it."""
    points = SparkSession.active().range(CODE_POINTS).filter(~F.col("id").between(0xD800, 0xDFFF))
    character = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    known = np.zeros(CODE_POINTS, bool)
    known[points.filter(character.rlike(_WORD)).toArrow().column("id").to_numpy()] = True
    return np.flatnonzero(np.diff(known, prepend=False))


def _parts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The strings from bytes `start` to `end` of `data`; none begins before the last one's end."""
    cuts = np.column_stack([start, end]).ravel()
    # Every second string is what lies between two of them.
    return pa.LargeStringArray.from_buffers(
        max(0, len(cuts) - 1), pa.py_buffer(cuts), pa.py_buffer(data)).take(pa.array(np.arange(0, len(cuts), 2)))


def words_of(texts: pa.Array, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Of each word in `texts` (no nulls): its text's place, begin of the gap before it, start, end, gap, word.

    The gap is null if it is one blank, as most are. `known` tells of each code point if it is of words.
    """
    texts = texts.cast(pa.large_string())
    cuts = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[cuts[0]:cuts[-1]]
    # Byte of each code point, and first code point of each text.
    byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    first = np.searchsorted(byte, cuts - cuts[0])
    here = known[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    before, behind = np.append(False, here[:-1]), np.append(here[1:], False)
    before[first[:-1][first[:-1] < len(here)]] = False
    behind[first[1:][first[1:] > 0] - 1] = False
    start, end = np.flatnonzero(here & ~before), np.flatnonzero(here & ~behind) + 1
    text = np.searchsorted(first, start, side="right") - 1
    follows = np.append(False, text[1:] == text[:-1])[:len(text)]
    begin = np.where(follows, np.append(0, end)[:len(text)], first[text])
    zero = first[text]
    gap = _parts(data, byte[begin], byte[start])
    blank = (byte[start] - byte[begin] == 1) & (data[byte[begin]] == 0x20)
    return (text, begin - zero, start - zero, end - zero,
            pc.if_else(pa.array(blank), pa.scalar(None, pa.large_string()), gap), _parts(data, byte[start], byte[end]))


PLACES = ("begin", "start", "end")


def word_rows(blocks: DataFrame, *columns: str) -> DataFrame:
    """A row per word of `text_blocks`: doc_id, begin (of the gap before it), start, end, piece, word.

    `piece` is the word with the gap before it. Words of many blocks are found at once, on arrays.
    `columns` names those wanted besides doc_id, among them `gap`, which is null where it is one blank.
    """
    if not columns:
        piece = F.concat(F.coalesce("gap", F.lit(" ")), "word").alias("piece")
        return word_rows(blocks, *PLACES, "gap", "word").select("doc_id", *PLACES, piece, "word")
    borders = _word_borders()
    kind = blocks.schema["doc_id"].dataType
    names = ["doc_id", *columns]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = np.zeros(CODE_POINTS, bool)
        turns[borders] = True
        known = np.logical_xor.accumulate(turns)
        for batch in batches:
            for i in range(0, len(batch), RUN):
                run = batch.slice(i, RUN)
                place, begin, start, end, gap, word = words_of(run.column("block"), known)
                zero = run.column("block_start").to_numpy()[place]
                at = {"begin": begin, "start": start, "end": end}
                text = {"gap": gap, "word": word}
                yield pa.RecordBatch.from_arrays(
                    [run.column("doc_id").take(pa.array(place)),
                     *(text[c].cast(pa.string()) if c in text else pa.array(zero + at[c]) for c in columns)], names)

    schema = T.StructType([T.StructField("doc_id", kind), *(
        T.StructField(c, T.LongType() if c in PLACES else T.StringType()) for c in columns)])
    return blocks.mapInArrow(cut, schema)


def _endings() -> str:
    """Matches the beginning of a reversed word whose longest ending gives a root; group 1 is the ending."""
    found = []
    for ending, new in sorted(fixed.ROOT_RULES.items(), key=lambda rule: -len(rule[0])):
        least = max(0, fixed.ROOT_LETTERS - len(new))
        vowel = "" if re.search("[aeiouy]", new) else "(?=[a-z]*[aeiouy])"
        found.append(f"{ending[::-1]}(?=[a-z]{{{least}}}){vowel}")
    return f"^({'|'.join(found)})"


def root_by_rules(token: Column) -> Column:
    """The root of an inflected word of ASCII letters by its longest known ending, else null.

    All endings are tried in one look at the word from its end, so the cost of a word is small
    however many rules there are.
    """
    word = F.lower(token)
    ending = F.reverse(F.regexp_extract(F.reverse(word), _endings(), 1))
    rules = F.create_map(*(F.lit(x) for pair in fixed.ROOT_RULES.items() for x in pair))
    root = F.concat(F.substring(word, F.lit(1), F.length(word) - F.length(ending)), F.try_element_at(rules, ending))
    # Most words have no such ending; only the others are looked at closely.
    last = "".join(sorted({ending[-1] for ending in fixed.ROOT_RULES}))
    return F.when(token.rlike(f"(?i)^[a-z]+[{last}]$"), root)


def forms_by_rules(roots: Iterable[str]) -> list[str]:
    """All words, in small letters, that `root_by_rules` may take to one of `roots`, and some more."""
    return sorted({root[:len(root) - len(new)] + ending for root in roots
                   for ending, new in fixed.ROOT_RULES.items() if root.endswith(new)})


def without_leading_gap(piece: Column) -> Column:
    return F.regexp_replace(piece, rf"^{_GAP}+", "")
