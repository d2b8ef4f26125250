"""Runs of repeated words, found on a grammar of the texts.

The word ids of a slice of texts are compressed by Re-Pair in rounds: in each, every pair of
neighbouring symbols that occurs twice or more is a candidate, and where two overlap the more
frequent one becomes a nonterminal. The texts of a slice share one grammar, so what repeats, within
a text or between copies, is looked at once.

A run lies in the expansion of a lowest nonterminal, or of a text's start rule, and crosses the
boundary of its two halves there. So runs are searched at the boundary of each nonterminal once, on
one of its places, and moved to all of its places; parts of one run, seen lower down, merge into it.
The search at a boundary takes words of 1, 2, 4, ... ids that are longer than the period: within a
run such a word comes again after exactly one period, and not before. Equal words are known by
exact names, made of the names of their halves and kept only while a word occurs twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from datatrawl.llm.common import unused
from datatrawl.llm.tokens import slices

LEAST_WORDS = 6     # of a run
LEAST_TIMES = 4     # periods of a run
SLICE_BYTES = 2 << 20
SHRINK = 16         # a round that replaces less than this part of the symbols is the last

RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Ids of all words of `texts` (no nulls), the offsets of each text, and the words by id."""
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    known = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy().astype(np.int64)
    if "" in known:
        full = codes != known.index("")
        codes, owner = codes[full], owner[full]
    counts = np.bincount(owner, minlength=len(texts))
    return codes, np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), known


def _flags(n: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[at] = True
    return out


def boundaries(w: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The grammar of the texts as boundaries: `low`, `mid`, `high`, and their places.

    Of each nonterminal, one place [low, high) in the words and the boundary `mid` of its halves;
    of each start rule, the text and every boundary of its symbols. `which`, `shift` list all
    places of nonterminals: the boundary's number and how far the place is from [low, high).
    """
    n = len(w)
    symbol, start = w.copy(), np.arange(n)
    first = _flags(n + 1, offsets[:-1])[:n]     # does a text begin here?
    fresh = int(w.max()) + 1 if n else 0
    lows, mids, highs, which, shift = [], [], [], [], []
    made = 0
    while len(symbol) > 1:
        m = len(symbol)
        end = np.append(start[1:], n)
        inside = ~first[1:]
        key = np.where(inside, symbol[:-1] * fresh + symbol[1:], -1)
        kinds, kind, count = np.unique(key, return_inverse=True, return_counts=True)
        rank = np.lexsort((kinds, count))
        order = np.empty(len(kinds), np.int64)
        order[rank] = np.arange(1, len(kinds) + 1)
        order[(count < 2) | (kinds < 0)] = 0
        weight = order[kind]
        # Of a row of equal pairs (aaaa) every second one may be taken.
        new = np.ones(m - 1, bool)
        new[1:] = kind[1:] != kind[:-1]
        begin = np.maximum.accumulate(np.where(new, np.arange(m - 1), 0))
        odd = ((np.arange(m - 1) - begin) & 1).astype(bool)
        rival = np.where(odd, 0, weight)
        left, right = np.append(0, rival[:-1]), np.append(rival[1:], 0)
        taken = np.flatnonzero((rival > 0) & (rival > left) & (rival > right))
        if len(taken) * SHRINK < m:
            break
        used, first_of, name = np.unique(kind[taken], return_index=True, return_inverse=True)
        one = taken[first_of]
        lows.append(start[one])
        mids.append(start[one + 1])
        highs.append(end[one + 1])
        which.append(made + name)
        shift.append(start[taken] - start[one][name])
        made += len(used)
        symbol[taken] = fresh + name
        fresh += len(used)
        keep = np.ones(m, bool)
        keep[taken + 1] = False
        symbol, start, first = symbol[keep], start[keep], first[keep]
    # Start rules: boundaries between the symbols that are left.
    rest = np.flatnonzero(~first[:len(symbol)])
    text = np.searchsorted(offsets, start[rest], side="right") - 1
    lows.append(offsets[text])
    mids.append(start[rest])
    highs.append(offsets[text + 1])
    which.append(made + np.arange(len(rest)))
    shift.append(np.zeros(len(rest), np.int64))
    return tuple(np.concatenate(x).astype(np.int64) for x in (lows, mids, highs, which, shift))


class Names:
    """Exact names of the words of 1, 2, 4, ... ids that occur at least twice."""

    def __init__(self, w: np.ndarray) -> None:
        self.places: list[np.ndarray] = []
        self.names: list[np.ndarray] = []
        self.following: list[np.ndarray] = []    # the next place of the same word, or -1
        at, name = np.arange(len(w)), w
        while len(at):
            order = np.argsort(name, kind="stable")
            same = name[order][1:] == name[order][:-1]
            following = np.full(len(at), -1)
            following[order[:-1][same]] = at[order[1:][same]]
            twice = following >= 0
            twice[order[1:][same]] = True
            at, name, following = at[twice], name[twice], following[twice]
            if not len(at):
                break
            name = np.unique(name, return_inverse=True)[1]
            self.places.append(at)
            self.names.append(name)
            self.following.append(following)
            half = 1 << (len(self.places) - 1)
            there = self._index(len(self.places) - 1, at + half)
            at, name, there = at[there >= 0], name[there >= 0], there[there >= 0]
            name = name * (len(self.places[-1]) + 1) + self.names[-1][there]

    def _index(self, level: int, at: np.ndarray) -> np.ndarray:
        """Where `at` stands among the places of a level, or -1."""
        places = self.places[level]
        found = np.minimum(np.searchsorted(places, at), len(places) - 1)
        return np.where(places[found] == at, found, -1)

    def next(self, level: int, at: np.ndarray) -> np.ndarray:
        found = self._index(level, at)
        return np.where(found >= 0, self.following[level][found], -1)

    def alike(self, a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
        """How many ids from `a` on equal those from `b` on (`back`: before them); a < b."""
        total = np.zeros(len(a), np.int64)
        for level in range(len(self.places) - 1, -1, -1):
            step = 1 << level
            i, j = (a - total - step, b - total - step) if back else (a + total, b + total)
            x, y = self._index(level, i), self._index(level, j)
            names = self.names[level]
            total += np.where((x >= 0) & (y >= 0) & (names[x] == names[y]), step, 0)
        return total


def runs_of(w: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(text, start, length, period) of all runs, sorted; starts count within the text."""
    none = np.zeros((0, 4), np.int64)
    if len(w) < LEAST_WORDS:
        return none
    low, mid, high, which, shift = boundaries(w, offsets)
    names = Names(w)
    found = []
    for level in range(1, len(names.places)):
        # Periods from `least` up to `long`, words of `long` ids.
        least, long = 1 << (level - 1), 1 << level
        open_ = np.flatnonzero(high - low >= max(LEAST_WORDS, LEAST_TIMES * least))
        for back in range(5):
            # A run of four periods holds one of these places and, one period on, the same word.
            at = mid[open_] - back * least
            fits = (at >= low[open_]) & (at + long + least <= high[open_])
            rule, at = open_[fits], at[fits]
            period = names.next(level, at) - at
            good = (period >= least) & (period < long) & (at + period + long <= high[rule])
            found.append(np.column_stack([rule[good], at[good], period[good]]))
    found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    if not len(found):
        return none
    rule, at, period = found.T
    start = np.maximum(low[rule], at - names.alike(at, at + period, back=True))
    end = np.minimum(high[rule], at + period + names.alike(at, at + period))
    good = (start < mid[rule]) & (end > mid[rule]) & (
        end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period))
    found = np.unique(np.column_stack([rule, start, end, period])[good], axis=0)
    if not len(found):
        return none
    # To all places of the nonterminal.
    held = _flags(len(low), found[:, 0])
    which, shift = which[held[which]], shift[held[which]]
    begin, stop = np.searchsorted(found[:, 0], which), np.searchsorted(found[:, 0], which, side="right")
    size = stop - begin
    nth = np.repeat(begin, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    move = np.repeat(shift, size)
    return _merged(found[nth, 1] + move, found[nth, 2] + move, found[nth, 3], offsets)


def _merged(start: np.ndarray, end: np.ndarray, period: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Intervals of one period that overlap in a period or more are parts of one run."""
    order = np.lexsort((end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(0, period[1:] != period[:-1]))
    far = int(offsets[-1]) + 1
    reach = np.maximum.accumulate(end + group * far) - group * far
    begins = np.ones(len(start), bool)
    begins[1:] = (group[1:] != group[:-1]) | (start[1:] > reach[:-1] - period[1:])
    at = np.flatnonzero(begins)
    start, end, period = start[at], np.maximum.reduceat(end, at), period[at]
    text = np.searchsorted(offsets, start, side="right") - 1
    out = np.column_stack([text, start - offsets[text], end - start, period])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of `n` words stay: no run holds them behind its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `docs`: `doc_id`, `n_words`, `runs` (start, length, period, by start and period), `collapsed`.

    Words are what stands between ASCII white space. A run is a longest stretch of words with
    smallest period q and at least max(6, 4 q) words. `collapsed` has of each run only the first
    period, words joined by one blank. A null or wordless text has no runs and collapses to the
    empty text. Repeated rows come out as often as they go in; other columns are not read.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for batch in batches:
            for at, part in slices(batch.column("text"), SLICE_BYTES):
                w, offsets, known = word_ids(part)
                runs = runs_of(w, offsets)
                ends = np.searchsorted(runs[:, 0], np.arange(len(part) + 1))
                words = np.array(known, object)
                texts = []
                for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    own = w[a:b]
                    if ends[i + 1] > ends[i]:
                        own = own[kept_words(b - a, runs[ends[i]:ends[i + 1]])]
                    texts.append(" ".join(words[own].tolist()))
                flat = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], fields=list(item))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(at, len(part)), pa.array(np.diff(offsets)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(texts, pa.string())],
                    ["id", "n_words", "runs", "collapsed"])

    return narrow.mapInArrow(search, f"id {kind}, n_words long, runs {RUNS}, collapsed string").withColumnRenamed(
        "id", doc_id)


def with_planted_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`doc_id`, `text` with every tenth text, by its id's checksum h, made periodic from some word on.

    With n words and g = h div 10, each word i >= a is word a + (i - a) % p, for a = g % n and
    p = 1 + (n - a) div (3 + g % 8). A null id plants nothing.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.crc32(F.col(doc_id).cast("string")).alias("h"),
                         F.coalesce(F.col(text), F.lit("")).alias("text"))

    def one(value: str, h: int) -> str:
        words = value.encode().split()
        if not words:
            return value
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        period = words[a:a + p]
        times, more = divmod(n - a, p)
        return b" ".join(words[:a] + period * times + period[:more]).decode()

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tenth = pc.fill_null(pc.equal(pc.subtract(
                batch.column("h"), pc.multiply(pc.divide(batch.column("h"), 10), 10)), 0), False)
            texts = batch.column("text")
            new = [one(t.as_py(), h) for t, h in zip(texts.filter(tenth), batch.column("h").filter(tenth).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pc.replace_with_mask(texts, tenth, pa.array(new, texts.type))], ["id", "text"])

    kind = narrow.schema["id"].dataType.simpleString()
    out = narrow.mapInArrow(plant, f"id {kind}, text string")
    return out.withColumnRenamed("id", doc_id).withColumnRenamed("text", text)


def digest(found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of `periodic_runs` with the longest run and checksums in place of runs and texts."""
    # Ties of the longest: smallest start, then period.
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
        r["period"].cast("string"), F.lit("\n"))), "")
    top = unused(found, "top")
    return found.withColumn(top, longest).select(
        doc_id, F.size("runs").cast("long").alias("n_runs"), (-F.col(f"{top}.start")).alias("start"),
        F.col(f"{top}.length").alias("length"), (-F.col(f"{top}.period")).alias("period"),
        F.floor(F.col(f"{top}.length") * 1000 / -F.col(f"{top}.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
