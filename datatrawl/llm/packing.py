"""Best-fit packing of token sequences by bin completion branch-and-bound.

Documents are encoded once, in Arrow functions; what is shuffled is one narrow row for each piece.
Pieces are dealt at random over groups of bounded size, and each group is packed by itself: around
the largest piece left, undominated fillings of the rest of its sequence are enumerated, least
waste first; a branch whose waste can no longer beat the incumbent is pruned, and the incumbent
begins as a best-fit packing. A group that meets its lower bound is optimal, and so is one whose
search ends within its limits; these are parameters, and `search_gap` tells what they may cost.
"""

from __future__ import annotations

import bisect
import itertools
import math
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from datatrawl.llm.common import give_back, stage
from datatrawl.llm.tokens import TOKENIZER, encoder, slices, text_pieces

CAPACITY = 4096      # tokens of a sequence
END_ID = 1           # ends each document
GROUP_PIECES = 4096  # pieces that are packed together, on average
FILL_NODES = 2000    # nodes of one enumeration of fillings; the best found until then are kept
FIRST_NODES = 400    # nodes of the enumeration for a bin of the first descent
FILLINGS = 64        # branches kept for one sequence
SEARCH_NODES = 300_000  # nodes of all enumerations of one group beyond its first descent
SLICE_BYTES = 8 << 20   # text that is encoded at once


def slice_ids(texts: pa.Array, name: str = TOKENIZER) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Ids of runs of `texts` (no nulls): the run's first row, its ids, and where each text's end."""
    enc = encoder(name)
    for at, run in slices(texts, SLICE_BYTES):
        if len(run) == 1 and pc.binary_length(run[0]).as_py() > SLICE_BYTES:
            ids = np.concatenate([
                enc.ids(enc.split(pa.array([piece], pa.large_string()))[0])
                for piece in text_pieces(run[0].as_py(), SLICE_BYTES)])
            yield at, ids, np.array([len(ids)])
            continue
        places, offsets = enc.split(run)
        ends = np.concatenate([[0], np.cumsum(enc.sizes(places), dtype=np.int64)])[offsets[1:]]
        yield at, enc.ids(places), ends


def document_ids(texts: pa.Array, name: str = TOKENIZER) -> Iterator[np.ndarray]:
    """The ids of each text (no nulls), in order."""
    for _, ids, ends in slice_ids(texts, name):
        yield from np.split(ids, ends[:-1])


def cut_places(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each piece of documents of the given lengths: its document, number and length."""
    count = -(-lengths // capacity)
    row = np.repeat(np.arange(len(lengths)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, nth, np.minimum(capacity, lengths[row] - nth * capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text",
           tokenizer: str = TOKENIZER, with_ids: bool = False) -> DataFrame:
    """The pieces of each row of `docs`: `id`, `piece`, `start`, `length`, `ids_crc32`, `salt`.

    A document's ids end with END_ID, so an empty or null text is one piece of one token. `salt`
    numbers the pieces of a task. `with_ids` adds the ids themselves as `ids`.
    """
    narrow = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    fields = [narrow.schema["id"], T.StructField("piece", T.IntegerType()),
              T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
              T.StructField("ids_crc32", T.LongType()), T.StructField("salt", T.LongType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def cut_batch(batch: pa.RecordBatch, salt: int) -> Generator[pa.RecordBatch, None, int]:
        for at, ids, ends in slice_ids(batch.column("text"), tokenizer):
            # Each document's ids and its end, one after another.
            whole = np.insert(ids, ends, END_ID).astype("<u4")
            lengths = np.diff(ends, prepend=0) + 1
            row, nth, size = cut_places(lengths, capacity)
            begin = (np.cumsum(lengths) - lengths)[row] + nth * capacity
            data = memoryview(whole).cast("B")
            crcs = [zlib.crc32(data[a:b]) for a, b in zip((4 * begin).tolist(), (4 * (begin + size)).tolist())]
            columns = [batch.column("id").take(pa.array(at + row)), pa.array(nth.astype(np.int32)),
                       pa.array(nth * capacity), pa.array(size), pa.array(crcs, pa.int64()),
                       pa.array(np.arange(salt, salt + len(row)))]
            if with_ids:
                # Pieces stand in order and without gaps.
                offsets = pa.array(np.append(begin, len(whole)).astype(np.int32))
                columns.append(pa.ListArray.from_arrays(offsets, pa.array(whole.astype(np.int64))))
            salt += len(row)
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])
        return salt

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            salt = yield from cut_batch(batch, salt)
            del batch
            give_back()

    return narrow.mapInArrow(cut, T.StructType(fields))


class _Stock:
    """How many pieces of each length are left."""

    def __init__(self, lengths: list[int]) -> None:
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.sizes[bisect.bisect_left(self.sizes, n)]

    def give(self, n: int) -> None:
        if not self.count[n]:
            bisect.insort(self.sizes, n)
        self.count[n] += 1


def _dominated(stock: _Stock, chosen: tuple[int, ...], room: int) -> bool:
    """Would a larger piece in place of one or two of `chosen` (with `room` left) be no worse?

    Then the filling with that piece is looked at too, and the pieces it sets free are easier to place.
    """
    sizes, count = stock.sizes, stock.count

    def better(least: int, most: int) -> bool:
        at = bisect.bisect_left(sizes, least)
        while at < len(sizes) and sizes[at] <= most:
            if chosen.count(sizes[at]) < count[sizes[at]]:
                return True
            at += 1
        return False

    if any(better(n + 1, n + room) for n in set(chosen)):
        return True
    return any(better(a + b, a + b + room) for a, b in set(itertools.combinations(chosen, 2)))


def fillings(stock: _Stock, room: int, keep: int = FILLINGS, nodes: int = FILL_NODES) -> tuple[list[tuple[int, ...]], int]:
    """Undominated ways to fill `room` from the stock, least waste first, at most `keep`, and the nodes taken.

    Lengths are tried from the largest down. Nothing beats a filling without waste by the largest
    pieces, so the first such ends the enumeration if no other is kept.
    """
    best: list[tuple[int, int, tuple[int, ...]]] = []
    left = nodes
    sizes, count = stock.sizes, stock.count

    def add(room: int, chosen: tuple[int, ...]) -> None:
        entry = (room, len(chosen), chosen)
        if (len(best) < keep or entry < best[-1]) and not _dominated(stock, chosen, room):
            bisect.insort(best, entry)
            del best[keep:]

    def descend(room: int, top: int, chosen: tuple[int, ...]) -> bool:
        """Is there a filling without waste, when only one is wanted?"""
        nonlocal left
        at = bisect.bisect_right(sizes, min(room, top)) - 1
        tried = False
        while at >= 0 and left > 0:
            n = sizes[at]
            at -= 1
            if chosen.count(n) >= count[n]:
                continue
            tried = True
            left -= 1
            if descend(room - n, n, (*chosen, n)):
                return True
        if not tried:
            add(room, chosen)
        return room == 0 and keep == 1

    descend(room, room, ())
    return [chosen for *_, chosen in best] or [()], nodes - left


def first_filling(stock: _Stock, room: int) -> tuple[tuple[int, ...], int]:
    """The way of least waste that a short enumeration finds, and the nodes taken."""
    ways, taken = fillings(stock, room, keep=1, nodes=FIRST_NODES)
    return ways[0], taken


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing takes: by the total, and by pieces that can't share one.

    For each a up to half of a bin: pieces over capacity - a are alone among those of a and more;
    those over a half have a bin each, with some room for pieces between.
    """
    x = np.sort(np.array(lengths, np.int64))
    total = np.concatenate([[0], np.cumsum(x)])
    bound = -(-int(total[-1]) // capacity)
    half = np.searchsorted(x, capacity // 2, "right")       # pieces up to a half come before
    for a in np.unique(x[:half]):
        low, alone = np.searchsorted(x, a), np.searchsorted(x, capacity - a, "right")
        large = len(x) - half
        room = (alone - half) * capacity - (total[alone] - total[half])
        bound = max(bound, large + max(0, -(-int(total[half] - total[low] - room) // capacity)))
    return bound


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each piece goes where the least room is left."""
    bins: list[list[int]] = []
    rooms: list[int] = []            # distinct rooms left, sorted
    by_room: dict[int, list[int]] = {}
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            k, room = len(bins), capacity
            bins.append([])
        else:
            room = rooms[at]
            k = by_room[room].pop()
            if not by_room[room]:
                del rooms[at]
        bins[k].append(n)
        room -= n
        if not by_room.get(room):
            bisect.insort(rooms, room)
        by_room.setdefault(room, []).append(k)
    return bins


def complete(lengths: list[int], capacity: int = CAPACITY, search_nodes: int = SEARCH_NODES) -> list[list[int]]:
    """Bins of the given lengths (1 to `capacity`), by bin completion."""
    full = [[n] for n in lengths if n == capacity]
    rest = [n for n in lengths if n < capacity]
    incumbent = best_fit(rest, capacity)
    total = sum(rest)
    bound = lower_bound(rest, capacity)
    # A first descent by the best filling of each bin, then the search over all.
    if len(incumbent) > bound:
        stock, greedy = _Stock(rest), []
        while stock.sizes:
            largest = stock.sizes[-1]
            stock.take(largest)
            way, _ = first_filling(stock, capacity - largest)
            for n in way:
                stock.take(n)
            greedy.append([largest, *way])
        incumbent = min(greedy, incumbent, key=len)
    stock = _Stock(rest)
    path: list[list[int]] = []                       # bins so far
    choices: list[Iterator[tuple[int, ...]]] = []    # what is left to try for each
    wastes = [0]
    left = search_nodes

    def undo() -> None:
        for n in path.pop():
            stock.give(n)
        wastes.pop()

    while len(incumbent) > bound and left > 0:
        spare = (len(incumbent) - 1) * capacity - total  # waste that a better packing may have
        if stock.sizes and wastes[-1] <= spare:
            largest = stock.sizes[-1]
            stock.take(largest)
            ways, taken = fillings(stock, capacity - largest)
            left -= taken + 1
            stock.give(largest)
            choices.append(iter([(largest, *way) for way in ways]))
        elif not stock.sizes and len(path) < len(incumbent):
            incumbent = [list(b) for b in path]
            continue
        while choices:
            way = next(choices[-1], None)
            if len(path) == len(choices):
                undo()
            if way is not None:
                break
            choices.pop()
        if not choices:
            break
        for n in way:
            stock.take(n)
        path.append(list(way))
        # The last bin's room is no waste that other pieces could have filled.
        wastes.append(wastes[-1] + (capacity - sum(way) if stock.sizes else 0))
    return full + incumbent


def search_gap(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Of packed rows, by group: sequences and the lower bound of its pieces' lengths (one row a group)."""

    def one(rows: pa.Table) -> pa.Table:
        lengths = rows.column("length").to_pylist()
        return pa.table({"sequences": [len(set(rows.column("sequence_id").to_pylist()))],
                         "bound": [lengths.count(capacity) + lower_bound([n for n in lengths if n < capacity], capacity)]})

    grouped = packed.select("length", "sequence_id", F.shiftright("sequence_id", 32).alias("bucket")).groupBy("bucket")
    return grouped.applyInArrow(one, "sequences long, bound long")


def place(lengths: np.ndarray, order: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each piece (from 0) and its offset there; `order` settles ties."""
    of: dict[int, list[int]] = {}
    for i in order:
        of.setdefault(int(lengths[i]), []).append(i)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, held in enumerate(complete(lengths.tolist(), capacity)):
        at = 0
        for n in held:
            i = of[n].pop()
            bins[i], offsets[i] = k, at
            at += n
    return bins, offsets


def pack(cut: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """`cut` (see `pieces`) without `salt`, with `sequence_id` and `offset`.

    Pieces are dealt by a hash of all that tells them apart and of `salt`, so that copies of one
    document spread over all groups. Empty input gives no rows.
    """
    kept = stage(cut)
    groups = max(1, math.ceil(kept.count() / group_pieces))
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("id", "piece", "ids_crc32", "salt"), F.lit(groups)))
    columns = [c for c in kept.columns if c != "salt"]
    schema = T.StructType([kept.schema[c] for c in columns] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        tie = [rows.column(c).to_numpy() for c in ("salt", "piece", "ids_crc32", "length")]
        bins, offsets = place(tie[-1], np.lexsort(tie), capacity)
        sequence = (key[0].as_py() << 32) + bins
        return rows.select(columns).append_column("sequence_id", pa.array(sequence)).append_column(
            "offset", pa.array(offsets))

    return dealt.groupBy("bucket").applyInArrow(one, schema)


def packed_sequences(docs: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id",
                     text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """All of `docs` packed: a row per piece, with the contract's columns."""
    cut = pieces(docs, capacity, doc_id, text, tokenizer)
    return pack(cut, capacity).withColumnRenamed("id", doc_id)
