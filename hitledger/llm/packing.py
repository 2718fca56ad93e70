"""Best-fit packing of token sequences by exact-complement hashing.

Where a piece goes depends on its length alone, so the packing is worked out on the numbers of pieces by length: a table with
``capacity`` entries however many documents there are. It yields kinds of sequences (the lengths in them) with how many of each.
The pieces of a length are numbered across all tasks and the numbers mapped to slots; no piece is moved for that.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, Window as W

from hitledger.llm.common import written
from hitledger.llm.encoding import IDS, encoder_of, read_vocabulary, slices

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids binary, ids_crc32 long, part int, nth long"


class _Counts:
    """Available lengths, with an index of how many pairs of them make every sum."""

    def __init__(self, counts: np.ndarray):
        self.n, self.capacity = counts.copy(), len(counts) - 1
        self.there = self.n > 0
        self.pairs = np.zeros(self.capacity + 1, np.int64)  # ordered pairs of different lengths and twice of each double
        for length in np.flatnonzero(self.there):
            self._index(length, 1)

    def _index(self, length: int, sign: int) -> None:
        others = self.there.copy()
        if sign > 0:
            others[length:] = False  # pairs with greater ones are added when these are
        room = self.capacity - length
        self.pairs[length:] += sign * others[:room + 1]
        if 2 * length <= self.capacity and sign > 0:
            self.pairs[2 * length] += 1

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for length in lengths:
            self.n[length] -= times
        for length in set(lengths):
            if not self.n[length] and self.there[length]:
                self._index(length, -1)
                self.there[length] = False

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.n[x]) // lengths.count(x) for x in lengths)

    def filling(self, first: int) -> tuple[int, ...] | None:
        """``first`` with the one, two or three available lengths that fill its gap exactly, the greatest possible ones first."""
        gap = self.capacity - first
        if gap and self.there[gap] and self.times((first, gap)):
            return first, gap
        for pair in self._pairs(gap, (first,)):
            return first, *pair
        third = np.flatnonzero(self.there[:gap] & (self.pairs[gap:0:-1] > 0))[::-1]
        for c in third:
            if self.times((first, int(c))):
                for pair in self._pairs(gap - int(c), (first, int(c))):
                    return first, int(c), *pair
        return None

    def _pairs(self, total: int, others: tuple[int, ...]) -> Iterator[tuple[int, int]]:
        if total < 2 or not self.pairs[total]:
            return
        small = np.arange(1, total // 2 + 1)
        for a in small[self.there[small] & self.there[total - small]]:
            pair = (total - int(a), int(a))
            if self.times((*others, *pair)):
                yield pair


def pack_lengths(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Kinds of sequences and how many of each hold ``counts[length]`` pieces of every length (at most ``len(counts) - 1``).

    First the combinations that fill a sequence exactly: for each length, from the longest down, the single, pair or triple of
    other lengths that sums to its gap, as often as the counts allow. What is left goes, longest first, where it fits best.
    """
    capacity, kinds = len(counts) - 1, {}
    left = _Counts(counts)

    def done(lengths: tuple[int, ...], times: int) -> None:
        kinds[lengths] = kinds.get(lengths, 0) + times

    if left.n[capacity]:
        done((capacity,), int(left.n[capacity]))
        left.take((capacity,), int(left.n[capacity]))
    for first in range(capacity - 1, (capacity - 1) // 4, -1):
        while left.n[first] and (found := left.filling(first)):
            times = left.times(found)
            done(tuple(sorted(found, reverse=True)), times)
            left.take(found, times)
    open_: dict[int, list] = {}  # gap -> kinds of sequences with that gap
    gaps = np.zeros(capacity + 1, bool)

    def put(gap: int, lengths: tuple[int, ...], times: int) -> None:
        if times and gap:
            open_.setdefault(gap, []).append((lengths, times))
            gaps[gap] = True
        elif times:
            done(lengths, times)

    for length in np.flatnonzero(left.n)[::-1]:
        length, n = int(length), int(left.n[length])
        while n:
            fitting = length + int(np.argmax(gaps[length:]))
            if not gaps[fitting]:
                each = capacity // length
                put(capacity - each * length, (length,) * each, n // each)
                put(capacity - n % each * length, (length,) * (n % each), int(n % each > 0))
                break
            lengths, times = open_[fitting].pop()
            gaps[fitting] = bool(open_[fitting])
            moved = min(times, n)
            put(fitting, lengths, times - moved)
            put(fitting - length, (*lengths, length), moved)
            n -= moved
    for rest in open_.values():
        for lengths, times in rest:
            done(lengths, times)
    return list(kinds.items())


@dataclass(frozen=True)
class Slots:
    """For each length, runs of piece numbers from ``numbers`` on: sequence ids from ``sequences`` on, at ``offsets``."""
    lengths: np.ndarray
    numbers: np.ndarray
    sequences: np.ndarray
    offsets: np.ndarray

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.zeros(len(length), np.int64)
        for value in np.unique(length):
            i, j = np.searchsorted(self.lengths, [value, value + 1])
            here = length == value
            at[here] = i + np.searchsorted(self.numbers[i:j], number[here], "right") - 1
        return self.sequences[at] + number - self.numbers[at], self.offsets[at]


def slots(kinds: list[tuple[tuple[int, ...], int]]) -> Slots:
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, times in kinds:
        offset = 0
        for length in lengths:
            rows.append((length, used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + times
            offset += length
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return Slots(*table.T)


def tokenised_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, spaces: str = "dropped") -> DataFrame:
    """Pieces of the documents' ids: doc_id, piece, start, length, ids, ids_crc32, and (part, nth) that number pieces of a length.

    Each document is its ids and ``end_id``; only longer ones than ``capacity`` are cut. ids are little-endian unsigned 32-bit.
    A null or empty text is its end id alone. Rows that repeat a doc_id are packed each.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.array([end_id], IDS).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part, seen = encoder_of(shipped.value, spaces), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for doc_ids, texts in slices([batch["doc_id"]], batch["text"]):
                rows = []
                for doc_id, ids in zip(doc_ids, encoder.encode(texts)):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at:at + 4 * capacity]
                        length = len(cut) // 4
                        rows.append((doc_id, piece, at // 4, length, cut, zlib.crc32(cut), part, int(seen[length])))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                    pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64()))], names=[
                    x.split()[0] for x in PIECES.split(", ")])

    made = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(encode, PIECES)
    return written(made, "pieces")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (a written table) without ids, with the place of each: sequence_id from 0 and a gapless offset in it."""
    counts = np.zeros(capacity + 1, np.int64)
    parts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    for row in parts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    shipped = pieces.sparkSession.sparkContext.broadcast(astuple(slots(pack_lengths(counts))))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")
    numbered = pieces.drop("ids").join(parts.select("length", "part", before.alias("_before")), ["length", "part"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "part", "nth", (F.col("_before") + F.col("nth")).alias("number"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = Slots(*shipped.value)
        for batch in batches:
            sequence, offset = where.find(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(sequence), pa.array(offset)], names=[
                *batch.schema.names[:7], "sequence_id", "offset"])

    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long, "
                                      "sequence_id long, offset long")


def sequences(pieces: DataFrame, placed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, ids (binary, at most the capacity) and the doc_ids of its pieces, in order."""
    numbered = ["part", "nth", "length"]
    slots_ = pieces.select("doc_id", "ids", *numbered).join(placed.select("sequence_id", "offset", *numbered), numbered).select(
        "sequence_id", F.struct("offset", "ids", "doc_id").alias("slot"))
    ordered = slots_.groupBy("sequence_id").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    joined = F.aggregate("slots", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return ordered.select("sequence_id", joined.alias("ids"), F.col("slots.doc_id").alias("doc_ids"))
