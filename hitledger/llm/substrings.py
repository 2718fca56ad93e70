"""Substring dedup by difference-cover anchors.

A repeated window of ``WINDOW`` words, wherever it starts in its documents, holds some stretch of ``ANCHOR`` words at a position that is
in the cover in both of them: the differences of ``COVER`` modulo ``PERIOD`` are all residues. So only stretches at cover positions are
hashed (4 in 13). Windows around anchors that occur more than once are then hashed in full, 128 bits; of equal ones the first stays.

Documents are dealt to ``part``s by their id. What a part asks of the corpus (is this anchor repeated?) goes out once per slice of
documents and anchor, packed by hash bucket; so a passage shared by a third of all documents sends a row a slice. Who holds the
first of equal windows is a minimum with partial aggregation, and only that holder is told. No group of equal passages ever meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hitledger.llm.common import arrow_table, written
from hitledger.llm.encoding import slices

WINDOW, PERIOD = 20, 13
COVER = (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
PART_BYTES = 16_000_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64


class Words:
    """The words of several texts in one buffer, single spaces between them."""

    def __init__(self, texts: list[bytes]):
        self.texts = [b" ".join(t.split()) for t in texts]
        self.counts = np.array([t.count(b" ") + 1 if t else 0 for t in self.texts], np.int64)
        self.buffer = b" ".join([t for t in self.texts if t])
        letters = np.frombuffer(self.buffer, np.uint8)
        gaps = np.flatnonzero(letters == 32)
        n = int(self.counts.sum())
        self.starts = np.concatenate([[0], gaps + 1])[:n].astype(np.int64)
        self.ends = np.concatenate([gaps, [len(letters)]])[:n].astype(np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        self.owner = np.repeat(np.arange(len(texts)), self.counts)
        self.hashes: np.ndarray | None = None

    def _word_hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, from running sums over its bytes."""
        hashed, done = np.empty(len(self.starts), np.uint64), 0
        while done < len(hashed):  # a few megabytes at a time, also inside a very long text
            low = self.starts[done]
            upto = max(done + 1, int(np.searchsorted(self.ends, low + 2_000_000)))
            letters = np.frombuffer(self.buffer, np.uint8)[low:self.ends[upto - 1]].astype(np.uint64) + np.uint64(1)
            hashed[done:upto] = _spans(letters, self.starts[done:upto] - low, self.ends[done:upto] - low, BASES[0])
            done = upto
        return hashed

    def spans(self, at: np.ndarray, length: int, base: int) -> np.ndarray:
        """A 64-bit hash of the ``length`` words from each of the words ``at`` on; another one for each base."""
        if self.hashes is None:
            self.hashes = self._word_hashes()
        return _spans(self.hashes, at, at + length, base)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(word number, hash) of every anchor: the first word at a cover position of its text, all words in that text."""
        n = len(self.starts) - ANCHOR + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.arange(n)
        inside = np.isin((at - self.first[self.owner[:n]]) % PERIOD, COVER) & (self.owner[:n] == self.owner[ANCHOR - 1:])
        at = at[inside]
        return at, self.spans(at, ANCHOR, BASES[0])

    def around(self, anchors: np.ndarray) -> np.ndarray:
        """Numbers of the words at which windows around the given anchors start."""
        n = len(self.starts)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, np.maximum(anchors - (WINDOW - ANCHOR), self.first[self.owner[anchors]]), 1)
        np.add.at(change, anchors + 1, -1)
        last = self.first + self.counts - WINDOW
        return np.flatnonzero((np.cumsum(change)[:n] > 0) & (np.arange(n) <= last[self.owner]))

    def windows(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each window, in two halves."""
        return tuple(self.spans(starts, WINDOW, base).view(np.int64) for base in BASES)


def _spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Hashes of runs of ``values`` (64-bit) from ``begin`` up to ``end``, the same wherever a run lies: polynomials in ``base``, mixed."""
    n = len(values)
    with np.errstate(over="ignore"):
        power, inverse = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, x, np.uint64))]) for x in (base, pow(base, -1, 1 << 64)))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((values ^ np.uint64(base)) * power[:n])])
        x = (sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ x >> np.uint64(29)) * np.uint64(0x9FB21C651E98DF25)
        return x ^ x >> np.uint64(32)


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, texts in slices([batch["part"]], batch["text"]):
                words = Words(texts)
                at, hashed = words.anchors()
                part = np.array(parts, np.int32)[words.owner[at]]
                order = np.lexsort((part, hashed))
                hashed, part = hashed[order], part[order]
                new = np.ones(len(hashed), bool)
                new[1:] = (hashed[1:] != hashed[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                times = np.minimum(np.diff(np.append(first, len(hashed))), 2).astype(np.uint8)
                hashed, part = hashed[first], part[first]
                bucket = (hashed % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                hashed, part, times, bucket = hashed[order], part[order], times[order], bucket[order]
                bounds = np.searchsorted(bucket, np.unique(bucket)).tolist() + [len(bucket)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.unique(bucket), pa.int64()), *[pa.array([x[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())
                                                              for x in (hashed, part, times)]], names=["bucket", "hashes", "parts", "times"])
    return ask


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each bucket (rows sorted by it) the anchors found more than once, by the parts that asked."""
    def answered(held: list[dict]) -> pa.RecordBatch:
        hashed, part, times = (np.frombuffer(b"".join(x[k] for x in held), t) for k, t in (
            ("hashes", np.uint64), ("parts", np.int32), ("times", np.uint8)))
        _, same = np.unique(hashed, return_inverse=True)
        again = np.bincount(same, weights=times)[same] > 1
        hashed, part = hashed[again], part[again]
        order = np.argsort(part, kind="stable")
        hashed, part = hashed[order], part[order]
        who = np.unique(part)
        bounds = [*np.searchsorted(part, who).tolist(), len(part)]
        return pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array(
            [hashed[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], names=["part", "hashes"])

    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and held[-1]["bucket"] != row["bucket"]:
                yield answered(held)
                held = []
            held.append(row)
    if held:
        yield answered(held)


def _runs(numbers: np.ndarray) -> bytes:
    """Ascending numbers as (from, to) pairs of 32-bit integers, the end not included."""
    if not len(numbers):
        return b""
    cut = np.flatnonzero(np.diff(numbers) > 1)
    return np.stack([np.append(numbers[:1], numbers[cut + 1]), np.append(numbers[cut], numbers[-1]) + 1], axis=1).astype(np.int32).tobytes()


def _numbers(runs: bytes) -> np.ndarray:
    pairs = np.frombuffer(runs, np.int32).reshape(-1, 2)
    return np.concatenate([np.arange(a, b) for a, b in pairs]) if len(pairs) else np.empty(0, np.int64)


FOUND = "doc_id long, part int, n_words long, words binary, windows binary"


def _find(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Documents of a part with the starts of the windows around repeated anchors; words only where there are such windows."""
    known = np.unique(np.frombuffer(b"".join(answers["hashes"].to_pylist()), np.uint64))
    rows = []
    for values, texts in slices([docs["doc_id"], docs["part"]], docs["text"]):
        words = Words(texts)
        at, hashed = words.anchors()
        starts = words.around(at[np.isin(hashed, known)])
        bounds = np.searchsorted(starts, np.append(words.first, len(words.starts)))
        for i, (doc_id, part) in enumerate(values):
            own = starts[bounds[i]:bounds[i + 1]] - words.first[i]
            rows.append((doc_id, part, int(words.counts[i]), words.texts[i], _runs(own)))
    return arrow_table(rows, [("doc_id", pa.int64()), ("part", pa.int32()), ("n_words", pa.int64()), ("words", pa.binary()), ("windows", pa.binary())])


def _list_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, doc_id): the hash of each different window of a slice of documents and the smallest id that has it."""
    for batch in batches:
        for values, texts in slices([batch["doc_id"], batch["windows"]], batch["words"]):
            words = Words(texts)
            own = [_numbers(runs) for _, runs in values]
            starts = np.concatenate([n + f for n, f in zip(own, words.first)])
            high, low = words.windows(starts.astype(np.int64))
            ids = np.repeat(np.array([doc_id or 0 for doc_id, _ in values], np.int64), [len(n) for n in own])
            nulls = np.repeat(np.array([doc_id is None for doc_id, _ in values], bool), [len(n) for n in own])
            order = np.lexsort((ids, nulls, low, high))
            high, low, ids, nulls = high[order], low[order], ids[order], nulls[order]
            first = np.ones(len(high), bool)
            first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(high[first]), pa.array(low[first]), pa.array(ids[first], mask=nulls[first])],
                                             names=["high", "low", "doc_id"])


REMOVED = "doc_id long, n_words long, n_removed long, kept binary, removed_spans array<struct<start:int,end:int>>"


def _remove(docs: pa.Table, firsts: pa.Table) -> pa.Table:
    owner, low, nulls = (c.to_numpy() for c in (pc.fill_null(firsts["doc_id"], 0), firsts["low"], pc.is_null(firsts["doc_id"])))
    order = np.lexsort((owner, nulls))
    owner, low, nulls = owner[order], low[order], nulls[order]
    known = int(np.searchsorted(nulls, True))  # rows without an id come last

    def owned(doc_id: int | None) -> np.ndarray:
        return low[known:] if doc_id is None else low[slice(*np.searchsorted(owner[:known], [doc_id, doc_id + 1]))]

    rows = []
    for values, texts in slices([docs["doc_id"], docs["n_words"], docs["windows"]], docs["words"]):
        words, own = Words(texts), [_numbers(runs) for *_, runs in values]
        found = words.windows(np.concatenate([x + f for x, f in zip(own, words.first)]).astype(np.int64))[1]
        ends = np.cumsum([len(x) for x in own])
        for i, (doc_id, n, _) in enumerate(values):
            starts, halves = own[i], found[ends[i] - len(own[i]):ends[i]]
            first = np.zeros(len(starts), bool)
            first[np.unique(halves, return_index=True)[1]] = True
            later = starts[~(first & np.isin(halves, owned(doc_id)))]
            change = np.zeros(n + 1, np.int64)
            np.add.at(change, later, 1)
            np.add.at(change, later + WINDOW, -1)
            gone = np.cumsum(change)[:n] > 0
            spans = np.frombuffer(_runs(np.flatnonzero(gone)), np.int32).reshape(-1, 2)
            split = texts[i].split()
            kept = b" ".join([split[i] for i in np.flatnonzero(~gone)]) if len(spans) else texts[i]
            rows.append((doc_id, n, int(gone.sum()), kept, [{"start": int(a), "end": int(b)} for a, b in spans]))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    return arrow_table(rows, [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary()),
                              ("removed_spans", pa.list_(span))])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space, UTF-8), removed_spans (word numbers, end not included).

    Removes each word covered by a window of WINDOW words that also starts earlier: in a document of smaller doc_id, or before
    in the same document. Windows are judged on the input. Null texts have no words. A null doc_id counts as greater than any
    other; rows that share a doc_id are one place, so none of them is earlier than the other. An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // PART_BYTES))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"), _part(parts).alias("part"))
    asked = texts.select("part", "text").mapInArrow(_ask(4 * parts), "bucket long, hashes binary, parts binary, times binary")
    answers = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "part int, hashes binary")
    found = written(texts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_find, FOUND), "windows")
    pending = found.filter("octet_length(windows) > 0")
    firsts = pending.select("doc_id", "words", "windows").mapInArrow(_list_windows, "high long, low long, doc_id long").groupBy(
        "high", "low").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "low", _part(parts).alias("part"))
    removed = pending.groupBy("part").cogroup(firsts.groupBy("part")).applyInArrow(_remove, REMOVED)
    whole = found.filter("octet_length(windows) = 0").select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("words").alias("kept"),
        F.array().cast("array<struct<start:int,end:int>>").alias("removed_spans"))
    return whole.unionByName(removed)
