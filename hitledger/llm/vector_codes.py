"""Product codes of vectors, learned with norm-of-sum bounds.

Vectors are cut into equal parts, each part has a codebook of its own. Rounds assign every part to its nearest entry and move each
entry to the floor of its parts' mean, in integers throughout. The codebooks of all rounds are kept (``rounds`` times ``parts`` times
``entries`` short lists, whatever the number of vectors). For every part and group of entries a vector carries a lower bound on the
distance to the group's nearest entry and the round in which that was measured. A later round lessens it by the greatest true
displacement of an entry of the group between the two rounds, the norm of the summed moves, which is never more than the sum of
their norms; a part whose own entry is nearer than what is left has no rival in the group. Only groups that fail this are measured
again, exactly, and stamped anew.

Vectors travel in blocks of at most ``BLOCK``, as rows of binary columns written to the shared folder each round. Entries' sums are
added up in every task before they are shuffled; the driver holds codebooks and sums, nothing that grows with the vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hitledger.llm.common import joined_back, written

SCALE, PARTS, ENTRIES, ROUNDS, GROUPS = 256, 16, 64, 2, 4
BLOCK = 4096
SAFE = 1 - 1e-6  # bounds are compared with this much to spare, far more than doubles lose
STATE = "vec_ids array<long>, labels array<string>, vectors binary, codes binary, bounds binary, stamps binary, errors array<long>, sums binary"
_STATE_TYPES = [pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4, pa.list_(pa.int64()), pa.binary()]
_STATE_NAMES = [x.split()[0] for x in STATE.split(", ")]


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~bad, F.lit(False))


def scaled(vector: Column) -> Column:
    """Each component x as floor(SCALE * x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


@dataclass
class Codes:
    """``rows``: vec_id, label, codes (array of entry numbers in part order), error. ``history``: the codebooks of all rounds, the last
    being the one of the codes, each of shape (parts, entries, width); None where there were no vectors."""
    rows: DataFrame
    history: list[np.ndarray] | None

    def reconstruct(self) -> DataFrame:
        """vec_id, label and the vector that the codes stand for, in units of the input."""
        books = None if self.history is None else (self.history[-1] / SCALE).tolist()
        if books is None:
            return self.rows.select("vec_id", "label", F.array().cast("array<double>").alias("vector"))
        table = F.array(*[F.array(*[F.array(*map(F.lit, e)) for e in book]) for book in books])
        return self.rows.select("vec_id", "label", F.flatten(F.transform("codes", lambda c, p: table[p][c])).alias("vector"))

    def digest(self) -> str:
        """SHA-256 of the final entries' components by part, entry and position, decimal, with commas."""
        flat = [] if self.history is None else self.history[-1].reshape(-1).tolist()
        return hashlib.sha256(",".join(map(str, flat)).encode()).hexdigest()


def _displacement(history: list[np.ndarray], groups: list[np.ndarray]) -> np.ndarray:
    """By round, part and group: the furthest that an entry of the group has moved, net, from that round's codebook to the last."""
    moved = [np.sqrt(((history[-1] - then).astype(np.float64) ** 2).sum(axis=2)) for then in history]
    return np.stack([np.stack([m[:, g].max(axis=1) for g in groups], axis=1) for m in moved]) * (1 + 1e-9)


def _squares(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of every part (rows) to every entry."""
    return ((parts[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)


def _below(values: np.ndarray) -> np.ndarray:
    """As half-precision numbers that are not greater."""
    half = np.minimum(values, 65504.0).astype(np.float16)
    over = half.astype(np.float64) > values
    half[over] = np.nextafter(half[over], np.float16(-np.inf))
    return np.maximum(half, np.float16(0))


def assign(vectors: np.ndarray, history: list[np.ndarray], codes: np.ndarray | None, bounds: np.ndarray | None,
           stamps: np.ndarray | None, n_groups: int = GROUPS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of the last codebook of ``history``, ties to the lower number: (codes, bounds, stamps, squared distances, number
    of distances measured). ``vectors`` has shape (n, parts, width); without ``codes`` everything is measured."""
    now, book = len(history) - 1, history[-1]
    n, parts, _ = vectors.shape
    groups = np.array_split(np.arange(book.shape[1]), min(n_groups, book.shape[1]))
    group_of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    moved, rows, measured = _displacement(history, groups), np.arange(n), 0
    fresh = codes is None
    codes = np.zeros((n, parts), np.uint8) if fresh else codes.copy()
    bounds = np.zeros((n, parts, len(groups)), np.float16) if fresh else bounds.copy()
    stamps = np.zeros((n, parts, len(groups)), np.uint8) if fresh else stamps.copy()
    squared = np.empty((n, parts), np.int64)
    for p in range(parts):
        part, old = vectors[:, p], codes[:, p].astype(np.int64)
        own = ((part - book[p][old]) ** 2).sum(axis=1)
        measured += n
        best, at = own.copy(), old.copy()
        left = bounds[:, p].astype(np.float64) - moved[stamps[:, p], p, np.arange(len(groups))]
        rivals = ~(np.sqrt(own)[:, None] < left * SAFE)
        if fresh:
            rivals[:] = True
        rescanned = {}
        for g, members in enumerate(groups):
            again = np.flatnonzero(rivals[:, g])
            if not len(again):
                continue
            found = _squares(part[again], book[p][members])
            measured += found.size
            rescanned[g] = again, found
            nearest = found.argmin(axis=1)
            value, number = found[np.arange(len(again)), nearest], members[nearest]
            better = (value < best[again]) | ((value == best[again]) & (number < at[again]))
            best[again[better]], at[again[better]] = value[better], number[better]
        for g, (again, found) in rescanned.items():
            inside = np.flatnonzero(group_of[at[again]] == g)
            others = found.astype(np.float64)
            others[inside, at[again[inside]] - groups[g][0]] = np.inf
            bounds[again, p, g] = _below(np.sqrt(others.min(axis=1)))
            stamps[again, p, g] = now
        left_behind = np.flatnonzero(at != old)  # the entry given up is a rival from now on
        if not fresh and len(left_behind):
            g = group_of[old[left_behind]]
            kept = left_behind[~rivals[left_behind, g]]
            g = group_of[old[kept]]
            bounds[kept, p, g] = _below(np.minimum(left[kept, g], np.sqrt(own[kept])))
            stamps[kept, p, g] = now
        codes[:, p], squared[:, p] = at, best
    return codes, bounds, stamps, squared, measured


def _sums(vectors: np.ndarray, codes: np.ndarray, entries: int) -> np.ndarray:
    """Parts of each entry and the sums of their components, of shape (parts, entries, 1 + width)."""
    n, parts, width = vectors.shape
    out = np.zeros((parts, entries, 1 + width), np.int64)
    for p in range(parts):
        np.add.at(out[p], codes[:, p], np.concatenate([np.ones((n, 1), np.int64), vectors[:, p]], axis=1))
    return out


def _round(history: list[np.ndarray], width: int, groups: int):
    """One assignment of blocks; also of raw rows (vec_id, label, v), which become blocks."""
    parts, entries = history[-1].shape[:2]
    g = min(groups, entries)

    def block(vec_ids, labels, vectors: np.ndarray, codes=None, bounds=None, stamps=None) -> pa.RecordBatch:
        new = assign(vectors, history, codes, bounds, stamps, groups)
        values = (vec_ids, labels, vectors.astype("<i4").tobytes(), *[x.tobytes() for x in new[:3]], new[3].sum(axis=1).tolist(),
                  _sums(vectors, new[0], entries).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _STATE_TYPES)], names=_STATE_NAMES)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                cut = batch.slice(low, BLOCK)
                vectors = pc.list_flatten(cut["v"]).to_numpy().reshape(-1, parts, width)
                yield block(cut["vec_id"].to_pylist(), cut["label"].to_pylist(), vectors)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch[c][i].as_py() for c in ("vec_ids", "labels", "vectors", "codes", "bounds", "stamps")}
                n = len(row["vec_ids"])
                yield block(row["vec_ids"], row["labels"], np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(n, parts, width),
                            np.frombuffer(row["codes"], np.uint8).reshape(n, parts),
                            np.frombuffer(row["bounds"], np.float16).reshape(n, parts, g),
                            np.frombuffer(row["stamps"], np.uint8).reshape(n, parts, g))
    return first, later


def _moved(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The codebook after an update: floors of means, unused entries as they are."""
    shape = (*book.shape[:2], 1 + book.shape[2])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for raw in batch["sums"].to_pylist():
                total += np.frombuffer(raw, np.int64).reshape(shape)
        part, entry = np.nonzero(total[:, :, 0])
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(
            total[part, entry].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "total"])

    totals = state.select("sums").mapInArrow(partial, "part int, entry int, total array<long>")
    columns = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(shape[2])]
    new = book.copy()
    for row in totals.groupBy("part", "entry").agg(*columns).collect():  # at most one row an entry
        new[row["part"], row["entry"]] = [int(row[f"t{i}"]) // int(row["t0"]) for i in range(1, shape[2])]
    return new


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, groups: int = GROUPS) -> Codes:
    """Codes of the rows (vec_id, embedding, label) of ``vectors`` whose vector is there and finite; others are dropped.

    The codebooks start as the parts of the ``entries`` rows of smallest vec_id: rows that share an id in the order of their
    vectors, a null id after all others, fewer entries if there are fewer rows. Rows that repeat an id are coded each. Vectors can be
    coded if they have the most frequent length (of equally frequent ones the greatest) among lengths that ``parts`` divides, and
    no component so large that distances leave 64 bits (about 130,000 at 1,024 components); other finite ones have null codes and a
    null error, and do not move entries. An empty table gives an empty result. Other columns are not read.
    """
    if entries > 256:
        raise ValueError("a code is one byte")
    spark = vectors.sparkSession
    kept = vectors.filter(usable(F.col("embedding"))).select("vec_id", F.col("label").cast("string").alias("label"), "embedding")
    lengths = kept.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("rows")).filter(f"n > 0 AND n % {parts} = 0")
    common = lengths.orderBy(F.col("rows").desc(), F.col("n").desc()).first()
    dims = common["n"] if common else 0
    most = isqrt(2**62 // dims) // 2 if dims else 0
    fits = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: F.abs(x.cast("double") * SCALE) > min(most, 2**31 - 2)) & F.lit(dims > 0)
    coded = kept.filter(fits).select("vec_id", "label", scaled(F.col("embedding")).alias("v"))
    uncoded = kept.filter(~fits).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    first = [x["v"] for x in coded.select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()]
    if not first:
        return Codes(uncoded, None)
    width = dims // parts
    book = np.array(first, np.int64).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    history, state = [book], None
    for _ in range(rounds + 1):
        start, later = _round(list(history), width, groups)
        made = coded.mapInArrow(start, STATE) if state is None else state.drop("errors", "sums").mapInArrow(later, STATE)
        state = written(made, f"codes{len(history)}")
        if len(history) <= rounds:
            history.append(_moved(state, history[-1]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.uint8).reshape(-1, parts).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(row["vec_ids"], pa.int64()), pa.array(row["labels"], pa.string()), pa.array(
                    codes, pa.list_(pa.int32())), pa.array(row["errors"], pa.int64())], names=["vec_id", "label", "codes", "error"])

    listed = state.select("vec_ids", "labels", "codes", "errors").mapInArrow(rows, "vec_id long, label string, codes array<int>, error long")
    return Codes(listed.unionByName(uncoded), history)


def with_label_error(rows: DataFrame) -> DataFrame:
    """``rows`` with label_error: the errors of all rows of the label added up (nulls are one label; null errors count nothing)."""
    return joined_back(rows, ["label"], F.sum("error").alias("label_error"))
