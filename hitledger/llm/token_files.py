"""Token-id files in a static range asymmetric numeral system (rANS).

A file is a row of groups, in ascending doc_id order; a group holds whole documents, about ``GROUP_IDS`` ids. Its frequency table (ids
and freqs, summing to 2**SCALE) is shared by its blocks of ``BLOCK_IDS`` ids, which are independent of each other. A block is cut by
checkpoints every ``STEPS`` steps of ``LANES`` interleaved coders; the coders' states at each checkpoint are stored, so all stretches
between checkpoints are decoded at once, and any one can be decoded alone. Each group carries the CRC-32 of its blocks and of its ids.

A block, little-endian: ids u64, stretches u32, words u32, then the states (stretches x LANES, u64), the words of each stretch
(u32) and the words themselves (u32). A table: its ids, then its freqs, u32, deflated. Files are Spark's: written by its committer, read from any store it
reads, group by group.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from hitledger.llm.common import small_table
from hitledger.llm.encoding import IDS, encoder_of, read_vocabulary, slices

SCALE, LANES, STEPS = 20, 32, 256
BLOCK_IDS, GROUP_IDS = 1 << 20, 1 << 21
LOW, WORD_BITS = np.uint64(1 << 31), np.uint64(32)
_HEAD = "<QII"


class Coder:
    """Encodes and decodes ids by a table of (id, freq) whose freqs sum to 2**SCALE."""

    def __init__(self, ids: np.ndarray, freqs: np.ndarray):
        self.ids, self.freqs = ids.astype(np.int64), freqs.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.freqs)[:-1]]).astype(np.uint64)
        self.place = np.zeros(int(ids.max(initial=-1)) + 1, np.int32)
        self.place[ids] = np.arange(len(ids))
        self.slots = np.repeat(np.arange(len(ids)), freqs.astype(np.int64)).astype(np.int32)

    def encode(self, ids: np.ndarray) -> bytes:
        stretches = -(-len(ids) // (LANES * STEPS))
        padded = np.full(stretches * STEPS * LANES, -1, np.int32)
        padded[:len(ids)] = self.place[ids]
        grid = padded.reshape(stretches, STEPS, LANES)
        states = np.full((stretches, LANES), LOW, np.uint64)
        whole_steps = (len(ids) - (stretches - 1) * LANES * STEPS) // LANES
        words, owners = [], []
        for step in range(STEPS - 1, -1, -1):
            s = grid[:, step]
            full = None if step < whole_steps else s >= 0  # all coders have an id, or some
            if full is not None and not full.any():
                continue
            f, c = self.freqs[s], self.starts[s]
            spill = states >= f << np.uint64(63 - SCALE)
            if full is not None:
                spill &= full
            words.append((states[spill] & np.uint64(0xFFFFFFFF)).astype(IDS))
            owners.append(np.nonzero(spill)[0])
            x = np.where(spill, states >> WORD_BITS, states)
            quotient = x // f
            x = (quotient << np.uint64(SCALE)) + (x - quotient * f) + c
            states = x if full is None else np.where(full, x, states)
        owner = np.concatenate([*owners[::-1], np.empty(0, np.int64)])
        stream = np.concatenate([*words[::-1], np.empty(0, IDS)])[np.argsort(owner, kind="stable")]
        counts = np.bincount(owner, minlength=stretches).astype(IDS)
        return b"".join([struct.pack(_HEAD, len(ids), stretches, len(stream)), states.astype("<u8").tobytes(), counts.tobytes(),
                         stream.astype(IDS).tobytes()])

    def decode(self, payload: bytes, only: range | None = None) -> np.ndarray:
        """All ids of a block, or those of the stretches ``only``."""
        n, stretches, n_words = struct.unpack_from(_HEAD, payload)
        at = struct.calcsize(_HEAD)
        states = np.frombuffer(payload, "<u8", stretches * LANES, at).reshape(stretches, LANES)
        counts = np.frombuffer(payload, IDS, stretches, at + states.nbytes).astype(np.int64)
        stream = np.frombuffer(payload, IDS, n_words, at + states.nbytes + 4 * stretches).astype(np.uint64)
        chosen = only if only is not None else range(stretches)
        first, last = chosen.start, chosen.stop
        states, next_word = states[first:last].copy(), np.cumsum(counts)[first:last] - counts[first:last]
        left = np.clip(n - np.arange(first, last) * LANES * STEPS, 0, LANES * STEPS)
        out = np.zeros((last - first, STEPS, LANES), np.int32)
        mask, lane, whole_steps = np.uint64((1 << SCALE) - 1), np.arange(LANES), left.min(initial=0) // LANES
        for step in range(STEPS):
            full = None if step < whole_steps else step * LANES + lane < left[:, None]
            if full is not None and not full.any():
                break
            slot = states & mask
            s = self.slots[slot]
            out[:, step] = s
            x = self.freqs[s] * (states >> np.uint64(SCALE)) + slot - self.starts[s]
            need = x < LOW
            if full is not None:
                need &= full
            where = (next_word[:, None] + np.cumsum(need, axis=1) - 1)[need]
            x[need] = (x[need] << WORD_BITS) | stream[where]
            next_word += need.sum(axis=1)
            states = x if full is None else np.where(full, x, states)
        return self.ids[out.reshape(-1)[:int(left.sum())]].astype(IDS)


def table_of(ids: np.ndarray, scale: int = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """The different ``ids`` and their freqs: at least 1 each, in proportion otherwise, summing to 2**scale."""
    counts = np.bincount(ids)
    there = np.flatnonzero(counts)
    n = counts[there].astype(np.float64)
    if len(there) > 1 << scale:
        raise ValueError("more different ids than the table has room for")
    if not len(there):
        return there, there
    freqs = np.maximum(1, np.floor(n / n.sum() * ((1 << scale) - len(there)))).astype(np.int64)
    freqs[np.argmax(n)] += (1 << scale) - freqs.sum()
    return there, freqs


FIELDS = [("part", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
          ("table", pa.binary()), ("blocks", pa.list_(pa.binary())), ("blocks_crc32", pa.int64()), ("ids_crc32", pa.int64())]
SCHEMA = ("part int, start long, n_ids long, doc_ids array<long>, lengths array<long>, table binary, blocks array<binary>, "
          "blocks_crc32 long, ids_crc32 long")


def encode_group(part: int, start: int, doc_ids: list, ids: list[bytes], block_ids: int = BLOCK_IDS) -> tuple:
    """A group's row from its documents' ids."""
    joined = b"".join(ids)
    every = np.frombuffer(joined, IDS)
    table = table_of(every)
    coder = Coder(*table)
    blocks = [coder.encode(every[at:at + block_ids]) for at in range(0, len(every), block_ids)]
    return (part, start, len(every), doc_ids, [len(x) // 4 for x in ids], zlib.compress(np.stack(table, axis=0).astype(IDS).tobytes()), blocks,
            zlib.crc32(b"".join(blocks)), zlib.crc32(joined))


def decode_group(row: dict) -> bytes:
    """All ids of a group, little-endian unsigned 32-bit; an error if it is damaged."""
    where = f"group {row['part']}/{row['start']}"
    if zlib.crc32(b"".join(row["blocks"])) != row["blocks_crc32"]:
        raise ValueError(f"{where} is damaged")
    coder = Coder(*np.frombuffer(zlib.decompress(row["table"]), IDS).reshape(2, -1).astype(np.int64))
    raw = b"".join(coder.decode(block).tobytes() for block in row["blocks"])
    if zlib.crc32(raw) != row["ids_crc32"]:
        raise ValueError(f"{where} does not decode to the ids it was made of")
    return raw


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, spaces: str = "attached", group_ids: int = GROUP_IDS,
                      block_ids: int = BLOCK_IDS, files: int | None = None) -> None:
    """Encodes every text of ``docs``, appends ``end_id``, and writes the files to ``path`` in ascending doc_id order.

    A null text counts as empty; a null doc_id comes first. Rows that repeat a doc_id are written each, in the order of a hash of
    their texts. Texts are dealt by ranges of doc_id to ``files`` files, or as many as Spark's shuffle settings give; a task's
    memory is bounded by a group. No table of all ids is ever made: one pass tokenises, counts and encodes.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    end = np.array([end_id], IDS).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part, before = encoder_of(shipped.value, spaces), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        held: list[bytes] = []
        size = 0

        def group() -> pa.RecordBatch:
            row = encode_group(part, before, doc_ids, held, block_ids)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, (_, t) in zip(row, FIELDS)], names=[n for n, _ in FIELDS])

        for batch in batches:
            for new, texts in slices([batch["doc_id"]], batch["text"]):
                for doc_id, ids in zip(new, encoder.encode(texts)):
                    doc_ids.append(doc_id)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= group_ids:
                        yield group()
                        doc_ids, held, before, size = [], [], before + size, 0
        if held:
            yield group()

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange(*([files] if files else []), "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
    ordered.drop("_tie").mapInArrow(encode, SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and ids unless ``with_ids`` is false.

    Every document of the files; everything is decoded and the groups' checksums verified either way.
    """
    groups = spark.read.schema(SCHEMA).parquet(path)
    base, before = [], 0
    for x in groups.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():  # one row a file
        base.append((x["part"], before))
        before += x["n"]
    bases = small_table(spark, base, "part int, _base long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                raw = decode_group(row)
                ends = np.cumsum(row["lengths"])
                starts = ends - row["lengths"]
                for low in range(0, len(ends), 2000):
                    a, z = starts[low:low + 2000], ends[low:low + 2000]
                    ids = [raw[4 * x:4 * y] for x, y in zip(a, z)]
                    columns = [pa.array(row["doc_ids"][low:low + 2000], pa.int64()), pa.array(a + row["start"] + row["_base"]),
                               pa.array(z - a), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns[:len(names)], names=names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][:4 + with_ids]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    return groups.join(bases, "part").mapInArrow(decode, schema)
