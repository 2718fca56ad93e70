"""Ranked lexical search with geometric blocks of posting lists.

Documents are held as forward vectors (the terms that the queries use, with their weights in the document) in the shared folder. A task
takes a shard of them at a time and gives each term a posting list; a list is cut into blocks of similar documents: all go to the
nearest of a few representatives, by the cosine of their vectors hashed to ``SKETCH`` numbers. A block's summary is the coordinatewise
maximum of its documents' vectors, so its product with a query is no less than any document's score in the block.

For a query, lists whose greatest contributions together can't lift a document over the tenth best score so far need no look. Of the
others, blocks whose summary bound is below that score are skipped and all documents of the remaining blocks are scored in full.
Everything is in integers, so bounds are exact and so is the answer. A list's blocks are made when a query first needs them, and live as
long as the shard; lists no longer than a block are one, and scored outright.

Queries come in blocks of a bounded number of terms, each answered over all documents. Tasks return k documents a query.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, functions as F, Window as W

from hitledger.llm.common import text_or_empty, written
from hitledger.llm.encoding import slices
from hitledger.session import shared_dir

# k1-like and length constants of the score, and what parts terms.
LENGTH_SHARE, SATURATION, UNIT = 75, 8, 1000
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

BLOCK, SKETCH, SHARD_DOCS, SHARD_CELLS, QUERY_TERMS = 128, 64, 2048, 8_000_000, 20_000
FORWARD = "doc_id long, n long, terms binary, times binary"
HITS = "query int, item_id long, doc_id long, score long, part int"


def terms_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII bytes, A-Z in lower case."""
    return text.translate(TERM_BYTES).split()


def term_weight(n_docs: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding + 1)))


def impacts(times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What an occurrence count in a document of so many terms is worth, before the term's weight."""
    m = np.array([100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * n_docs // n_terms for n in lengths.tolist()], np.int64)
    return UNIT**3 * times // (UNIT * times + SATURATION * m)


def _forward(vocabulary: dict[bytes, int]):
    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, texts in slices([batch["doc_id"]], batch["text"]):
                rows = []
                for doc_id, text in zip(doc_ids, texts):
                    terms = terms_of(text)
                    if terms:
                        known = np.array([x for x in map(vocabulary.get, terms) if x is not None], np.int32)
                        ids, times = np.unique(known, return_counts=True)
                        rows.append((doc_id, len(terms), ids.tobytes(), times.astype(np.int64).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["doc_id", "n", "terms", "times"])
    return forward


def _holding(forward: DataFrame, n_vocabulary: int) -> np.ndarray:
    """The number of documents that hold each term of the vocabulary."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_vocabulary, np.int64)
        for batch in batches:
            for raw in batch["terms"].to_pylist():
                counts[np.frombuffer(raw, np.int32)] += 1
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there])], names=["term", "n"])

    counts = np.zeros(n_vocabulary, np.int64)
    for row in forward.select("terms").mapInArrow(partial, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        counts[row["term"]] = row["n"]
    return counts


class Best:
    """The k best documents of a query so far: highest score, then smallest id, rows without one last."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids, self.nulls = k, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """The score that a document must reach to be among them."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        good = scores >= self.least
        if good.any():
            scores, ids, nulls = (np.concatenate([a, b[good]]) for a, b in zip((self.scores, self.ids, self.nulls), (scores, ids, nulls)))
            order = np.lexsort((ids, nulls, -scores))[:self.k]
            self.scores, self.ids, self.nulls = scores[order], ids[order], nulls[order]


class Shard:
    """Documents with posting lists in blocks. ``vectors``: (documents, local terms) of impacts."""

    def __init__(self, ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray, terms: np.ndarray, values: np.ndarray, weights: np.ndarray, block: int = BLOCK):
        self.ids, self.nulls, self.block = ids, nulls, block
        self.terms, local = np.unique(terms, return_inverse=True)
        docs = np.repeat(np.arange(len(ids)), np.diff(np.concatenate([[0], ends])))
        self.vectors = np.zeros((len(ids), len(self.terms)), np.int32)
        self.vectors[docs, local] = values
        by_term = np.argsort(local, kind="stable")
        self.lists = np.split(docs[by_term], np.searchsorted(local[by_term], np.arange(1, len(self.terms)))) if len(self.terms) else []
        self.most = self.vectors.max(axis=0, initial=0).astype(np.int64)
        self.blocks: dict[int, tuple[list[np.ndarray], np.ndarray]] = {}
        self.measured = self.skipped = 0
        mixed = (self.terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)
        sketch = np.zeros((len(ids), SKETCH), np.float32)
        sign = np.where(mixed >> np.uint64(20) & np.uint64(1), 1.0, -1.0)
        np.add.at(sketch, (docs, (mixed % np.uint64(SKETCH)).astype(np.int64)[local]), sign[local] * values * weights[terms])
        self.sketch = sketch / np.maximum(np.sqrt((sketch ** 2).sum(axis=1, keepdims=True)), 1e-9)

    def blocks_of(self, term: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The blocks of a list (numbers of documents) and their summaries."""
        if term not in self.blocks:
            docs = self.lists[term]
            leaders = docs[np.linspace(0, len(docs) - 1, -(-len(docs) // self.block)).astype(np.int64)]
            nearest = (self.sketch[docs] @ self.sketch[leaders].T).argmax(axis=1)
            made = [docs[nearest == i] for i in range(len(leaders))]
            made = [b[low:low + 2 * self.block] for b in made for low in range(0, len(b), 2 * self.block)]
            self.blocks[term] = made, np.stack([self.vectors[b].max(axis=0) for b in made])
        return self.blocks[term]

    def search(self, wanted: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Adds the shard's best documents for a query: its terms (ascending) and each one's weight times its repeats."""
        at = np.searchsorted(self.terms, wanted)
        here = at < len(self.terms)
        here[here] = self.terms[at[here]] == wanted[here]
        at, weights = at[here], weights[here]
        most = self.most[at] * weights
        order = np.argsort(most, kind="stable")
        at, weights, together = at[order], weights[order], np.cumsum(most[order])
        seen = np.zeros(len(self.ids), bool)

        def score(docs: np.ndarray) -> None:
            docs = docs[~seen[docs]]
            if len(docs):
                seen[docs] = True
                self.measured += len(docs)
                best.add(self.vectors[docs][:, at].astype(np.int64) @ weights, self.ids[docs], self.nulls[docs])

        for i in range(len(at) - 1, -1, -1):
            if together[i] < best.least:  # this and all lists before it can't make a document good enough
                return
            term = int(at[i])
            if len(self.lists[term]) <= self.block:
                score(self.lists[term])
                continue
            blocks, summaries = self.blocks_of(term)
            bounds = summaries[:, at].astype(np.int64) @ weights
            for b in np.argsort(-bounds, kind="stable"):
                if bounds[b] < best.least:
                    self.skipped += 1
                    continue
                score(blocks[b])


def _hits(queries: list[tuple], vocabulary_weights: np.ndarray, n_docs: int, n_terms: int, k: int, block: int):
    """queries: (number, item_id, terms, repeats)."""
    size = max(1, min(SHARD_DOCS, SHARD_CELLS // max(1, len(vocabulary_weights))))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                rows = batch.slice(low, size)
                terms = [np.frombuffer(x, np.int32) for x in rows["terms"].to_pylist()]
                times = np.concatenate([np.frombuffer(x, np.int64) for x in rows["times"].to_pylist()])
                each = np.array([len(t) for t in terms])
                lengths = np.repeat(rows["n"].to_numpy(), each)
                nulls = rows["doc_id"].is_null().to_numpy(zero_copy_only=False)
                ids = rows["doc_id"].fill_null(0).to_numpy()
                terms = np.concatenate(terms)
                yield Shard(ids, nulls, np.cumsum(each), terms, impacts(times, lengths, n_docs, n_terms), vocabulary_weights, block)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        best = [Best(k) for _ in queries]
        weighted = [(terms, vocabulary_weights[terms] * repeats) for _, _, terms, repeats in queries]
        weighted = [(terms[w > 0], w[w > 0]) for terms, w in weighted]
        for shard in shards(batches):
            for of_query, found in zip(weighted, best):
                shard.search(*of_query, found)
        part = TaskContext.get().partitionId()
        rows = [(number, item, None if null else doc_id, score, part) for (number, item, *_), b in zip(queries, best) for score, doc_id, null in zip(
            b.scores.tolist(), b.ids.tolist(), b.nulls.tolist())]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (
                pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=[x.split()[0] for x in HITS.split(", ")])
    return hits


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query: first among those of some tasks, then of all, so that no task sorts what all tasks return."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = hits.withColumn("some", F.pmod("part", F.lit(256)))
    for keys in (["query", "some"], ["query"]):
        some = some.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)
    return some.select("item_id", "rank", "doc_id", "score")


def _query_blocks(items: DataFrame, most: int) -> Iterator[list[tuple]]:
    """(item_id, Counter of terms) in lists of at most ``most`` different terms each, or one item. The driver holds one list at a time."""
    held, size = [], 0
    for row in items.select("item_id", text_or_empty().cast("binary").alias("text")).toLocalIterator():
        terms = Counter(terms_of(bytes(row["text"])))
        if held and size + len(terms) > most:
            yield held
            held, size = [], 0
        if terms:
            held.append((row["item_id"], terms))
            size += len(terms)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 10, block: int = BLOCK, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents (doc_id, text) of highest score for each row (item_id, text) of ``items``.

    A document's score is positive or it is not returned; equal scores by ascending doc_id, rows without one last. Rows that repeat a
    doc_id are documents of their own; rows that repeat an item_id are queries of their own, each with ranks from 1. Null and empty
    texts have no terms: such documents count for nothing, such items return nothing. Terms of the whole text count, however long.
    Empty tables give an empty result. Other columns are not read.
    """
    spark, path, made = docs.sparkSession, shared_dir(docs.sparkSession, "hits"), False
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    for queries in _query_blocks(items, query_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
        shipped = spark.sparkContext.broadcast(vocabulary)  # at most ``query_terms`` terms, or those of one item
        forward = written(texts.mapInArrow(lambda batches, v=shipped: _forward(v.value)(batches), FORWARD), "forward")
        totals: Row = forward.agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
        if not totals["docs"]:
            break
        weights = np.array([term_weight(totals["docs"], int(h)) for h in _holding(forward, len(vocabulary))], np.int64)
        numbered = []
        for i, (item_id, terms) in enumerate(queries):
            numbers = np.array(sorted(vocabulary[t] for t in terms), np.int64)
            repeats = {vocabulary[t]: n for t, n in terms.items()}
            numbered.append((i, item_id, numbers, np.array([repeats[x] for x in numbers.tolist()], np.int64)))
        answering = spark.sparkContext.broadcast((numbered, weights, totals["docs"], totals["terms"], k, block))
        hits = forward.mapInArrow(lambda batches, a=answering: _hits(*a.value)(batches), HITS)
        _ranked(hits, k).write.mode("append").parquet(path)
        made = True
    schema = "item_id long, rank int, doc_id long, score long"
    return spark.read.schema(schema).parquet(path) if made else spark.createDataFrame([], schema)
