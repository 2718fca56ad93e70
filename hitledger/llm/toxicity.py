"""Toxicity by multiple-instance learning: a document is as toxic as its sentences make it.

A sentence's score is a logistic model of its words and their beginnings (hashed into ``FEATURES`` weights). A document is toxic if at least one sentence
is: p = 1 - product(1 - p_sentence), noisy-or. Only documents carry labels; the likelihood of these labels under noisy-or trains the
sentence model, which then also tells which sentences offend.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hitledger.llm.encoding import slices

FEATURES = 1 << 18
REMEMBERED = 200_000
SAMPLE, SAMPLE_BYTES = 5_000, 16_384
ENDS, MARKS = (b".", b"!", b"?"), b".,;:!?\"'()[]"
STEMS = (4, 5, 6)  # bytes of the beginnings of a word


@dataclass(frozen=True)
class Model:
    """Weights of hashed features and the bias of a sentence. ``constant``: no labels of both kinds; every score is 0."""
    weights: np.ndarray
    bias: float
    constant: bool = False


def word_features(word: bytes) -> list[int]:
    """Hashes of a word without its punctuation and of its beginnings: inflected and compounded forms share these."""
    bare = word.strip(MARKS)
    return [zlib.crc32(bare + b" ") % FEATURES, *[zlib.crc32(bare[:n]) % FEATURES for n in STEMS]]


def split_sentences(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """(words of all texts with A-Z lower-cased, first word of each sentence, text of each sentence).

    A sentence ends at a line's end or at a word's final . ! or ?
    """
    words, owners, lines = [], [], []
    for i, text in enumerate(texts):
        for line in text.lower().split(b"\n"):
            split = line.split()
            if split:
                words += split
                lines.append(len(words))
                owners.append(i)
    last = np.fromiter([w.endswith(ENDS) for w in words], bool, len(words))
    last[np.array(lines, np.int64) - 1] = True
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), last[:-1]]))
    return words, first, np.array(owners, np.int64)[np.searchsorted(np.array(lines, np.int64), first, "right")]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    """Sentence scores of texts by a model; the weights of recent words are kept."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(score, first word and text of each sentence, number of words)."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        words, first, text = split_sentences(texts)
        for word in set(words) - self.known.keys():
            self.known[word] = float(self.model.weights[word_features(word)].sum())
        values = np.fromiter(map(self.known.__getitem__, words), np.float64, len(words))
        sums = np.add.reduceat(values, first) if len(first) else np.empty(0)
        return logistic(sums + self.model.bias) * (not self.model.constant), first, text, len(words)


def noisy_or(scores: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """1 - product(1 - score) by text; 0 for a text without sentences."""
    return -np.expm1(np.bincount(text, weights=np.log1p(-scores), minlength=n))


def _words_of(texts: list[bytes], at_once: int = 200) -> tuple[np.ndarray, ...]:
    """All words as numbers of different ones, the features of these, first word and text of each sentence, and the number of
    texts that have each feature. Words themselves are held for ``at_once`` texts at a time."""
    kinds: dict[bytes, int] = {}
    of_kind, texts_with = [], np.zeros(FEATURES, np.int32)
    parts: list[tuple] = []
    n_words = 0
    for low in range(0, len(texts), at_once):
        words, first, text = split_sentences(texts[low:low + at_once])
        kind = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int32, len(words))
        of_kind += [np.array(word_features(w), np.int32) for w in islice(kinds, len(of_kind), None)]
        owner = np.repeat(text, np.diff(np.append(first, len(words))))
        held = np.unique(kind.astype(np.int64) * at_once + owner)
        pairs = np.array([of_kind[k] for k in held // at_once], np.int64).reshape(len(held), 1 + len(STEMS)) * at_once + (held % at_once)[:, None]
        texts_with += np.bincount(np.unique(pairs) // at_once, minlength=FEATURES).astype(np.int32)
        parts.append((kind, (first + n_words).astype(np.int32), (text + low).astype(np.int32)))
        n_words += len(words)
    kind, first, text = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int32)]) for i in range(3))
    return kind, np.array(of_kind, np.int32).reshape(len(of_kind), 1 + len(STEMS)), first, text, texts_with


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 90, refined: int = 60, rate: float = 0.1,
        sparsity: float = 6e-4, least: int = 4) -> Model:
    """Weights that make the labels likely, by gradient steps on all texts: ``rounds`` with a penalty on the sum of the weights'
    sizes, which chooses the features, and ``refined`` without it on those.

    Features in fewer than ``least`` texts get no weight.
    """
    kind, of_kind, first, text, texts_with = _words_of(texts)
    if not 0 < labels.sum() < len(labels) or not len(first):
        return Model(np.zeros(FEATURES, np.float32), 0.0, True)
    sizes = np.diff(np.append(first, len(kind)))
    used = np.flatnonzero(texts_with >= least)
    place = np.full(FEATURES, len(used))
    place[used] = np.arange(len(used))
    columns = place[of_kind]
    telling = (columns < len(used)).any(axis=1)  # all other words are as one
    kind, columns = np.where(telling, np.cumsum(telling) - 1, telling.sum())[kind], np.concatenate(
        [columns[telling], np.full((1, columns.shape[1]), len(used))])
    sentence = np.repeat(np.arange(len(first), dtype=np.int32), sizes)
    weights, bias, n = np.zeros(len(used) + 1), -5.0, len(texts)
    speed, spread = np.zeros(len(used) + 2), np.zeros(len(used) + 2)
    toxic, open_ = labels[text] > 0, np.ones(len(used) + 1)
    for step in range(1, rounds + refined + 1):
        scores = logistic(np.add.reduceat(weights[columns].sum(axis=1)[kind], first) + bias)
        document = np.clip(noisy_or(scores, text, n), 1e-9, 1 - 1e-9)[text]
        pull = np.where(toxic, -scores * (1 - document) / document, scores) / n
        by_kind = np.bincount(kind, weights=pull[sentence], minlength=len(columns))
        by_column = np.bincount(columns.ravel(), weights=np.repeat(by_kind, columns.shape[1]), minlength=len(used) + 1)
        slope = np.append(by_column, pull.sum())
        speed, spread = 0.9 * speed + 0.1 * slope, 0.99 * spread + 0.01 * slope ** 2
        scale = rate / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-6)
        moved = speed / (1 - 0.9 ** step) * scale
        weights, bias = weights - moved[:-1] * open_, bias - moved[-1]
        if step <= rounds:
            weights = np.sign(weights) * np.maximum(0, np.abs(weights) - sparsity * np.minimum(scale[:-1], 2000 * rate))
        if step == rounds:
            open_ = (weights != 0).astype(np.float64)
        weights[-1] = 0.0
    whole = np.zeros(FEATURES, np.float32)
    whole[used] = weights[:-1]
    return Model(whole, float(bias))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from at most ``sample`` labelled documents of at most ``sample_bytes`` bytes each that are not held out.

    The sample is drawn by a hash of doc_id and sent to the driver (``sample * sample_bytes`` bounds it): of rows that
    repeat an id, one text stands for each label, that of least hash. Null labels teach nothing.
    """
    marked = labels.filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_labelled"), "toxic")
    drawn = marked.select("*", F.xxhash64("_labelled").alias("_order")).orderBy("_order", "toxic").limit(sample)
    labelled = docs.select("doc_id", F.col("text").cast("binary").alias("text")).filter(F.octet_length("text") <= sample_bytes).join(
        F.broadcast(drawn), F.col("doc_id") == F.col("_labelled"))
    least = F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))
    rows = labelled.groupBy("_order", "_labelled", "toxic").agg(least.alias("least")).collect()
    rows = sorted((x["_order"], bytes(x["least"]["text"]), x["toxic"]) for x in rows)
    return fit([x[1] for x in rows], np.array([x[2] for x in rows], np.int64))


def score_documents(docs: DataFrame, model: Model, offending: float = 0.5) -> DataFrame:
    """doc_id, score, sentences: all sentences that score ``offending`` or more, worst first, as (start, end, score) in words.

    Whole texts; a null or empty text scores 0. Rows that repeat an id are scored each.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.constant))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shipped.value))
        for batch in batches:
            for doc_ids, texts in slices([batch["doc_id"]], batch["text"]):
                scores, first, text, n = scorer.score(texts)
                ends = np.append(first[1:], n)
                base = np.concatenate([first, [0]])[np.minimum(np.searchsorted(text, np.arange(len(texts))), len(first))]
                found: list[list] = [[] for _ in texts]
                for i in np.flatnonzero(scores >= offending):
                    start = base[text[i]]
                    found[text[i]].append({"start": int(first[i] - start), "end": int(ends[i] - start), "score": float(scores[i])})
                found = [sorted(x, key=lambda s: (-s["score"], s["start"])) for x in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(noisy_or(scores, text, len(texts))),
                    pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    names=["doc_id", "score", "sentences"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        score, "doc_id long, score double, sentences array<struct<start:int,end:int,score:double>>")
