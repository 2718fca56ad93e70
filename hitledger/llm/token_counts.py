"""Token counts of documents under a unigram model: pre-tokens in a trie, forward scores once per shared prefix.

The count of a pre-token (a word with the mark of its beginning) is the number of pieces on its best path: the one of greatest
summed log probability, of fewer pieces among equals. The best score of a prefix depends on the prefix alone, so in a trie of the
different pre-tokens of a batch it is computed once per node. The trie is walked in sorted order, which needs no more of it than
the path to the current node; the counts at the terminal nodes are stored and looked up for every occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from hitledger.llm.encoding import slices

BEGIN = "▁"  # how vocabularies write the beginning of a word
REMEMBERED = 200_000  # counted pre-tokens kept by generation (two of them) in a task: some 50 MB
UNKNOWN = 10.0  # how far an unknown character's log probability lies below the least likely piece's


def zipf_scores(model_file: str) -> dict[str, float]:
    """Log probabilities of the pieces of a sentencepiece model by its own order: the r-th has a probability in proportion to 1 / r.

    Control, unknown and byte pieces are left out. The driver reads the file and ships the pieces: a megabyte, whatever the input.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
    return {piece: -math.log(r) - total for r, piece in enumerate(pieces, 1)}


def count_sorted(tokens: list[str], scores: dict[str, float]) -> list[int]:
    """Pieces on the best path of each pre-token; ``tokens`` sorted. An unknown character counts one piece per UTF-8 byte."""
    longest, unknown = max(map(len, scores), default=1), min(scores.values(), default=0.0) - UNKNOWN
    forward, pieces, before, counts = [0.0], [0], "", []  # of every prefix on the path from the root
    for token in tokens:
        shared = 0
        for a, b in zip(before, token):
            if a != b:
                break
            shared += 1
        del forward[shared + 1:], pieces[shared + 1:]
        for end in range(shared + 1, len(token) + 1):
            best, fewest = -math.inf, 0
            for start in range(max(0, end - longest), end):
                score = scores.get(token[start:end])
                if score is not None:
                    score, n = forward[start] + score, pieces[start] + 1
                    if score > best or score == best and n < fewest:
                        best, fewest = score, n
            if token[end - 1] not in scores:
                score, n = forward[end - 1] + unknown, pieces[end - 1] + len(token[end - 1].encode("utf-8", "replace"))
                if score > best:
                    best, fewest = score, n
            forward.append(best)
            pieces.append(fewest)
        counts.append(pieces[-1])
        before = token
    return counts


def token_counts(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """doc_id, n_words, n_tokens of every row; zeros for a null or empty text. Rows that repeat an id are counted each.

    Whole texts, no shuffle: a task keeps the counts of recent pre-tokens and works on a megabyte of text at a time.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(scores)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, known, older = shipped.value, {}, {}
        for batch in batches:
            for doc_ids, texts in slices([batch["doc_id"]], batch["text"]):
                if len(known) > REMEMBERED:
                    known, older = {}, known
                split = [t.split() for t in texts]
                new = set().union(*split) - known.keys()
                known.update((w, older[w]) for w in new if w in older)
                tokens = sorted((BEGIN + w.decode("utf-8", "replace"), w) for w in new if w not in older)
                known.update(zip([w for _, w in tokens], count_sorted([t for t, _ in tokens], scores)))
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array([len(x) for x in split], pa.int64()),
                    pa.array([sum(map(known.__getitem__, x)) for x in split], pa.int64())], names=["doc_id", "n_words", "n_tokens"])
                for w in new:
                    if len(w) > 64:
                        del known[w]

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(count, "doc_id long, n_words long, n_tokens long")
