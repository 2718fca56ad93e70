"""Ranked lexical search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from hitledger.llm import lexical
from tests.llm.corpus import EDGES, lower, table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, k=10):
    held = [(doc_id, Counter(TERM.findall(lower(text)))) for doc_id, text, *_ in docs]
    held = [(doc_id, c) for doc_id, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    holding = Counter(t for _, c in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in TERM.findall(lower(text)) if c[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc_id, -score) for rank, (score, null, doc_id) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    asked = spark.createDataFrame([(i, t, "x", -1) for i, t in items], "item_id long, text string, doc_id string, score long")
    return sorted((tuple(r) for r in lexical.search(docs, asked, **options).collect()), key=repr)


def corpus(seed):
    draw = random.Random(seed)
    vocabulary = [f"{c}{i}" for i in range(40) for c in ("a", "Ä", "x9")]
    docs = [(i, " ".join(draw.choice(vocabulary[:3 + draw.randrange(118)]) for _ in range(draw.randrange(60))), "en", "s") for i in range(700)]
    items = [(i, "; ".join(draw.choices(vocabulary, k=draw.randrange(1, 25)))) for i in range(40)]
    return docs, items


def test_awkward_rows(spark):
    items = [(1, "hello WORLD hello"), (1, "w0 ärger same line"), (2, None), (3, " .,- "), (None, "no id w1edd"), (5, "x" * 5000), (6, "\x00y É"),
             (7, EDGES[14][1])]
    docs = [*EDGES, *[(60 + i, f"filler {i} text", "en", "a") for i in range(40)]]
    assert found(spark, table(spark, docs), items) == brute(docs, items)
    assert found(spark, table(spark, docs), items, query_terms=2) == brute(docs, items)
    assert found(spark, table(spark, []), items) == found(spark, table(spark, docs), []) == found(spark, table(spark, docs[:3]), items) == []


def test_blocks_lose_nothing(spark):
    """Lists far longer than a block, many ties and equal documents; blocks of every size give the same answer."""
    docs, items = corpus(3)
    docs += [(1000 + i, docs[i % 5 + 30][1], "en", "s") for i in range(60)]
    want = brute(docs, items)
    for block in (2, 7, 128):
        assert found(spark, table(spark, docs).repartition(3), items, block=block) == want
    assert found(spark, table(spark, docs), items, k=1) == brute(docs, items, 1)


def test_summaries_bound_and_skip():
    """Every block's summary is no less than its members in any coordinate, every document is in one block of the list, and blocks are skipped."""
    draw = np.random.default_rng(5)
    topics = [draw.choice(200, 20, replace=False) for _ in range(12)]
    terms = [np.unique(np.append(draw.choice(topics[i % 12], 8), [200])).astype(np.int32) for i in range(600)]
    ends = np.cumsum([len(t) for t in terms])
    flat = np.concatenate(terms)
    values = draw.integers(1, 1000, len(flat))
    shard = lexical.Shard(np.arange(600), np.zeros(600, bool), ends, flat, values, np.ones(201, np.int64), block=16)
    common = int(np.searchsorted(shard.terms, 200))
    blocks, summaries = shard.blocks_of(common)
    assert sorted(np.concatenate(blocks).tolist()) == sorted(shard.lists[common].tolist()) == list(range(600))
    for block, summary in zip(blocks, summaries):
        assert len(block) <= 32 and (shard.vectors[block] <= summary).all() and (shard.vectors[block].max(axis=0) == summary).all()
    best, query = lexical.Best(5), np.append(topics[3][:3], 200).astype(np.int32)
    query.sort()
    weights = np.where(query == 200, 5, 1)
    shard.search(query, weights, best)
    everything = (shard.vectors[:, np.searchsorted(shard.terms, query)].astype(np.int64) @ weights).tolist()
    assert best.scores.tolist() == sorted(everything, reverse=True)[:5]
    assert shard.skipped and shard.measured < 600
    by_score = defaultdict(list)
    for i, s in enumerate(everything):
        by_score[s].append(i)
    assert all(i in by_score[s] for i, s in zip(best.ids.tolist(), best.scores.tolist()))
