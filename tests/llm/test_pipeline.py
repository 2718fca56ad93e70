"""The pipeline against its stages done by hand."""

from collections import defaultdict

import corpus_pipeline
from hitledger.llm.common import written
from tests.llm.corpus import EDGES, lower, prose, table, words
from tests.llm.test_dedup import SF_DIR, similarity
from tests.llm.test_models import statistics


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF_DIR), "test"))
    assert all(frame.columns == columns for frame in kept[:-1])
    rows = [[tuple(r) for r in frame.collect()] for frame in kept]
    # Too few labels for cutoffs at this size: the base rules alone decide.
    assert sorted(rows[1]) == sorted(r for r in rows[0] if not statistics(r[1])[-1])
    largest = {}
    for r in rows[1]:
        largest[lower(r[1])] = max(largest.get(lower(r[1]), r), r)
    assert sorted(rows[2]) == sorted(largest.values())
    ordered = sorted(rows[2])
    least = list(range(len(ordered)))  # of the documents that all pairs of similar ones connect

    def find(x):
        while least[x] != x:
            x = least[x]
        return x
    for i, a in enumerate(ordered):
        for j in range(i):
            if similarity(a[1], ordered[j][1]) >= 0.8:
                x, y = find(i), find(j)
                least[max(x, y)] = min(x, y)
    assert sorted(rows[3]) == [r for i, r in enumerate(ordered) if find(i) == i]
    times = defaultdict(int)
    for r in rows[4]:
        times[r] += 1
    assert set(times) <= set(rows[3]) and max(times.values()) <= 2
    total = sum(len(words(r[1])) for r in rows[3])
    assert abs(sum(len(words(r[1])) for r in rows[4]) - 1.5 * total) < 0.05 * total
    packed = kept[5].filter("piece = 0").groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in packed} == {r[0]: n for r, n in times.items()}
    assert corpus_pipeline.ORACLE_SQL is None


def test_awkward_rows_and_an_empty_table(spark):
    """Null, empty, very long, repeated and clashing rows pass every stage; so does a table without rows."""
    for rows in ([*EDGES, *[(500 + i, prose(80, 50 + i), "en", None if i % 3 else "a") for i in range(20)]], []):
        docs = table(spark, rows)
        columns = docs.columns
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, SF_DIR), "test")
            assert docs.columns == columns
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
        assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").isEmpty()
        assert packed.filter("piece = 0").count() == docs.count() and (not rows) == docs.isEmpty()
        ids = {r["doc_id"] for r in docs.collect()}
        assert not ids & {0, 1, 2, 3, 14} and (not rows or {500, 519, 13} <= ids)
