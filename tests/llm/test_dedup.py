"""Exact dedup, SimHash near-dedup and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import oracle_check
from hitledger.llm import exact_dedup, oracle, queries, simhash, substrings
from hitledger.llm.components import connected_components
from tests.llm.corpus import EDGES, lower, prose, table, words

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_query_equals_its_sql(spark, name):
    assert oracle_check.differences(queries.QUERIES[name](spark, SF_DIR), oracle.ORACLE[name], oracle_check.connect(SF_DIR)) == []


@pytest.mark.parametrize("content_hash", [exact_dedup.md5_bytes, lambda text: F.lit(b"\0")])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_groups(spark, keep, content_hash):
    """Also with a hash that collides for all texts: bytes decide."""
    got = sorted((tuple(r) for r in exact_dedup.exact_groups(table(spark, EDGES), keep, content_hash=content_hash).collect()), key=repr)
    groups = defaultdict(list)
    for doc_id, text, *_ in EDGES:
        groups[lower(text)].append(doc_id)
    pick = {"min": min, "max": max}[keep]
    want = []
    for doc_id, text, *_ in EDGES:
        ids = groups[lower(text)]
        stays = pick((i for i in ids if i is not None), default=None)
        want.append((doc_id, stays, len(ids), doc_id == stays, hashlib.sha256(lower(text).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_drop_copies_keeps_all_columns(spark):
    docs = table(spark, EDGES)
    kept = exact_dedup.drop_copies(docs, "max")
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.filter("doc_id IN (3, 4, 5, 8, 9)").collect()) == [5, 9]
    assert exact_dedup.drop_copies(docs.filter("false")).count() == 0


def fingerprints(text, families, shingle=3):
    w = words(lower(text))
    hashed = [xxhash.xxh64_intdigest(" ".join(w[i:i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))] if w else []
    mixed = [simhash._remixed(np.array(hashed, np.uint64), f).tolist() for f in range(families)]
    return [sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in m) > len(hashed)) for m in mixed]


def fingerprint(text):
    return fingerprints(text, 1)[0]


def components(prints):
    return components_of_families([[p] for p in prints])


def components_of_families(prints):
    """Root number of each list of fingerprints by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if any((x ^ y).bit_count() <= 3 for x, y in zip(a, prints[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("families", [1, 4])
def test_near_duplicates(spark, families):
    rows = [*EDGES, *[(100 + i, " ".join(w if k != 7 * i else "changed" for k, w in enumerate(prose(400, 9).split())), "en", "a") for i in range(12)]]
    got = simhash.near_duplicates(table(spark, rows), families=families).collect()
    of_families = [fingerprints(text, families) for _, text, *_ in rows]
    roots, prints = components_of_families(of_families), [p[0] for p in of_families]
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = [(rows[i][0], prints[i], least[roots[i]]) for i in range(len(rows))]
    assert sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in got), key=repr) == sorted(want, key=repr)
    assert len({c for d, _, c in want if d is not None and d >= 100}) < 12
    kept = simhash.keep_one(table(spark, rows), families=families)
    assert sorted({r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()}) == sorted({d for d, _, c in want if d is not None and d == c})
    assert simhash.near_duplicates(table(spark, []), families=families).count() == 0


@pytest.mark.parametrize("most", [3, 40, 512])
def test_links_of_crowded_keys(spark, most):
    """A crowd of fingerprints that differ in few bits: refined keys find the same components as all pairs."""
    draw = random.Random(most)
    centre = draw.getrandbits(64)
    prints = {centre ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for _ in range(120)}
    prints = sorted(prints | {draw.getrandbits(64) for _ in range(50)})
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.near_links(frame, most)).collect()}
    groups = defaultdict(set)
    for p, root in zip(prints, components(prints)):
        groups[root].add(p)
    got = defaultdict(set)
    for p in prints:
        got[found.get(p, p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_pairs_alone_in_a_crowd_of_one_key(spark):
    """Refined keys hold fingerprints from several starts of the ring; pairs that fit one start's chains alone are linked too."""
    draw, start = random.Random(7), 0x123456789A  # segments 0 to 4 are equal
    crowd, pairs = [], []
    while len(crowd) < 600:
        x = start | draw.getrandbits(24) << 40
        if all((x ^ y).bit_count() > 6 for y in crowd[-30:]):
            crowd.append(x)
    for x in crowd[:60]:
        pairs.append((x, x ^ sum(1 << 40 + 8 * s + draw.randrange(8) for s in range(3))))
    prints = sorted({p for pair in pairs for p in pair} | set(crowd))
    frame = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp long")
    found = {r["node"] % (1 << 64): r["root"] for r in connected_components(simhash.near_links(frame)).collect()}
    assert [pair for pair in pairs if found.get(pair[0], pair[0]) != found.get(pair[1], pair[1])] == []


def test_components_of_a_path_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_removed(rows):
    """(n_words, n_removed, kept) by row; rows that share an id are one place."""
    first = {}
    for doc_id, text, *_ in rows:
        w = words(text)
        for s in range(len(w) - 19):
            place = (doc_id is None, doc_id or 0, s)
            key = tuple(w[s:s + 20])
            first[key] = min(first.get(key, place), place)
    out = []
    for doc_id, text, *_ in rows:
        w, gone = words(text), set()
        for s in range(len(w) - 19):
            if first[tuple(w[s:s + 20])] != (doc_id is None, doc_id or 0, s):
                gone.update(range(s, s + 20))
        out.append((doc_id, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def test_remove_repeats(spark):
    shared = prose(33, 77)
    rows = [*EDGES, *[(200 + i, prose(i, 100 + i) + " " + shared + " " + prose(i % 7, 300 + i), "en", "a") for i in range(40)],
            (300, ("again and again " * 30), "en", "a"), (301, prose(19, 1), "en", "a"), (302, prose(20, 1), "en", "a"), (303, prose(20, 1), "en", "a")]
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"]).decode()) for r in substrings.remove_repeats(
        table(spark, rows)).collect()), key=repr)
    assert got == sorted(brute_removed(rows), key=repr)
    spans = {r["doc_id"]: r["removed_spans"] for r in substrings.remove_repeats(table(spark, rows)).collect()}
    assert [(s["start"], s["end"]) for s in spans[201]] == [(1, 34)]
    assert substrings.remove_repeats(table(spark, [])).count() == 0


def test_cover_reaches_every_pair_of_positions():
    for a in range(substrings.PERIOD):
        for b in range(substrings.PERIOD):
            assert any((a + d) % substrings.PERIOD in substrings.COVER and (b + d) % substrings.PERIOD in substrings.COVER
                       for d in range(substrings.PERIOD))


def similarity(a, b, shingle=5):
    one, other = ({tuple(w[i:i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set() for w in (words(lower(a)), words(lower(b))))
    return len(one & other) / len(one | other) if one | other else 1.0


def edited(text, draw, n):
    w = text.split()
    for i in draw.sample(range(len(w)), n):
        w[i] = f"new{draw.randrange(10**6)}"
    return " ".join(w)


def test_near_copies_are_linked_by_their_shingles(spark):
    """Components lie within those of all pairs that are similar, miss few of these, and hold no link that is not."""
    draw = random.Random(11)
    bases = [prose(draw.randrange(60, 400), 1000 + i) for i in range(25)]
    rows = [*EDGES, *[(100 + 20 * i + j, edited(b, draw, draw.randrange(0, max(2, len(b.split()) // 25))), "en", "a") for i, b in enumerate(bases) for j in range(8)]]
    rows += [(900 + i, edited(bases[i], draw, len(bases[i].split()) // 4), "en", "a") for i in range(25)]  # like, but not like enough
    got = simhash.near_copies(table(spark, rows)).collect()
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(r[0] for r in rows if r[0] is not None)
    component = {r["doc_id"]: r["component_id"] for r in got}
    like = [(a[0], b[0]) for i, a in enumerate(rows) for b in rows[:i] if a[0] is not None and b[0] is not None and similarity(a[1], b[1]) >= 0.8]
    found = [component[a] == component[b] for a, b in like]
    assert len(like) > 150 and sum(found) > 0.95 * len(found), (len(like), sum(found))
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in like:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert all(find(d) == find(c) for d, c in component.items() if d is not None)
    kept = simhash.keep_dissimilar(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    assert {r["doc_id"] for r in kept.filter("doc_id IS NOT NULL").collect()} == {d for d, c in component.items() if d is not None and d == c}
    assert simhash.near_copies(table(spark, [])).count() == 0 and simhash.keep_dissimilar(table(spark, rows[:1])).count() == 1


def test_a_crowd_of_near_copies_is_compared_a_few_times_each(spark, monkeypatch):
    base, draw, asked = prose(200, 4), random.Random(2), []
    rows = [(i, edited(base, draw, 1), "en", "a") for i in range(400)]
    plain = simhash._compared

    def counting(links, *more):
        asked.append((links.count(), links.groupBy("a").count().agg(F.max("count")).first()[0]))
        return plain(links, *more)
    monkeypatch.setattr(simhash, "_compared", counting)
    got = simhash.near_copies(table(spark, rows)).collect()
    assert {r["component_id"] for r in got} == {0}
    assert sum(n for n, _ in asked) < 4 * len(rows)


def test_similarity():
    a, b = prose(100, 1), edited(prose(100, 1), random.Random(1), 4)
    assert simhash.similarity(a.encode(), b.encode()) == similarity(a, b) and simhash.similarity(b"", b" ") == 1.0 and simhash.similarity(b"a", b"") == 0.0
    assert simhash.similarity(b"A b", b"a B") == 1.0 and simhash.similarity("Ä".encode(), "ä".encode()) == 0.0
