"""SimHash near-dedup with pigeonring candidates.

A 64-bit fingerprint is a ring of eight segments. If two fingerprints differ in at most three bits, then from some segment on every
chain of k consecutive segments has at most floor(3k / 8) differing bits: none in the first two, one in the first five, two in the
first seven. One differing bit in the third to fifth leaves two of these three equal; so each fingerprint is filed under the 24 keys made of
two neighbouring segments and two of the next three, 32 equal bits each. Pairs under a key must pass the longer chains before their
Hamming distance is taken.

Only different fingerprints are filed. A key with more than ``MOST`` of them is refined: what is left of the ring is cut in four, one
of which must be equal too, until no key holds more, or leaves no more than three bits open: all its fingerprints are then within the
distance, and linked to the least of them. Refined keys hold fingerprints from several starts of the ring, so their pairs
need no chain but the Hamming distance alone. Each step closes a quarter of the open bits, so this ends after a dozen steps;
nothing is left out, and no task compares more than ``MOST`` with each other. A key's links are reduced to a tree per
component before they leave the task.

Fingerprints alone say how near texts may be, not how near they are. ``near_copies`` takes families of fingerprints over the different
words of texts for candidates, and links those whose five-word shingles really have the similarity asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from hitledger.llm.common import joined_back, written
from hitledger.llm.components import connected_components
from hitledger.llm.encoding import slices

SEED, SEGMENTS, WIDTH, DISTANCE = 42, 8, 8, 3
MOST = 512


def _segment_mask(segments) -> int:
    return sum(0xFF << WIDTH * (s % SEGMENTS) for s in segments)


KEYS = [(start, _segment_mask((start, start + 1, *pair))) for start in range(SEGMENTS)
        for pair in combinations(range(start + 2, start + 5), 2)]
# By start of the ring: (mask of the first k segments, most differing bits in them).
CHAINS = [[(_segment_mask(range(start, start + k)), DISTANCE * k // SEGMENTS) for k in (5, 6, 7)] for start in range(SEGMENTS)]


def _remixed(hashed: np.ndarray, family: int) -> np.ndarray:
    """Hashes of another family, as good as independent: the first family has the hashes themselves."""
    if not family:
        return hashed
    x = (hashed ^ np.uint64(family * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of each run of ``shingle`` words of a text with A-Z lower-cased, or of all its words if they are fewer; none without words."""
    import xxhash
    digest, joined = xxhash.xxh64_intdigest, b" ".join(text.lower().split())  # bytes.lower() changes A-Z alone
    if not joined:
        return
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    starts, ends, view = [0, *[g + 1 for g in gaps]], [*gaps, len(joined)], memoryview(joined)
    total = max(1, len(starts) - shingle + 1)
    for low in range(0, total, 1 << 16):
        high = min(total, low + (1 << 16))
        yield np.array([digest(view[a:b], SEED) for a, b in zip(
            starts[low:high], ends[low + shingle - 1:high + shingle - 1] or ends[-1:])], np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 3, families: int = 1, different: bool = False) -> DataFrame:
    """doc_id and fingerprints (signed longs, one a family): bit b is set if it is set in over half of the text's shingle hashes.

    Shingles are ``shingle`` consecutive words of the text with A-Z lower-cased, repeats included unless only ``different`` ones count,
    joined by spaces; a shorter text is one shingle; one without words (or null) has fingerprints 0. Hashes are XXH64 with seed 42,
    remixed for further families. An empty table gives an empty result.
    """
    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, texts in slices([batch["doc_id"]], batch["text"]):
                found = np.zeros((len(texts), families), np.uint64)
                for i, text in enumerate(texts):
                    counts, total = np.zeros((families, 64), np.int64), 0
                    parts = _shingle_hashes(text, shingle)
                    for hashed in [np.unique(np.concatenate([*parts, np.empty(0, np.uint64)]))] if different else parts:
                        total += len(hashed)
                        for family in range(families):
                            mixed = _remixed(hashed, family).astype("<u8")
                            bits = np.unpackbits(mixed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                            counts[family] += bits.sum(axis=0, dtype=np.uint32)
                    if total:
                        found[i] = np.packbits(2 * counts > total, axis=1, bitorder="little").view("<u8")[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(found.view(np.int64).tolist(), pa.list_(pa.int64()))],
                                                 names=["doc_id", "fingerprints"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(fingerprint, "doc_id long, fingerprints array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _key(*columns: Column | str) -> Column:
    """One number for a key. Should two keys of a mask ever share it, their fingerprints are compared in vain."""
    return F.xxhash64(*columns).alias("key")


def _file(prints: DataFrame) -> DataFrame:
    """(key, slot, fp): each fingerprint under its 24 keys; the slot tells family and mask. These rows are all fingerprints 24 times over."""
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(mask)).alias("mask")) for i, (_, mask) in enumerate(KEYS)])
    each = prints.select("family", "fp", F.explode(masks).alias("m"))
    return each.select(_key("family", F.col("m.mask"), F.col("fp").bitwiseAND(F.col("m.mask"))),
                       (F.col("family") * len(KEYS) + F.col("m.i")).cast("int").alias("slot"), "fp")


def _unfiled(marked: DataFrame) -> DataFrame:
    """``slot`` as family, mask and the start of the ring that the mask's chains have."""
    number = F.pmod("slot", F.lit(len(KEYS)))
    masks, starts = (F.array(*[F.lit(x) for x in values]) for values in ([_signed(m) for _, m in KEYS], [s for s, _ in KEYS]))
    return marked.select("key", ((F.col("slot") - number) / len(KEYS)).cast("int").alias("family"), masks[number].alias("mask"),
                         starts[number].alias("start"), "fp", "n", "least")


def _finer(mask: int) -> list[int]:
    """``mask`` with each quarter of the bits it leaves open added: of at most three differing bits, one quarter has none."""
    free = [b for b in range(64) if not mask >> b & 1]
    cut = [len(free) * i // 4 for i in range(5)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cut, cut[1:])]


def _finer_masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(m, _signed(f)) for m in batch["mask"].to_pylist() for f in _finer(m % (1 << 64))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], names=["mask", "finer"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the keys of sorted rows: each fingerprint with the one from which it was reached, a tree per component."""
    def linked(start: int | None, fps: np.ndarray) -> np.ndarray:
        found, open_ = [], np.ones(len(fps), bool)
        for root in range(len(fps)):
            if not open_[root]:
                continue
            open_[root], ring = False, [root]
            for at in ring:
                rest = np.flatnonzero(open_)
                differ = fps[rest] ^ fps[at]
                for chain, most in CHAINS[start] if start is not None else ():
                    near = np.bitwise_count(differ & np.uint64(chain)) <= most
                    rest, differ = rest[near], differ[near]
                near = rest[np.bitwise_count(differ) <= DISTANCE]
                open_[near] = False
                ring += near.tolist()
                found.append(np.stack([fps[near], np.full(len(near), fps[at])], axis=1))
        return np.concatenate(found)

    def made(links: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        pairs = np.concatenate([p for _, p in links]).view(np.int64)
        family = np.repeat([f for f, _ in links], [len(p) for _, p in links])
        return pa.RecordBatch.from_arrays([pa.array(family, pa.int32()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["family", "a", "b"])

    key, key_start, held = None, None, []
    for batch in batches:
        links: list[tuple[int, np.ndarray]] = []
        for value, family, mask, start, fp in zip(*(batch[c].to_pylist() for c in ("key", "family", "mask", "start", "fp"))):
            if key != (family, mask, value):
                if len(held) > 1:
                    links.append((key[0], linked(key_start, np.array(held, np.int64).view(np.uint64))))
                key, key_start, held = (family, mask, value), start, []
            held.append(fp)
        if links:
            yield made(links)
    if len(held) > 1:
        yield made([(key[0], linked(key_start, np.array(held, np.int64).view(np.uint64)))])


def near_links(prints: DataFrame, most: int = MOST) -> DataFrame:
    """Links (family, a, b) that connect whatever different fingerprints (columns family and fp, or fp alone) of a family lie within
    DISTANCE bits of each other. All families are refined together; every step is written once."""
    links, order = None, ["key", "family", "mask"]
    filed = _file(prints if "family" in prints.columns else prints.select(F.lit(0).alias("family"), "fp"))
    closed = F.bit_count(F.bitwise_not("mask")) <= DISTANCE
    while True:
        first = links is None  # half of the bits are open: nothing is closed yet
        sizes = filed.groupBy("key").agg(F.count("*").alias("n"), *([] if first else [F.min("fp").alias("least")])).filter("n > 1")
        sizes = written(sizes.withColumn("least", F.lit(None).cast("long")) if first else sizes, "keys")
        joined = filed.join(sizes, "key")
        marked = written(_unfiled(joined) if first else joined, "marked")
        small = marked.filter(~closed & (F.col("n") <= most)).select(*order, "start", "fp")
        found = small.repartition("key").sortWithinPartitions(*order).mapInArrow(_trees, "family int, a long, b long").unionByName(
            marked.filter(closed & F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))).between(1, DISTANCE)).select("family", F.col("fp").alias("a"), F.col("least").alias("b"))).distinct()
        links = found if links is None else links.unionByName(found)
        large = marked.filter(~closed & (F.col("n") > most)).select("family", "mask", "fp")
        if large.isEmpty():
            return links
        masks = written(large.select("mask").distinct().mapInArrow(_finer_masks, "mask long, finer long"), "masks")  # Spark knows its size
        finer = large.join(masks, "mask").select("family", F.col("finer").alias("mask"), "fp").distinct()
        filed = finer.select(_key("family", "mask", F.col("fp").bitwiseAND(F.col("mask"))), "family", "mask", F.lit(None).cast("int").alias("start"), "fp")


def _family_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between the nodes of ``prints`` (node, family, fp): the least one stands for all that share a family's fingerprint."""
    stands = written(prints.groupBy("family", "fp").agg(F.min("node").alias("stand")), "stands")
    shared = prints.join(stands, ["family", "fp"]).filter("node <> stand").select(F.col("node").alias("a"), F.col("stand").alias("b"))
    of = [stands.select("family", F.col("fp").alias(side), F.col("stand").alias(f"{side}_stand")) for side in "ab"]
    near = near_links(stands).join(of[0], ["family", "a"]).join(of[1], ["family", "b"]).select(
        F.col("a_stand").alias("a"), F.col("b_stand").alias("b"))
    return shared.unionByName(near)


def _by_family(node: Column | str) -> list[Column]:
    return [F.col(node).alias("node") if isinstance(node, str) else node.alias("node"), F.posexplode("fingerprints").alias("family", "fp")]


def near_duplicates(docs: DataFrame, shingle: int = 3, families: int = 1) -> DataFrame:
    """doc_id, fingerprint (signed long), component_id: the smallest doc_id reachable over fingerprints DISTANCE bits apart or less.

    With several ``families`` texts are linked if their fingerprints of any family are that close, which finds pairs whose first
    fingerprints happen to differ more; ``fingerprint`` is that of the first.

    Equal fingerprints are linked, texts without words among them. Rows without a doc_id take part; a component that has no other
    has component_id null. Rows that repeat a doc_id are rows of their own. An empty table gives an empty result.
    """
    marked = written(fingerprints(docs, shingle, families).withColumn("fingerprint", F.col("fingerprints")[0]), "fingerprints")
    nodes = written(marked.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("doc_id").alias("least")), "nodes")
    links = near_links(nodes.select("fp")).select("a", "b") if families == 1 else _family_links(
        written(marked.select("fingerprint", "fingerprints").distinct().select(*_by_family("fingerprint")).distinct(), "family"))
    roots = connected_components(links)
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(F.col("fp").alias("fingerprint"), F.coalesce("root", "fp").alias("root"), "least")
    named = joined_back(written(rooted, "rooted"), ["root"], F.min("least").alias("component_id")).select("fingerprint", "component_id")
    return _looked_up(marked.select("doc_id", "fingerprint"), named).select("doc_id", "fingerprint", "component_id")


def _looked_up(rows: DataFrame, of_print: DataFrame, most: int = 10_000) -> DataFrame:
    """``rows`` with what ``of_print`` has for their fingerprint; the fingerprints of the most rows are looked up in broadcast tables."""
    counted = written(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).join(of_print, "fingerprint"), "prints")
    least = counted.select("n").orderBy(F.desc("n")).offset(most).limit(1).first()
    if least is None:
        return rows.join(F.broadcast(counted.drop("n")), "fingerprint")
    hot, cold = F.broadcast(counted.filter(F.col("n") > least["n"]).drop("n")), counted.filter(F.col("n") <= least["n"]).drop("n")
    return rows.join(hot, "fingerprint").unionByName(rows.join(hot, "fingerprint", "left_anti").join(cold, "fingerprint"))


def keep_one(docs: DataFrame, shingle: int = 3, families: int = 1) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those whose component has a smaller doc_id.

    An id stays if any of the rows that carry it does; rows without an id go where a component has one.
    """
    return _without(docs, near_duplicates(docs, shingle, families).select("doc_id", "component_id"))


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id stays: one row of ``found`` (doc_id, component_id) has it as component_id."""
    stays = F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id")))
    dropped = found.groupBy("doc_id").agg(stays.alias("stays")).filter("NOT stays").select(F.col("doc_id").alias("id"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id")
    return rows.join(dropped, rows["doc_id"].eqNullSafe(dropped["id"]), "left_anti").select("row.*")


# Near copies: candidates by fingerprints over different words, links by the similarity of shingles.

SIMILAR, SHINGLE, FAMILIES = 0.8, 5, 6
SHARED = 256  # links that one copy of a text is compared for


def similarity(a: bytes, b: bytes, shingle: int = SHINGLE) -> float:
    """Shared among all different shingles (64-bit hashes) of two texts; two texts without words are equal."""
    one, other = (np.unique(np.concatenate([*_shingle_hashes(t, shingle), np.empty(0, np.uint64)])) for t in (a, b))
    both = len(np.intersect1d(one, other, assume_unique=True))
    return both / (len(one) + len(other) - both) if len(one) + len(other) else 1.0


def _compared(links: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """The ``links`` (a, b) whose texts (node, text) have the similarity ``least``. A text that many links ask for is handed out in copies."""
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [similarity(batch["text_a"][i].as_py(), batch["text_b"][i].as_py(), shingle) >= least for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = links
    for side in "ab":
        copies = links.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count("*") / SHARED).cast("int").alias("copies"))
        handed = texts.join(copies, "node").select(F.col("node").alias(side), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"),
                                                   "copies", F.col("text").alias(f"text_{side}"))
        other = "b" if side == "a" else "a"
        dealt = rows.join(copies.withColumnRenamed("node", side), side).withColumn("copy", F.pmod(F.xxhash64(other), F.col("copies")).cast("int"))
        rows = dealt.join(handed.drop("copies"), [side, "copy"]).drop("copy", "copies")
    return rows.mapInArrow(similar, "a long, b long")


def near_copies(docs: DataFrame, least: float = SIMILAR, shingle: int = SHINGLE, families: int = FAMILIES) -> DataFrame:
    """doc_id, component_id: the smallest doc_id reachable over texts of similarity ``least``, by their different shingles.

    Candidates are texts of which one family's fingerprints (over different words) are DISTANCE bits apart or less, as trees. Each
    text's candidates are compared a few at a time, four times as many in every round; those that the texts compared so far already
    connect need no comparison. All others are compared, so a crowd costs some comparisons a text and no candidate is left out.

    A null text counts as empty; texts without words are equal. Rows without a doc_id take part; a component that has no other has
    component_id null. Rows that repeat a doc_id are rows of their own. An empty table gives an empty result; other columns are not read.
    """
    texts = written(docs.select(F.monotonically_increasing_id().alias("node"), "doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text")), "texts")
    prints = fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), 1, families, different=True)
    prints = written(prints.select(*_by_family("doc_id")), "prints")
    left = written(_family_links(prints).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "candidates")
    good, take, roots = None, 1, None
    while not left.isEmpty():
        ranked = left.withColumn("rank", F.row_number().over(W.partitionBy("a").orderBy("b")))
        chosen = ranked.filter(F.col("rank") <= take).drop("rank")
        tested = written(_compared(chosen, texts.select("node", "text"), least, shingle), "similar")
        good = tested if good is None else good.unionByName(tested)
        roots = written(connected_components(good), "roots")
        rest = ranked.filter(F.col("rank") > take).drop("rank")
        for side in "ab":
            of = roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
            rest = rest.join(of, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
        left = written(rest.filter("root_a <> root_b").select("a", "b"), "candidates")
        take *= 4
    ids = texts.select("node", "doc_id")
    rooted = ids.withColumn("root", F.col("node")) if roots is None else ids.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = joined_back(written(rooted, "rooted"), ["root"], F.min("doc_id").alias("component_id"))
    return named.select("doc_id", "component_id")


def keep_dissimilar(docs: DataFrame, least: float = SIMILAR, shingle: int = SHINGLE, families: int = FAMILIES) -> DataFrame:
    """The rows of ``docs``, with all their columns, without those that are ``near_copies`` of a row of smaller doc_id.

    An id stays if any of the rows that carry it does; rows without an id go where a component has one.
    """
    return _without(docs, near_copies(docs, least, shingle, families))
