"""Mixing overlapping sources to target weights: a min-cost flow over membership patterns, then seeded documents.

Documents are aggregated by pattern (the set of sources they belong to). The flow routes words from patterns to the quotas of
their sources; the k-th use of a pattern's words costs more than the ones before, so words are repeated only where fresh ones run
out. Its size is that of the patterns, not of the documents. What a pattern has to give is then drawn from its documents in the
order of a seeded hash: the hash below which documents are taken is found digit by digit from sums over 4,096 buckets, so no
group is ever sorted or gathered, however many documents share a source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from hitledger.llm.common import WORD, small_table, text_or_empty, written

DIGITS = (52, 40, 28, 16, 4, 0)  # shifts that bring a 64-bit hash down to its leading 12, 24, ... 64 bits


@dataclass(frozen=True)
class Mix:
    """``documents``: doc_id, members, size (words), copies and taken (words) of every row. ``targets`` and ``sizes`` by source;
    ``routes``: words that each (pattern, source) contributes; ``plan``: by pattern, how documents are chosen by
    their hash; ``picks``: those chosen besides."""
    documents: DataFrame
    plan: DataFrame
    picks: DataFrame
    seed: int
    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    routes: dict[tuple[tuple, str | None], int]


def capped_targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """``total`` shared out by weight; no source gets more than ``most`` times its size, the excess is shared by weight again."""
    open_, targets, left = set(sizes), {}, total
    while open_:
        unit = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if unit * weights[s] > most * sizes[s]}
        if not full:
            return targets | {s: unit * weights[s] for s in open_}
        targets |= {s: float(most * sizes[s]) for s in full}
        left -= sum(targets[s] for s in full)
        open_ -= full
    return targets


def repeating_weights(sources: list, pattern: tuple[float, ...] = (5, 2, 1)) -> dict:
    """Weights given in turn to the sources by code point, a null source last."""
    ordered = sorted(s for s in sources if s is not None) + [None] * (None in sources)
    return {s: pattern[i % len(pattern)] for i, s in enumerate(ordered)}


def route(patterns: dict[tuple, int], quotas: dict[str | None, int], copies: int) -> dict[tuple[tuple, str | None], int]:
    """Words that each (pattern, source) contributes: as much of all quotas as can be met, at the least cost of repetition.

    The cost of a word grows with its use number alone. So the cheapest flow comes from adding one use of every pattern at a time
    and augmenting to a maximum flow before the next: an augmenting path never takes back what leaves the origin.
    """
    room: dict = {}  # residual capacities: node -> node -> capacity
    for sources in patterns:
        for s in sources:
            room.setdefault(("pattern", sources), {})[("source", s)] = sum(quotas.values())
            room.setdefault(("source", s), {})[("pattern", sources)] = 0
    for s, quota in quotas.items():
        room.setdefault(("source", s), {})["end"] = quota
    fresh = {}
    for _ in range(copies):
        fresh = {p: fresh.get(p, 0) + n for p, n in patterns.items()}
        while levels := _levels(room, fresh):
            for p in fresh:
                if fresh[p] and levels.get(("pattern", p)) == 1:
                    fresh[p] -= _push(room, levels, ("pattern", p), fresh[p])
    return {(p, s): room["source", s]["pattern", p] for p in patterns for s in p if room["source", s]["pattern", p]}


def _levels(room: dict, fresh: dict) -> dict | None:
    """Distance of each node from the origin over arcs with room, or None if the end is out of reach."""
    found = {("pattern", p): 1 for p, n in fresh.items() if n}
    ring = list(found)
    while ring and "end" not in found:
        following = []
        for node in ring:
            for to, left in room.get(node, {}).items():
                if left and to not in found:
                    found[to] = found[node] + 1
                    following.append(to)
        ring = following
    return found if "end" in found else None


def _push(room: dict, levels: dict, node, amount: int) -> int:
    if node == "end":
        return amount
    sent = 0
    for to, left in room[node].items():
        if sent < amount and left and levels.get(to) == levels[node] + 1:
            moved = _push(room, levels, to, min(amount - sent, left))
            room[node][to] -= moved
            if to != "end":
                room[to][node] += moved
            sent += moved
    if not sent:
        levels[node] = -1
    return sent


def _rank(shift: int) -> Column:
    return F.shiftright("_hash", shift) if shift else F.col("_hash")


def _cuts(sized: DataFrame, wanted: dict[str, int]) -> dict[str, tuple[int, int]]:
    """By pattern key: the hash below which all documents are taken, and the words still missing then.

    Documents of equal hash (rows repeating an id and its text) are one unit: all of them lie below a cut or none.
    """
    spark, cuts = sized.sparkSession, {}
    state = {key: (None, n) for key, n in wanted.items() if n > 0}
    for above, shift in zip((None, *DIGITS), DIGITS):
        if not state:
            break
        goals = small_table(spark, [(k, p, n) for k, (p, n) in state.items()], "_key string, _prefix long, _wanted long")
        here = sized.join(goals, "_key")
        if above is not None:
            here = here.filter(_rank(above) == F.col("_prefix"))
        sums = here.groupBy("_key", "_wanted", _rank(shift).alias("_digit")).agg(
            F.sum("size").alias("_size"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
        before = F.sum("_size").over(W.partitionBy("_key").orderBy("_digit")) - F.col("_size")
        state = {}
        for x in sums.withColumn("_before", before).filter("_before < _wanted AND _wanted <= _before + _size").collect():
            missing = x["_wanted"] - x["_before"]
            if x["_least"] == x["_most"]:
                cuts[x["_key"]] = (x["_least"], missing)
            else:
                state[x["_key"]] = (x["_digit"], missing)
    return cuts


def mix(docs: DataFrame, members: Column, weights=repeating_weights, share: float = 1.5, most: int = 2, seed: int = 42,
        max_patterns: int = 100_000) -> Mix:
    """Words taken from every document so that each source comes to its target.

    ``members``: array of the sources of a document (null is a source of its own; a null or empty array belongs to none and
    gives nothing). ``weights`` maps the list of sources to their weights. A document is taken whole: ``most`` times, some times
    fewer, or never; which ones is decided by ``seed``, doc_id and text alone, so reruns agree. Rows that repeat an id and its text
    share one decision. Null texts have size 0. An empty table gives an empty mix. The driver handles one number per pattern and
    refuses more than ``max_patterns``.
    """
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), *_drawn(members, seed)), "mix")
    found = sized.groupBy("_key", "members").agg(F.sum("size").alias("n")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} combinations of sources")
    patterns = {tuple(x["members"]): x["n"] for x in found if x["members"]}
    sizes: dict = {}
    for sources, n in patterns.items():
        for s in sources:
            sizes[s] = sizes.get(s, 0) + n
    targets = capped_targets(sizes, weights(list(sizes)), share * sum(patterns.values()), most)
    routes = route(patterns, {s: round(t) for s, t in targets.items()}, most)
    keys = {tuple(x["members"]): x["_key"] for x in found}
    given: dict = {}
    for (sources, _), n in routes.items():
        given[sources] = given.get(sources, 0) + n
    rounds = {keys[p]: divmod(n, patterns[p]) for p, n in given.items()}
    units = written(sized.groupBy("_key", "_hash").agg(F.sum("size").alias("size")).filter("size > 0"), "units")
    cuts = _cuts(units, {key: rest for key, (_, rest) in rounds.items()})
    picks = _fills(units, cuts)
    plan = small_table(
        spark, [(key, *((rounds.get(key) or (0, 0))[:1]), cuts.get(key, (None, 0))[0]) for key in keys.values()],
        "_key string, _rounds int, _cut long")
    documents = sized.join(plan, "_key", "left").join(picks, ["_key", "_hash"], "left").select("doc_id", "members", "size", _copies().alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size"))
    return Mix(documents, plan, picks, seed, sizes, targets, routes)


def _fills(units: DataFrame, cuts: dict[str, tuple[int, int]]) -> DataFrame:
    """(_key, _hash, _picked: true) of the units taken besides those below the cut of a pattern, until none fits that is left.

    From the largest size that fits down, as many units of each size are taken as fit, those of least hash first. Then the smallest
    unit left is taken too if that comes nearer. Without that last one, picks have no more words than the unit at the cut.
    """
    spark = units.sparkSession
    gaps = [(key, cut, missing) for key, (cut, missing) in cuts.items() if missing > 0]
    if not gaps:
        return spark.createDataFrame([], "_key string, _hash long, _picked boolean")
    beyond = units.join(small_table(spark, gaps, "_key string, _cut long, _missing long"), "_key").filter("_hash >= _cut")
    sizes = beyond.filter("size <= _missing").groupBy("_key", "_missing", "size").agg(F.count("*").alias("n"))
    listed = sizes.groupBy("_key", "_missing").agg(F.sort_array(F.collect_list(F.struct("size", "n")), False).alias("sizes"))
    filled = written(listed.select("_key", F.expr("""
        aggregate(sizes, named_struct('missing', _missing, 'took', cast(array() AS array<struct<size: bigint, k: bigint, n: bigint>>)),
            (a, x) -> if(x.size > a.missing, a, named_struct(
                'missing', a.missing - least(x.n, a.missing div x.size) * x.size,
                'took', concat(a.took, array(named_struct('size', x.size, 'k', least(x.n, a.missing div x.size), 'n', x.n))))))
        """).alias("f")).select("_key", F.col("f.missing").alias("_left"), F.col("f.took").alias("_took")), "filled")
    took = filled.select("_key", F.inline("_took"))
    # A size of which units stay leaves less than half of what was missing before, so these are few for each pattern.
    some = {f"{x['size']} {x['_key']}": x for x in took.filter("k < n").collect()}
    of_size = beyond.select(F.concat_ws(" ", "size", "_key").alias("_key"), "_hash", F.lit(1).cast("long").alias("size"))
    upto = _cuts(of_size, {name: x["k"] for name, x in some.items()})
    upto = small_table(spark, [(x["_key"], x["size"], upto[name][0]) for name, x in some.items()], "_key string, size long, _upto long")
    picks = written(beyond.join(took, ["_key", "size"]).join(upto, ["_key", "size"], "left").filter("k = n OR _hash <= _upto").select(
        "_key", "_hash", F.lit(True).alias("_picked")), "picks")
    left = beyond.join(filled.select("_key", "_left"), "_key", "left").join(picks, ["_key", "_hash"], "left").filter("_picked IS NULL").withColumn(
        "_left", F.coalesce("_left", "_missing")).filter("size BETWEEN _left + 1 AND 2 * _left - 1")
    nearer = left.groupBy("_key").agg(F.min(F.struct("size", "_hash")).alias("best")).select("_key", F.col("best._hash").alias("_hash"), F.lit(True).alias("_picked"))
    return written(picks.unionByName(nearer), "picks")


def _drawn(members: Column, seed: int) -> list[Column]:
    """The pattern of a document, its key, and the hash that decides about it."""
    listed = F.sort_array(F.array_distinct(F.coalesce(members, F.array().cast("array<string>"))))
    return [listed.alias("members"), F.to_json(listed).alias("_key"), F.xxhash64(F.lit(seed), "doc_id", text_or_empty()).alias("_hash")]


def _copies() -> Column:
    once = F.coalesce(F.col("_hash") < F.col("_cut"), F.lit(False)) | F.coalesce("_picked", F.lit(False))
    return F.coalesce("_rounds", F.lit(0)) + F.when(once, 1).otherwise(0)


def mixed_documents(docs: DataFrame, members: Column, result: Mix) -> DataFrame:
    """The rows of ``docs`` as the mix takes them, repeated ones that many times, with the columns of ``docs``.

    No text is shuffled unless picks are too many to broadcast.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), *_drawn(members, result.seed)).join(result.plan, "_key", "left").join(
        result.picks, ["_key", "_hash"], "left")
    return rows.withColumn("copies", _copies()).filter("copies > 0").select(
        "row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
