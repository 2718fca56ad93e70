"""Top rows overall and per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

PARTIAL_LIMIT = 1000  # up to here Spark limits each group inside every task before it shuffles
SPREAD = 256


def top(df: DataFrame, count: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of the highest ``count``; equal counts in the order of ``ties``."""
    return df.orderBy(F.col(count).desc(), *ties).limit(n)


def top_per_group(df: DataFrame, group: Sequence[str], count: str, ties: Sequence[str], n: int) -> DataFrame:
    """The ``n`` rows of the highest ``count`` in each group; equal counts in the order of ``ties``.

    A small ``n`` shuffles at most ``n`` rows per group and task. A large one is first taken within ``SPREAD`` parts of
    each group, so that no task sorts a whole hot group and the last step sees at most ``SPREAD * n`` rows of it.
    """
    def ranked(rows: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col(count).desc(), *ties)
        return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")

    if n > PARTIAL_LIMIT:
        part = F.pmod(F.xxhash64(*ties), F.lit(SPREAD))
        df = ranked(df.withColumn("_part", part), [*group, "_part"]).drop("_part")
    return ranked(df, group)


def _nth(sums: DataFrame, group: Sequence[str], key: str, n: int) -> DataFrame:
    """The ``n``-th highest ``_sum`` of every group as ``_nth``, 0 where a group has fewer keys."""
    highest = top_per_group(sums, group, "_sum", [key], n)
    return highest.groupBy(*group).agg(F.when(F.count("*") == n, F.min("_sum")).otherwise(0).alias("_nth"))


def list_candidates(lists: DataFrame, group: Sequence[str], by: Sequence[str], key: str, count: str, n: int) -> DataFrame:
    """``(*group, key)`` of all keys whose total over the lists may be among the ``n`` highest of their group.

    The ``n`` highest entries of each list give partial sums; the ``n``-th of these is a lower bound of the answer's least total. Spread
    over all lists of the group it is the least entry that a key of the answer must have in some list. The entries from there on
    give better partial sums, and what a key may have beside them is known; keys that can't reach the ``n``-th partial sum are out.
    """
    highest = top_per_group(lists, [*group, *by], count, [key], n)
    reached = _nth(highest.groupBy(*group, key).agg(F.sum(count).alias("_sum")), group, key, n)
    sizes = lists.select(*group, *by).distinct().groupBy(*group).agg(F.count("*").alias("_lists"))
    bounds = sizes.join(reached, [*group]).select(*group, "_lists", F.expr("(_nth + _lists - 1) div _lists").alias("_least"))
    seen = lists.join(bounds, [*group]).filter(F.col(count) >= F.col("_least")).groupBy(*group, key, "_lists", "_least").agg(
        F.sum(count).alias("_sum"), F.count("*").alias("_seen"))
    rest = (F.col("_lists") - F.col("_seen")) * F.greatest(F.col("_least") - 1, F.lit(0))
    return seen.join(_nth(seen, group, key, n), [*group]).filter(F.col("_sum") + rest >= F.col("_nth")).select(*group, key)


def top_of_lists(lists: DataFrame, group: Sequence[str], by: Sequence[str], key: str, count: str, n: int) -> DataFrame:
    """``(*group, key, n)``: the ``n`` keys of the highest totals of each group, equal totals in the order of keys, without summing every key.

    A group's entries lie in lists named by the columns ``by``; a list holds a key once at most, with an integer count of 0 or more. Only
    candidates are summed (``list_candidates``): the shuffles carry the highest entries of each list, and all of them only where bounds or
    candidates are too large for Spark to broadcast. The result is that of summing everything, whatever the split. Rows without a group, key or count are left out; no rows give no rows.
    """
    known = lists.dropna(subset=[*group, key, count]).select(*group, *by, key, F.col(count).alias("_count"))
    if not group:
        return top_of_lists(known.withColumn("_all", F.lit(0)), ["_all"], by, key, "_count", n).drop("_all")
    chosen = list_candidates(known, group, by, key, "_count", n)
    totals = known.join(chosen, [*group, key], "left_semi").groupBy(*group, key).agg(F.sum("_count").alias("n"))
    return top_per_group(totals, group, "n", [key], n)
