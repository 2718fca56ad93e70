"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hitledger.llm.common import written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b: long), root being the smallest node reachable.

    Large-star and small-star steps in turn until nothing changes: each hangs a node's neighbours on their smallest one. Every
    step is aggregated before it shuffles, and its result written to the shared folder, so a hub costs one row a task and neighbour
    and a lost executor costs one step. The rounds grow with the logarithm of the longest path.
    """
    stars = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        stars = written(_small_star(_large_star(stars)), "stars")
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _large_star(stars: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is linked to the node's smallest neighbour, or to the node if that is smaller."""
    both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the smallest of them."""
    least = stars.groupBy("a").agg(F.min("b").alias("m"))
    moved = stars.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
