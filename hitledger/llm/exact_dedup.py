"""Exact dedup: documents grouped by a 128-bit content hash, told apart by their bytes inside a group.

Only DataFrame functions. Texts are grouped by (hash, bytes) with a partial aggregation in every task, so a group of copies
that holds a third of all rows reaches its reducer as one row a task. What is joined back to the documents is narrow: two
hashes, the size and the id that stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from hitledger.llm.common import ascii_lower, text_or_empty


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_groups(docs: DataFrame, keep: str = "min", normalise: Callable[[Column], Column] = ascii_lower,
                 content_hash: Callable[[Column], Column] = md5_bytes) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when ``normalise`` makes the same bytes of them. The row with the smallest (``keep="max"``: largest)
    doc_id stays. A null text counts as empty. Rows without a doc_id stay only in groups without any (keep_id null), rows
    that repeat a doc_id share its decision. An empty table gives an empty result; other columns of ``docs`` are not read.

    A text's class is named by (content_hash, SHA-256). Should two different texts ever agree in both, the query fails
    rather than merge them; a weak ``content_hash`` alone never merges anything.
    """
    best = {"min": F.min, "max": F.max}[keep]
    texts = docs.select("doc_id", normalise(text_or_empty()).alias("_text"))
    named = [content_hash(F.col("_text")).alias("_hash"), F.sha2("_text", 256).alias("text_sha256")]
    classes = (texts.groupBy(named[0], "_text").agg(best("doc_id").alias("_keep"), F.count("*").alias("_n"))
               .select("_hash", named[1], "_keep", "_n")
               .groupBy("_hash", "text_sha256").agg(F.count("*").alias("_texts"), best("_keep").alias("_keep"), F.sum("_n").alias("_n"))
               .withColumn("_n", F.when(F.col("_texts") == 1, F.col("_n")).otherwise(
                   F.raise_error(F.lit("two texts agree in both content hashes")).cast("long")))
               .filter("_n > 1").select("_hash", "text_sha256", "_keep", "_n"))
    rows = texts.select("doc_id", *named).join(classes, ["_hash", "text_sha256"], "left")
    alone = F.col("_n").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("_keep"))
    return rows.select("doc_id", keep_id.alias("keep_id"), F.coalesce("_n", F.lit(1)).alias("group_size"),
                       F.col("doc_id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Same rules as ``exact_groups``.

    Only ids and hashes of dropped rows are joined to the documents.
    """
    dropped = exact_groups(docs, keep).filter(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha")).distinct()
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.sha2(ascii_lower(text_or_empty()), 256).alias("own_sha"))
    same = rows["doc_id"].eqNullSafe(dropped["id"]) & (rows["own_sha"] == dropped["sha"])
    return rows.join(dropped, same, "left_anti").select("row.*")
