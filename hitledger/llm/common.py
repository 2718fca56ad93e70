"""Helpers of the corpus operators: words, normalised text, tables written to the shared folder."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hitledger.session import shared_dir

# What separates words, as characters and as a pattern.
WORD_BREAKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def written(frame: DataFrame, purpose: str) -> DataFrame:
    """``frame`` as a table in the folder all executors share: computed once, and read again if an executor is lost."""
    path = shared_dir(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str, most: int = 100_000) -> DataFrame:
    """Rows that the driver holds as a table, to be broadcast in joins if there are at most ``most``; else Spark shuffles."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= most else frame


def joined_back(rows: DataFrame, keys: list[str], *aggregates: Column, most: int = 10_000) -> DataFrame:
    """``rows`` with the named ``aggregates`` of their group; null keys are equal. Keys are numbers, hashes or other short values.

    The groups are aggregated in every task before the shuffle. At most ``most`` of them, those with the most rows, are broadcast
    to the rows; only rows of smaller groups (each less than one in ``most`` of all) are shuffled, so no hot key meets in a task.
    """
    own = [f"_key{i}" for i in range(len(keys))]
    groups = written(rows.groupBy(*keys).agg(F.count("*").alias("_n"), *aggregates).withColumnsRenamed(dict(zip(keys, own))), "groups")
    least = groups.select("_n").orderBy(F.desc("_n")).offset(most).limit(1).first()

    def same(side: DataFrame) -> Column:
        return reduce(Column.__and__, [rows[k].eqNullSafe(side[o]) for k, o in zip(keys, own)])

    if least is None:
        return rows.join(F.broadcast(groups.drop("_n")), same(groups)).drop(*own)
    hot, cold = F.broadcast(groups.filter(F.col("_n") > least["_n"]).drop("_n")), groups.filter(F.col("_n") <= least["_n"]).drop("_n")
    quiet = rows.join(hot, same(hot), "left_anti")
    return rows.join(hot, same(hot)).drop(*own).unionByName(quiet.join(cold, same(cold)).drop(*own))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once a row, also where ``use`` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged. Pure ASCII takes the fast way, which gives the same there."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def words(text: Column) -> Column:
    """The words of a text that is not null, in order; an empty array if it has none."""
    bare = F.btrim(text, F.lit(WORD_BREAKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+"))


def arrow_table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    """Rows, or none, as an Arrow table."""
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])
