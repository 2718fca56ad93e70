"""Compressed files dealt to tasks by size."""

import gzip
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hitledger.operators import ledger
from hitledger.sources import files

SCHEMA = "source string, path string, kind string, size bigint"


def dealt(frame, *args):
    rows, tasks = files.packed(frame, *args)
    loads = defaultdict(list)
    for r in rows.collect():
        loads[r.task].append(r.size or 0)
    return loads, tasks


def test_many_small_files_make_few_tasks(spark):
    listing = spark.range(100_000).selectExpr("concat('f', id, '.gz') AS source", "concat('/logs/f', id, '.gz') AS path", "'gzip' AS kind", "id % 3000 AS size")
    loads, tasks = dealt(listing)
    assert 190 <= tasks <= 210 and set(loads) == set(range(tasks)) and sum(map(len, loads.values())) == 100_000
    assert max(map(len, loads.values())) <= files.TASK_BYTES // files.FILE_BYTES + 1


@pytest.mark.parametrize("sizes", [[10**12, 5, 5, 10**12], [0], [None, 0, -1], [70 * 2**20] * 40, [2**20] * 300 + [2**33], []])
def test_tasks_hold_a_stretch_and_one_file_more(spark, sizes):
    listing = spark.createDataFrame([("same", f"/{i}", "gzip", s) for i, s in enumerate(sizes)], SCHEMA)
    loads, tasks = dealt(listing)
    cores = spark.sparkContext.defaultParallelism
    assert sorted(s for load in loads.values() for s in load) == sorted(s or 0 for s in sizes)
    assert all(0 <= t < tasks for t in loads) and tasks <= max(cores, 2 * len(sizes) + 1)
    for load in loads.values():
        assert sum(sorted(load)[:-1]) <= files.TASK_BYTES


def test_few_files_use_all_cores(spark):
    listing = spark.createDataFrame([(f"{i}", f"/{i}", "gzip", 2**20) for i in range(64)], SCHEMA)
    loads, tasks = dealt(listing)
    assert tasks == spark.sparkContext.defaultParallelism and max(map(len, loads.values())) <= 64 // tasks + 1


def test_files_of_one_path_and_extra_columns(spark):
    listing = spark.createDataFrame([("a", "/a", "gzip", 5, 1), ("a", "/a", "gzip", 5, 2)], SCHEMA + ", part int")
    rows, _ = files.packed(listing)
    assert rows.columns == [*listing.columns, "task"] and sorted(r.part for r in rows.collect()) == [1, 2]


def test_no_line_is_lost_where_files_share_tasks(spark, tmp_path):
    for i in range(200):
        (tmp_path / f"l{i}.log.gz").write_bytes(gzip.compress("".join(f"{i}-{k}\n" for k in range(i % 7)).encode()))
    (tmp_path / "bad.gz").write_bytes(b"not gzip")
    listed = ledger.classify(files.list_files(spark, str(tmp_path))).collect()
    lines = files.read_lines(spark, listed)
    assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    good = lines.filter("error IS NULL AND line IS NOT NULL")
    assert sorted(r.line for r in good.collect()) == sorted(f"{i}-{k}" for i in range(200) for k in range(i % 7))
    assert [r.source for r in lines.filter(F.col("error").isNotNull()).collect()] == ["bad.gz"]
