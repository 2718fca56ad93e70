"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
import oracle_check
from workload import oracle, registry

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle_check.connect(SF_DIR)


def test_every_query_of_the_workload_has_a_twin():
    assert set(registry.QUERIES) == set(oracle.ORACLE)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    spark.conf.set("spark.sql.codegen.wholeStage", "true")  # as in production; the unit tests run without
    try:
        assert oracle_check.differences(entry.queries()[name](spark, SF_DIR), entry.oracle_sql()[name], duck) == []
    finally:
        spark.conf.set("spark.sql.codegen.wholeStage", "false")


def test_entry(spark):
    assert entry.entry(spark).columns == ["path", "n"]
