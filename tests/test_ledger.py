import pytest

from hitledger.operators import ledger

NOW = "2025-03-10 12:00:00"
LEDGER = "source string, mtime double, size bigint, ingested_at string"


def changed(spark, entries, listing, cooldown=300):
    known = spark.createDataFrame(entries, LEDGER).selectExpr(
        "source", "concat('/x/', source) AS path", "mtime", "size", "CAST(ingested_at AS timestamp_ntz) AS ingested_at")
    files = spark.createDataFrame(listing, "source string, path string, mtime double, size bigint")
    return {r.source for r in ledger.changed(files, known, NOW, cooldown).collect()}


@pytest.mark.parametrize("entry, disk, cooldown, current", [
    (None, (1000.0, 512), 300, False),
    ((1234567890.0, 4096, "2020-01-01 00:00:00"), (1234567890.0, 4096), 300, True),
    ((1000.0, 4096, "2020-01-01 00:00:00"), (1000.0009, 4096), 300, True),
    ((1000.0, 4096, "2020-01-01 00:00:00"), (1000.002, 4096), 300, False),
    ((1000.0, 100, NOW), (1000.0, 200), 0, False),
    ((1000.0, 100, NOW), (1001.0, 200), 300, True),
    ((1000.0, 100, "2025-03-10 11:55:01"), (1001.0, 200), 300, True),
    ((1000.0, 100, "2025-03-10 11:55:00"), (1001.0, 200), 300, False),
    ((1000.0, 100, "2025-03-10 11:50:00"), (1001.0, 200), 300, False),
    ((1000.0, 100, NOW), (1001.0, 200), 0, False),
    ((1000.0, 100, None), (1001.0, 200), 300, False),
])
def test_currency(spark, entry, disk, cooldown, current):
    entries = [("other.log", 1.0, 1, NOW)] + ([("a.log", *entry)] if entry else [])
    assert changed(spark, entries, [("a.log", "/x/a.log", *disk)], cooldown) == (set() if current else {"a.log"})


def test_a_name_stands_for_one_path(spark):
    known = spark.createDataFrame([("a.log", "/x/a.log", 1.0, 1)], "source string, path string, mtime double, size bigint").selectExpr(
        "*", "timestamp_ntz'2025-03-10 11:59:00' AS ingested_at")
    files = spark.createDataFrame([("a.log", "/y/a.log", 1.0, 1), ("b.log", "/x/b.log", 1.0, 1), ("b.log", "/y/b.log", 1.0, 1), ("c.log", "/y/c.log", 1.0, 1)],
                                  "source string, path string, mtime double, size bigint")
    found = ledger.with_status(files, known, NOW).filter("NOT current").orderBy("source", "path").collect()
    assert len(found) == 4 and set(ledger.same_names(found)) == {"a.log", "b.log"}


def test_kinds(spark):
    names = {"access.log": "text", "access": "text", "logfile.2020-01-01": "text", "a.log.GZ": "gzip", "a.TAR.GZ": "archive",
             "a.tar.gz": "archive", "a.tgz": "text", "x.duckdb": None, "x.wal": None, "x.DB": None, "x.json": None,
             "x.bz2": None, "x.log.zip": None, "zip": "text", "db.log": "text"}
    rows = spark.createDataFrame([(n,) for n in names], "source string")
    assert {r.source: r.kind for r in ledger.classify(rows).collect()} == {n: k for n, k in names.items() if k}


def test_retention_keeps_whole_days(spark):
    days = spark.sql("SELECT CAST(d AS date) AS day FROM VALUES ('2025-03-01'), ('2025-02-28') AS t(d)")
    hours = spark.sql("SELECT CAST(h AS timestamp_ntz) AS hour FROM VALUES ('2025-03-01 00:00:00'), "
                      "('2025-02-28 23:00:00') AS t(h)")
    assert [str(r.day) for r in ledger.retained(days, "2025-03-10", 9).collect()] == ["2025-03-01"]
    assert [str(r.hour) for r in ledger.retained(hours, "2025-03-10", 9).collect()] == ["2025-03-01 00:00:00"]
