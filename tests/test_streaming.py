import gzip
import os

import pytest

from hitledger import session
from hitledger.operators import parse, rollups
from hitledger.plans.ingest import Settings
from hitledger.plans.store import RollupStore
from hitledger.streaming import continuous
from loglines import AS_OF, CRAWLER, frame, line
from pyspark.sql import functions as F


def write_logs(directory):
    """Three files whose days arrive out of order."""
    logs = {"a.log": [line(at="2025-03-05T10:00:00"), line(agent=CRAWLER)], "b.log": [line(at="2025-03-01T10:00:00")] * 2,
            "c.log": [line(at="2025-03-05T10:30:00"), "garbage"]}
    for i, (name, lines) in enumerate(logs.items()):
        (directory / name).write_text("".join(x + "\n" for x in lines))
        os.utime(directory / name, (1_700_000_000 + i,) * 2)
    return logs


def batch_rows(spark, logs, table):
    rows = None
    for name, lines in logs.items():
        rows = frame(spark, lines, name) if rows is None else rows.unionByName(frame(spark, lines, name))
    built = rollups.build(parse.parse_lines(rows), AS_OF)[table]
    return sorted(map(str, built.select(sorted(built.columns)).collect()))


def stored_rows(store, table):
    rows = store.tables()[table].drop("day") if table == "hourly_totals" else store.tables()[table]
    return sorted(map(str, rows.select(sorted(rows.columns)).collect()))


def settings():
    return Settings(AS_OF, "2025-03-10 10:00:00")


def test_watched_directory_equals_batch(spark, tmp_path):
    store = RollupStore(spark, session.shared_dir(spark, "store"))
    logs = write_logs(tmp_path)
    checkpoint = session.shared_dir(spark, "checkpoint")

    def run(where):
        continuous.watch_directory(store, str(tmp_path), where, settings, files_per_batch=1,
                                   available_now=True).awaitTermination()

    run(checkpoint)
    for table in ("daily_totals", "daily_paths", "hourly_totals", "daily_ip_paths"):
        assert stored_rows(store, table) == batch_rows(spark, logs, table)
    run(session.shared_dir(spark, "checkpoint"))  # a new checkpoint shows all files again
    logs["d.log"] = [line(at="2025-03-01T11:00:00")]
    (tmp_path / "d.log").write_text(logs["d.log"][0] + "\n")
    run(checkpoint)  # the next batch of the first stream
    assert stored_rows(store, "hourly_totals") == batch_rows(spark, logs, "hourly_totals")


def total(store):
    return store.tables()["daily_totals"].filter("category = 'all'").agg(F.coalesce(F.sum("total_requests"), F.lit(0))).first()[0]


def watch(store, directory, checkpoint):
    continuous.watch_directory(store, str(directory), checkpoint, settings, available_now=True).awaitTermination()


def test_no_file_is_lost(spark, tmp_path):
    """Two directories, a grown file under a new checkpoint, and a truncated file completed later, all into one store."""
    store, one, two = RollupStore(spark, session.shared_dir(spark, "store")), tmp_path / "one", tmp_path / "two"
    for directory, n in ((one, 2), (two, 3)):
        directory.mkdir()
        (directory / f"{directory.name}.log").write_text((line() + "\n") * n)
    checkpoints = [session.shared_dir(spark, "checkpoint") for _ in range(3)]
    watch(store, one, checkpoints[0])
    watch(store, two, checkpoints[1])
    assert total(store) == 5
    (one / "one.log").write_text((line() + "\n") * 7)  # within the cooldown of its ingest
    whole = gzip.compress("".join(f"{line(path=f'/{i}')}\n" for i in range(5000)).encode())
    (one / "late.log.gz").write_bytes(whole[:-500])
    watch(store, one, checkpoints[2])
    assert total(store) == 10
    (one / "late.log.gz").write_bytes(whole)
    watch(store, one, checkpoints[2])  # the stream shows no new file
    assert total(store) == 5010
    watch(store, one, checkpoints[2])
    assert total(store) == 5010 and store.failed_files("x").isEmpty()


def test_live_counts_equal_batch_and_keep_late_lines(spark, tmp_path):
    logs = write_logs(tmp_path)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path)).select(
        F.col("_metadata.file_name").alias("source"), F.col("value").alias("line"))
    path = session.shared_dir(spark, "counts")
    continuous.keep_updates(continuous.windowed_counts(lines, watermark=None), path, session.shared_dir(spark, "checkpoint"),
                            available_now=True).awaitTermination()
    got = continuous.latest_counts(spark, path).withColumnRenamed("start", "hour")
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == batch_rows(spark, logs, "hourly_totals")


def test_watermark_drops_what_is_older(spark, tmp_path):
    write_logs(tmp_path)
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 1).load(str(tmp_path)).select(
        F.lit("s").alias("source"), F.col("value").alias("line"))
    path = session.shared_dir(spark, "counts")
    continuous.keep_updates(continuous.windowed_counts(lines, "1 day", "2 days"), path,
                            session.shared_dir(spark, "checkpoint"), available_now=True).awaitTermination()
    days = {str(r.start)[:10]: r["count"] for r in continuous.latest_counts(spark, path).filter("category = 'all'").collect()}
    # 9 March closes 1 and 5 March. Spark still accepts the next batch's lines, and drops those of the batch after it.
    assert days == {"2025-03-09": 1, "2025-03-05": 1, "2025-03-01": 2}


ZONES = ("UTC", "America/New_York")


def in_zone(spark, zone, action):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        return action()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def text_stream(spark, directory, files=1):
    return spark.readStream.format("text").option("maxFilesPerTrigger", files).load(str(directory)).select(
        F.lit("s").alias("source"), F.col("value").alias("line"))


def starts(frame):
    """Windows as the log's clock tells them, whatever zone the session is in."""
    return sorted((r.start, r["count"]) for r in frame.filter("category = 'all'").select(F.col("start").cast("string"), "count").collect())


@pytest.mark.parametrize("zone", ZONES)
@pytest.mark.parametrize("size,want", [("1 hour", [("2024-03-10 01:00:00", 1), ("2024-03-10 02:00:00", 1), ("2024-03-10 03:00:00", 1), ("2024-03-10 23:00:00", 1)]),
                                       ("1 day", [("2024-03-10 00:00:00", 4)])])
def test_windows_are_of_the_logs_clock(spark, tmp_path, zone, size, want):
    """The night in which New York has no hour from two to three."""
    (tmp_path / "a.log").write_text("".join(line(at=f"2024-03-10T{t}:00") + "\n" for t in ("01:30", "02:30", "03:30", "23:59")))

    def counted():
        paths = [session.shared_dir(spark, "counts") for _ in range(3)]
        for path, mark in zip(paths, ("2 days", None)):
            continuous.keep_updates(continuous.windowed_counts(text_stream(spark, tmp_path), size, mark), path, session.shared_dir(spark, "checkpoint"),
                                    available_now=True).awaitTermination()
            assert starts(continuous.latest_counts(spark, path)) == want
        continuous.count_windows(text_stream(spark, tmp_path), paths[2], session.shared_dir(spark, "checkpoint"), size, available_now=True).awaitTermination()
        assert starts(continuous.window_totals(spark, paths[2])) == want
    in_zone(spark, zone, counted)


def test_counts_without_state(spark, tmp_path):
    """Lines years late count; folders stay few; replayed batches, folded or not, count once; no state is kept."""
    for i in range(9):
        (tmp_path / f"{i}.log").write_text("".join(line(at=f"20{20 + i % 5}-01-0{1 + j}T10:00:00", agent=CRAWLER if j else "x") + "\n" for j in range(3)) + "garbage\n")
        os.utime(tmp_path / f"{i}.log", (1_700_000_000 + i,) * 2)
    path, checkpoint = session.shared_dir(spark, "counts"), session.shared_dir(spark, "checkpoint")
    assert continuous.window_totals(spark, path).isEmpty() and continuous.fold_counts(spark, path) is None

    def run(where, fold_every):
        continuous.count_windows(text_stream(spark, tmp_path), path, where, "1 day", fold_every, available_now=True).awaitTermination()

    def everything():
        rows = spark.read.text(str(tmp_path)).select(F.lit("s").alias("source"), F.col("value").alias("line"))
        return sorted(tuple(r) for r in continuous.windowed_counts(rows, "1 day", None).collect())

    run(checkpoint, 2)
    assert sorted(tuple(r) for r in continuous.window_totals(spark, path).collect()) == everything()
    assert len(session.children(spark, path)) <= 6 and not session.exists(spark, f"{checkpoint}/state")
    run(session.shared_dir(spark, "checkpoint"), 100)  # all batches once more under their old numbers
    assert sorted(tuple(r) for r in continuous.window_totals(spark, path).collect()) == everything()
    assert continuous.fold_counts(spark, path) == continuous.fold_counts(spark, path) == 8
    (tmp_path / "late.log").write_text(line(at="1999-12-31T23:59:59") + "\n")
    run(checkpoint, 2)
    assert ("1999-12-31 00:00:00", 1) in starts(continuous.window_totals(spark, path))
    assert sorted(tuple(r) for r in continuous.window_totals(spark, path).collect()) == everything()
