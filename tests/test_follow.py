"""Growing logs: read from where they ended, read anew where they did not merely grow."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from hitledger import session
from hitledger.plans import ingest
from hitledger.plans.ingest import Settings, ingest_directory
from hitledger.plans.store import RollupStore
from hitledger.plans.traffic import Traffic
from hitledger.sources import files
from loglines import AS_OF, line

DAYS = ("2025-01-01", AS_OF)


@pytest.fixture
def store(spark):
    return RollupStore(spark, session.shared_dir(spark, "store"))


def at(hour, **more):
    return Settings(AS_OF, f"2025-03-10 {hour:02}:00:00", follow=True, **more)


def put(path, text, mtime, mode="wb"):
    with open(path, mode) as out:
        out.write(text if isinstance(text, bytes) else "".join(x + "\n" for x in text).encode())
    os.utime(path, (1_700_000_000 + mtime,) * 2)


def paths(store):
    return {r.path: r.n for r in Traffic(store.tables()).top_paths("all", *DAYS).collect()}


def listed(spark, path, begin, size):
    return spark.createDataFrame([("a.log", f"file:{path}", begin, size)], "source string, path string, begin bigint, size bigint")


@pytest.mark.parametrize("ends", [("\n",), ("\r\n",), ("\r",), ("\n", "\r\n", "\r")])
def test_ranges_hold_every_line_once(spark, tmp_path, ends):
    drawn = random.Random(len(ends) + len(ends[0]))
    data = "".join("x" * drawn.choice([0, 1, 2, 9, 40]) + str(i) + drawn.choice(ends) for i in range(60)).encode() + b"unfinished"
    put(tmp_path / "a.log", data, 0)
    want = sorted(re.split(r"\r\n|\r|\n", data.decode()))
    for width in (1, 7, 10_000):
        found = files.read_ranges(listed(spark, tmp_path / "a.log", 0, len(data)), width)
        assert sorted(r.line for r in found.collect()) == want, width
    text = spark.read.text(str(tmp_path / "a.log"))
    assert sorted(r.value for r in text.collect()) == want


def test_ranges_end_where_the_listing_did(spark, tmp_path):
    put(tmp_path / "a.log", ["one", "two", "three"], 0)
    assert [r.line for r in files.read_ranges(listed(spark, tmp_path / "a.log", 4, 8)).collect()] == ["two"]
    assert files.read_ranges(listed(spark, tmp_path / "a.log", 8, 8)).count() == 0
    (short,) = files.read_ranges(listed(spark, tmp_path / "a.log", 4, 99)).collect()
    assert short.line is None and "99 were listed" in short.error


def test_endings_tell_changes_at_both_ends(spark, tmp_path):
    data = b"a" * 50 + b"\n" + b"b" * 50 + b"\n"

    def ending(content, size, check=8):
        put(tmp_path / "a.log", content, 0)
        return files.endings(listed(spark, tmp_path / "a.log", 0, size), "size", check).first().ending

    known = ending(data, len(data))
    assert known and ending(data + b"more", len(data)) == known
    assert ending(b"x" + data[1:], len(data)) != known and ending(data[:-2] + b"x\n", len(data)) != known
    assert ending(data[:20] + b"x" + data[21:], len(data)) == known  # a short check does not see the middle
    assert ending(data[:20] + b"x" + data[21:], len(data), None) != ending(data, len(data), None)
    assert ending(data, len(data) - 1) is None and ending(data, len(data) + 1) is None and ending(b"", 0) is None


def test_appended_lines_are_added(spark, store, tmp_path):
    log = tmp_path / "a.log"
    put(log, [line(path="/old")] * 3 + ["garbage"], 0)
    put(tmp_path / "b.log", [line(path="/b")], 0)
    assert ingest_directory(store, str(tmp_path), at(1)).files_followed == []
    first = store.ledger().filter("source = 'a.log'").first()
    for hour in (2, 3):
        put(log, [line(path="/new"), line(path="/old", ip="10.0.0.9"), "garbage"], hour, "ab")
        summary = ingest_directory(store, str(tmp_path), at(hour))
        assert (summary.files_ingested, summary.files_followed, summary.n_unchanged) == (["a.log"], ["a.log"], 1)
    assert paths(store) == {"/old": 5, "/new": 2, "/b": 1}
    entry = store.ledger().filter("source = 'a.log'").first()
    assert (entry.rows_ingested, entry["size"], len(entry.kept)) == (7, log.stat().st_size, 2) and entry.kept[-1] == first.data_id
    assert store.tables()["daily_totals"].filter("category = 'all'").agg(F.sum("errors")).first()[0] == 3
    threshold = Traffic(store.tables()).top_by_threshold("daily_paths", "all", *DAYS, 2)
    assert [(r.path, r.n) for r in threshold.collect()] == [("/old", 5), ("/new", 2)]
    assert Traffic(store.tables()).unique_ips("all", *DAYS).first()[0] == Traffic(store.tables()).about_unique_ips("all", *DAYS).first()[0] == 2
    assert not ingest.has_pending_work(store, str(tmp_path), "2025-03-10 05:00:00")
    store.delete_sources(["a.log"], "gone", "2025-03-10 06:00:00")
    assert paths(store) == {"/b": 1}


def test_files_that_did_not_merely_grow_are_replaced(store, tmp_path):
    before = [line(path=f"/{i}") for i in range(6)]
    data = "".join(x + "\n" for x in before).encode()
    half = data + line(path="/half").encode()[:-3]
    changes = {"truncated": (data, data[: len(data) // 6 * 2]),
               "rotated": (data, "".join(line(path="/rotated/away") + "\n" for _ in range(9)).encode()),
               "rewritten": (data, data.replace(b"/0 ", b"/z ") + before[0].encode() + b"\n"),
               "within": (half, half + b'"x"\n' + before[0].encode() + b"\n"),
               "end": (data, data[:-1] + b" 77\n" + before[0].encode() + b"\n")}
    for name, (old, _) in changes.items():
        put(tmp_path / f"{name}.log", old, 0)
    ingest_directory(store, str(tmp_path), at(1))
    for name, (_, new) in changes.items():
        put(tmp_path / f"{name}.log", new, 9)
    summary = ingest_directory(store, str(tmp_path), at(2))
    assert summary.files_ingested == sorted(f"{c}.log" for c in changes) and summary.files_followed == []
    fresh = RollupStore(store.spark, session.shared_dir(store.spark, "store"))
    ingest_directory(fresh, str(tmp_path), Settings(AS_OF, "2025-03-10 02:00:00"))

    def by_source(of):
        return {(r.source, r.path): r["count"] for r in of.tables()["daily_paths"].filter("category = 'all'").collect()}

    assert by_source(store) == by_source(fresh)
    assert store._rows("daily_paths").select("ingest_id").distinct().count() == 1


def test_a_file_followed_often_is_read_anew(store, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "MOST_FOLLOWED", 2)
    log, followed = tmp_path / "a.log", []
    for hour in range(5):
        put(log, [line(path=f"/{hour}"), line()], hour, "ab")
        followed.append(bool(ingest_directory(store, str(tmp_path), at(hour)).files_followed))
    assert followed == [False, True, True, False, True]
    assert paths(store) == {"/start": 5, **{f"/{h}": 1 for h in range(5)}}
    assert store._rows("daily_paths").select("ingest_id").distinct().count() == 2


def test_following_beside_months_other_kinds_and_a_lost_ingest(store, tmp_path, monkeypatch):
    import gzip
    log = tmp_path / "a.log"
    put(log, [line(at="2025-01-05T10:00:00"), line()], 0)
    put(tmp_path / "c.log.gz", gzip.compress((line(path="/gz") + "\n").encode()), 0)
    ingest_directory(store, str(tmp_path), at(1))
    assert store.build_months(AS_OF) == ["2025-01"]
    put(log, [line(path="/late", at="2025-01-06T10:00:00")], 1, "ab")
    append = store.append_entries
    monkeypatch.setattr(store, "append_entries", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest_directory(store, str(tmp_path), at(2))
    assert paths(store) == {"/start": 2, "/gz": 1} and store.built_months() == ["2025-01"]
    monkeypatch.setattr(store, "append_entries", append)
    assert ingest_directory(store, str(tmp_path), at(3)).files_followed == ["a.log"]
    assert paths(store) == {"/start": 2, "/gz": 1, "/late": 1} and store.built_months() == []
    assert store._rows("daily_paths").select("ingest_id").distinct().count() == 2
    assert store.build_months(AS_OF) == ["2025-01"]
    answers = Traffic(store.tables(), store.months())
    assert answers.totals("all", *DAYS).first().total_requests == 4
