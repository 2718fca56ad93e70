import gzip
import io
import os
import tarfile

import pyarrow.parquet as pq
import pytest

from hitledger import session
from hitledger.operators import geo
from hitledger.plans import ingest, store as stores
from hitledger.plans.ingest import Settings, ingest_directory, ingest_lines
from hitledger.plans.store import RollupStore
from hitledger.plans.traffic import Traffic
from loglines import AS_OF, frame, line
from pyspark.sql import functions as F

DAYS = ("2025-01-01", AS_OF)


@pytest.fixture
def store(spark):
    return RollupStore(spark, session.shared_dir(spark, "store"))


def at(minute, **more):
    return Settings(AS_OF, f"2025-03-10 10:{minute:02}:00", **more)


def write(path, lines, mtime=1_700_000_000):
    path.write_text("".join(x + "\n" for x in lines))
    os.utime(path, (mtime, mtime))


def write_tar(path, members):
    with tarfile.open(path, "w:gz") as archive:
        for name, lines in members.items():
            data = "".join(x + "\n" for x in lines).encode()
            data = gzip.compress(data) if name.lower().endswith(".gz") else data
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            archive.addfile(entry, io.BytesIO(data))


def total(store, **where):
    rows = store.tables()["daily_totals"].filter("category = 'all'")
    for key, value in where.items():
        rows = rows.filter(F.col(key) == value)
    return rows.agg(F.coalesce(F.sum("total_requests"), F.lit(0))).first()[0]


def test_all_kinds_of_files(spark, store, tmp_path):
    write(tmp_path / "plain [1].log", [line()] * 4 + ["garbage"])
    write(tmp_path / "notes.json", [line()])
    (tmp_path / "old.zip").write_bytes(b"PK")
    (tmp_path / "crlf.log").write_bytes((line() + "\r\n" + line() + "\r" + line()).encode() + b" \xff\xfe\n")
    with gzip.open(tmp_path / "b.log.GZ", "wt") as out:
        out.write((line() + "\n") * 5)
    write_tar(tmp_path / "c.tar.gz", {"x/one.log": [line()] * 3, "y/one.log": [line()] * 2, "empty.log": [], "z/old.log.1.GZ": [line()] * 6})
    (tmp_path / "sub").mkdir()
    write(tmp_path / "sub" / "deep.log", [line()])
    assert ingest.has_pending_work(store, str(tmp_path))
    summary = ingest_directory(store, str(tmp_path), at(0))
    assert summary.files_ingested == ["b.log.GZ", "c.tar.gz", "crlf.log", "plain [1].log"]
    assert (summary.n_unchanged, summary.files_skipped, summary.errors) == (0, {}, {})
    by_source = {r.source: r.total_requests for r in store.tables()["daily_totals"].filter(
        "category = 'all' AND total_requests > 0").collect()}
    assert by_source == {"plain [1].log": 4, "crlf.log": 3, "b.log.GZ": 5, "c.tar.gz/x/one.log": 3, "c.tar.gz/y/one.log": 2,
                         "c.tar.gz/z/old.log.1.GZ": 6}
    rows = {r.source: r.rows_ingested for r in store.ledger().collect()}
    assert rows == {**by_source, "c.tar.gz": 0}
    again = ingest_directory(store, str(tmp_path), at(30))
    assert again.files_ingested == [] and again.n_unchanged == 4
    assert not ingest.has_pending_work(store, str(tmp_path))


def test_changed_file_replaces_its_rows_after_the_cooldown(store, tmp_path):
    log = tmp_path / "a.log"
    write(log, [line(path="/old")] * 3)
    write(tmp_path / "b.log", [line(path="/b")])
    ingest_directory(store, str(tmp_path), at(0))
    write(log, [line(path="/new")] * 5, mtime=1_700_000_100)
    assert ingest_directory(store, str(tmp_path), at(4)).files_ingested == []
    assert total(store, source="a.log") == 3
    assert ingest_directory(store, str(tmp_path), at(5)).files_ingested == ["a.log"]
    assert total(store, source="a.log") == 5 and total(store, source="b.log") == 1
    paths = {r.path for r in store.tables()["daily_paths"].filter("source = 'a.log'").collect()}
    assert paths == {"/new"}
    (entry,) = store.ledger().filter("source = 'a.log'").collect()
    assert (entry.mtime, entry.size, entry.rows_ingested) == (1_700_000_100, log.stat().st_size, 5)
    write(log, [], mtime=1_700_000_200)
    ingest_directory(store, str(tmp_path), at(20))
    assert total(store, source="a.log") == 0 and total(store) == 1


def test_unreadable_files_keep_their_old_rows(store, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as out:
        out.write((line() + "\n") * 3)
    write(tmp_path / "b.log", [line()])
    write_tar(tmp_path / "c.tar.gz", {"m.log": [line()] * 2})
    ingest_directory(store, str(tmp_path), at(0))
    whole = gzip.compress("".join(f"{line(path=f'/{i}')}\n" for i in range(20_000)).encode())
    (tmp_path / "a.log.gz").write_bytes(whole[:-500])
    (tmp_path / "c.tar.gz").write_bytes(b"no archive")
    write(tmp_path / "b.log", [line()] * 2)
    summary = ingest_directory(store, str(tmp_path), at(30))
    assert summary.files_ingested == ["b.log"]
    assert set(summary.errors) == {"a.log.gz"} and "EOF" in summary.errors["a.log.gz"]
    assert set(summary.files_skipped) == {"c.tar.gz"}
    assert [total(store, source=s) for s in ("a.log.gz", "b.log", "c.tar.gz/m.log")] == [3, 2, 2]
    assert ingest.has_pending_work(store, str(tmp_path), "2025-03-10 11:00:00")


def test_members_dropped_from_an_archive_disappear(store, tmp_path):
    write_tar(tmp_path / "c.tar.gz", {"one.log": [line()], "two.log": [line()] * 2})
    ingest_directory(store, str(tmp_path), at(0))
    write_tar(tmp_path / "c.tar.gz", {"two.log": [line()] * 7})
    ingest_directory(store, str(tmp_path), at(30))
    assert total(store) == 7
    assert {r.source for r in store.ledger().collect()} == {"c.tar.gz", "c.tar.gz/two.log"}


def test_failed_ingest_stays_invisible(spark, store, monkeypatch):
    ingest_lines(store, frame(spark, [line()] * 2), at(0), "one")
    monkeypatch.setattr(store, "append_entries", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest_lines(store, frame(spark, [line()] * 9), at(1), "two")
    assert total(store) == 2
    monkeypatch.undo()
    ingest_lines(store, frame(spark, [line()] * 5), at(2), "two")
    assert total(store) == 5
    ingest_lines(store, frame(spark, [line()] * 8), at(3), "two")  # already committed
    assert total(store) == 5


def rows_on_disk(spark, store, table="daily_paths"):
    return store._rows(table)


def test_replaced_and_deleted_rows_leave_the_disk(spark, store):
    for i, source in enumerate(("a", "b", "c")):
        ingest_lines(store, frame(spark, [line()] * (i + 1), source), at(i), f"in-{i}")
    ingest_lines(store, frame(spark, [line()] * 9, "a"), at(5), "in-5")
    store.delete_sources(["b"], "del", "2025-03-10 10:06:00")
    assert {r.source for r in store.ledger().collect()} == {"a", "c"}
    assert total(store) == 12
    for table in store.tables():
        left = {(r.source, r.ingest_id) for r in rows_on_disk(spark, store, table).select("source", "ingest_id").collect()}
        assert left == ({("a", "in-5"), ("c", "in-2")} if table != "daily_referers" else set())
    plan = store.tables()["daily_paths"]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan  # nothing is unsettled, so the table is a plain scan
    ingest_lines(store, frame(spark, [line()], "c"), at(8), "in-8")
    assert total(store) == 10


def test_only_buckets_of_replaced_sources_are_rewritten(spark, store):
    for i in range(12):
        ingest_lines(store, frame(spark, [line(), line(at="2025-03-01T00:00:00")], f"s{i}"), at(i), f"in-{i}")
    before = {p: m for p, m in files_of(store).items()}
    ingest_lines(store, frame(spark, [line()], "s3"), at(30), "again")
    after = files_of(store)
    bucket = rows_on_disk(spark, store).filter("source = 's3'").select("bucket").first()[0]
    touched = {p for p in set(before) ^ set(after)} | {p for p in before if after.get(p) != before[p]}
    assert touched and all(f"bucket={bucket}/" in p for p in touched)
    assert total(store) == 23 and total(store, source="s3") == 1


def test_files_of_replaced_rows_alone_are_removed_not_rewritten(spark, store, monkeypatch):
    """Only folders with a file of both kinds of rows are written again: here that of the two sources that came with one ingest."""
    written, settling = [], []
    write, rewrite = store._writer, store._rewrite
    monkeypatch.setattr(store, "_writer", lambda table, *a: (settling and written.append(table), write(table, *a))[1])
    monkeypatch.setattr(store, "_rewrite", lambda buckets: (settling.append(1), rewrite(buckets), settling.clear())[1])
    ingest_lines(store, frame(spark, [line()] * 2, "a"), at(0), "one")
    ingest_lines(store, frame(spark, [line()] * 5, "a"), at(1), "two")
    assert written == [] and total(store) == 5
    assert {r[0] for r in rows_on_disk(spark, store).select("ingest_id").distinct().collect()} == {"two"}
    same = next(f"b{i}" for i in range(99) if spark.sql(f"SELECT pmod(xxhash64('b{i}'), 8) = pmod(xxhash64('a'), 8)").first()[0])
    ingest_lines(store, frame(spark, [line()], "a").unionByName(frame(spark, [line()] * 3, same)), at(2), "three")
    assert written == [] and total(store) == 4
    ingest_lines(store, frame(spark, [line()] * 7, "a"), at(3), "four")
    assert "daily_totals" in written and (total(store, source="a"), total(store, source=same)) == (7, 3)
    assert {tuple(r) for r in rows_on_disk(spark, store).select("source", "ingest_id").collect()} == {("a", "four"), (same, "three")}


def test_a_changed_file_replaces_its_rows_without_writing_others_again(spark, store, tmp_path, monkeypatch):
    written, write_rows = [], store._writer
    monkeypatch.setattr(store, "_writer", lambda table, *a: (written.append(table), write_rows(table, *a))[1])
    write(tmp_path / "a.log", [line()] * 2)
    ingest_directory(store, str(tmp_path), at(0))
    write(tmp_path / "a.log", [line()] * 4)
    ingest_directory(store, str(tmp_path), at(30))
    assert total(store) == 4 and sorted(written) == sorted([*store.tables()] * 2)  # once by each ingest


def test_staged_rollups_are_parsed_once_and_invisible(spark, store, monkeypatch):
    parsed, parse_lines = [], ingest.parse.parse_lines
    monkeypatch.setattr(ingest.parse, "parse_lines", lambda lines: (parsed.append(1), parse_lines(lines))[1])
    ingest_lines(store, frame(spark, [line()] * 2, "a"), at(0), "one")
    ingest.stage_rollups(store, frame(spark, [line()] * 9, "a"), at(1), "lost")
    assert len(parsed) == 2 and total(store) == 2
    assert {r[0] for r in rows_on_disk(spark, store).select("ingest_id").distinct().collect()} == {"one", "lost"}
    ingest_lines(store, frame(spark, [line()] * 3, "a"), at(2), "two")
    assert total(store) == 3 and not session.children(spark, f"{store.root}/unsettled")


def files_of(store):
    root = store.root.removeprefix("file:")
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(f"{root}/rollups") for n in names if n.endswith(".parquet")}


def test_an_interrupted_rewrite_is_invisible_and_done_by_the_next_ingest(spark, store, monkeypatch):
    ingest_lines(store, frame(spark, [line()] * 2, "a"), at(0), "one")
    monkeypatch.setattr(store, "_rewrite", lambda buckets: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        ingest_lines(store, frame(spark, [line()] * 5, "a"), at(1), "two")
    assert total(store) == 5  # committed; the old rows are still on disk
    assert rows_on_disk(spark, store).select("ingest_id").distinct().count() == 2
    monkeypatch.undo()
    ingest_lines(store, frame(spark, [line()], "b"), at(2), "three")
    assert total(store) == 6 and not session.children(spark, f"{store.root}/unsettled")
    assert {r[0] for r in rows_on_disk(spark, store).select("ingest_id").distinct().collect()} == {"two", "three"}


def test_planning_does_not_grow_with_ingests(spark, store, monkeypatch):
    monkeypatch.setattr(stores, "LEDGER_FOLDERS", 4)
    for i in range(11):
        store.mark_ingested(f"s{i % 6}", f"/logs/s{i % 6}", float(i), i, f"m{i}", f"2025-03-10 10:{i:02}:00")
    assert len(session.children(spark, f"{store.root}/ledger/commits")) <= 4 and len(session.children(spark, f"{store.root}/ledger/folds")) == 1
    assert {(r.source, r["size"]) for r in store.ledger().collect()} == {(f"s{i % 6}", i) for i in range(5, 11)}
    assert all(store.has_ingest(f"m{i}") for i in range(11)) and not store.has_ingest("m11")


def test_a_lookup_reads_few_row_groups(spark):
    """One client among thousands: most row groups of its day's files are passed over, without knowing which bucket holds it."""
    store = RollupStore(spark, session.shared_dir(spark, "store"), buckets=2, options={"parquet.block.size": "65536", "parquet.page.row.count.limit": "1000"})
    lines = spark.range(40_000).selectExpr("concat('s', id % 3) AS source", "concat('10.', id % 200, '.', id div 200 % 200, '.7') AS ip", "id").select(
        "source", F.concat("ip", F.lit(' - - [05/Mar/2025:10:00:00 +0000] "GET /'), F.col("id").cast("string"), F.lit(' HTTP/1.1" 200 5 "-" "x" 1')).alias("line"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many files as a large day has
    try:
        ingest_lines(store, lines, at(0), "one")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert store.tables()["daily_ips"].filter("category = 'all'").count() == 40_000
    found = store.tables()["daily_ips"].filter("category = 'all' AND ip = '10.7.9.7'")
    assert found.agg(F.sum("count")).first()[0] == 1
    groups, holding = 0, 0
    for path in files_of(store):
        if "/daily_ips/" in path:
            meta = pq.ParquetFile(path).metadata
            column = next(i for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema == "ip")
            for g in range(meta.num_row_groups):
                stats = meta.row_group(g).column(column).statistics
                groups += 1
                holding += stats.min <= "10.7.9.7" <= stats.max
    assert groups >= 8 and holding <= groups / 4, (groups, holding)


def test_mark_ingested_keeps_rows(spark, store):
    store.mark_ingested("arc.tar.gz", "/logs/arc.tar.gz", 1000.0, 500, "m1", "2025-03-10 10:00:00")
    store.mark_ingested("arc.tar.gz", "/logs/arc.tar.gz", 2000.0, 600, "m2", "2025-03-10 10:01:00")
    (entry,) = store.ledger().collect()
    assert (entry.mtime, entry.size) == (2000.0, 600)
    ingest_lines(store, frame(spark, [line()] * 3, "a"), at(2), "in")
    store.mark_ingested("a", "/logs/a", 1.0, 1, "m3", "2025-03-10 10:03:00")
    assert total(store) == 3


def test_retention_drops_day_folders(spark, store):
    lines = [line(at=f"2025-03-0{d}T00:00:00", referer="http://r/") for d in (1, 2, 3)]
    ingest_lines(store, frame(spark, lines), at(0, retention_days=8), "one")  # keeps 2025-03-02 and later
    days = {t: {str(r.day) for r in store.tables()[t].select("day").distinct().collect()} for t in store.tables()}
    assert set(map(frozenset, days.values())) == {frozenset({"2025-03-02", "2025-03-03"})}


def test_queries_prune_days_and_columns(spark, store):
    ingest_lines(store, frame(spark, [line()]), at(0), "one")
    plan = Traffic(store.tables()).top_paths("human", "2025-03-01", "2025-03-09")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in text and "day#" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert "EqualTo(category,human)" in text
    assert "ReadSchema: struct<category:string,path:string,count:bigint>" in text


def test_ingest_and_report(spark, store, tmp_path):
    write(tmp_path / "a.log", [line("10.0.0.1", "/a", rt=1000), line("10.0.0.1", "/a", rt=3000), line("10.0.0.2", "/b", at="2025-01-01T00:00:00"),
                               "garbage"])
    blocks = geo.blocks_from_networks(spark.createDataFrame(
        [("10.0.0.0/31", "AA", "Aland", "Acity")], "network string, country_code string, country string, city string"))
    report = ingest.ingest_and_report(store, str(tmp_path), at(0, blocks=blocks), days=30)
    assert (report["from_date"], report["to_date"], report["geo_available"]) == ("2025-02-08", AS_OF, True)
    totals = report["all"]["totals"].first()
    assert (totals.total_requests, totals.errors, totals.unique_ips, totals.avg_response_time_us) == (2, 1, 1, 2000)
    assert report["bot"]["totals"].first().total_requests == 0
    assert [tuple(r) for r in report["all"]["top_countries"].collect()] == [("AA", "Aland", 2)]
    assert [tuple(r) for r in report["drill_ip"].collect()] == [("10.0.0.1", "/a", 2)]
    assert report["ingest"].files_ingested == ["a.log"]


def test_clock_is_utc():
    assert len(stores.utc_now().split(".")[0]) == 19


def test_empty_store_answers(store):
    traffic = Traffic(store.tables())
    assert traffic.available_years("all").isEmpty() and traffic.subnets("all", *DAYS).isEmpty()
    assert traffic.totals("all", *DAYS).first().total_requests == 0


def test_sizes_beyond_a_bigint_fail_their_file_alone(store, tmp_path):
    write(tmp_path / "good.log", [line(size=str(2**63 - 1)), line()])
    write(tmp_path / "bad.log", [line(size=str(2**63 - 1))] * 2)
    write(tmp_path / "fine.log", [line(size=str(2**63 - 1))])
    write(tmp_path / "good.log", [line()] * 2)
    summary = ingest_directory(store, str(tmp_path), at(0))
    assert summary.files_ingested == ["fine.log", "good.log"] and set(summary.errors) == {"bad.log"}
    assert "2^63" in summary.errors["bad.log"] and total(store) == 3


def test_blocks_of_a_compressed_file_lose_no_line(spark, store, tmp_path, monkeypatch):
    from hitledger.sources import files
    monkeypatch.setattr(files, "BLOCK_BYTES", 1000)
    lines = [line(path=f"/{i}") for i in range(300)] + ["x" * 5000] + [line(path="/last")]
    with gzip.open(tmp_path / "a.log.gz", "wb") as out:
        out.write("\n".join(lines).encode())
    ingest_directory(store, str(tmp_path), at(0))
    assert total(store) == 301
    assert store.tables()["daily_paths"].filter("category = 'all'").select("path").distinct().count() == 301


def test_same_name_in_two_directories_is_refused(store, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        write(tmp_path / name / "a.log", [line()] * (2 if name == "one" else 9))
    assert ingest_directory(store, str(tmp_path / "one"), at(0)).files_ingested == ["a.log"]
    summary = ingest_directory(store, str(tmp_path / "two"), at(30))
    assert summary.files_ingested == [] and "has the name of" in summary.errors["a.log"] and total(store) == 2


def test_drill_downs_hold_everything(spark, store):
    """More clients, paths of a client and clients of a path than any top list has."""
    lines = [line(ip=f"10.1.{i // 250}.{i % 250}", path="/common") for i in range(600)]
    lines += [line(ip="10.1.2.99", path=f"/p{i}") for i in range(25)] + [line(path=f"/q{i}/needle") for i in range(1150)]
    ingest_lines(store, frame(spark, lines), at(0), "one")
    traffic = Traffic(store.tables())
    assert traffic.drill_path_total("/common", *DAYS, limit=1000).first().total_requests == 600
    assert traffic.drill_path("/common", *DAYS, limit=1000).count() == 600
    assert traffic.drill_ip("10.1.2.99", *DAYS, limit=100).count() == 26
    assert all(traffic.drill_ip(f"10.1.{i // 250}.{i % 250}", *DAYS).count() == 1 for i in (0, 555, 598))
    assert traffic.search_paths("/q1149/", "all", *DAYS).count() == 1
    assert traffic.search_paths("/needle", "all", *DAYS).count() == 1150


def test_driver_work_does_not_grow_with_history(spark, store, tmp_path, monkeypatch):
    """Sources that are gone and earlier ingests cost no file-system calls."""
    write(tmp_path / "a.log", [line()])
    gone = spark.range(1000).selectExpr("concat('gone', id) AS source", "concat('/old/gone', id) AS path", "1.0D AS mtime", "9L AS size",
        "timestamp_ntz'2025-03-01 00:00:00' AS ingested_at", "1L AS rows_ingested", "0.0D AS duration_s", "cast(null AS string) AS container",
        "cast(null AS string) AS data_id", "false AS deleted")
    store.append_entries("old", gone, "2025-03-01 00:00:00")
    calls = []
    for name in ("file_status", "exists", "children", "empty_files"):
        whole = getattr(session, name)
        monkeypatch.setattr(session, name, lambda *a, f=whole, n=name: calls.append(n) or f(*a))
    ingest_directory(store, str(tmp_path), at(0))
    assert len(calls) < 60 and "file_status" not in calls


@pytest.mark.parametrize("block_bytes", [1, 7, 4 * 2**20])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends_are_alike_in_all_kinds_of_files(spark, tmp_path, monkeypatch, end, block_bytes):
    from hitledger.operators import ledger as lg
    from hitledger.sources import files
    monkeypatch.setattr(files, "BLOCK_BYTES", block_bytes)
    for name, body in (("a", "one{e}two{e}"), ("b", "one{e}{e}two"), ("c", "{e}"), ("d", "x{e}\r\ny\r")):
        data = body.replace("{e}", end).encode()
        (tmp_path / f"{name}.log").write_bytes(data)
        (tmp_path / f"{name}z.log.gz").write_bytes(gzip.compress(data))
        with tarfile.open(tmp_path / f"{name}t.tar.gz", "w:gz") as archive:
            entry = tarfile.TarInfo("m.log")
            entry.size = len(data)
            archive.addfile(entry, io.BytesIO(data))
    lines = files.read_lines(spark, lg.classify(files.list_files(spark, str(tmp_path))).collect()).collect()
    for name in "abcd":
        kinds = [sorted(r.line for r in lines if r.file == f) for f in (f"{name}.log", f"{name}z.log.gz", f"{name}t.tar.gz")]
        assert kinds[0] == kinds[1] == kinds[2] and kinds[0]


def test_a_damaged_member_does_not_take_the_archive_with_it(store, tmp_path):
    def pack(third, overflow=1):
        with tarfile.open(tmp_path / "c.tar.gz", "w:gz") as archive:
            for name, data in (("one.log", (line() + "\n").encode() * 2), ("two.log.gz", third), ("wide.log", f"{line(size=str(2**63 - 1))}\n".encode() * overflow),
                               ("last.log", (line() + "\n").encode() * 3)):
                entry = tarfile.TarInfo(name)
                entry.size = len(data)
                archive.addfile(entry, io.BytesIO(data))

    whole = gzip.compress("".join(f"{line(path=f'/{i}')}\n" for i in range(5000)).encode())
    pack(whole)
    assert ingest_directory(store, str(tmp_path), at(0)).member_errors == {}
    assert total(store) == 5006
    pack(whole[:-500], overflow=2)
    summary = ingest_directory(store, str(tmp_path), at(30))
    assert summary.files_ingested == ["c.tar.gz"] and summary.files_skipped == {}
    assert set(summary.member_errors) == {"c.tar.gz/two.log.gz", "c.tar.gz/wide.log"}
    assert total(store) == 5006 and total(store, source="c.tar.gz/two.log.gz") == 5000  # their old rows stay
    pack(b"no gzip")
    assert set(ingest_directory(store, str(tmp_path), at(59)).member_errors) == {"c.tar.gz/two.log.gz"}
    assert total(store) == 5006
