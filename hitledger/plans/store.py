"""Rollups and their ledger as parquet folders.

Rollups lie by day and, inside a day, by bucket (a hash of the source). An ingest appends its rows, which carry its id, and writes
its ledger rows last. A source's newest ledger row names the ingest whose rows are valid, so readers see either the old or the
new version of a source in all tables, and a failed ingest stays invisible. The row of a file that was followed from where it ended names
the ingests of its earlier lines too (``kept``). After the commit the files that hold replaced rows alone are removed, and the (day, bucket)
folders with files of both kinds rewritten without them by dynamic partition overwrite; until that is done a marker tells readers to join the
ledger. Without markers every table is a plain scan. One ingest at a time may write to a store.

Whole months may be kept a second time, merged from their days (``build_months``). A commit that changes rows of a month first takes
its marker away, so a month is read only while it equals its days.

Inside a bucket rows are dealt to files by ranges of their key and sorted by it, and clients and paths have bloom filters, so looking up
one key reads the row groups that may hold it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, Window, functions as F

from hitledger import fixed_values as fixed, schemas, session
from hitledger.functions import labels
from hitledger.operators import ledger as lg, rollups
from hitledger.operators.rollups import KEYED_TABLES, PAIR_TABLES, Months, Rollups

WRITERS = 12  # tables written at a time: all of them, so that small tables, a few tasks of many files, do not idle the cluster
BUCKETS = 8
LEDGER_FOLDERS = 64  # commits beyond this many are folded into one
LOOKUPS = ("ip", "path")  # columns with bloom filters


def utc_now() -> str:
    return datetime.now(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")


class RollupStore:
    """``buckets`` of a store never change; ``options`` are added to those of the parquet writer."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, options: Mapping[str, str] | None = None):
        self.spark, self.buckets = spark, buckets
        self.root = session.qualified(spark, root)
        self.options = {"parquet.bloom.filter.adaptive.enabled": "true", **(options or {})}

    # layout

    def _table_path(self, table: str) -> str:
        return f"{self.root}/rollups/{table}"

    @property
    def _ledger_path(self) -> str:
        return f"{self.root}/ledger"

    def _marker(self, ingest_id: str = "") -> str:
        """Folder that is there while rows of an ingest, or rows it replaces, lie in the tables without being valid."""
        return f"{self.root}/unsettled/{ingest_id}".rstrip("/")

    def staging_path(self, ingest_id: str, name: str = "") -> str:
        return f"{self.root}/staging/{ingest_id}/{name}".rstrip("/")

    def _read(self, path: str, schema: str) -> DataFrame:
        if not session.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(path)

    # ledger

    def entries(self) -> DataFrame:
        """Ledger rows: all since the last fold, before that the newest of every source."""
        commits = self._read(f"{self._ledger_path}/commits", schemas.LEDGER)
        folds = session.children(self.spark, f"{self._ledger_path}/folds")
        for fold in folds[-1:]:
            commits = commits.unionByName(self.spark.read.schema(schemas.LEDGER).parquet(f"{self._ledger_path}/folds/{fold}"))
        return commits

    def ledger(self) -> DataFrame:
        """One row per current source."""
        return lg.live(self.entries())

    def has_ingest(self, ingest_id: str) -> bool:
        return any(session.exists(self.spark, f"{self._ledger_path}/{p}") for p in (f"commits/ingest_id={ingest_id}/_SUCCESS", f"folded/{ingest_id}"))

    def append_entries(self, ingest_id: str, entries: DataFrame, now: str | None = None) -> None:
        """Commit ledger rows, which makes an ingest visible, then drop the rows they replace. Months it changes go before."""
        if built := self.built_months():
            self._drop_months(self._months_changed(ingest_id, entries, built))
        stamped = entries.withColumn("committed_at", F.lit(now or utc_now()).cast("timestamp_ntz"))
        columns = [c.split() for c in schemas.LEDGER.split(", ") if not c.startswith("ingest_id ")]
        stamped.select(*(F.col(c) if c in stamped.columns else F.lit(None).cast(kind).alias(c) for c, kind in columns)).write.mode("overwrite").parquet(f"{self._ledger_path}/commits/ingest_id={ingest_id}")
        self.settle(ingest_id)

    def _fold_ledger(self) -> None:
        """Keep the newest row of every source in one folder once there are many commits; committed ids stay known by name."""
        commits = session.children(self.spark, f"{self._ledger_path}/commits")
        if len(commits) <= LEDGER_FOLDERS:
            return
        folds = session.children(self.spark, f"{self._ledger_path}/folds")
        number = int(folds[-1]) + 1 if folds else 0
        lg.newest(self.entries()).write.mode("overwrite").parquet(f"{self._ledger_path}/folds/.new")
        session.rename(self.spark, f"{self._ledger_path}/folds/.new", f"{self._ledger_path}/folds/{number:09d}")
        for commit in commits:
            session.make_folder(self.spark, f"{self._ledger_path}/folded/{commit.removeprefix('ingest_id=')}")
            session.remove(self.spark, f"{self._ledger_path}/commits/{commit}")
        for fold in folds:
            session.remove(self.spark, f"{self._ledger_path}/folds/{fold}")

    def mark_ingested(self, source: str, path: str, mtime: float, size: int, ingest_id: str, now: str | None = None) -> None:
        """Record a source as seen; rollup rows it already has stay valid."""
        seen = self.spark.createDataFrame([(source, path, float(mtime), size)],
                                          "source string, path string, mtime double, size bigint")
        known = self.ledger().select("source", "data_id", "kept")
        entry = seen.join(known, "source", "left").select(
            "*", F.lit(now or utc_now()).cast("timestamp_ntz").alias("ingested_at"), F.lit(0).cast("bigint").alias("rows_ingested"),
            F.lit(0.0).alias("duration_s"), F.lit(None).cast("string").alias("container"), F.lit(False).alias("deleted"))
        self.append_entries(ingest_id, entry, now)

    def delete_sources(self, sources: Iterable[str], ingest_id: str, now: str | None = None) -> None:
        """Remove all rows of the sources."""
        gone = self.spark.createDataFrame([(s,) for s in sources], "source string")
        entries = self.ledger().join(gone, "source", "left_semi").withColumn("deleted", F.lit(True))
        session.make_folder(self.spark, self._marker(ingest_id))
        self.append_entries(ingest_id, entries, now)

    # files a stream could not use

    def _failed_path(self, stream: str) -> str:
        return f"{self.root}/failed/{stream}"

    def failed_files(self, stream: str) -> DataFrame:
        """Listing rows of the files that the stream has to try again, as they are now; files that are gone are left out."""
        rows = []
        if versions := session.children(self.spark, self._failed_path(stream)):
            kept = self.spark.read.schema("source string, path string").parquet(f"{self._failed_path(stream)}/{versions[-1]}")
            rows = [(f.source, f.path, *status) for f in kept.collect() if (status := session.file_status(self.spark, f.path))]
        return self.spark.createDataFrame(rows, "source string, path string, mtime double, size bigint")

    def keep_failed(self, stream: str, files: Iterable) -> None:
        """Replace what ``failed_files`` gives, in a new folder; older ones go once it is complete."""
        path = self._failed_path(stream)
        before = session.children(self.spark, path)
        rows = [(f.source, f.path) for f in files]
        if rows:
            number = int(before[-1].removeprefix("v")) + 1 if before else 0
            self.spark.createDataFrame(rows, "source string, path string").coalesce(1).write.mode("overwrite").parquet(f"{path}/v{number:012d}")
        for old in before:
            session.remove(self.spark, f"{path}/{old}")

    # rollups

    def _writer(self, table: str, rows: DataFrame, folders: tuple[str, ...] = ("day", "bucket")) -> DataFrameWriter:
        """Rows of a table in files of their own ranges of the key, sorted by it."""
        key = {**KEYED_TABLES, **{t: outer for t, (outer, _) in PAIR_TABLES.items()}}.get(table)
        order = [*folders, *([key] if key else [])]
        dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order, *(["category"] if "category" in rows.columns else []))
        blooms = {f"parquet.bloom.filter.enabled#{c}": "true" for c in LOOKUPS if c in rows.columns}
        return dealt.write.partitionBy(*folders).options(**{**blooms, **self.options})

    def _each_table(self, action: Callable[[str], object], names: Iterable[str] = schemas.ROLLUPS) -> list:
        with ThreadPoolExecutor(WRITERS) as pool:
            return list(pool.map(action, names))

    def write_tables(self, ingest_id: str, tables: Mapping[str, DataFrame]) -> None:
        """Append all rollups of one ingest; invisible until its ledger rows are committed."""
        if session.exists(self.spark, self._marker(ingest_id)):  # an attempt before this one did not end
            self._rewrite(None)
        session.make_folder(self.spark, self._marker(ingest_id))

        def write(table: str) -> None:
            rows = tables[table]
            if table == "hourly_totals" and "day" not in rows.columns:
                rows = rows.withColumn("day", F.col("hour").cast("date"))
            rows = rows.withColumns({"ingest_id": F.lit(ingest_id), "bucket": F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")})
            self._writer(table, rows.select(*[c.split()[0] for c in schemas.ROLLUPS[table].split(", ")])).mode("append").parquet(self._table_path(table))

        self._each_table(write)

    def _rows(self, table: str) -> DataFrame:
        return self._read(self._table_path(table), schemas.ROLLUPS[table])

    def _valid(self) -> DataFrame:
        """(source, ingest_id) of the rows that count."""
        return self.ledger().filter("data_id IS NOT NULL").select("source", F.explode(lg.data_ids()).alias("ingest_id"))

    def tables(self) -> Rollups:
        """The valid rows of every rollup: plain scans, joined with the ledger only while an ingest is unsettled."""
        unsettled = session.children(self.spark, self._marker())

        def plan(table: str) -> DataFrame:
            rows = self._rows(table)
            return (rows.join(self._valid(), ["source", "ingest_id"], "left_semi") if unsettled else rows).drop("bucket")

        lists = {table: (lambda t=table: plan(t)) for table in rollups.TABLES}
        return Rollups({table: (lambda p=p: p().drop("ingest_id")) for table, p in lists.items()}, lists)

    # months

    def _month_path(self, table: str, month: str = "") -> str:
        return f"{self.root}/months/tables/{table}" + (f"/day={month}-01" if month else "")

    def built_months(self) -> list[str]:
        """Months (``2024-01``) whose merged rows are there and equal to their days."""
        return session.children(self.spark, f"{self.root}/months/built")

    def _months_changed(self, ingest_id: str, entries: DataFrame, built: list[str]) -> list[str]:
        """Built months in which rows come to count, or cease to, once the ledger rows are committed.

        Every source with rows in any table has rows of the same days in ``daily_totals``, the smallest; only that is read.
        """
        totals = self._rows("daily_totals").select("source", "ingest_id", labels.month_label(F.col("day")).alias("month")).filter(F.col("month").isin(built))
        touched = totals.join(entries.select("source", lg.data_ids(entries).alias("ids"), "deleted"), "source").filter(
            (F.col("ingest_id") == ingest_id) | F.col("deleted") | ~F.coalesce(F.array_contains("ids", F.col("ingest_id")), F.lit(False)))
        return [r.month for r in touched.select("month").distinct().collect()]

    def _drop_months(self, months: Iterable[str]) -> None:
        """Markers go first, so rows that are only partly gone are never read."""
        months = list(months)
        for month in months:
            session.remove(self.spark, f"{self.root}/months/built/{month}")
        for month in months:
            for table in schemas.MONTHS:
                session.remove(self.spark, self._month_path(table, month))

    def build_months(self, as_of: str) -> list[str]:
        """Merge the days of every month before that of ``as_of`` that is not built; returns these months.

        A job of its own, to be run now and then: ingests only drop what they change. Not to be run during an ingest.
        """
        found = {p.rpartition("day=")[2][:7] for p in session.matching(self.spark, f"{self._table_path('daily_totals')}/day=*")}
        todo = sorted(m for m in found - set(self.built_months()) if m < date.fromisoformat(as_of).isoformat()[:7])
        if todo:
            self._drop_months(todo)  # what an attempt that did not end has left
            days = self.tables()

            def write(table: str) -> None:
                rows = rollups.by_month(days[table].filter(labels.month_label(F.col("day")).isin(todo)))
                self._writer(table, rows, ("day",)).mode("append").parquet(self._month_path(table))

            self._each_table(write, schemas.MONTHS)
            for month in todo:
                session.make_folder(self.spark, f"{self.root}/months/built/{month}")
        return todo

    def months(self) -> Months:
        """The month level as it is now: merged rollups and the months they hold."""
        plans = {t: (lambda t=t: self._read(self._month_path(t), schemas.MONTHS[t])) for t in schemas.MONTHS}
        return Months(plans, self.built_months())

    # upkeep

    def _rewrite(self, buckets: list[int] | None) -> None:
        """Take the rows that do not count out of the (day, bucket) folders of some buckets or all.

        Files and folders that hold no others are removed, as every ingest writes files of its own; only folders with a file of both kinds are rewritten.
        """
        valid = self._valid()

        def rewrite(table: str) -> None:
            if not session.exists(self.spark, self._table_path(table)):
                return
            rows = self._rows(table) if buckets is None else self._rows(table).filter(F.col("bucket").isin(buckets))
            marked = valid.withColumn("counts", F.lit(True))
            held = rows.select("day", "bucket", F.col("_metadata.file_name").alias("file"), "source", "ingest_id").distinct()
            files = held.join(marked, ["source", "ingest_id"], "left").groupBy("day", "bucket", "file").agg(
                F.bool_or(F.col("counts").isNull()).alias("stale"), F.bool_or(F.col("counts").isNotNull()).alias("live"))
            folder = {c: F.bool_or(e).over(Window.partitionBy("day", "bucket")) for c, e in (("mixed", F.expr("stale AND live")), ("kept", F.col("live")))}
            found = files.withColumns(folder).filter("stale").select("day", "bucket", "mixed", "kept", F.when(~F.col("mixed") & F.col("kept"), F.col("file")).alias("file"))
            # One row for each folder to be rewritten or dropped, at most the days of a retention times the buckets, and for each file to be dropped alone.
            found = found.distinct().collect()
            if mixed := [(f.day, f.bucket) for f in found if f.mixed]:
                places = self.spark.createDataFrame(mixed, "day date, bucket int")
                pruned = rows.filter(F.col("day").isin(sorted({day for day, _ in mixed})) & F.col("bucket").isin(sorted({b for _, b in mixed})))
                kept = pruned.join(places, ["day", "bucket"], "left_semi").join(valid, ["source", "ingest_id"], "left_semi").select(*rows.columns)
                self._writer(table, kept).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._table_path(table))
            for f in found:
                if not f.mixed:
                    session.remove(self.spark, f"{self._table_path(table)}/day={f.day}/bucket={f.bucket}" + (f"/{f.file}" if f.file else ""))

        self._each_table(rewrite)

    def settle(self, ingest_id: str) -> None:
        """Drop the rows that a committed ingest replaced, and those of ingests that failed before it; then its marker goes.

        Only buckets of sources that had other rows are looked at. Interrupted, it is done by the next ingest.
        """
        markers = session.children(self.spark, self._marker())
        if markers == [ingest_id] or not markers:
            own = F.col("ingest_id") == ingest_id
            entries = self.entries()
            before = entries.filter(~own & F.col("data_id").isNotNull()).select("source").distinct()
            replaced = entries.filter(own & (F.col("kept").isNull() | F.col("deleted"))).select("source").join(before, "source", "left_semi")
            buckets = sorted(r[0] for r in replaced.select(F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int")).distinct().collect())
            if buckets and markers:
                self._rewrite(buckets)
        else:
            self._rewrite(None)
        for marker in markers:
            session.remove(self.spark, self._marker(marker))
        self._fold_ledger()

    def enforce_retention(self, as_of: str, days: int = fixed.RETENTION_DAYS) -> int:
        """Drop whole day folders older than ``days`` before ``as_of``; returns how many. One listing of the tables' days."""
        first = (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()
        self._drop_months(m for m in self.built_months() if f"{m}-01" < first)
        old = [p for p in session.matching(self.spark, f"{self.root}/rollups/*/day=*") if p.rpartition("day=")[2] < first]
        return sum(session.remove(self.spark, p) for p in old)

    def drop_staging(self, ingest_id: str) -> None:
        session.remove(self.spark, self.staging_path(ingest_id))
