"""Incremental ingest: changed files, or given lines, into a rollup store."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, functions as F

from hitledger import fixed_values as fixed, schemas
from hitledger.operators import geo, ledger as lg, parse, rollups
from hitledger.plans.store import RollupStore, utc_now
from hitledger.plans.traffic import Traffic, default_range
from hitledger.sources import files as source_files

_FILE = "source string, path string, mtime double, size bigint, kind string, begin bigint, kept array<string>, rows_before bigint"
MOST_FOLLOWED = 100  # times a file is read from where it ended before it is read anew, which merges its rows


@dataclass
class IngestSummary:
    ingest_id: str
    files_ingested: list[str] = field(default_factory=list)
    n_unchanged: int = 0
    files_followed: list[str] = field(default_factory=list)  # those of the ingested that were read from where they had ended
    files_skipped: dict[str, str] = field(default_factory=dict)  # unreadable archives and why
    errors: dict[str, str] = field(default_factory=dict)  # other unreadable files and why
    member_errors: dict[str, str] = field(default_factory=dict)  # unusable members of archives that were ingested, and why
    duration_s: float = 0.0


@dataclass
class Settings:
    """What an ingest may be told: the day of malformed lines, the clock (UTC; now if None) and locations.

    ``follow`` reads text files that only grew from where they ended. That they only grew is told by ``check_bytes`` at both ends of what
    was read before (by all of it if None); files that do not show it, or ended within a line, are read anew and replaced as without it.
    """

    as_of: str
    now: str | None = None
    cooldown_seconds: int = fixed.COOLDOWN_SECONDS
    retention_days: int = fixed.RETENTION_DAYS
    blocks: DataFrame | None = None
    keep_staging: bool = False
    follow: bool = False
    check_bytes: int | None = source_files.CHECK_BYTES


def new_ingest_id() -> str:
    return f"ingest-{time.strftime('%Y%m%dT%H%M%S', time.gmtime())}-{uuid.uuid4().hex[:8]}"


def has_pending_work(store: RollupStore, directory: str, now: str | None = None,
                     cooldown_seconds: int = fixed.COOLDOWN_SECONDS) -> bool:
    """Whether any log file of the directory is new or changed."""
    listing = lg.classify(source_files.list_files(store.spark, directory))
    return not lg.changed(listing, store.ledger(), now or utc_now(), cooldown_seconds).isEmpty()


def _stage(store: RollupStore, ingest_id: str, lines: DataFrame) -> DataFrame:
    """Parse every line once and keep the result, so that the rollups scan only the columns they need."""
    path = store.staging_path(ingest_id, "parsed")
    parse.parse_lines(lines).write.mode("overwrite").parquet(path)
    return store.spark.read.schema(schemas.PARSED).parquet(path)


def _lines(store: RollupStore, files: list[Row], settings: Settings) -> DataFrame:
    """Lines of the files, of followed ones from where they had ended. To follow, text has to be read up to the listed size and no further."""
    if not settings.follow:
        return source_files.read_lines(store.spark, files)
    text = [f for f in files if f.kind == lg.TEXT]
    others = source_files.read_lines(store.spark, [f for f in files if f.kind != lg.TEXT])
    if not text:
        return others
    ranges = store.spark.createDataFrame([(f.source, f.path, f.begin, f.size) for f in text], "source string, path string, begin bigint, size bigint")
    lines = source_files.read_ranges(ranges)
    return lines if len(text) == len(files) else lines.unionByName(others)


def _write_rollups(store: RollupStore, ingest_id: str, parsed: DataFrame, settings: Settings) -> None:
    path = store.staging_path(ingest_id, "pairs")
    rollups.ip_path_pairs(parse.requests(parsed)).write.mode("overwrite").parquet(path)
    pairs = store.spark.read.schema(schemas.PAIRS).parquet(path)
    hot = {} if settings.blocks is None else geo.hot_buckets(parse.requests(parsed).select("ip").distinct())
    store.write_tables(ingest_id, rollups.build(
        parsed, settings.as_of, pairs, lambda ips: geo.locate_clients(ips, settings.blocks, hot)))


def _unusable(parsed: DataFrame) -> DataFrame:
    """(source, file, error) of files and archive members that can't be read, or whose sizes or times sum to more than a bigint holds."""
    wide = [F.sum(F.abs(F.col(c).cast("decimal(38,0)"))) for c in ("bytes", "response_time_us")]
    largest = F.lit(2**63 - 1).cast("decimal(38,0)")
    over = F.when(F.greatest(*wide) > largest, F.lit("sizes or response times sum to more than 2^63 - 1"))
    return parsed.groupBy("source", "file").agg(F.coalesce(F.min("error"), over).alias("error")).filter("error IS NOT NULL")


def _entries(store: RollupStore, ingest_id: str, files: list[Row], parsed: DataFrame, now: str,
             duration_s: float, broken_members: DataFrame, settings: Settings) -> DataFrame:
    """Ledger rows of the ingested files: one per file, per archive and per archive member, and tombstones of members
    that a changed archive no longer has. Members that could not be read keep what they have."""
    listed = store.spark.createDataFrame([tuple(f[c.split()[0]] for c in _FILE.split(", ")) for f in files], _FILE)
    if settings.follow:
        endings = source_files.endings(listed.filter(F.col("kind") == lg.TEXT), "size", settings.check_bytes)
        listed = listed.join(endings, "path", "left")
    else:
        listed = listed.withColumn("ending", F.lit(None).cast("string"))
    counted = parsed.groupBy("source", "file").agg(F.count_if(F.col("outcome") == parse.REQUEST).alias("rows_ingested"))
    archives = listed.filter(F.col("kind") == lg.ARCHIVE).select("source", "path", "mtime", "size")
    whole = listed.join(counted.drop("file"), "source", "left").select(
        "source", "path", "mtime", "size",
        (F.coalesce("rows_ingested", F.lit(0)) + F.coalesce("rows_before", F.lit(0))).alias("rows_ingested"),
        F.lit(None).cast("string").alias("container"), F.when(F.col("kind") != lg.ARCHIVE, ingest_id).alias("data_id"),
        "kept", "ending", F.lit(False).alias("deleted"))
    nothing = (F.lit(None).cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("ending"))
    members = counted.join(archives.withColumnRenamed("source", "file"), "file").select(
        "source", "path", "mtime", "size", "rows_ingested", F.col("file").alias("container"),
        F.lit(ingest_id).alias("data_id"), *nothing, F.lit(False).alias("deleted"))
    gone = (store.ledger().join(archives.select(F.col("source").alias("container")), "container", "left_semi")
            .join(members, "source", "left_anti").join(broken_members, "source", "left_anti")
            .withColumn("deleted", F.lit(True)).select(*members.columns))
    return whole.unionByName(members).unionByName(gone).select(
        "*", F.lit(now).cast("timestamp_ntz").alias("ingested_at"), F.lit(duration_s).alias("duration_s"))


def ingest_listing(store: RollupStore, listing: DataFrame, settings: Settings,
                   ingest_id: str | None = None) -> IngestSummary:
    """Ingest the new and changed log files of a listing; each replaces its earlier version.

    Only names, sizes and times of new and changed files come to the driver. A file that cannot be used is reported and
    keeps its old rows; the others are ingested. So is a file whose name another directory's file already has in the
    store. An ingest id that is already committed is left as it is.
    """
    started = time.time()
    ingest_id = ingest_id or new_ingest_id()
    now = settings.now or utc_now()
    summary = IngestSummary(ingest_id)
    if store.has_ingest(ingest_id):
        return summary
    status = lg.with_status(lg.classify(listing), store.ledger(), now, settings.cooldown_seconds)
    summary.n_unchanged = status.filter("current").count()
    changed = status.filter("NOT current")
    if settings.follow:
        changed = lg.followed(changed, store.ledger(), lambda files, size: source_files.endings(files, size, settings.check_bytes), MOST_FOLLOWED)
    else:
        changed = changed.select("*", F.lit(0).cast("bigint").alias("begin"), F.lit(None).cast("array<string>").alias("kept"),
                                 F.lit(None).cast("bigint").alias("rows_before"))
    found = changed.orderBy("source", "path").collect()
    summary.errors = lg.same_names(found)
    todo = [f for f in found if f.source not in summary.errors]
    if todo:
        parsed = _stage(store, ingest_id, _lines(store, todo, settings))
        unusable = _unusable(parsed).collect()
        broken = {r.file: r.error for r in unusable if r.source == r.file}
        members = {r.source: r.error for r in unusable if r.source != r.file and r.file not in broken}
        no_members = store.spark.createDataFrame([(m,) for m in members], "source string")
        if broken:
            names = store.spark.createDataFrame([(b,) for b in broken], "file string")
            parsed = parsed.join(names, "file", "left_anti")
        if members:
            parsed = parsed.join(no_members, "source", "left_anti")
        good = [f for f in todo if f.source not in broken]
        if good:
            _write_rollups(store, ingest_id, parsed, settings)
            entries = _entries(store, ingest_id, good, parsed, now, round(time.time() - started, 2), no_members, settings)
            store.append_entries(ingest_id, entries, settings.now)
        summary.files_ingested = [f.source for f in good]
        summary.files_followed = [f.source for f in good if f.kept]
        archives = {f.source for f in todo if f.kind == lg.ARCHIVE}
        summary.files_skipped = {f: why for f, why in broken.items() if f in archives}
        summary.errors |= {f: why for f, why in broken.items() if f not in archives}
        summary.member_errors = members
        if not settings.keep_staging:
            store.drop_staging(ingest_id)
    store.enforce_retention(settings.as_of, settings.retention_days)
    summary.duration_s = round(time.time() - started, 2)
    return summary


def ingest_directory(store: RollupStore, directory: str, settings: Settings,
                     ingest_id: str | None = None) -> IngestSummary:
    """Ingest the new, changed and emptied log files of a directory."""
    listing = source_files.list_files(store.spark, directory)
    had_rows = store.ledger().filter(F.col("container").isNull() & (F.col("size") > 0)).select("source")
    empty = source_files.empty_files(store.spark, directory).join(had_rows, "source", "left_semi")
    return ingest_listing(store, listing.unionByName(empty), settings, ingest_id)


def stage_rollups(store: RollupStore, lines: DataFrame, settings: Settings, ingest_id: str) -> DataFrame:
    """Parse ``(source, line)`` rows once and append their rollups, invisible until ledger rows are committed; returns the parsed lines."""
    parsed = _stage(store, ingest_id, lines.select(
        "source", F.col("source").alias("file"), "line", F.lit(None).cast("string").alias("error")))
    _write_rollups(store, ingest_id, parsed, settings)
    return parsed


def ingest_lines(store: RollupStore, lines: DataFrame, settings: Settings, ingest_id: str | None = None) -> str:
    """Ingest ``(source, line)`` rows from anywhere; every source in them replaces its earlier version."""
    started = time.time()
    ingest_id = ingest_id or new_ingest_id()
    if store.has_ingest(ingest_id):
        return ingest_id
    now = settings.now or utc_now()
    parsed = stage_rollups(store, lines, settings, ingest_id)
    entries = parsed.groupBy("source").agg(
        F.count_if(F.col("outcome") == parse.REQUEST).alias("rows_ingested"), F.sum("line_chars").alias("size")).select(
        "*", F.col("source").alias("path"), F.unix_seconds(F.lit(now).cast("timestamp")).cast("double").alias("mtime"),
        F.lit(None).cast("string").alias("container"), F.lit(ingest_id).alias("data_id"), F.lit(False).alias("deleted"),
        F.lit(now).cast("timestamp_ntz").alias("ingested_at"), F.lit(round(time.time() - started, 2)).alias("duration_s"))
    store.append_entries(ingest_id, entries, settings.now)
    if not settings.keep_staging:
        store.drop_staging(ingest_id)
    store.enforce_retention(settings.as_of, settings.retention_days)
    return ingest_id


def ingest_and_report(store: RollupStore, directory: str, settings: Settings, days: int = fixed.WINDOW_DAYS,
                      from_day: str | None = None, to_day: str | None = None) -> dict:
    """Bring the store up to date, then the statistics of every category and both drill-down maps of the range."""
    summary = ingest_directory(store, directory, settings)
    start, _ = default_range(settings.as_of, days)
    start, end = from_day or start, to_day or settings.as_of
    traffic = Traffic(store.tables(), store.months())
    return {
        "window_days": days, "from_date": start, "to_date": end, "ingest": summary,
        **{category: traffic.stats(category, start, end) for category in fixed.CATEGORIES},
        "drill_ip": traffic.drill_ip_map(start, end), "drill_path": traffic.drill_path_map(start, end),
        "geo_available": settings.blocks is not None,
    }
