"""Continuous ingest and live counts with Structured Streaming.

``watch_directory`` follows new files; rotated logs never change, so each is ingested once. A stream does not look at a
known path again: logs that still grow need a scheduled ``ingest_directory``, which replaces their earlier version.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from hitledger import schemas, session
from hitledger.operators import parse
from hitledger.plans.ingest import Settings, ingest_listing
from hitledger.plans.store import RollupStore
from hitledger.sources import files as source_files

EVERY = "3 seconds"


def _started(writer: DataStreamWriter, checkpoint: str, available_now: bool, every: str) -> StreamingQuery:
    timed = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)
    return timed.option("checkpointLocation", checkpoint).start()


def watch_directory(store: RollupStore, directory: str, checkpoint: str, settings: Callable[[], Settings],
                    files_per_batch: int | None = None, available_now: bool = False,
                    every: str = EVERY) -> StreamingQuery:
    """Ingest files as they appear, whole files per micro-batch, text, gzip and archives alike.

    The stream carries only file names; each batch is a batch ingest of its own. What is a replay is decided by the ledger
    (name, path, time, size), not by batch numbers, so several streams and new checkpoints may feed one store. The cooldown
    does not apply, as a stream shows a file once. Files that could not be used are kept in the checkpoint's folder in the
    store and tried again with the next batch and at the next start. Late lines go to their own day.
    """
    reader = store.spark.readStream.format("binaryFile").schema(schemas.LISTING)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    listing = source_files.as_listing(reader.load(directory))
    stream = hashlib.sha256(session.qualified(store.spark, checkpoint).encode()).hexdigest()[:16]

    def ingest(files: DataFrame) -> None:
        batch = files.unionByName(store.failed_files(stream)).dropDuplicates(["path"]).persist()
        summary = ingest_listing(store, batch, replace(settings(), cooldown_seconds=0))
        failed = {**summary.errors, **summary.files_skipped}
        store.keep_failed(stream, [f for f in batch.select("source", "path").collect() if f.source in failed] if failed else [])
        batch.unpersist()

    ingest(store.spark.createDataFrame([], listing.schema))
    return _started(listing.writeStream.foreachBatch(lambda files, _: ingest(files)), checkpoint, available_now, every)


def _category_rows(counted: DataFrame) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(c).alias("category"), n.alias("count")) for c, n in (
        ("all", F.col("n_all")), ("bot", F.col("n_bot")), ("human", F.col("n_all") - F.col("n_bot")))))
    return counted.select("start", "source", F.inline(rows)).filter(F.col("count") > 0)


def windowed_counts(lines: DataFrame, size: str = "1 hour", watermark: str | None = "2 days") -> DataFrame:
    """Requests per tumbling window, source and category of a stream (or batch) of ``(source, line)`` rows.

    Windows are of the log's wall clock, whatever the session's time zone. Windows older than the watermark are closed and leave
    the state; later lines for them are dropped. With None no line is dropped and the state keeps every window; ``count_windows``
    keeps neither state nor watermark.
    """
    reqs, start = parse.requests(parse.parse_lines(lines)), F.col("window.start")
    if watermark:  # Spark has watermarks on instants only
        reqs, start = reqs.withColumn("ts", _as_utc(F.col("ts"))).withWatermark("ts", watermark), _of_utc(start)
    counted = reqs.groupBy(F.window("ts", size), "source").agg(F.count("*").alias("n_all"), F.count_if("is_bot").alias("n_bot"))
    return _category_rows(counted.select(start.alias("start"), "source", "n_all", "n_bot"))


def _as_utc(clock: Column) -> Column:
    """The instant at which a UTC clock shows a wall-clock time of whole seconds; the session's zone plays no part."""
    hours = F.unix_date(clock.cast("date")).cast("long") * 24 + F.hour(clock)
    return F.timestamp_seconds((hours * 60 + F.minute(clock)) * 60 + F.second(clock))


def _of_utc(instant: Column) -> Column:
    """What a UTC clock shows at an instant of whole seconds."""
    seconds = F.unix_seconds(instant)
    in_day = F.pmod(seconds, F.lit(86_400))
    day = F.date_from_unix_date(((seconds - in_day) / 86_400).cast("int"))
    return day.cast("timestamp_ntz") + F.make_dt_interval(secs=in_day)


def keep_updates(counts: DataFrame, path: str, checkpoint: str, available_now: bool = False,
                 every: str = EVERY) -> StreamingQuery:
    """Store each batch's changed windows in a folder of its own; a replayed batch overwrites its folder."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _started(counts.writeStream.outputMode("update").foreachBatch(write), checkpoint, available_now, every)


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every window from the folders of ``keep_updates``."""
    updates = spark.read.schema("start timestamp_ntz, source string, category string, count bigint, batch bigint").parquet(path)
    return updates.groupBy("start", "source", "category").agg(F.max_by("count", "batch").alias("count"))


# Counts without state: what a batch adds is stored as it is, readers add up.

_PARTS = "start timestamp_ntz, source string, n_all bigint, n_bot bigint"


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the complete folders ``prefix=number`` of ``path``, ascending: at most twice ``fold_every`` names."""
    return sorted(int(n.removeprefix(prefix)) for n in session.children(spark, path) if n.startswith(prefix)
                  and session.exists(spark, f"{path}/{n}/_SUCCESS"))


def _added_up(spark: SparkSession, path: str) -> tuple[DataFrame, int | None]:
    """Window counts per source from the newest fold and the batches after it, and that fold's number."""
    folds = _numbers(spark, path, "fold-")
    newest = folds[-1] if folds else None
    folders = [f"{path}/fold-{newest:012d}"] if folds else []
    folders += [f"{path}/batch-{n:012d}" for n in _numbers(spark, path, "batch-") if newest is None or n > newest]
    parts = spark.read.schema(_PARTS).parquet(*folders) if folders else spark.createDataFrame([], _PARTS)
    return parts.groupBy("start", "source").agg(F.sum("n_all").alias("n_all"), F.sum("n_bot").alias("n_bot")), newest


def fold_counts(spark: SparkSession, path: str) -> int | None:
    """Fold all stored batches into one folder; returns the number of the last one folded.

    The folders that the fold before this made obsolete are removed now, so a reader that has just listed them can finish.
    """
    before = _numbers(spark, path, "fold-")
    batches = _numbers(spark, path, "batch-")
    last = batches[-1] if batches else None
    if last is None or before and last <= before[-1]:
        return before[-1] if before else None
    whole, _ = _added_up(spark, path)
    by_start = whole.repartitionByRange("start").sortWithinPartitions("start", "source")
    by_start.write.mode("overwrite").parquet(f"{path}/fold-{last:012d}")
    if before:
        for prefix, numbers, limit in (("batch", batches, before[-1]), ("fold", before, before[-1] - 1)):
            for n in numbers:
                if n <= limit:
                    session.remove(spark, f"{path}/{prefix}-{n:012d}")
    return last


def count_windows(lines: DataFrame, path: str, checkpoint: str, size: str = "1 hour", fold_every: int = 100, available_now: bool = False,
                  every: str = EVERY) -> StreamingQuery:
    """Count a stream of ``(source, line)`` rows per wall-clock window without state and without a watermark.

    A batch's counts go to a folder of its own at ``path``, which no other stream may use; ``window_totals`` adds them up. So a line
    counts however late it comes, nothing is held between batches, and a batch that is replayed overwrites its folder, or is
    passed over if it has been folded. Every ``fold_every`` batches the folders are folded into one; there are never more
    than about twice as many.
    """
    spark = lines.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        folds = _numbers(spark, path, "fold-")
        if folds and batch_id <= folds[-1]:
            return
        reqs = parse.requests(parse.parse_lines(batch))
        counted = reqs.groupBy(F.window("ts", size), "source").agg(F.count("*").alias("n_all"), F.count_if("is_bot").alias("n_bot"))
        counted.select(F.col("window.start").alias("start"), "source", "n_all", "n_bot").write.mode("overwrite").parquet(f"{path}/batch-{batch_id:012d}")
        if (batch_id + 1) % fold_every == 0:
            fold_counts(spark, path)

    return _started(lines.writeStream.foreachBatch(write), checkpoint, available_now, every)


def window_totals(spark: SparkSession, path: str) -> DataFrame:
    """Requests per window, source and category that ``count_windows`` has stored so far at ``path``; none if there is nothing yet."""
    return _category_rows(_added_up(spark, path)[0])
