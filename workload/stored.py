"""Registered queries that go through log files, the rollup store or a stream, in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitledger import fixed_values as fixed, session
from hitledger.operators import geo, ledger
from hitledger.plans import ingest, traffic
from hitledger.plans.ingest import Settings
from hitledger.plans.store import RollupStore
from hitledger.sources import files
from hitledger.streaming import continuous
from workload.access_log import AS_OF, FROM_DAY, TO_DAY, geo_blocks, raw_log
from workload.log_files import write_log_files

FIRST, LATER = "2024-01-31 10:00:00", "2024-01-31 11:00:00"
_stores: dict[tuple[str, str], RollupStore] = {}


def new_store(spark: SparkSession) -> RollupStore:
    return RollupStore(spark, session.shared_dir(spark, "store"))


def settings(now: str = FIRST, **more) -> Settings:
    return Settings(AS_OF, now, **more)


def log_directory(spark: SparkSession, sf_dir: str, all_text: bool = False, directory: str | None = None,
                  copies: int = 1) -> str:
    """The whole derived log as files, beside two files that are no logs; ``copies`` repeats every line."""
    directory = directory or session.shared_dir(spark, "logs")
    lines = raw_log(spark, sf_dir)
    if copies > 1:
        lines = lines.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    write_log_files(lines, directory, all_text)
    return directory


def loaded_store(spark: SparkSession, sf_dir: str) -> RollupStore:
    """A store holding the whole derived log with locations, ingested once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        store = new_store(spark)
        blocks = geo.blocks_from_ranges(geo_blocks(spark, sf_dir))
        ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(blocks=blocks), "first")
        _stores[key] = store
    return _stores[key]


def _daily(store: RollupStore) -> DataFrame:
    """Totals per day and category over all sources."""
    measures = [F.sum(c).alias(c) for c in traffic.TOTALS]
    return store.tables()["daily_totals"].groupBy("day", "category").agg(*measures)


def _by_source(store: RollupStore) -> DataFrame:
    return store.tables()["daily_totals"].filter(F.col("category") == "all").groupBy("source").agg(
        F.sum("total_requests").alias("total_requests"), F.sum("errors").alias("errors"))


def scan_plain_gz_tar(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    ingest.ingest_directory(store, log_directory(spark, sf_dir), settings())
    return _daily(store)


def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of the files of a log directory, with the number of lines read from each kind."""
    directory = log_directory(spark, sf_dir)
    listed = ledger.classify(files.list_files(spark, directory))
    lines = files.read_lines(spark, listed.collect())
    counted = lines.groupBy("file").agg(F.count("*").alias("n"))
    return listed.join(counted, F.col("source") == F.col("file")).groupBy("kind").agg(F.sum("n").alias("lines"))


def replace_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source twice as long at first, then replaced by the log as it is."""
    store = new_store(spark)
    doubled = raw_log(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    ingest.ingest_lines(store, doubled, settings(FIRST), "first")
    ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(LATER), "second")
    return _by_source(store)


def marked_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source recorded as seen again keeps its rows; the ledger shows what was recorded."""
    store = new_store(spark)
    ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(FIRST), "first")
    store.mark_ingested("access_1.log", "/logs/access_1.log", 2000.0, 5, "second", LATER)
    seen = store.ledger().select("source", (F.col("size") == 5).alias("marked"))
    return _by_source(store).join(seen, "source")


def delete_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = new_store(spark)
    ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(FIRST), "first")
    store.delete_sources(["access_1.log"], "second", LATER)
    return _by_source(store)


def compacted_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace, delete and retain as usual, with an ingest that never ended in between: only valid rows are left, in plain scans."""
    store = new_store(spark)
    ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(FIRST), "first")
    ingest.stage_rollups(store, raw_log(spark, sf_dir), settings(FIRST), "lost")
    ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(LATER, retention_days=15), "second")
    store.delete_sources(["access_3.log"], "third", LATER)
    return store.tables()["hourly_totals"].groupBy("hour", "category").agg(F.sum("count").alias("count"))


def stored_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year's answers from months: built over twice the log, changed by a replacement and a deletion, and built again."""
    store = new_store(spark)
    doubled = raw_log(spark, sf_dir).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    ingest.ingest_lines(store, doubled, settings(FIRST), "first")
    store.build_months("2024-12-31")
    ingest.ingest_lines(store, raw_log(spark, sf_dir), settings(LATER), "second")
    store.delete_sources(["access_3.log"], "third", LATER)
    store.build_months("2024-12-31")
    answers, scope = traffic.Traffic(store.tables(), store.months()), ("human", "2024-01-01", "2024-12-31")
    parts = {"month": answers.monthly(2024, "human"), "status": answers.status_codes(*scope), "path": answers.top_paths(*scope, 10),
             "clients": answers.unique_ips(*scope).select(F.lit("all").alias("clients"), "unique_ips")}
    rows = [part.toDF("key", "n").select(F.lit(section).alias("section"), "key", F.col("n").cast("bigint").alias("n")) for section, part in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def changed_file_reingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files grow to twice their lines; within the cooldown they stay as they were, after it they are replaced."""
    store = new_store(spark)
    directory = log_directory(spark, sf_dir, all_text=True)
    steps = [ingest.ingest_directory(store, directory, settings(FIRST), "step-1")]
    log_directory(spark, sf_dir, all_text=True, directory=directory, copies=2)
    steps.append(ingest.ingest_directory(store, directory, settings("2024-01-31 10:04:00"), "step-2"))
    path = session.shared_dir(spark, "before")  # the third ingest rewrites what this reads
    _daily(store).select(F.lit("before").alias("state"), "*").write.parquet(path)
    before = spark.read.parquet(path)
    steps.append(ingest.ingest_directory(store, directory, settings(LATER), "step-3"))
    if [bool(s.files_ingested) for s in steps] != [True, False, True]:
        raise AssertionError(f"unexpected ingests: {steps}")
    return before.unionByName(_daily(store).select(F.lit("after").alias("state"), "*"))


def followed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files that grow are read from where they ended; those of one source begin with other lines then and are read anew."""
    store, directory = RollupStore(spark, session.shared_dir(spark, "store"), buckets=1), session.shared_dir(spark, "logs")
    lines = raw_log(spark, sf_dir).withColumn("part", (F.col("event_id") % 3 == 0).cast("int"))
    turned = F.when(F.col("source") == "access_3.log", 1 - F.col("part")).otherwise(F.col("part"))
    for shown, now in ((lines.filter("part = 0"), FIRST), (lines.withColumn("part", turned), LATER)):
        write_log_files(shown, directory, all_text=True, order=("part", "event_id"))
        ingest.ingest_directory(store, directory, settings(now, follow=True))
    number = F.concat(F.regexp_extract("source", r"^(access_\d+)", 1), F.lit(".log"))
    times = store.ledger().groupBy(number.alias("source")).agg(F.max(F.coalesce(F.size("kept"), F.lit(0))).alias("times_followed"))
    return _by_source(store).groupBy(number.alias("source")).agg(
        F.sum("total_requests").alias("total_requests"), F.sum("errors").alias("errors")).join(times, "source")


def traffic_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.Traffic(loaded_store(spark, sf_dir).tables()).stats_rows("all", FROM_DAY, TO_DAY)


def ingest_and_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingest a directory and report it: statistics of all categories and both drill-down maps, as rows."""
    store = new_store(spark)
    blocks = geo.blocks_from_ranges(geo_blocks(spark, sf_dir))
    directory = log_directory(spark, sf_dir)
    report = ingest.ingest_and_report(store, directory, settings(blocks=blocks), from_day=FROM_DAY, to_day=TO_DAY)
    answers = traffic.Traffic(store.tables())
    rows = answers.stats_rows("all", FROM_DAY, TO_DAY)
    for category in fixed.CATEGORIES[1:]:
        rows = rows.unionByName(answers.stats_rows(category, FROM_DAY, TO_DAY))
    for name, key, detail in (("drill_ip", "ip", "path"), ("drill_path", "path", "ip")):
        rows = rows.unionByName(report[name].select(
            F.lit("all").alias("category"), F.lit(name).alias("section"), F.col(key).alias("key"),
            F.col(detail).alias("detail"), "n"))
    return rows


def stored_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.Traffic(loaded_store(spark, sf_dir).tables()).top_paths("all", FROM_DAY, TO_DAY, 10)


def stored_subnets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.Traffic(loaded_store(spark, sf_dir).tables()).subnets("all", FROM_DAY, TO_DAY, alert_pct=5.0)


def _watched(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None, rounds: int = 1) -> RollupStore:
    store = new_store(spark)
    directory = log_directory(spark, sf_dir)
    for i in range(rounds):  # a new checkpoint shows all files again
        continuous.watch_directory(store, directory, session.shared_dir(spark, f"checkpoint-{i}"), settings,
                                   files_per_batch=files_per_batch, available_now=True).awaitTermination()
    return store


def stream_daily_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two watched directories, with half of the lines each, feed one store."""
    store, lines = new_store(spark), raw_log(spark, sf_dir)
    for half in range(2):
        directory = session.shared_dir(spark, "logs")
        write_log_files(lines.filter(F.col("event_id") % 2 == half), directory, prefix=f"host{half}-")
        continuous.watch_directory(store, directory, session.shared_dir(spark, "checkpoint"), settings,
                                   available_now=True).awaitTermination()
    return _daily(store)


def stream_replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _daily(_watched(spark, sf_dir, rounds=2))


def stream_late_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of a few files each: every batch but the first brings lines of days already counted."""
    return _daily(_watched(spark, sf_dir, files_per_batch=12))


def stream_hourly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stateful hourly counts over the log's text files, updated batch by batch."""
    directory = log_directory(spark, sf_dir, all_text=True)
    source = F.concat(F.regexp_extract(F.col("_metadata.file_name"), r"^(access_\d+)", 1), F.lit(".log"))
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 16).load(directory).select(
        source.alias("source"), F.col("value").alias("line"))
    path = session.shared_dir(spark, "counts")
    continuous.keep_updates(continuous.windowed_counts(lines, watermark=None), path, session.shared_dir(spark, "checkpoint"),
                            available_now=True).awaitTermination()
    return continuous.latest_counts(spark, path).withColumnRenamed("start", "hour")


def stream_window_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same hours from stateless batches of every kind of zone: wall-clock windows, folded every few batches."""
    directory = log_directory(spark, sf_dir, all_text=True)
    source = F.concat(F.regexp_extract(F.col("_metadata.file_name"), r"^(access_\d+)", 1), F.lit(".log"))
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", 8).load(directory).select(
        source.alias("source"), F.col("value").alias("line"))
    path = session.shared_dir(spark, "parts")
    continuous.count_windows(lines, path, session.shared_dir(spark, "checkpoint"), fold_every=3, available_now=True).awaitTermination()
    return continuous.window_totals(spark, path).withColumnRenamed("start", "hour")


STORED = {f.__name__: f for f in (
    scan_plain_gz_tar, classify_files, replace_by_source, marked_source, delete_source, compacted_store, stored_months, changed_file_reingest, followed_logs,
    traffic_stats, ingest_and_report, stored_top_paths, stored_subnets, stream_daily_totals, stream_replay_idempotent,
    stream_late_data, stream_hourly_totals, stream_window_parts)}
