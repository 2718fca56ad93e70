"""What has been ingested, and what on disk differs from it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from hitledger import fixed_values as fixed

ARCHIVE, GZIP, TEXT = "archive", "gzip", "text"


def file_kind(name: Column) -> Column:
    """``archive``, ``gzip`` or ``text`` by suffix, null for files that are never logs; case does not matter."""
    lower = F.lower(name)
    suffix = F.regexp_extract(lower, r"^.+\.([^.]+)$", 1)
    return (F.when(lower.rlike(r"^.+\.tar\.gz$"), ARCHIVE)
            .when(F.endswith(lower, F.lit(fixed.GZIP_SUFFIX)), GZIP)
            .when(~suffix.isin(*fixed.IGNORED_SUFFIXES), TEXT))


def classify(listing: DataFrame) -> DataFrame:
    """Add ``kind`` to a listing with a ``source`` name column and drop files that are never logs."""
    return listing.withColumn("kind", file_kind(F.col("source"))).filter(F.col("kind").isNotNull())


def newest(entries: DataFrame) -> DataFrame:
    """Newest entry of every source; the larger ingest id wins between commits of one moment."""
    latest = entries.groupBy("source").agg(
        F.max_by(F.struct(*(c for c in entries.columns if c != "source")), F.struct("committed_at", "ingest_id")).alias("e"))
    return latest.select("source", "e.*")


def data_ids(entries: DataFrame | None = None) -> Column:
    """The ingests whose rows count for a ledger row: its own, and those it kept because the file was read from where it had ended."""
    kept = F.col("kept") if entries is None or "kept" in entries.columns else F.lit(None).cast("array<string>")
    return F.concat(F.array("data_id"), F.coalesce(kept, F.array().cast("array<string>")))


def live(entries: DataFrame) -> DataFrame:
    """Newest entry of every source that is not deleted."""
    return newest(entries).filter(~F.col("deleted"))


def with_status(listing: DataFrame, ledger: DataFrame, now: str,
                cooldown_seconds: int = fixed.COOLDOWN_SECONDS) -> DataFrame:
    """Add ``current`` to a listing: whether the file needs no ingest.

    A file is current when its ledger entry has the same size and, within a millisecond, the same modification time,
    or when it was ingested less than ``cooldown_seconds`` before ``now`` (UTC); files without an entry, or of another
    path than the entry's (``known_path``), are not.
    """
    known = ledger.select("source", F.col("mtime").alias("_mtime"), F.col("size").alias("_size"), "ingested_at",
                          F.col("path").alias("known_path"))
    same = (F.abs(F.col("mtime") - F.col("_mtime")) < fixed.MTIME_TOLERANCE_SECONDS) & (F.col("size") == F.col("_size"))
    age = F.lit(now).cast("timestamp_ntz") - F.col("ingested_at")
    recent = (age < F.make_dt_interval(secs=F.lit(cooldown_seconds))) & F.lit(cooldown_seconds > 0)
    same_file = F.col("path") == F.col("known_path")
    current = F.coalesce(same_file & (same | F.coalesce(recent, F.lit(False))), F.lit(False))
    return listing.join(known, "source", "left").select(*listing.columns, current.alias("current"), "known_path")


def changed(listing: DataFrame, ledger: DataFrame, now: str,
            cooldown_seconds: int = fixed.COOLDOWN_SECONDS) -> DataFrame:
    """Files of ``listing`` that need ingesting."""
    return with_status(listing, ledger, now, cooldown_seconds).filter(~F.col("current")).drop("current", "known_path")


def followed(found: DataFrame, ledger: DataFrame, endings: Callable[[DataFrame, str], DataFrame], most: int) -> DataFrame:
    """Add ``begin``, from where a file has to be read, and what its ledger row then keeps: ``kept``, ``rows_before``.

    A text file is read from the end of what was read before if it has grown, if what it had then is unchanged (``endings`` of files give
    what tells, by path), and if that was fewer than ``most`` times so already; else ``begin`` is 0 and ``kept`` null.
    """
    known = ledger.select("source", F.col("path").alias("_path"), F.col("size").alias("_size"), F.col("ending").alias("_ending"),
                          data_ids().alias("kept"), F.col("rows_ingested").alias("rows_before"))
    grown = found.filter(F.col("kind") == TEXT).join(known, "source").filter(
        (F.col("path") == F.col("_path")) & (F.col("size") > F.col("_size")) & F.col("_ending").isNotNull() & (F.size("kept") <= most))
    same = grown.join(endings(grown, "_size"), "path").filter(F.col("ending") == F.col("_ending")).select(
        "source", "path", F.col("_size").alias("begin"), "kept", "rows_before")
    return found.join(same, ["source", "path"], "left").withColumn("begin", F.coalesce("begin", F.lit(0)).cast("bigint"))


def same_names(found: Sequence[Row]) -> dict[str, str]:
    """Why files can't be told from others: their name stands for another path in the ledger, or twice in the listing."""
    clashes, paths = {}, {}
    for f in found:
        other = paths.setdefault(f.source, f.known_path or f.path)
        if other != f.path:
            clashes[f.source] = f"{f.path} has the name of {other}"
    return clashes


def newest_first(ledger: DataFrame) -> DataFrame:
    return ledger.orderBy(F.col("ingested_at").desc(), "source")


def retained(table: DataFrame, as_of: str, days: int = fixed.RETENTION_DAYS) -> DataFrame:
    """Rows within the retention window, whole days for daily and hourly tables alike."""
    first = F.date_sub(F.lit(as_of).cast("date"), days)
    if "day" in table.columns:
        return table.filter(F.col("day") >= first)
    return table.filter(F.col("hour") >= first.cast("timestamp_ntz"))
