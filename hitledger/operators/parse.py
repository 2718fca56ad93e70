"""Raw log lines to typed requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hitledger import fixed_values as fixed
from hitledger.functions import requests as rq

REQUEST, BAD_TIME, MALFORMED, UNREADABLE = "request", "bad_time", "malformed", "unreadable"


def _once(value: Column) -> Column:
    """Generate instead of project, so that later filters do not evaluate ``value`` a second time."""
    return F.explode(F.array(value))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Parse ``(source, line)`` rows; every line gives one row whose ``outcome`` says what it is.

    ``request`` rows carry all fields. ``bad_time`` lines match the format but have no usable time, ``malformed``
    lines do not match at all, and a null line marks an input that could not be read. Lines hold no terminators;
    further columns of ``lines`` are carried along.
    """
    carried = [c for c in lines.columns if c not in ("source", "line")]
    fields = F.split(F.regexp_replace("line", fixed.ACCESS_LINE, "\n".join(
        f"${i}" for i in range(1, len(fixed.ACCESS_LINE_FIELDS) + 1))), "\n")
    cut = lines.select("source", *carried, (F.length("line") + 1).alias("line_chars"), _once(fields).alias("f"))

    def field(name: str) -> Column:
        return F.get("f", fixed.ACCESS_LINE_FIELDS.index(name))

    ts = rq.wall_clock(*(field(x) for x in ("year", "month", "day", "hour", "minute", "second")))
    timed = cut.select("source", *carried, "line_chars", "f", _once(ts).alias("ts"))
    usable = F.col("ts").between(
        F.lit(fixed.EARLIEST_REQUEST).cast("timestamp_ntz"), F.lit(fixed.LATEST_REQUEST).cast("timestamp_ntz"))
    outcome = (F.when(F.col("f").isNull(), UNREADABLE).when(F.size("f") == 1, MALFORMED)
               .when(usable, REQUEST).otherwise(BAD_TIME))
    agent = rq.or_absent(field("user_agent"))
    return timed.select(
        "source", *carried, F.col("line_chars").cast("bigint").alias("line_chars"), outcome.alias("outcome"),
        field("ip").alias("ip"), "ts", F.col("ts").cast("date").alias("day"), rq.start_of_hour(F.col("ts")).alias("hour"),
        rq.known_method(field("method")).alias("method"), rq.normal_path(field("target")).alias("path"),
        field("status").alias("status"), field("bytes").try_cast("bigint").alias("bytes"),
        rq.or_absent(field("referer")).alias("referer"), agent.alias("user_agent"),
        field("response_time").try_cast("bigint").alias("response_time_us"), rq.is_bot(agent).alias("is_bot"))


def requests(parsed: DataFrame) -> DataFrame:
    """Rows of valid requests."""
    return parsed.filter(F.col("outcome") == REQUEST).drop("outcome", "line_chars")


def between(reqs: DataFrame, start: str, end: str) -> DataFrame:
    """Requests of an absolute wall-clock range, both ends inclusive."""
    return reqs.filter(F.col("ts").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def with_categories(reqs: DataFrame) -> DataFrame:
    """Each request once under ``all`` and once under its own category."""
    return reqs.withColumn("category", F.explode(F.array(F.lit("all"), rq.category(F.col("is_bot")))))


def line_metrics(parsed: DataFrame) -> DataFrame:
    """Valid rows, malformed lines and characters read of each source."""
    return parsed.groupBy("source").agg(
        F.count_if(F.col("outcome") == REQUEST).alias("rows"),
        F.count_if(F.col("outcome") == MALFORMED).alias("errors"),
        F.sum("line_chars").alias("chars_read"))
