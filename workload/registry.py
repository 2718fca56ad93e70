"""Registered queries over the derived access log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from hitledger import session
from hitledger.operators import geo, ledger, parse, rollups
from hitledger.plans import reports, traffic
from hitledger.plans.traffic import Traffic
from workload.access_log import AS_OF, FROM_DAY, TO_DAY, geo_blocks, geo_networks, raw_log
from workload.stored import STORED

DAYS = (FROM_DAY, TO_DAY)
ALL, HUMAN, BOT = (("all", *DAYS), ("human", *DAYS), ("bot", *DAYS))
NOW = "2024-01-31 12:00:00"
DRILL_IP = "10.1.2.16"
DRILL_PATH = "/fr/825"
YEAR = 2024

Query = Callable[[SparkSession, str], DataFrame]


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_lines(raw_log(spark, sf_dir))


def reqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.requests(parsed(spark, sf_dir))


def tables(spark: SparkSession, sf_dir: str, located: bool = False, staged: bool = False) -> rollups.Rollups:
    """Rollups of the derived log. ``staged``: lines are parsed once, to the shared folder, for answers from several rollups."""
    rows = parsed(spark, sf_dir)
    if staged:
        path = session.shared_dir(spark, "parsed")
        rows.write.parquet(path)
        rows = spark.read.schema(rows.schema).parquet(path)
    blocks = geo.blocks_from_ranges(geo_blocks(spark, sf_dir)) if located else None
    return rollups.build(rows, AS_OF, locate=lambda ips: geo.locate_clients(ips, blocks))


def _traffic(answer: Callable[[Traffic], DataFrame], located: bool = False, staged: bool = False) -> Query:
    return lambda spark, sf_dir: answer(Traffic(tables(spark, sf_dir, located, staged)))


def _rollup(name: str) -> Query:
    return lambda spark, sf_dir: rollups.build(parsed(spark, sf_dir), AS_OF)[name]


def _requests(*columns: str) -> Query:
    return lambda spark, sf_dir: reqs(spark, sf_dir).select("event_id", *columns)


def _of_outcome(outcome: str, *columns: str) -> Query:
    return lambda spark, sf_dir: parsed(spark, sf_dir).filter(F.col("outcome") == outcome).select("event_id", *columns)


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_log(spark, sf_dir).groupBy("source").agg(F.sum(F.length("line") + 1).alias("size")).select(
        "source", F.concat(F.lit("/logs/"), "source").alias("path"), F.lit(1000.0).alias("mtime"), "size")


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of three of four files: unchanged; grown long ago, after an older version; grown just now."""
    number = F.substring("source", 8, 1)
    seen = _listing(spark, sf_dir).filter(number != "3")
    versions = seen.select("*", F.explode(F.when(number == "1", F.array(F.lit(1), F.lit(2))).otherwise(
        F.array(F.lit(2)))).alias("version"))
    age = F.when(number == "2", F.lit(60)).otherwise(F.lit(600)) + (F.lit(2) - F.col("version")) * 3600
    return versions.select(
        "source", "path", "mtime", (F.col("size") - F.when(number == "0", 0).otherwise(10)).alias("size"),
        (F.lit(NOW).cast("timestamp_ntz") - F.make_dt_interval(secs=age)).alias("ingested_at"),
        F.concat(F.lit("run-"), F.col("version").cast("string")).alias("ingest_id"), F.lit(False).alias("deleted")
    ).withColumn("committed_at", F.col("ingested_at"))


def _changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.changed(_listing(spark, sf_dir), ledger.live(_ledger(spark, sf_dir)), NOW)


def _log_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("id"), "ts", F.upper("event_type").alias("level"),
        F.concat(F.lit("user."), F.col("user_id").cast("string")).alias("logger"), F.col("props").alias("message"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.busiest_keys(rollups.keyed_counts(reqs(spark, sf_dir), "daily_paths"), "path", 5)


def _top_pairs(outer: str, inner: str) -> Query:
    return lambda spark, sf_dir: rollups.top_pairs(rollups.ip_path_pairs(reqs(spark, sf_dir)), outer, inner, 5, 3)


def _geo_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables(spark, sf_dir, located=True)["daily_ips"]


def _nested_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients = reqs(spark, sf_dir).select("ip").distinct()
    return geo.locate_clients(clients, geo.disjoint(geo.blocks_from_networks(geo_networks(spark, sf_dir))))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    folded = traffic.nested(Traffic(tables(spark, sf_dir, staged=True)).drill_ip_map(*DAYS, 20, 3), "ip", "path")
    return folded.select("ip", F.explode("counts").alias("path", "n"))


def _about_unique_ips(t: Traffic) -> DataFrame:
    """Distinct clients of each category, exactly, and whether the sketches' estimate is within five standard errors of that."""
    rows = [t.unique_ips(c, *DAYS).select(F.lit(c).alias("category"), "unique_ips", t.about_unique_ips(c, *DAYS).scalar().alias("about"))
            for c in ("all", "bot", "human")]
    found = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return found.select("category", "unique_ips", (F.abs(F.col("about") - F.col("unique_ips")) <= 0.04 * F.col("unique_ips")).alias("is_near"))


def _month_scope(t: Traffic) -> DataFrame:
    return t.totals("human", *traffic.month_range(YEAR, 1))


def _default_window(t: Traffic) -> DataFrame:
    return t.totals("all", *traffic.default_range(AS_OF))


QUERIES: dict[str, Query] = {
    # lines and fields
    "parse_log_lines": _requests("source", "ip", "ts", "day", "hour", "method", "path", "status", "bytes", "referer",
                                 "user_agent", "response_time_us", "is_bot"),
    "malformed_lines": _of_outcome(parse.MALFORMED, "source", "line_chars"),
    "bad_timestamp_lines": _of_outcome(parse.BAD_TIME, "source", "line_chars"),
    "normalize_paths": _requests("path"),
    "valid_methods": _requests("method"),
    "bot_classification": _requests("user_agent", "is_bot"),
    "safe_numeric_fields": _requests("bytes", "response_time_us"),
    "category_membership": lambda s, d: parse.with_categories(reqs(s, d)).select("event_id", "category"),
    "ingest_metrics": lambda s, d: parse.line_metrics(parsed(s, d)),
    "time_range_filter": lambda s, d: parse.between(reqs(s, d), "2024-01-10 06:30:00", "2024-01-12 18:00:00").select(
        "event_id", "ts"),
    "default_window": _traffic(_default_window, staged=True),
    # rollups
    "daily_totals": _rollup("daily_totals"),
    "error_counts": lambda s, d: rollups.daily_totals(parsed(s, d), AS_OF).filter("errors > 0").select(
        "day", "source", "errors"),
    "daily_paths": _rollup("daily_paths"),
    "daily_ips": _rollup("daily_ips"),
    "daily_status": _rollup("daily_status"),
    "daily_methods": _rollup("daily_methods"),
    "daily_ua": _rollup("daily_ua"),
    "daily_referers": _rollup("daily_referers"),
    "hourly_totals": _rollup("hourly_totals"),
    "ip_path_pairs": lambda s, d: rollups.ip_path_pairs(reqs(s, d)),
    "capped_daily_paths": _capped,
    "top_ip_paths_per_day": _top_pairs("ip", "path"),
    "top_path_ips_per_day": _top_pairs("path", "ip"),
    # totals and series
    "window_totals": _traffic(lambda t: t.totals(*ALL), staged=True),
    "unique_ips": _traffic(lambda t: t.unique_ips(*HUMAN)),
    "about_unique_ips": _traffic(_about_unique_ips, staged=True),
    "status_distribution": _traffic(lambda t: t.status_codes(*ALL)),
    "method_distribution": _traffic(lambda t: t.methods(*BOT)),
    "daily_series": _traffic(lambda t: t.daily(*HUMAN)),
    "hourly_series": _traffic(lambda t: t.hourly(*ALL)),
    "month_scope_totals": _traffic(_month_scope, staged=True),
    # top lists
    "top_paths": _traffic(lambda t: t.top_paths(*ALL, 10)),
    "path_search": _traffic(lambda t: t.search_paths("/en/", *ALL)),
    "top_ips": _traffic(lambda t: t.top_ips(*HUMAN)),
    "top_user_agents": _traffic(lambda t: t.top_user_agents(*ALL, 4)),
    "top_referers": _traffic(lambda t: t.top_referers(*BOT)),
    # geography
    "geo_enrich_ips": _geo_ips,
    "geo_nested_blocks": _nested_blocks,
    "top_countries": _traffic(lambda t: t.top_countries(*ALL, 5), located=True),
    "top_cities": _traffic(lambda t: t.top_cities(*ALL, 5), located=True),
    "latest_ip_geo": lambda s, d: geo.latest(_geo_ips(s, d)),
    "top_ips_geo": _traffic(lambda t: t.top_ips(*ALL), located=True),
    # drill-downs
    "drill_ip": _traffic(lambda t: t.drill_ip(DRILL_IP, *DAYS)),
    "drill_path": _traffic(lambda t: t.drill_path(DRILL_PATH, *DAYS)),
    "drill_ip_total": _traffic(lambda t: t.drill_ip_total(DRILL_IP, *DAYS), located=True, staged=True),
    "drill_path_total": _traffic(lambda t: t.drill_path_total(DRILL_PATH, *DAYS)),
    "drill_ip_map": _traffic(lambda t: t.drill_ip_map(*DAYS, 20, 3), staged=True),
    "drill_path_map": _traffic(lambda t: t.drill_path_map(*DAYS, 20, 3), staged=True),
    "drill_ip_nested": _nested,
    "threshold_top_paths": _traffic(lambda t: t.top_by_threshold("daily_paths", *ALL, 10), staged=True),
    "threshold_drill_map": _traffic(lambda t: t.drill_map_by_threshold("ip", *DAYS, 20, 3), staged=True),
    "subnet_share": _traffic(lambda t: t.subnets(*ALL, alert_pct=5.0)),
    # years
    "yearly_totals": _traffic(lambda t: t.yearly_totals(YEAR, "bot"), staged=True),
    "monthly_series": _traffic(lambda t: t.monthly(YEAR, "all")),
    "available_years": _traffic(lambda t: t.available_years("all")),
    "yearly_report": _traffic(lambda t: reports.yearly_report(t, YEAR, "human"), staged=True),
    # application log
    "recent_log_records": lambda s, d: traffic.recent_records(_log_records(s, d), 500, "error"),
    # ledger
    "retention_filter": lambda s, d: ledger.retained(rollups.build(parsed(s, d), AS_OF)["hourly_totals"], AS_OF, 15),
    "ledger_changed_files": _changed,
    "ledger_pending": lambda s, d: _changed(s, d).limit(1).agg((F.count("*") > 0).alias("pending")),
    "ledger_latest": lambda s, d: ledger.newest_first(ledger.live(_ledger(s, d))).select(
        "source", "size", "ingested_at", "ingest_id"),
    # files, store and streams
    **STORED,
}
