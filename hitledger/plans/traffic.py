"""Traffic answers on the rollups. Every method returns an unevaluated DataFrame."""

from __future__ import annotations

from calendar import monthrange
from collections.abc import Mapping
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from hitledger import fixed_values as fixed
from hitledger.functions import labels, network
from hitledger.operators import geo
from hitledger.operators.rollups import CLIENTS, KEYED_TABLES, Months
from hitledger.operators.topk import top, top_of_lists, top_per_group

TOTALS = ("total_requests", "bytes_total", "errors", "rt_sum", "rt_n")


def check_category(category: str) -> str:
    if category not in fixed.CATEGORIES:
        raise ValueError(f"invalid category: {category!r}")
    return category


def check_range(from_day: str, to_day: str) -> tuple[str, str]:
    start, end = date.fromisoformat(from_day), date.fromisoformat(to_day)
    if start > end:
        raise ValueError(f"invalid date range: {from_day} is after {to_day}")
    return start.isoformat(), end.isoformat()


def check_year(year: int) -> int:
    if isinstance(year, bool) or not isinstance(year, int) or not fixed.FIRST_YEAR <= year <= fixed.LAST_YEAR:
        raise ValueError(f"invalid year: {year!r}")
    return year


def default_range(as_of: str, days: int = fixed.WINDOW_DAYS, from_day: str | None = None,
                  to_day: str | None = None) -> tuple[str, str]:
    """The last ``days`` days up to ``as_of``, both ends inclusive; a half-given range falls back entirely."""
    if from_day and to_day:
        return check_range(from_day, to_day)
    end = date.fromisoformat(as_of)
    return (end - timedelta(days=days)).isoformat(), end.isoformat()


def month_range(year: int, month: int) -> tuple[str, str]:
    check_year(year)
    first = date(year, month, 1)
    last = date(year, 12, 31) if month == 12 else date(year, month + 1, 1) - timedelta(days=1)
    return first.isoformat(), last.isoformat()


def whole_months(from_day: str, to_day: str) -> list[str]:
    """Months (``2024-01``) all of whose days are in the range."""
    start, end = check_range(from_day, to_day)
    months = [(y, m) for y in range(int(start[:4]), int(end[:4]) + 1) for m in range(1, 13)]
    return [f"{y:04d}-{m:02d}" for y, m in months
            if start <= f"{y:04d}-{m:02d}-01" and f"{y:04d}-{m:02d}-{monthrange(y, m)[1]}" <= end]


def _in_days(from_day: str, to_day: str) -> Column:
    start, end = check_range(from_day, to_day)
    return F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))


def _lists(rows: DataFrame) -> list[str]:
    """Columns inside whose values a rollup holds each key once: a followed file has rows of several ingests."""
    return [c for c in ("day", "source", "ingest_id") if c in rows.columns]


def _total(column: str = "count") -> Column:
    return F.sum(column).alias("n")


class Traffic:
    """Queries over a mapping of rollup tables, such as ``rollups.build`` or ``RollupStore.tables`` give.

    ``months``, as ``RollupStore.months`` gives them, stand for the days of those whole months of a range that they hold.
    """

    def __init__(self, tables: Mapping[str, DataFrame], months: Months | None = None):
        self.tables, self.months = tables, months
        self._lists = getattr(tables, "lists", tables)

    def _range(self, table: str, from_day: str, to_day: str) -> DataFrame:
        """Rows of a range of days, from months where they can be; ``day`` and ``source`` tell nothing then."""
        whole = [m for m in whole_months(from_day, to_day) if m in self.months.built] if self.months else []
        days = self.tables[table].filter(_in_days(from_day, to_day))
        if not whole:
            return days
        merged = self.months[table].filter(labels.month_label(F.col("day")).isin(whole))
        return days.filter(~labels.month_label(F.col("day")).isin(whole)).select(*merged.columns).unionByName(merged)

    def _scope(self, table: str, category: str, from_day: str, to_day: str) -> DataFrame:
        return self._range(table, from_day, to_day).filter(F.col("category") == check_category(category))

    def _scope_of_all(self, table: str) -> DataFrame:
        return self.tables[table].filter(F.col("category") == "all")

    def _by_key(self, table: str, key: str, scope: tuple[str, str, str]) -> DataFrame:
        return self._scope(table, *scope).groupBy(key).agg(_total())

    # totals and series

    def totals(self, category: str, from_day: str, to_day: str) -> DataFrame:
        """Always one row: request, byte, error and response-time sums, mean response time and distinct clients."""
        sums = self._scope("daily_totals", category, from_day, to_day).agg(
            *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS))
        return sums.select(
            *TOTALS, labels.mean_floor(F.col("rt_sum"), F.col("rt_n")).alias("avg_response_time_us"),
            self.unique_ips(category, from_day, to_day).scalar().alias("unique_ips"))

    def unique_ips(self, category: str, from_day: str, to_day: str) -> DataFrame:
        return self._scope("daily_ips", category, from_day, to_day).agg(F.count_distinct("ip").alias("unique_ips"))

    def about_unique_ips(self, category: str, from_day: str, to_day: str) -> DataFrame:
        """Distinct clients from the days' sketches: a standard error of 0.8 %, and a few rows read for each day, whatever the traffic."""
        every = F.hll_sketch_estimate(F.hll_union_agg("clients"))
        return self._scope(CLIENTS, category, from_day, to_day).agg(F.coalesce(every, F.lit(0)).alias("unique_ips"))

    def status_codes(self, category: str, from_day: str, to_day: str) -> DataFrame:
        return self._by_key("daily_status", "status", (category, from_day, to_day)).orderBy("status")

    def methods(self, category: str, from_day: str, to_day: str) -> DataFrame:
        return self._by_key("daily_methods", "method", (category, from_day, to_day)).orderBy("method")

    def daily(self, category: str, from_day: str, to_day: str) -> DataFrame:
        scope = self.tables["daily_totals"].filter((F.col("category") == check_category(category)) & _in_days(from_day, to_day))
        return scope.groupBy("day").agg(_total("total_requests")).orderBy("day")

    def hourly(self, category: str, from_day: str, to_day: str) -> DataFrame:
        start, end = check_range(from_day, to_day)
        after = (date.fromisoformat(end) + timedelta(days=1)).isoformat()
        hours = self.tables["hourly_totals"]
        if "day" in hours.columns:  # stored by day: prune partitions
            hours = hours.filter(_in_days(start, end))
        scope = hours.filter(
            (F.col("category") == check_category(category))
            & (F.col("hour") >= F.lit(start).cast("timestamp_ntz")) & (F.col("hour") < F.lit(after).cast("timestamp_ntz")))
        return scope.groupBy("hour").agg(_total()).orderBy("hour").select(labels.hour_label(F.col("hour")).alias("hour"), "n")

    # top lists

    def top_paths(self, category: str, from_day: str, to_day: str, limit: int = fixed.ALL_PATHS) -> DataFrame:
        return top(self._by_key("daily_paths", "path", (category, from_day, to_day)), "n", ["path"], limit)

    def search_paths(self, needle: str, category: str, from_day: str, to_day: str) -> DataFrame:
        """Every path that contains ``needle``, busiest first; the store's scan filters before anything is counted."""
        found = self._scope("daily_paths", category, from_day, to_day).filter(F.contains(F.col("path"), F.lit(needle)))
        return found.groupBy("path").agg(_total()).orderBy(F.col("n").desc(), "path")

    def top_user_agents(self, category: str, from_day: str, to_day: str,
                        limit: int = fixed.TOP_USER_AGENTS) -> DataFrame:
        return top(self._by_key("daily_ua", "user_agent", (category, from_day, to_day)), "n", ["user_agent"], limit)

    def top_referers(self, category: str, from_day: str, to_day: str, limit: int = fixed.TOP_REFERERS) -> DataFrame:
        return top(self._by_key("daily_referers", "referer", (category, from_day, to_day)), "n", ["referer"], limit)

    def _counted_with(self, key: str, along: tuple[str, ...], rows: DataFrame) -> DataFrame:
        """Requests per ``key`` with one value each of the columns ``along``.

        Text minima cannot be hash-aggregated, so the rows are first counted by all columns, which can.
        """
        counted = rows.groupBy(key, *along).agg(_total())
        return counted.groupBy(key).agg(*(F.min(c).alias(c) for c in along), _total("n"))

    def top_ips(self, category: str, from_day: str, to_day: str, limit: int = fixed.TOP_IPS) -> DataFrame:
        """Busiest clients with a known country code, country and city of each, if any."""
        scope = self._scope("daily_ips", category, from_day, to_day)
        return top(self._counted_with("ip", geo.GEO, scope), "n", ["ip"], limit)

    def top_countries(self, category: str, from_day: str, to_day: str, limit: int = fixed.TOP_COUNTRIES) -> DataFrame:
        known = self._scope("daily_ips", category, from_day, to_day).filter(
            F.col("country_code").isNotNull() & F.col("country").isNotNull())
        return top(self._counted_with("country_code", ("country",), known), "n", ["country_code"], limit)

    def top_cities(self, category: str, from_day: str, to_day: str, limit: int = fixed.TOP_CITIES) -> DataFrame:
        known = self._scope("daily_ips", category, from_day, to_day).filter(F.col("city").isNotNull())
        return top(self._counted_with("city", ("country_code",), known), "n", ["city"], limit)

    def subnets(self, category: str, from_day: str, to_day: str, limit: int = fixed.TOP_SUBNETS,
                alert_pct: float = fixed.SUBNET_ALERT_PCT) -> DataFrame:
        """Busiest /24 prefixes with their share of all traffic in the range and an alert flag."""
        scope = self._scope("daily_ips", category, from_day, to_day)
        counted = scope.groupBy(network.subnet_24(F.col("ip")).alias("ip_prefix")).agg(_total())
        everything = counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).scalar()  # shares the scan and the shuffle
        busiest = top(counted, "n", ["ip_prefix"], limit)
        shared = busiest.select("ip_prefix", "n", labels.share_pct(F.col("n"), everything).alias("pct"))
        return shared.withColumn("is_alert", F.col("pct") >= F.lit(alert_pct))

    # drill-downs

    def _drill(self, table: str, key: str, value: str, other: str, days: tuple[str, str], limit: int) -> DataFrame:
        scope = self._range(table, *days).filter(F.col(key) == F.lit(value))
        return top(scope.groupBy(other).agg(_total()), "n", [other], limit)

    def drill_ip(self, ip: str, from_day: str, to_day: str, limit: int = fixed.DRILL_ROWS) -> DataFrame:
        return self._drill("daily_ip_paths", "ip", ip, "path", (from_day, to_day), limit)

    def drill_path(self, path: str, from_day: str, to_day: str, limit: int = fixed.DRILL_ROWS) -> DataFrame:
        return self._drill("daily_path_ips", "path", path, "ip", (from_day, to_day), limit)

    def drill_ip_total(self, ip: str, from_day: str, to_day: str, limit: int = fixed.DRILL_ROWS) -> DataFrame:
        """Sum over the listed rows of ``drill_ip``, with the client's latest known location."""
        place = geo.latest(self._scope_of_all("daily_ips").filter(F.col("ip") == F.lit(ip)))
        listed = self.drill_ip(ip, from_day, to_day, limit).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests"))
        return listed.select(F.lit(ip).alias("ip"), "total_requests",
                             *(place.select(c).scalar().alias(c) for c in geo.GEO))

    def drill_path_total(self, path: str, from_day: str, to_day: str, limit: int = fixed.DRILL_ROWS) -> DataFrame:
        """Sum over the listed rows of ``drill_path``."""
        return self.drill_path(path, from_day, to_day, limit).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_requests")).select(F.lit(path).alias("path"), "total_requests")

    def _drill_map(self, top_table: str, pair_table: str, outer: str, inner: str, days: tuple[str, str],
                   outer_n: int, inner_n: int) -> DataFrame:
        busiest = top(self._by_key(top_table, outer, ("all", *days)), "n", [outer], outer_n).select(outer)
        scope = self._range(pair_table, *days).join(busiest, outer, "left_semi")
        counted = scope.groupBy(outer, inner).agg(_total())
        return top_per_group(counted, [outer], "n", [inner], inner_n).select(outer, inner, "n")

    def drill_ip_map(self, from_day: str, to_day: str, top_ips: int = fixed.DRILL_MAP_KEYS,
                     paths_per_ip: int = fixed.DRILL_PATHS_PER_IP) -> DataFrame:
        """The busiest clients' busiest paths."""
        return self._drill_map("daily_ips", "daily_ip_paths", "ip", "path", (from_day, to_day), top_ips, paths_per_ip)

    def drill_path_map(self, from_day: str, to_day: str, top_paths: int = fixed.DRILL_MAP_KEYS,
                       ips_per_path: int = fixed.DRILL_IPS_PER_PATH) -> DataFrame:
        """The busiest paths' busiest clients."""
        return self._drill_map("daily_paths", "daily_path_ips", "path", "ip", (from_day, to_day), top_paths, ips_per_path)

    # the same top lists over long ranges: entries of days and sources that can't matter are neither summed nor shuffled

    def top_by_threshold(self, table: str, category: str, from_day: str, to_day: str, limit: int) -> DataFrame:
        """The busiest keys of a keyed rollup (``KEYED_TABLES``), as ``top_paths`` and the like give them without locations."""
        key = KEYED_TABLES[table]
        lists = self._lists[table].filter((F.col("category") == check_category(category)) & _in_days(from_day, to_day))
        return top_of_lists(lists, [], _lists(lists), key, "count", limit).orderBy(F.col("n").desc(), key)

    def drill_map_by_threshold(self, outer: str, from_day: str, to_day: str, outer_n: int = fixed.DRILL_MAP_KEYS,
                               inner_n: int = fixed.DRILL_PATHS_PER_IP) -> DataFrame:
        """``drill_ip_map`` (``outer`` is "ip") or ``drill_path_map`` ("path")."""
        busy, pairs, inner = {"ip": ("daily_ips", "daily_ip_paths", "path"), "path": ("daily_paths", "daily_path_ips", "ip")}[outer]
        busiest = self.top_by_threshold(busy, "all", from_day, to_day, outer_n).select(outer)
        lists = self._lists[pairs].filter(_in_days(from_day, to_day)).join(busiest, outer, "left_semi")
        return top_of_lists(lists, [outer], _lists(lists), inner, "count", inner_n)

    # years

    def available_years(self, category: str) -> DataFrame:
        days = self.tables["daily_totals"].filter(F.col("category") == check_category(category))
        return days.select(F.year("day").alias("year")).distinct().orderBy(F.col("year").desc())

    def yearly_totals(self, year: int, category: str) -> DataFrame:
        check_year(year)
        totals = self.totals(category, f"{year:04d}-01-01", f"{year:04d}-12-31")
        return totals.select(F.lit(year).alias("year"), F.lit(category).alias("category"), "*")

    def monthly(self, year: int, category: str) -> DataFrame:
        check_year(year)
        scope = self._scope("daily_totals", category, f"{year:04d}-01-01", f"{year:04d}-12-31")
        return (scope.groupBy(labels.month_label(F.col("day")).alias("month")).agg(_total("total_requests"))
                .orderBy("month"))

    # whole documents

    def stats(self, category: str, from_day: str, to_day: str) -> dict[str, DataFrame]:
        """The parts of the statistics document of one category and range, by name."""
        scope = (category, from_day, to_day)
        return {
            "totals": self.totals(*scope), "top_paths": self.top_paths(*scope, fixed.TOP_PATHS),
            "all_paths": self.top_paths(*scope), "top_ips": self.top_ips(*scope),
            "status_codes": self.status_codes(*scope), "methods": self.methods(*scope),
            "top_user_agents": self.top_user_agents(*scope), "top_referers": self.top_referers(*scope),
            "hourly": self.hourly(*scope), "daily": self.daily(*scope),
            "top_countries": self.top_countries(*scope), "top_cities": self.top_cities(*scope),
        }

    def stats_rows(self, category: str, from_day: str, to_day: str) -> DataFrame:
        """The statistics document as ``(category, section, key, detail, n)`` rows."""
        parts = self.stats(category, from_day, to_day)
        scalars = ("total_requests", "bytes_total", "errors", "avg_response_time_us", "unique_ips")
        rows = [parts.pop("totals").select(F.inline(F.array(*(
            F.struct(F.lit("totals").alias("section"), F.lit(c).alias("key"), F.lit(None).cast("string").alias("detail"),
                     F.col(c).alias("n")) for c in scalars))))]
        detail = {"top_ips": "country_code", "top_countries": "country", "top_cities": "country_code"}
        key = {"top_countries": "country_code", "top_cities": "city", "top_ips": "ip"}
        for section, part in parts.items():
            name = key.get(section, part.columns[0])
            more = F.col(detail[section]) if section in detail else F.lit(None)
            rows.append(part.select(F.lit(section).alias("section"), F.col(name).cast("string").alias("key"),
                                    more.cast("string").alias("detail"), "n"))
        whole = rows[0]
        for part in rows[1:]:
            whole = whole.unionByName(part)
        return whole.select(F.lit(category).alias("category"), "*")


def nested(pairs: DataFrame, outer: str, inner: str) -> DataFrame:
    """Fold ranked pairs into one map per outer key; each holds at most the pairs that were ranked."""
    return pairs.groupBy(outer).agg(F.map_from_entries(F.collect_list(F.struct(inner, "n"))).alias("counts"))


def recent_records(records: DataFrame, n: int = fixed.LOG_TAIL, level: str | None = None) -> DataFrame:
    """The last ``n`` log records by ``ts`` (ties by ``id``), then those of one level among them."""
    tail = records.orderBy(F.col("ts").desc(), F.col("id").desc()).limit(n)
    return tail.filter(F.col("level") == level.upper()) if level else tail
