"""Daily and hourly rollups of parsed lines, one row set per source.

Every rollup counts ``all`` and ``bot`` side by side in one aggregation and turns the finished counts into category
rows, so requests are neither doubled before the shuffle nor aggregated twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, functions as F

from hitledger import fixed_values as fixed
from hitledger.operators.parse import MALFORMED, REQUEST, requests
from hitledger.operators.topk import top_per_group

# table -> the request column whose values it counts per day and category
KEYED_TABLES = {
    "daily_paths": "path", "daily_ips": "ip", "daily_status": "status", "daily_methods": "method",
    "daily_ua": "user_agent", "daily_referers": "referer",
}
PAIR_TABLES = {"daily_ip_paths": ("ip", "path"), "daily_path_ips": ("path", "ip")}
Step = Callable[[DataFrame], DataFrame]
CLIENTS = "daily_clients"
TABLES = ("daily_totals", *KEYED_TABLES, "hourly_totals", *PAIR_TABLES, CLIENTS)
MONTH_TABLES = tuple(t for t in TABLES if t != "hourly_totals")
SKETCH_BITS = 14  # 16,384 registers: the estimate's standard error is 0.8 %


def _category_rows(grouped: DataFrame, keys: list[str], measures: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Unpivot ``(of all, of bots)`` measure pairs to one row per category."""
    rows = []
    for name in fixed.CATEGORIES:
        pick = {"all": lambda a, b: a, "bot": lambda a, b: b, "human": lambda a, b: a - b}[name]
        rows.append(F.struct(F.lit(name).alias("category"), *(pick(a, b).alias(m) for m, (a, b) in measures.items())))
    return grouped.select(*keys, F.inline(F.array(*rows)))


def _counted(reqs: DataFrame, keys: list[str], enrich: Step | None = None) -> DataFrame:
    """Counts per keys and category; ``enrich`` may add columns while there is one row per key."""
    grouped = reqs.groupBy(*keys).agg(F.count("*").alias("n_all"), F.count_if("is_bot").alias("n_bot"))
    if enrich:
        grouped = enrich(grouped)
    kept = [c for c in grouped.columns if c not in ("n_all", "n_bot")]
    rows = _category_rows(grouped, kept, {"count": (F.col("n_all"), F.col("n_bot"))})
    return rows.filter(F.col("count") > 0)


def daily_totals(parsed: DataFrame, as_of: str) -> DataFrame:
    """Requests, bytes, malformed lines and response times; malformed lines count for ``all`` on day ``as_of``."""
    malformed = F.col("outcome") == MALFORMED
    bot = F.col("is_bot") & ~malformed

    def both(value: Column) -> tuple[Column, Column]:
        return F.coalesce(F.sum(value), F.lit(0)), F.coalesce(F.sum(F.when(bot, value)), F.lit(0))

    measures = {
        "total_requests": both(F.when(malformed, 0).otherwise(1)),
        "bytes_total": both(F.col("bytes")), "rt_sum": both(F.col("response_time_us")),
        "rt_n": both(F.when(F.col("response_time_us").isNotNull(), 1).otherwise(0)),
    }
    grouped = (parsed.filter(F.col("outcome").isin(REQUEST, MALFORMED))
               .withColumn("day", F.when(malformed, F.lit(as_of).cast("date")).otherwise(F.col("day")))
               .groupBy("day", "source")
               .agg(F.count_if(malformed).alias("n_errors"),
                    *(x.alias(f"{m}_{side}") for m, pair in measures.items() for x, side in zip(pair, ("all", "bot")))))
    pairs = {m: (F.col(f"{m}_all"), F.col(f"{m}_bot")) for m in measures}
    pairs["errors"] = (F.col("n_errors"), F.lit(0).cast("bigint"))
    rows = _category_rows(grouped, ["day", "source"], pairs)
    is_all = F.col("category") == "all"
    return (rows.withColumn("errors", F.when(is_all, F.col("errors")).otherwise(0).cast("bigint"))
            .filter(is_all | (F.col("total_requests") > 0))
            .select("day", "category", "source", "total_requests", "bytes_total", "errors", "rt_sum", "rt_n"))


def keyed_counts(reqs: DataFrame, table: str, enrich: Step | None = None) -> DataFrame:
    """Requests per value of the table's key, with the columns that ``enrich`` adds to the counted keys."""
    key = KEYED_TABLES[table]
    counted = {
        "user_agent": F.col(key) != fixed.ABSENT,
        "referer": ~F.col(key).isin(*fixed.UNCOUNTED_REFERERS),
    }.get(key, F.col(key).isNotNull())
    rows = _counted(reqs.filter(counted), ["day", "source", key], enrich)
    added = [c for c in rows.columns if c not in ("day", "category", "source", key, "count")]
    return rows.select("day", "category", "source", key, "count", *added)


def busiest_keys(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` most requested keys of each day, category and source, for a report; rollups hold all keys."""
    return top_per_group(rows, ["day", "category", "source"], "count", [key], n)


def hourly_totals(reqs: DataFrame) -> DataFrame:
    return _counted(reqs, ["hour", "source"]).select("hour", "category", "source", "count")


def client_sketches(reqs: DataFrame) -> DataFrame:
    """A mergeable sketch of the different clients of each day, source and category: at most some 16 KB a row, however many clients.

    Rows of any days and sources give the clients of them all by ``hll_union_agg``; partial sketches absorb hot days before the shuffle.
    """
    of = {"all": F.col("ip"), "bot": F.when(F.col("is_bot"), F.col("ip")), "human": F.when(~F.col("is_bot"), F.col("ip"))}
    grouped = reqs.groupBy("day", "source").agg(
        *(F.hll_sketch_agg(ip, SKETCH_BITS).alias(name) for name, ip in of.items()), *(F.count(ip).alias(f"n_{name}") for name, ip in of.items()))
    rows = F.array(*(F.struct(F.lit(name).alias("category"), F.when(F.col(f"n_{name}") > 0, F.col(name)).alias("clients")) for name in of))
    return grouped.select("day", "source", F.inline(rows)).filter("clients IS NOT NULL").select("day", "category", "source", "clients")


def by_month(rows: DataFrame) -> DataFrame:
    """Rows of a daily rollup merged by month over all sources; ``day`` is the first of the month.

    Counts are summed and sketches united, so answers that sum, count different keys or unite sketches may read months for days.
    """
    dropped = {"source", "ingest_id", "bucket"}
    merged = {c: F.sum(c) for c in ("count", "total_requests", "bytes_total", "errors", "rt_sum", "rt_n")} | {"clients": F.hll_union_agg("clients")}
    keys = [c for c in rows.columns if c not in merged and c not in dropped]
    monthly = rows.withColumn("day", F.trunc("day", "month"))
    return monthly.groupBy(*keys).agg(*(merged[c].alias(c) for c in rows.columns if c in merged))


def ip_path_pairs(reqs: DataFrame) -> DataFrame:
    """Requests per client and path, all categories together."""
    return (reqs.filter(F.col("path").isNotNull())
            .groupBy("day", "source", "ip", "path").agg(F.count("*").alias("count")))


def top_pairs(pairs: DataFrame, outer: str, inner: str, outer_n: int, inner_n: int) -> DataFrame:
    """Per day and source the ``outer_n`` busiest ``outer`` keys, each with its ``inner_n`` busiest ``inner`` keys.

    Inner keys are ranked first: each task keeps at most ``inner_n`` rows of a key before the shuffle, so no hot key is joined.
    """
    keys = ["day", "source", outer]
    ranked = top_per_group(pairs, keys, "count", [inner], inner_n)
    busiest = top_per_group(pairs.groupBy(*keys).agg(F.sum("count").alias("n")), keys[:2], "n", [outer], outer_n)
    return ranked.join(busiest.select(*keys), keys).select(*keys, inner, "count")


class Rollups(Mapping[str, DataFrame]):
    """Tables by name, each planned only when it is asked for; ``lists`` has the same rows with their ``ingest_id``, where they have one."""

    def __init__(self, plans: Mapping[str, Callable[[], DataFrame]], lists: Mapping[str, Callable[[], DataFrame]] | None = None):
        self._plans = dict(plans)
        self.lists = self if lists is None else Rollups(lists)

    def __getitem__(self, name: str) -> DataFrame:
        return self._plans[name]()

    def __iter__(self) -> Iterator[str]:
        return iter(self._plans)

    def __len__(self) -> int:
        return len(self._plans)


class Months(Rollups):
    """Merged rollups by name, and the months (``2024-01``) that they hold."""

    def __init__(self, plans: Mapping[str, Callable[[], DataFrame]], built: Iterable[str]):
        super().__init__(plans)
        self.built = frozenset(built)


def build(parsed: DataFrame, as_of: str, pairs: DataFrame | None = None, locate: Step | None = None) -> Rollups:
    """All rollups, unevaluated and complete.

    ``pairs`` may give ready ``ip_path_pairs``; ``locate`` adds the location columns of ``daily_ips`` from its ``ip``.
    The two drill-down tables hold every pair, each ordered for lookups by its first key.
    """
    def drill(outer: str, inner: str) -> DataFrame:
        every = ip_path_pairs(requests(parsed)) if pairs is None else pairs
        return every.select("day", "source", outer, inner, "count")

    def keyed(table: str) -> Callable[[], DataFrame]:
        return lambda: keyed_counts(requests(parsed), table, locate if table == "daily_ips" else None)

    return Rollups({
        "daily_totals": lambda: daily_totals(parsed, as_of),
        **{table: keyed(table) for table in KEYED_TABLES},
        "hourly_totals": lambda: hourly_totals(requests(parsed)),
        "daily_ip_paths": lambda: drill("ip", "path"),
        "daily_path_ips": lambda: drill("path", "ip"),
        CLIENTS: lambda: client_sketches(requests(parsed)),
    })
