"""SQL twins of the registered queries, written for DuckDB over the same parquet tables."""

from __future__ import annotations

import re

from hitledger import fixed_values as fixed

AS_OF, FROM_DAY, TO_DAY = "DATE '2024-01-31'", "DATE '2024-01-10'", "DATE '2024-01-20'"
DRILL_IP, DRILL_PATH = "10.1.2.16", "/fr/825"

# The log line without the inner structure of its time and request; see hitledger.fixed_values.ACCESS_LINE.
_LINE = (r'^(\S+)\s+\S+\s+\S+\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)'
         r'(?:\s+"([^"]*)")?(?:\s+"([^"]*)")?(?:\s+(\d+))?')
_BOTS = "|".join([fixed.BOT_WORD_END + r"\b", *map(re.escape, fixed.BOT_MARKS)])
_METHODS = ",".join(f"'{m}'" for m in fixed.HTTP_METHODS)

_BASE = rf"""
WITH raw_log AS MATERIALIZED (
    SELECT k AS event_id, 'access_' || (k % 4) || '.log' AS source,
        CASE WHEN k % 101 = 7 THEN 'garbage line ' || k ELSE
            (CASE WHEN u % 50 = 49 THEN '2001:db8::' || lower(to_hex(u // 65536)) || ':' || lower(to_hex(u % 65536))
                  ELSE '10.' || (u % 3 + 3 * ((u // 5376) % 85)) || '.' || (u % 7) || '.' || (u % 256) END)
            || ' - - ['
            || (CASE WHEN k % 103 = 5 THEN '01/Jan/2024:25:00:00' ELSE strftime(ts, '%d/%b/%Y:%H:%M:%S') END)
            || ' +0000] "'
            || (CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'get' WHEN 'signup' THEN 'POST'
                                WHEN 'purchase' THEN 'PUT' ELSE 'NOVERB' END)
            || ' ' || regexp_replace(url, '^https?://[^/]+', '') || (CASE WHEN k % 9 = 0 THEN '//' ELSE '' END)
            || ' HTTP/1.1" '
            || (CASE WHEN event_type = 'error' THEN '500' WHEN k % 13 = 0 THEN '404' ELSE '200' END) || ' '
            || (CASE WHEN k % 17 = 0 THEN '-' ELSE CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) END)
            || ' "' || (CASE k % 5 WHEN 0 THEN '-' WHEN 1 THEN 'http://-' ELSE url END) || '" "'
            || (CASE u % 8
                    WHEN 0 THEN 'Fetchbot/4.2 (nightly)'
                    WHEN 1 THEN 'curl/8.9' WHEN 2 THEN '-' WHEN 3 THEN ''
                    WHEN 4 THEN 'Lynx/2.9 libwww-FM/2.14'
                    WHEN 5 THEN 'NetSurf/3.11 (Linux)'
                    WHEN 6 THEN 'Dillo/3.1 (X11; Linux)'
                    ELSE 'python-requests/2.32' END)
            || '"' || (CASE WHEN k % 3 = 0 THEN '' ELSE ' ' || (k * 37 % 5000) END)
        END AS line
    FROM (SELECT e.event_id AS k, e.user_id AS u, e.*, p.url
          FROM events e JOIN pages p ON p.page_id = e.event_id % (SELECT count(*) FROM pages))),
lines AS MATERIALIZED (
    SELECT event_id, source, CAST(length(line) + 1 AS BIGINT) AS line_chars, regexp_matches(line, '{_LINE}') AS matched,
        regexp_extract(line, '{_LINE}', 1) AS ip,
        try_strptime(regexp_replace(regexp_extract(line, '{_LINE}', 2), ' [^ ]*$', ''), '%d/%b/%Y:%H:%M:%S') AS ts,
        regexp_split_to_array(trim(regexp_extract(line, '{_LINE}', 3)), '\s+') AS request,
        regexp_extract(line, '{_LINE}', 4) AS status,
        regexp_extract(line, '{_LINE}', 5) AS bytes,
        coalesce(nullif(regexp_extract(line, '{_LINE}', 6), ''), '-') AS referer,
        coalesce(nullif(regexp_extract(line, '{_LINE}', 7), ''), '-') AS user_agent,
        nullif(regexp_extract(line, '{_LINE}', 8), '') AS rt
    FROM raw_log),
reqs AS MATERIALIZED (
    SELECT event_id, source, ip, ts, CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS hour,
        CASE WHEN upper(request[1]) IN ({_METHODS}) THEN upper(request[1]) END AS method,
        CASE WHEN coalesce(request[2], '') <> ''
             THEN coalesce(nullif(rtrim(split_part(request[2], '?', 1), '/'), ''), '/') END AS path,
        status, CASE WHEN regexp_matches(bytes, '^[+-]?[0-9]+$') THEN TRY_CAST(bytes AS BIGINT) END AS bytes,
        referer, user_agent, TRY_CAST(rt AS BIGINT) AS response_time_us,
        user_agent = '-' OR regexp_matches(user_agent, '{_BOTS}', 'i') AS is_bot
    FROM lines
    WHERE matched AND ts BETWEEN TIMESTAMP '1970-01-01 00:00:00' AND TIMESTAMP '2099-12-31 23:59:59'),
cats AS (
    SELECT r.*, c.category FROM reqs r
    JOIN (VALUES ('all'), ('bot'), ('human')) c(category)
      ON c.category = 'all' OR (c.category = 'bot') = r.is_bot)
"""


def _keyed(key: str, condition: str) -> str:
    return (f"SELECT day, category, source, {key}, CAST(count(*) AS BIGINT) AS count FROM cats WHERE {condition} "
            f"GROUP BY ALL")


_GOLD = {
    "daily_totals": f"""
        SELECT day, category, source, CAST(sum(n) AS BIGINT) AS total_requests, CAST(sum(b) AS BIGINT) AS bytes_total,
               CAST(sum(e) AS BIGINT) AS errors, CAST(sum(rs) AS BIGINT) AS rt_sum, CAST(sum(rn) AS BIGINT) AS rt_n
        FROM (SELECT day, category, source, 1 AS n, coalesce(bytes, 0) AS b, 0 AS e,
                     coalesce(response_time_us, 0) AS rs, CASE WHEN response_time_us IS NULL THEN 0 ELSE 1 END AS rn
              FROM cats
              UNION ALL SELECT {AS_OF}, 'all', source, 0, 0, 1, 0, 0 FROM lines WHERE NOT matched)
        GROUP BY day, category, source""",
    "daily_paths": _keyed("path", "path IS NOT NULL"),
    "daily_ips": _keyed("ip", "true"),
    "daily_status": _keyed("status", "true"),
    "daily_methods": _keyed("method", "method IS NOT NULL"),
    "daily_ua": _keyed("user_agent", "user_agent <> '-'"),
    "daily_referers": _keyed("referer", "referer NOT IN ('-', 'http://-')"),
    "hourly_totals": "SELECT hour, category, source, CAST(count(*) AS BIGINT) AS count FROM cats GROUP BY ALL",
    "pairs": """SELECT day, source, ip, path, CAST(count(*) AS BIGINT) AS count FROM reqs WHERE path IS NOT NULL
        GROUP BY ALL""",
    "geo_blocks": """
        SELECT 10 * 16777216 + (k % 4) * 65536 + (k % 7) * 256 AS lo, 'C' || k AS country_code, n_name AS country,
               CASE WHEN k % 4 <> 3 THEN n_name || ' City' END AS city
        FROM (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation)""",
    "located_ips": """
        SELECT i.*, g.country_code, g.country, g.city FROM daily_ips i LEFT JOIN geo_blocks g
          ON CASE WHEN contains(i.ip, '.') THEN
               CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536
               + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END
             BETWEEN g.lo AND g.lo + 255""",
}


def _drill_table(outer: str, inner: str, outer_n: int, inner_n: int) -> str:
    return f"""
        SELECT day, source, {outer}, {inner}, count FROM (
            SELECT p.*, row_number() OVER (PARTITION BY p.day, p.source, p.{outer} ORDER BY p.count DESC, p.{inner}) AS r
            FROM pairs p JOIN (
                SELECT day, source, {outer}, row_number() OVER (PARTITION BY day, source
                                                                ORDER BY sum(count) DESC, {outer}) AS o
                FROM pairs GROUP BY day, source, {outer}) t
              ON t.day = p.day AND t.source = p.source AND t.{outer} = p.{outer} AND t.o <= {outer_n})
        WHERE r <= {inner_n}"""


_GOLD["daily_ip_paths"] = _GOLD["daily_path_ips"] = "SELECT * FROM pairs"
_NEEDS = {"located_ips": ["daily_ips", "geo_blocks"], "daily_ip_paths": ["pairs"], "daily_path_ips": ["pairs"]}


def _with(*gold: str) -> str:
    """The shared part and the named rollups, with what those need."""
    names: list[str] = []
    for name in gold:
        names += [x for x in (*_NEEDS.get(name, []), name) if x not in names]
    return _BASE + "".join(f", {name} AS ({_GOLD[name]})" for name in names) + "\n"


def _scope(category: str, start: str = FROM_DAY, end: str = TO_DAY) -> str:
    return f"category = '{category}' AND day BETWEEN {start} AND {end}"


def _totals(category: str, start: str = FROM_DAY, end: str = TO_DAY, first: str = "") -> str:
    w = _scope(category, start, end)
    return _with("daily_totals", "daily_ips") + f"""
        SELECT {first} t.*, CASE WHEN rt_n > 0 THEN rt_sum // rt_n END AS avg_response_time_us,
               (SELECT CAST(count(DISTINCT ip) AS BIGINT) FROM daily_ips WHERE {w}) AS unique_ips
        FROM (SELECT CAST(coalesce(sum(total_requests), 0) AS BIGINT) AS total_requests,
                     CAST(coalesce(sum(bytes_total), 0) AS BIGINT) AS bytes_total,
                     CAST(coalesce(sum(errors), 0) AS BIGINT) AS errors,
                     CAST(coalesce(sum(rt_sum), 0) AS BIGINT) AS rt_sum,
                     CAST(coalesce(sum(rt_n), 0) AS BIGINT) AS rt_n
              FROM daily_totals WHERE {w}) t"""


def _grouped(table: str, keys: str, where: str, limit: int | None = None, more: str = "", measure: str = "count",
             ties: str | None = None) -> str:
    tail = "" if limit is None else f" ORDER BY n DESC, {ties or keys} LIMIT {limit}"
    return _with(table) + (f"SELECT {keys}{more}, CAST(sum({measure}) AS BIGINT) AS n FROM {table} WHERE {where} "
                           f"GROUP BY {keys}{tail}")


_MIN_GEO = ", min(country_code) AS country_code, min(country) AS country, min(city) AS city"
_NO_GEO = ", CAST(NULL AS VARCHAR) AS country_code, CAST(NULL AS VARCHAR) AS country, CAST(NULL AS VARCHAR) AS city"
_DAYS = f"day BETWEEN {FROM_DAY} AND {TO_DAY}"


def _drill_map(outer: str, inner: str, outer_table: str, pair_table: str) -> str:
    return _with(outer_table, pair_table) + f"""
        SELECT {outer}, {inner}, n FROM (
            SELECT {outer}, {inner}, CAST(sum(count) AS BIGINT) AS n,
                   row_number() OVER (PARTITION BY {outer} ORDER BY sum(count) DESC, {inner}) AS r
            FROM {pair_table}
            WHERE {_DAYS} AND {outer} IN (SELECT {outer} FROM {outer_table} WHERE {_scope('all')}
                                          GROUP BY {outer} ORDER BY sum(count) DESC, {outer} LIMIT 20)
            GROUP BY {outer}, {inner})
        WHERE r <= 3"""


_LISTING = """SELECT source, '/logs/' || source AS path, CAST(1000.0 AS DOUBLE) AS mtime,
                     CAST(sum(line_chars) AS BIGINT) AS size FROM lines GROUP BY source"""
_YEAR = ("DATE '2024-01-01'", "DATE '2024-12-31'")


def _bytes_label(x: str) -> str:
    units = [("TB", "1e12"), ("GB", "1e9"), ("MB", "1e6"), ("KB", "1e3")]
    return "CASE " + " ".join(f"WHEN {x} >= {f} THEN format('{{:.2f}} {u}', {x} / {f})" for u, f in units) + \
        f" ELSE {x} || ' B' END"


def _report(category: str, label: str) -> str:
    cards = [("Total Requests", "CAST(total_requests AS VARCHAR)"), ("Unique IPs", "CAST(unique_ips AS VARCHAR)"),
             ("Data Transferred", _bytes_label("bytes_total")), ("Errors", "CAST(errors AS VARCHAR)"),
             ("Avg Response Time", "CASE WHEN avg_response_time_us > 0 THEN format('{:.1f} ms', "
                                   "avg_response_time_us / 1000.0::DOUBLE) ELSE 'N/A' END"),
             ("Category", f"'{label}'")]
    head, body = _totals(category, *_YEAR).rsplit("\n        SELECT  t.*", 1)
    rows = " UNION ALL ".join(
        f"SELECT 'card' AS section, '{name}' AS label, {value} AS value, CAST(NULL AS BIGINT) AS bar_pct FROM y"
        for name, value in cards)
    return f"""{head}, y AS (SELECT t.*{body}), m AS (
        SELECT strftime(day, '%Y-%m') AS month, CAST(sum(total_requests) AS BIGINT) AS n FROM daily_totals
        WHERE {_scope(category, *_YEAR)} GROUP BY 1)
        {rows} UNION ALL SELECT 'month', month, CAST(n AS VARCHAR),
            CAST(round_even(n / (SELECT CASE WHEN max(n) > 0 THEN max(n) ELSE 1 END FROM m) * 100, 0) AS BIGINT) FROM m"""


_MEASURES = ("total_requests", "bytes_total", "errors", "rt_sum", "rt_n")


def _daily_sums(factor: int = 1, first: str = "") -> str:
    sums = ", ".join(f"CAST({factor} * sum({m}) AS BIGINT) AS {m}" for m in _MEASURES)
    return f"SELECT {first} day, category, {sums} FROM daily_totals GROUP BY day, category"


def _source_totals(where: str) -> str:
    return _with("daily_totals") + f"""
        SELECT source, CAST(sum(total_requests) AS BIGINT) AS total_requests, CAST(sum(errors) AS BIGINT) AS errors
        FROM daily_totals WHERE category = 'all' AND {where} GROUP BY source"""


def _stats(category: str) -> str:
    """Rows of one statistics document."""
    w = _scope(category)

    def rows(section: str, key: str, table: str, detail: str = "NULL", group: str | None = None, limit: int | None = None,
             where: str = "true", measure: str = "count") -> str:
        tail = "" if limit is None else f" ORDER BY n DESC, {group or key} LIMIT {limit}"
        return (f"SELECT * FROM (SELECT '{category}' AS category, '{section}' AS section, CAST({key} AS VARCHAR) AS key, "
                f"CAST({detail} AS VARCHAR) AS detail, CAST(sum({measure}) AS BIGINT) AS n FROM {table} "
                f"WHERE {w} AND {where} GROUP BY {group or key}{tail})")

    sums = ", ".join(f"coalesce(sum({m}), 0) AS {m}" for m in _MEASURES)
    scalars = {"total_requests": "total_requests", "bytes_total": "bytes_total", "errors": "errors",
               "avg_response_time_us": "CASE WHEN rt_n > 0 THEN rt_sum // rt_n END",
               "unique_ips": f"(SELECT count(DISTINCT ip) FROM located_ips WHERE {w})"}
    totals = [f"SELECT '{category}' AS category, 'totals' AS section, '{k}' AS key, CAST(NULL AS VARCHAR) AS detail, "
              f"CAST({v} AS BIGINT) AS n FROM (SELECT {sums} FROM daily_totals WHERE {w})" for k, v in scalars.items()]
    hourly = f"""SELECT '{category}', 'hourly', strftime(hour, '%Y-%m-%d %H:00'), NULL, CAST(sum(count) AS BIGINT)
        FROM hourly_totals WHERE category = '{category}' AND CAST(hour AS DATE) BETWEEN {FROM_DAY} AND {TO_DAY}
        GROUP BY hour"""
    return " UNION ALL ".join([
        *totals, hourly,
        rows("top_paths", "path", "daily_paths", limit=10), rows("all_paths", "path", "daily_paths", limit=1000),
        rows("top_ips", "ip", "located_ips", detail="min(country_code)", limit=50),
        rows("status_codes", "status", "daily_status"), rows("methods", "method", "daily_methods"),
        rows("top_user_agents", "user_agent", "daily_ua", limit=20),
        rows("top_referers", "referer", "daily_referers", limit=20),
        rows("daily", "day", "daily_totals", measure="total_requests"),
        rows("top_countries", "country_code", "located_ips", detail="min(country)", limit=30,
             where="country_code IS NOT NULL"),
        rows("top_cities", "city", "located_ips", detail="min(country_code)", limit=30, where="city IS NOT NULL")])


_STATS_TABLES = ("daily_totals", "daily_paths", "located_ips", "daily_status", "daily_methods", "daily_ua",
                 "daily_referers", "hourly_totals")


def _whole_drill(section: str, outer: str, inner: str) -> str:
    """A drill-down map from all pairs, without limits per day and source."""
    return f"""
        SELECT 'all', '{section}', {outer}, {inner}, n FROM (
            SELECT {outer}, {inner}, CAST(sum(count) AS BIGINT) AS n,
                   row_number() OVER (PARTITION BY {outer} ORDER BY sum(count) DESC, {inner}) AS r
            FROM pairs
            WHERE {_DAYS} AND {outer} IN (SELECT {outer} FROM {'daily_ips' if outer == 'ip' else 'daily_paths'}
                                          WHERE {_scope('all')} GROUP BY {outer}
                                          ORDER BY sum(count) DESC, {outer} LIMIT 200)
            GROUP BY {outer}, {inner})
        WHERE r <= 20"""


_DAILY = _with("daily_totals") + _daily_sums()

ORACLE: dict[str, str] = {
    "parse_log_lines": _BASE + "SELECT * FROM reqs",
    "malformed_lines": _BASE + "SELECT event_id, source, line_chars FROM lines WHERE NOT matched",
    "bad_timestamp_lines": _BASE + "SELECT event_id, source, line_chars FROM lines WHERE matched AND ts IS NULL",
    "normalize_paths": _BASE + "SELECT event_id, path FROM reqs",
    "valid_methods": _BASE + "SELECT event_id, method FROM reqs",
    "bot_classification": _BASE + "SELECT event_id, user_agent, is_bot FROM reqs",
    "safe_numeric_fields": _BASE + "SELECT event_id, bytes, response_time_us FROM reqs",
    "category_membership": _BASE + "SELECT event_id, category FROM cats",
    "ingest_metrics": _BASE + """
        SELECT source, CAST(count(*) FILTER (WHERE matched AND ts IS NOT NULL) AS BIGINT) AS rows,
               CAST(count(*) FILTER (WHERE NOT matched) AS BIGINT) AS errors,
               CAST(sum(line_chars) AS BIGINT) AS chars_read
        FROM lines GROUP BY source""",
    "time_range_filter": _BASE + """
        SELECT event_id, ts FROM reqs
        WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-12 18:00:00'""",
    "default_window": _totals("all", "DATE '2024-01-01'", AS_OF),
    **{name: _with(name) + f"SELECT * FROM {name}" for name in (
        "daily_totals", "daily_paths", "daily_ips", "daily_status", "daily_methods", "daily_ua", "daily_referers",
        "hourly_totals")},
    "error_counts": _BASE + f"""
        SELECT {AS_OF} AS day, source, CAST(count(*) AS BIGINT) AS errors FROM lines WHERE NOT matched GROUP BY source""",
    "ip_path_pairs": _with("pairs") + "SELECT * FROM pairs",
    "capped_daily_paths": _with("daily_paths") + """
        SELECT day, category, source, path, count FROM (
            SELECT *, row_number() OVER (PARTITION BY day, category, source ORDER BY count DESC, path) AS r
            FROM daily_paths) WHERE r <= 5""",
    "top_ip_paths_per_day": _with("pairs") + _drill_table("ip", "path", 5, 3),
    "top_path_ips_per_day": _with("pairs") + _drill_table("path", "ip", 5, 3),
    "window_totals": _totals("all"),
    "unique_ips": _with("daily_ips") + f"""
        SELECT CAST(count(DISTINCT ip) AS BIGINT) AS unique_ips FROM daily_ips WHERE {_scope('human')}""",
    "status_distribution": _grouped("daily_status", "status", _scope("all")),
    "method_distribution": _grouped("daily_methods", "method", _scope("bot")),
    "daily_series": _grouped("daily_totals", "day", _scope("human"), measure="total_requests"),
    "hourly_series": _with("hourly_totals") + f"""
        SELECT strftime(hour, '%Y-%m-%d %H:00') AS hour, CAST(sum(count) AS BIGINT) AS n FROM hourly_totals
        WHERE category = 'all' AND hour >= CAST({FROM_DAY} AS TIMESTAMP)
          AND hour < CAST({TO_DAY} AS TIMESTAMP) + INTERVAL 1 DAY GROUP BY 1""",
    "month_scope_totals": _totals("human", "DATE '2024-01-01'", "DATE '2024-01-31'"),
    "top_paths": _grouped("daily_paths", "path", _scope("all"), 10),
    "path_search": _with("daily_paths") + f"""
        SELECT path, CAST(sum(count) AS BIGINT) AS n FROM daily_paths WHERE {_scope('all')} AND contains(path, '/en/')
        GROUP BY path""",
    "top_ips": _grouped("daily_ips", "ip", _scope("human"), 50, more=_NO_GEO),
    "top_user_agents": _grouped("daily_ua", "user_agent", _scope("all"), 4),
    "top_referers": _grouped("daily_referers", "referer", _scope("bot"), 20),
    "geo_enrich_ips": _with("located_ips") + "SELECT * FROM located_ips",
    "top_countries": _grouped("located_ips", "country_code", _scope("all") + " AND country_code IS NOT NULL", 5,
                              more=", min(country) AS country"),
    "top_cities": _grouped("located_ips", "city", _scope("all") + " AND city IS NOT NULL", 5,
                           more=", min(country_code) AS country_code"),
    "latest_ip_geo": _with("located_ips") + """
        SELECT ip, country_code, country, city FROM (
            SELECT *, row_number() OVER (PARTITION BY ip ORDER BY day DESC, country_code DESC) AS r
            FROM located_ips WHERE country_code IS NOT NULL) WHERE r = 1""",
    "top_ips_geo": _grouped("located_ips", "ip", _scope("all"), 50, more=_MIN_GEO),
    "drill_ip": _grouped("daily_ip_paths", "path", f"ip = '{DRILL_IP}' AND {_DAYS}", 20),
    "drill_path": _grouped("daily_path_ips", "ip", f"path = '{DRILL_PATH}' AND {_DAYS}", 20),
    "drill_ip_total": _with("daily_ip_paths", "located_ips") + f"""
        SELECT '{DRILL_IP}' AS ip, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_requests,
               any_value(g.country_code) AS country_code, any_value(g.country) AS country, any_value(g.city) AS city
        FROM (SELECT path, sum(count) AS n FROM daily_ip_paths WHERE ip = '{DRILL_IP}' AND {_DAYS}
              GROUP BY path ORDER BY n DESC, path LIMIT 20)
        LEFT JOIN (SELECT country_code, country, city FROM located_ips
                   WHERE ip = '{DRILL_IP}' AND country_code IS NOT NULL ORDER BY day DESC LIMIT 1) g ON true""",
    "drill_path_total": _with("daily_path_ips") + f"""
        SELECT '{DRILL_PATH}' AS path, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_requests
        FROM (SELECT ip, sum(count) AS n FROM daily_path_ips WHERE path = '{DRILL_PATH}' AND {_DAYS}
              GROUP BY ip ORDER BY n DESC, ip LIMIT 20)""",
    "drill_ip_map": _drill_map("ip", "path", "daily_ips", "daily_ip_paths"),
    "drill_path_map": _drill_map("path", "ip", "daily_paths", "daily_path_ips"),
    "drill_ip_nested": _drill_map("ip", "path", "daily_ips", "daily_ip_paths"),
    "subnet_share": _with("daily_ips") + f""", s AS (
        SELECT array_to_string(str_split(ip, '.')[1:3], '.') AS ip_prefix, CAST(sum(count) AS BIGINT) AS n
        FROM daily_ips WHERE {_scope('all')} GROUP BY 1)
        SELECT ip_prefix, n, pct, pct >= 5.0 AS is_alert FROM (
            SELECT ip_prefix, n, round(CAST(n AS DOUBLE) * 100 / (SELECT sum(n) FROM s), 2) AS pct FROM s)
        ORDER BY n DESC, ip_prefix LIMIT 50""",
    "yearly_totals": _totals("bot", *_YEAR, first="CAST(2024 AS INTEGER) AS year, 'bot' AS category,"),
    "monthly_series": _with("daily_totals") + f"""
        SELECT strftime(day, '%Y-%m') AS month, CAST(sum(total_requests) AS BIGINT) AS n FROM daily_totals
        WHERE {_scope('all', *_YEAR)} GROUP BY 1""",
    "available_years": _with("daily_totals") + """
        SELECT DISTINCT CAST(extract(year FROM day) AS INTEGER) AS year FROM daily_totals WHERE category = 'all'""",
    "yearly_report": _report("human", "Human"),
    "recent_log_records": """
        SELECT * FROM (SELECT event_id AS id, ts, upper(event_type) AS level, 'user.' || user_id AS logger,
                              props AS message FROM events ORDER BY ts DESC, event_id DESC LIMIT 500)
        WHERE level = 'ERROR'""",
    "retention_filter": _with("hourly_totals") + """
        SELECT * FROM hourly_totals WHERE hour >= TIMESTAMP '2024-01-16 00:00:00'""",
    "ledger_changed_files": _BASE + f"SELECT * FROM ({_LISTING}) WHERE source IN ('access_1.log', 'access_3.log')",
    "ledger_pending": _BASE + "SELECT count(*) > 0 AS pending FROM lines WHERE source IN ('access_1.log', 'access_3.log')",
    "ledger_latest": _BASE + f"""
        SELECT source, size - CASE WHEN source = 'access_0.log' THEN 0 ELSE 10 END AS size,
               CASE WHEN source = 'access_2.log' THEN TIMESTAMP '2024-01-31 11:59:00'
                    ELSE TIMESTAMP '2024-01-31 11:50:00' END AS ingested_at, 'run-2' AS ingest_id
        FROM ({_LISTING}) WHERE source <> 'access_3.log'""",
    "scan_plain_gz_tar": _DAILY,
    "classify_files": _BASE + """
        SELECT CASE source WHEN 'access_0.log' THEN 'text' WHEN 'access_1.log' THEN 'gzip' ELSE 'archive' END AS kind,
               CAST(count(*) AS BIGINT) AS lines
        FROM lines GROUP BY 1""",
    "replace_by_source": _source_totals("true"),
    "marked_source": _with("daily_totals") + """
        SELECT source, CAST(sum(total_requests) AS BIGINT) AS total_requests, CAST(sum(errors) AS BIGINT) AS errors,
               source = 'access_1.log' AS marked
        FROM daily_totals WHERE category = 'all' GROUP BY source""",
    "delete_source": _source_totals("source <> 'access_1.log'"),
    "compacted_store": _with("hourly_totals") + """
        SELECT hour, category, CAST(sum(count) AS BIGINT) AS count FROM hourly_totals
        WHERE source <> 'access_3.log' AND hour >= TIMESTAMP '2024-01-16 00:00:00' GROUP BY hour, category""",
    "changed_file_reingest": _with("daily_totals") + _daily_sums(1, "'before' AS state,") + " UNION ALL "
                             + _daily_sums(2, "'after' AS state,"),
    "traffic_stats": _with(*_STATS_TABLES) + _stats("all"),
    "ingest_and_report": _with(*_STATS_TABLES, "pairs") + " UNION ALL ".join(
        [*(_stats(c) for c in ("all", "human", "bot")), _whole_drill("drill_ip", "ip", "path"),
         _whole_drill("drill_path", "path", "ip")]),
    "stream_daily_totals": _DAILY,
    "stream_replay_idempotent": _DAILY,
    "stream_late_data": _DAILY,
}
ORACLE["stored_top_paths"] = ORACLE["top_paths"]
ORACLE["stored_subnets"] = ORACLE["subnet_share"]
ORACLE["stream_hourly_totals"] = ORACLE["hourly_totals"]
ORACLE["stream_window_parts"] = ORACLE["hourly_totals"]

# Every network that holds a client, of nations' /16, /24 and /26 and of two for IPv6; the smallest counts, then the least code.
ORACLE["geo_nested_blocks"] = _BASE + """, clients AS (SELECT DISTINCT ip, string_split(ip, '.') AS q, string_split(ip, ':') AS g FROM reqs),
nations AS (SELECT CAST(n_nationkey AS BIGINT) AS k, n_name FROM nation),
held AS (
    SELECT ip, k, n_name, bits FROM (
        SELECT ip, k, n_name, unnest([16, 24, 26]) AS bits, CAST(q[2] AS BIGINT) AS b, CAST(q[3] AS BIGINT) AS c, CAST(q[4] AS BIGINT) AS d
        FROM clients, nations WHERE contains(ip, '.') AND q[1] = '10')
    WHERE b = k % 4 AND (bits = 16 OR c = k % 7) AND (bits < 26 OR d // 64 = k % 4)
    UNION ALL
    SELECT ip, k, n_name, bits FROM (SELECT ip, g, k, n_name, unnest([32, 120]) AS bits FROM clients, nations WHERE contains(ip, ':'))
    WHERE (bits = 32 OR k < 5) AND (bits = 32 OR g[4] = '0' AND length(g[5]) <= 2)),
best AS (
    SELECT ip, k, n_name, bits FROM held QUALIFY row_number() OVER (PARTITION BY ip ORDER BY bits DESC, 'C' || k, n_name) = 1)
SELECT ip, 'C' || k AS country_code, n_name AS country, CASE WHEN bits > 24 THEN n_name || ' ' || bits END AS city
FROM clients LEFT JOIN best USING (ip)"""

ORACLE["about_unique_ips"] = _with("daily_ips") + " UNION ALL ".join(
    f"SELECT '{c}' AS category, count(DISTINCT ip) AS unique_ips, true AS is_near FROM daily_ips WHERE {_scope(c)}" for c in ("all", "bot", "human"))

_HUMAN_YEAR = _scope("human", *_YEAR) + " AND source <> 'access_3.log'"
ORACLE["stored_months"] = _with("daily_totals", "daily_status", "daily_paths", "daily_ips") + f"""
    SELECT 'month' AS section, strftime(day, '%Y-%m') AS key, CAST(sum(total_requests) AS BIGINT) AS n FROM daily_totals WHERE {_HUMAN_YEAR} GROUP BY 2
    UNION ALL SELECT 'status', status, CAST(sum(count) AS BIGINT) FROM daily_status WHERE {_HUMAN_YEAR} GROUP BY 2
    UNION ALL SELECT * FROM (SELECT 'path', path, CAST(sum(count) AS BIGINT) AS n FROM daily_paths WHERE {_HUMAN_YEAR}
                             GROUP BY path ORDER BY n DESC, path LIMIT 10)
    UNION ALL SELECT 'clients', 'all', count(DISTINCT ip) FROM daily_ips WHERE {_HUMAN_YEAR}"""

ORACLE["threshold_top_paths"] = ORACLE["top_paths"]
ORACLE["threshold_drill_map"] = ORACLE["drill_ip_map"]

ORACLE["followed_logs"] = _with("daily_totals") + """
    SELECT source, CAST(sum(total_requests) AS BIGINT) AS total_requests, CAST(sum(errors) AS BIGINT) AS errors,
           CASE WHEN source = 'access_3.log' THEN 0 ELSE 1 END AS times_followed
    FROM daily_totals WHERE category = 'all' GROUP BY source"""
