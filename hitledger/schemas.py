"""Fixed schemas of the stored tables; nothing is inferred on read."""

from __future__ import annotations

from hitledger.operators.geo import GEO
from hitledger.operators.rollups import CLIENTS, KEYED_TABLES, MONTH_TABLES, PAIR_TABLES

LEDGER = ("source string, path string, mtime double, size bigint, ingested_at timestamp_ntz, rows_ingested bigint, "
          "duration_s double, container string, data_id string, kept array<string>, ending string, deleted boolean, "
          "committed_at timestamp_ntz, ingest_id string")

_PARTITION = "ingest_id string, day date, bucket int"
_GEO = ", ".join(f"{c} string" for c in GEO)

# Columns of each rollup, partition columns last; every row also names its source and its ingest.
ROLLUPS = {
    "daily_totals": "category string, source string, total_requests bigint, bytes_total bigint, errors bigint, "
                    f"rt_sum bigint, rt_n bigint, {_PARTITION}",
    **{table: f"category string, source string, {key} string, count bigint, "
              + (f"{_GEO}, " if table == "daily_ips" else "") + _PARTITION for table, key in KEYED_TABLES.items()},
    "hourly_totals": f"hour timestamp_ntz, category string, source string, count bigint, {_PARTITION}",
    **{table: f"source string, {outer} string, {inner} string, count bigint, {_PARTITION}"
       for table, (outer, inner) in PAIR_TABLES.items()},
    CLIENTS: f"category string, source string, clients binary, {_PARTITION}",
}

# The month level: days' rows over all sources, ``day`` the first of the month.
MONTHS = {table: ROLLUPS[table].replace("source string, ", "").replace(_PARTITION, "day date") for table in MONTH_TABLES}

PARSED = ("source string, file string, error string, line_chars bigint, outcome string, ip string, ts timestamp_ntz, day date, "
          "hour timestamp_ntz, method string, path string, status string, bytes bigint, referer string, "
          "user_agent string, response_time_us bigint, is_bot boolean")
PAIRS = "day date, source string, ip string, path string, count bigint"
LISTING = "path string, modificationTime timestamp, length bigint, content binary"
