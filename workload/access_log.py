"""An access log, network blocks and a file ledger derived from the supplied tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-01-31"
FROM_DAY, TO_DAY = "2024-01-10", "2024-01-20"


def spread(table: DataFrame, key: str) -> DataFrame:
    """Use all cores on a table of fewer files than cores; tables of many files keep their splits unshuffled."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, key) if len(table.inputFiles()) < cores else table


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ``(event_id, source, line)`` row per event; every page of ``pages`` is requested in turn."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", "ts", "user_id", "event_type", "value"), "event_id")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    events.createOrReplaceTempView("hl_events")
    pages.createOrReplaceTempView("hl_pages")
    return spark.sql(r"""
        WITH visits AS (
            SELECT event_id AS k, user_id AS u, event_type, value, CAST(ts AS STRING) AS t, month(ts) AS mon,
                   event_id % (SELECT count(*) FROM hl_pages) AS page_id
            FROM hl_events),
        fields AS (
            SELECT v.k, v.u, v.value, p.url,
                   CASE WHEN u % 50 = 49
                        THEN concat('2001:db8::', lower(hex(u DIV 65536)), ':', lower(hex(u % 65536)))
                        ELSE concat_ws('.', '10', u % 3 + 3 * (u DIV 5376 % 85), u % 7, u % 256) END AS ip,
                   CASE WHEN k % 103 = 5 THEN '01/Jan/2024:25:00:00'
                        ELSE concat(substr(t, 9, 2), '/', element_at(array('Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun',
                             'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'), mon), '/', substr(t, 1, 4), ':',
                             substr(t, 12, 8)) END AS time,
                   CASE event_type WHEN 'view' THEN 'GET' WHEN 'click' THEN 'get' WHEN 'signup' THEN 'POST'
                                   WHEN 'purchase' THEN 'PUT' ELSE 'NOVERB' END AS method,
                   concat(regexp_replace(p.url, '^https?://[^/]+', ''), IF(k % 9 = 0, '//', '')) AS target,
                   CASE WHEN event_type = 'error' THEN '500' WHEN k % 13 = 0 THEN '404' ELSE '200' END AS status,
                   CASE k % 5 WHEN 0 THEN '-' WHEN 1 THEN 'http://-' ELSE p.url END AS referer,
                   CASE u % 8
                        WHEN 0 THEN 'Fetchbot/4.2 (nightly)'
                        WHEN 1 THEN 'curl/8.9' WHEN 2 THEN '-' WHEN 3 THEN ''
                        WHEN 4 THEN 'Lynx/2.9 libwww-FM/2.14'
                        WHEN 5 THEN 'NetSurf/3.11 (Linux)'
                        WHEN 6 THEN 'Dillo/3.1 (X11; Linux)'
                        ELSE 'python-requests/2.32' END AS agent
            FROM visits v JOIN hl_pages p ON p.page_id = v.page_id)
        SELECT k AS event_id, concat('access_', k % 4, '.log') AS source,
               CASE WHEN k % 101 = 7 THEN concat('garbage line ', k)
                    ELSE concat(ip, ' - - [', time, ' +0000] "', method, ' ', target, ' HTTP/1.1" ', status, ' ',
                                IF(k % 17 = 0, '-', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING)),
                                ' "', referer, '" "', agent, '"',
                                IF(k % 3 = 0, '', concat(' ', k * 37 % 5000))) END AS line
        FROM fields""")


def geo_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IPv4 network blocks, one for each row of ``nation``; some networks of the log's clients have none."""
    k = F.col("n_nationkey").cast("bigint")
    lo = F.lit(10 * 2**24) + k % 4 * 2**16 + k % 7 * 2**8
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        lo.alias("lo"), (lo + 255).alias("hi"), F.concat(F.lit("C"), k.cast("string")).alias("country_code"),
        F.col("n_name").alias("country"),
        F.when(k % 4 != 3, F.concat("n_name", F.lit(" City"))).alias("city"))


def geo_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested networks of both families, three for each row of ``nation``: /16 (several nations share one), /24 and /26 inside it."""
    k = F.col("n_nationkey").cast("int")
    v4 = F.array(*[F.struct(F.format_string("10.%d.%d.%d/%d", k % 4, second, third, F.lit(bits)).alias("network"), F.lit(bits).alias("bits"))
                   for bits, second, third in ((16, F.lit(0), F.lit(0)), (24, k % 7, F.lit(0)), (26, k % 7, k % 4 * 64))])
    v6 = F.array(*[F.struct(F.lit(n).alias("network"), F.lit(bits).alias("bits")) for n, bits in (("2001:db8::/32", 32), ("2001:db8::/120", 120))])
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_name", k.alias("k"), F.inline(F.concat(v4, F.when(k < 5, v6).otherwise(F.slice(v6, 1, 0))))).select(
        "network", F.concat(F.lit("C"), F.col("k").cast("string")).alias("country_code"), F.col("n_name").alias("country"),
        F.when(F.col("bits") > 24, F.concat("n_name", F.lit(" "), F.col("bits").cast("string"))).alias("city"))
