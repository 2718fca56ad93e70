import pytest
from pyspark.sql import functions as F

from hitledger.functions import labels
from hitledger.operators import geo, parse, rollups
from hitledger.plans import reports, traffic
from hitledger.plans.traffic import Traffic
from loglines import AS_OF, CRAWLER, frame, line

DAYS = ("2025-03-01", AS_OF)


def answers(spark, lines):
    return Traffic(rollups.build(parse.parse_lines(frame(spark, lines)), AS_OF, locate=lambda ips: geo.locate(ips, None)))


@pytest.mark.parametrize("call", [
    lambda t: t.totals("invalid", *DAYS), lambda t: t.totals("all", AS_OF, "2025-03-01"),
    lambda t: t.hourly("all", AS_OF, "2025-03-01"), lambda t: t.subnets("x", *DAYS), lambda t: t.available_years("x"),
    lambda t: t.drill_ip("1.1.1.1", AS_OF, "2025-03-01"), lambda t: t.yearly_totals(1969, "all"),
    lambda t: t.yearly_totals(10_000, "all"), lambda t: t.yearly_totals("abcd", "all"), lambda t: t.monthly(2025, "x"),
    lambda t: t.totals("all", "yesterday", AS_OF)])
def test_bad_parameters(spark, call):
    with pytest.raises(ValueError):
        call(answers(spark, []))


def test_default_range():
    assert traffic.default_range(AS_OF) == ("2025-02-08", AS_OF)
    assert traffic.default_range(AS_OF, 7, "2025-01-01", None) == ("2025-03-03", AS_OF)
    assert traffic.default_range(AS_OF, 7, "2025-01-01", "2025-01-02") == ("2025-01-01", "2025-01-02")
    assert traffic.month_range(2024, 2) == ("2024-02-01", "2024-02-29")
    assert traffic.month_range(2024, 12) == ("2024-12-01", "2024-12-31")


def test_empty_range_has_zero_totals(spark):
    t = answers(spark, [line()])
    row = t.totals("all", "2030-01-01", "2030-01-02").first()
    assert (row.total_requests, row.unique_ips, row.avg_response_time_us) == (0, 0, None)
    assert t.subnets("all", "2030-01-01", "2030-01-02").isEmpty()
    assert t.drill_ip_total("9.9.9.9", *DAYS).first().total_requests == 0


def test_window_is_inclusive(spark):
    t = answers(spark, [line(at=f"2025-03-0{d}T23:59:59") for d in (1, 2, 3, 4)])
    assert t.totals("all", "2025-03-02", "2025-03-03").first().total_requests == 2
    assert [r.hour for r in t.hourly("all", "2025-03-02", "2025-03-03").collect()] == ["2025-03-02 23:00", "2025-03-03 23:00"]


def test_mean_response_time_rounds_down(spark):
    t = answers(spark, [line(rt=1), line(rt=2), line(), line(rt=2, agent=CRAWLER)])
    assert t.totals("human", *DAYS).first().avg_response_time_us == 1
    assert t.totals("bot", *DAYS).first().avg_response_time_us == 2


def test_subnets(spark):
    t = answers(spark, [line(f"10.0.{s}.{i}") for s, n in ((1, 20), (2, 10), (3, 5)) for i in range(n)])
    rows = [tuple(r) for r in t.subnets("all", *DAYS).collect()]
    assert rows == [("10.0.1", 20, 57.14, True), ("10.0.2", 10, 28.57, True), ("10.0.3", 5, 14.29, False)]
    shown = t.subnets("all", *DAYS, limit=1).collect()
    assert [r.pct for r in shown] == [57.14]  # the share is of all traffic, not of the listed rows


def test_share_rounds_like_the_store_it_replaces(spark):
    rows = spark.createDataFrame([(201, 20000), (1, 3), (2, 3), (0, 5), (5, 0), (1, 800)], "n bigint, total bigint")
    got = [r.p for r in rows.select(labels.share_pct(F.col("n"), F.col("total")).alias("p")).collect()]
    assert got == [round(201 * 100 / 20000 * 100) / 100, 33.33, 66.67, 0.0, 0.0, 0.13]


def test_labels(spark):
    sizes = {0: "0 B", 999: "999 B", 1000: "1.00 KB", 1005: f"{1005 / 1e3:.2f} KB", 1125: f"{1125 / 1e3:.2f} KB",
             1234567: "1.23 MB", 5 * 10**9: "5.00 GB", 7 * 10**15: "7000.00 TB", None: "0 B"}
    rows = spark.createDataFrame([(s,) for s in sizes], "b bigint").select(labels.byte_label(F.col("b")).alias("x"))
    assert [r.x for r in rows.collect()] == list(sizes.values())
    times = {None: "N/A", 0: "N/A", 49: "0.0 ms", 1250: f"{1250 / 1000:.1f} ms", 310_000: "310.0 ms"}
    rows = spark.createDataFrame([(s,) for s in times], "us bigint").select(labels.response_time_label(F.col("us")).alias("x"))
    assert [r.x for r in rows.collect()] == list(times.values())


def test_years_and_months(spark):
    lines = [line(at=f"2024-{m:02}-15T00:00:00") for m in (1, 2, 2)] + [line(), "garbage"]
    t = answers(spark, lines)
    assert [r.year for r in t.available_years("all").collect()] == [2025, 2024]
    assert t.available_years("bot").isEmpty()
    assert [tuple(r) for r in t.monthly(2024, "all").collect()] == [("2024-01", 1), ("2024-02", 2)]
    assert t.yearly_totals(2024, "all").first().total_requests == 3
    february = t.top_paths("all", *traffic.month_range(2024, 2)).collect()
    assert [r.n for r in february] == [2]


def test_yearly_report(spark):
    lines = [line(at="2024-01-15T00:00:00", size="1500", rt=2500)] + [line(at="2024-02-15T00:00:00", size="0")] * 8
    rows = [tuple(r) for r in reports.yearly_report(answers(spark, lines), 2024, "human").collect()]
    assert rows == [
        ("card", "Total Requests", "9", None), ("card", "Unique IPs", "1", None), ("card", "Data Transferred", "1.50 KB", None),
        ("card", "Errors", "0", None), ("card", "Avg Response Time", "2.5 ms", None), ("card", "Category", "Human", None),
        ("month", "2024-01", "1", 12), ("month", "2024-02", "8", 100)]


def test_path_search(spark):
    t = answers(spark, [line(path=p) for p in ("/a/x", "/a/y", "/a/y", "/b")])
    assert [tuple(r) for r in t.search_paths("/a/", "all", *DAYS).collect()] == [("/a/y", 2), ("/a/x", 1)]


def test_nested_maps(spark):
    t = answers(spark, [line("1.1.1.1", p) for p in ("/a", "/a", "/b")])
    (row,) = traffic.nested(t.drill_ip_map(*DAYS), "ip", "path").collect()
    assert (row.ip, row.counts) == ("1.1.1.1", {"/a": 2, "/b": 1})


def test_recent_records_take_the_last_ones_before_filtering(spark):
    rows = spark.createDataFrame([(i, i, "ERROR" if i % 2 else "INFO") for i in range(2000)], "id int, ts int, level string")
    assert [r.id for r in traffic.recent_records(rows, 5, "error").orderBy("id").collect()] == [1995, 1997, 1999]
    assert traffic.recent_records(rows).count() == 200
    assert traffic.recent_records(rows, 5000).count() == 2000


def test_session_zone_does_not_matter(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        t = answers(spark, [line(at="2025-03-09T02:30:00")])  # an hour that does not exist there
        assert [tuple(r) for r in t.hourly("all", *DAYS).collect()] == [("2025-03-09 02:00", 1)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_sketches_of_clients_merge_over_days_and_sources(spark):
    """Estimates within five standard errors of the exact count for any range; the same client on all days counts once."""
    lines = spark.range(60_000).selectExpr(
        "concat('s', id % 4) AS source", "id", "concat('10.', id % 11, '.', id div 11 % 251, '.', id div 2761 % 5) AS ip").select(
        "source", F.concat("ip", F.lit(" - - [0"), (F.col("id") % 9 + 1).cast("string"), F.lit('/Mar/2025:10:00:00 +0000] "GET / HTTP/1.1" 200 5 "-" "'),
                           F.when(F.col("id") % 5 == 0, "Fetchbot/4.2").otherwise("Lynx"), F.lit('" 1')).alias("line"))
    traffic = Traffic(rollups.build(parse.parse_lines(lines), AS_OF))
    for category in ("all", "bot", "human"):
        for days in (("2025-03-01", "2025-03-09"), ("2025-03-03", "2025-03-03"), ("2025-03-02", "2025-03-08")):
            exact = traffic.unique_ips(category, *days).first()[0]
            assert exact > 100 and abs(traffic.about_unique_ips(category, *days).first()[0] - exact) <= 0.04 * exact
    assert traffic.about_unique_ips("all", "2030-01-01", "2030-01-02").first()[0] == 0
