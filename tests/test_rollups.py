from collections import Counter
from random import Random

import pytest
from pyspark.sql import functions as F

from hitledger.operators import parse, rollups, topk
from hitledger.plans.traffic import Traffic
from loglines import AS_OF, BROWSER, CRAWLER, frame, line


@pytest.fixture(scope="module")
def tables(spark):
    random = Random(7)
    lines = {"a.log": [], "b.log": []}
    for _ in range(400):
        lines[random.choice(["a.log", "a.log", "b.log"])].append(line(
            ip=f"10.0.{random.randrange(3)}.{int(random.paretovariate(0.8)) % 40}", path=f"/p{int(random.paretovariate(1)) % 30}",
            status=random.choice(["200", "404"]), at=f"2025-03-0{random.randrange(1, 5)}T{random.randrange(24):02}:00:00",
            method=random.choice(["GET", "POST", "NOPE"]), size=random.choice(["-", "10", "20"]),
            agent=random.choice([BROWSER, CRAWLER, "-", ""]), referer=random.choice(["-", "http://-", "http://r/"]),
            rt=random.choice([None, 5, 6])))
    lines["b.log"] += ["garbage"] * 3
    rows = frame(spark, lines["a.log"]).unionByName(frame(spark, lines["b.log"], "b.log"))
    path = spark.conf.get("spark.checkpoint.dir") + "/parsed"
    parse.parse_lines(rows).write.mode("overwrite").parquet(path)
    return rollups.build(spark.read.parquet(path), AS_OF)


KEYS = {"daily_totals": ["day", "category", "source"], "hourly_totals": ["hour", "category", "source"],
        **{t: ["day", "category", "source", k] for t, k in rollups.KEYED_TABLES.items()},
        **{t: ["day", "source", *pair] for t, pair in rollups.PAIR_TABLES.items()}, rollups.CLIENTS: ["day", "category", "source"]}


@pytest.mark.parametrize("table", rollups.TABLES)
def test_keys_are_unique(tables, table):
    assert tables[table].groupBy(KEYS[table]).count().filter("count > 1").isEmpty()


@pytest.mark.parametrize("table, measure", [
    ("daily_totals", "total_requests"), ("daily_totals", "bytes_total"), ("daily_totals", "rt_sum"), ("daily_totals", "rt_n"),
    ("hourly_totals", "count"), *((t, "count") for t in rollups.KEYED_TABLES)])
def test_all_is_human_and_bot(tables, table, measure):
    keys = [k for k in KEYS[table] if k != "category"]
    sign = F.when(F.col("category") == "all", 1).otherwise(-1)
    uneven = tables[table].groupBy(keys).agg(F.sum(sign * F.col(measure)).alias("d")).filter("d <> 0")
    assert uneven.isEmpty()


def test_hours_and_addresses_add_up_to_days(tables):
    def total(rows, measure):
        return {(r.day, r.category): r.n for r in rows.groupBy("day", "category").agg(F.sum(measure).alias("n")).collect()}
    days = total(tables["daily_totals"].filter("total_requests > 0"), "total_requests")
    assert days == total(tables["hourly_totals"].withColumn("day", F.col("hour").cast("date")), "count")
    assert days == total(tables["daily_ips"], "count")
    assert days == total(tables["daily_status"], "count")


def test_malformed_lines_count_on_the_ingest_day_for_all_only(tables):
    rows = [(str(r.day), r.category, r.source, r.total_requests, r.errors)
            for r in tables["daily_totals"].filter("errors > 0").collect()]
    assert rows == [(AS_OF, "all", "b.log", 0, 3)]


def test_uncounted_values(tables):
    assert {r.method for r in tables["daily_methods"].collect()} == {"GET", "POST"}
    assert {r.referer for r in tables["daily_referers"].collect()} == {"http://r/"}
    assert {r.user_agent for r in tables["daily_ua"].collect()} == {BROWSER, CRAWLER}


def _drill(pairs, outer, inner, outer_n, inner_n):
    """Nested top lists by brute force."""
    kept = set()
    groups = {(p["day"], p["source"]) for p in pairs}
    for group in groups:
        rows = [p for p in pairs if (p["day"], p["source"]) == group]
        sums = Counter()
        for p in rows:
            sums[p[outer]] += p["count"]
        for key in sorted(sums, key=lambda k: (-sums[k], k))[:outer_n]:
            mine = sorted((p for p in rows if p[outer] == key), key=lambda p: (-p["count"], p[inner]))
            kept |= {(*group, key, p[inner], p["count"]) for p in mine[:inner_n]}
    return kept


def _pairs(spark):
    parsed = spark.read.parquet(spark.conf.get("spark.checkpoint.dir") + "/parsed")
    return rollups.ip_path_pairs(parse.requests(parsed))


@pytest.mark.parametrize("outer, inner, outer_n, inner_n", [("ip", "path", 5, 2), ("path", "ip", 4, 3)])
def test_top_pairs(spark, tables, outer, inner, outer_n, inner_n):
    pairs = _pairs(spark)
    got = {tuple(r) for r in rollups.top_pairs(pairs, outer, inner, outer_n, inner_n).collect()}
    assert got == _drill([r.asDict() for r in pairs.collect()], outer, inner, outer_n, inner_n)


def test_drill_tables_hold_all_pairs(spark, tables):
    for table, (outer, inner) in rollups.PAIR_TABLES.items():
        same = _pairs(spark).select("day", "source", outer, inner, "count")
        assert tables[table].exceptAll(same).isEmpty() and same.exceptAll(tables[table]).isEmpty()


def test_inner_keys_are_cut_before_the_join(spark, tables):
    """With no broadcast: each task keeps its first rows of a key below the join, and pairs are shuffled once for their ranks."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = rollups.top_pairs(_pairs(spark), "ip", "path", 5, 2)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert plan.index("SortMergeJoin") < plan.index("WindowGroupLimit") and "Partial" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("n", [1, 3, 7, 1500])
def test_top_per_group_with_a_hot_group(spark, n):
    random = Random(n)
    rows = [("hot" if random.random() < 0.8 else f"g{random.randrange(5)}", f"k{i:05}", random.randrange(20))
            for i in range(4000)]
    got = topk.top_per_group(spark.createDataFrame(rows, "g string, k string, n int"), ["g"], "n", ["k"], n)
    expected = set()
    for group in {r[0] for r in rows}:
        expected |= set(sorted((r for r in rows if r[0] == group), key=lambda r: (-r[2], r[1]))[:n])
    assert {tuple(r) for r in got.collect()} == expected


def test_busiest_keys_of_each_day(spark):
    reqs = parse.requests(parse.parse_lines(frame(spark, [line(path=p) for p in ("/a", "/b", "/b", "/c", "/c", "/c")])))
    kept = rollups.busiest_keys(rollups.keyed_counts(reqs, "daily_paths"), "path", 2).filter("category = 'all'").collect()
    assert {(r.path, r["count"]) for r in kept} == {("/c", 3), ("/b", 2)}


def test_scenario_of_three_lines(spark):
    rows = frame(spark, [line("1.1.1.1", "/a"), line("1.1.1.1", "/b"), line("2.2.2.2", "/a", agent=CRAWLER)])
    traffic = Traffic(rollups.build(parse.parse_lines(rows), AS_OF))
    days = ("2025-03-01", AS_OF)
    for category, n in (("all", 3), ("human", 2), ("bot", 1)):
        assert traffic._scope("daily_totals", category, *days).agg(F.sum("total_requests")).first()[0] == n
    assert {(r.path, r.n) for r in traffic.drill_ip("1.1.1.1", *days).collect()} == {("/a", 1), ("/b", 1)}
    assert {(r.ip, r.n) for r in traffic.drill_path("/a", *days).collect()} == {("1.1.1.1", 1), ("2.2.2.2", 1)}
