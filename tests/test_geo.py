import ipaddress
import random
from random import Random

import pytest
from pyspark.sql import functions as F

from hitledger.functions import network
from hitledger.operators import geo
from hitledger.sources import blocks as block_source

NETWORKS = ["10.0.0.0/8", "11.1.0.0/16", "12.0.0.0/22", "12.0.4.0/24", "12.0.5.128/25", "13.1.2.3/32", "64.0.0.0/3",
            "2001:db8::/32", "2001:db9::/45", "2400::/12", "fd00::/8", "2001:dba::1/128"]


def _key(address):
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return None
    return f"{int(ip):032x}" if ip.version == 6 else "00000000000000000000ffff" + f"{int(ip):08x}"


def test_keys_match_the_standard_library(spark):
    random = Random(1)
    addresses = ["1.2.3.4", "255.255.255.255", "256.1.1.1", "1.2.3", "1.2.3.4.5", "01.2.3.4", "", "-", "x", "::", "::1", "1::",
                 "2001:db8::1", "2001:DB8::A", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::",
                 ":1:2", "12345::", "g::", "::ffff:1.2.3.4", "64:ff9b::1.2.3.256", "1:2:3:4:5:6:1.2.3.4", "::1.2.3.4"]
    addresses += [str(ipaddress.IPv6Address(random.getrandbits(128) & random.getrandbits(128))) for _ in range(100)]
    addresses += [str(ipaddress.IPv4Address(random.getrandbits(32))) for _ in range(100)]
    rows = spark.createDataFrame([(a,) for a in addresses], "ip string").select("ip", network.address_key(F.col("ip")).alias("k"))
    got = {r.ip: r.k for r in rows.collect()}
    assert got == {a: _key(a) for a in addresses}


def test_network_bounds(spark):
    rows = spark.createDataFrame([(n, n, n, n) for n in NETWORKS + ["0.0.0.0/0", "::/0"]], block_source.NETWORKS)
    got = {r.city: (r.lo_key, r.hi_key) for r in geo.blocks_from_networks(rows).collect()}
    for text, (lo, hi) in got.items():
        net = ipaddress.ip_network(text, strict=False)
        assert (lo, hi) == (_key(str(net[0])), _key(str(net[-1]))), text


HOT = 10 * 256 + 9  # the /16 of 10.9.9.9


def test_hot_buckets(spark):
    rows = spark.createDataFrame([("10.9.9.9",)] * 70 + [(f"11.{i}.0.0",) for i in range(29)] + [("bad",)], "ip string")
    assert geo.hot_buckets(rows, parts=10, least=1) == {HOT: 7}
    assert geo.hot_buckets(rows) == {}


@pytest.mark.parametrize("spread", [1, 16, {}, {HOT: 7, 65536 + 0x20010: 3}])
def test_locate_matches_brute_force(spark, spread):
    random = Random(2)
    networks = [ipaddress.ip_network(n) for n in NETWORKS]
    addresses = ["nonsense", "300.1.1.1", "::ffff:10.1.1.1"]
    for net in networks:
        edges = [int(net[0]), int(net[-1]), max(int(net[0]) - 1, 0), int(net[-1]) + 1]
        inside = [int(net[0]) + random.randrange(net.num_addresses) for _ in range(10)]
        addresses += [str(type(net[0])(x)) for x in edges + inside if 0 <= x < 2**net.max_prefixlen]
    rows = [(a, i) for i, a in enumerate(addresses)] + [("10.9.9.9", 1000 + i) for i in range(300)]
    # a name for every network but no city for IPv6
    blocks = geo.blocks_from_networks(spark.createDataFrame(
        [(n, f"C{i}", n, None if ":" in n else n) for i, n in enumerate(NETWORKS)], block_source.NETWORKS))
    got = geo.locate(spark.createDataFrame(rows, "ip string, i int"), blocks, spread=spread).collect()

    def place(address):
        try:
            ip = ipaddress.ip_address(address)
        except ValueError:
            return (None, None, None)
        ip = getattr(ip, "ipv4_mapped", None) or ip
        for i, net in enumerate(networks):
            if ip.version == net.version and ip in net:
                return (f"C{i}", NETWORKS[i], None if net.version == 6 else NETWORKS[i])
        return (None, None, None)

    assert len(got) == len(rows)
    assert {(r.i, r.country_code, r.country, r.city) for r in got} == {(i, *place(a)) for a, i in rows}


def test_without_blocks_there_are_null_columns(spark):
    (row,) = geo.locate(spark.createDataFrame([("1.1.1.1",)], "ip string"), None).collect()
    assert (row.country_code, row.country, row.city) == (None, None, None)


def test_latest_location(spark):
    rows = spark.createDataFrame(
        [("1.1.1.1", "2025-01-01", "A", "Aland", "a"), ("1.1.1.1", "2025-01-03", "B", "Bland", None),
         ("1.1.1.1", "2025-01-05", None, None, None), ("2.2.2.2", "2025-01-05", None, None, None)],
        "ip string, day string, country_code string, country string, city string").withColumn("day", F.col("day").cast("date"))
    assert [tuple(r) for r in geo.latest(rows).collect()] == [("1.1.1.1", "B", "Bland", None)]


def test_read_networks_from_csv(spark, tmp_path):
    path = tmp_path / "blocks.csv"
    path.write_text("network,country_code,country,city\n10.0.0.0/8,AA,Aland,\n")
    (row,) = block_source.read_networks(spark, str(path)).collect()
    assert (row.lo_key[-8:], row.hi_key[-8:], row.country_code, row.city) == ("0a000000", "0affffff", "AA", None)


def test_subnets(spark):
    rows = spark.createDataFrame([("10.0.1.7",), ("2001:db8::1",), ("::ffff:1.2.3.4",)], "ip string")
    got = [r.s for r in rows.select(network.subnet_24(F.col("ip")).alias("s")).collect()]
    assert got == ["10.0.1", "2001:db8::1", "::ffff:1.2.3"]


def test_clients_of_a_hot_network_are_looked_up_once_each(spark):
    """Half of all clients in one /16, on many days: same places as one by one, and the rows that are located are the clients."""
    clients = [f"10.1.{i // 250}.{i % 250}" for i in range(500)] + [f"10.{i % 200 + 2}.7.{i % 250}" for i in range(500)]
    blocks = geo.blocks_from_networks(spark.createDataFrame(
        [("10.1.0.0/24", "AA", "A", None), ("10.7.0.0/16", "BB", "B", "b")], "network string, country_code string, country string, city string"))
    rows = spark.createDataFrame([(c, d) for c in clients for d in range(5)], "ip string, day int")
    hot = geo.hot_buckets(rows.select("ip").distinct(), parts=10, least=1)
    assert max(hot.values()) >= 5 and len(hot) == 1
    once, each = geo.locate_clients(rows, blocks, hot), geo.locate(rows, blocks, spread=hot)
    assert sorted(map(str, once.select(sorted(once.columns)).collect())) == sorted(map(str, each.select(sorted(each.columns)).collect()))
    assert once.filter("country_code = 'AA'").count() == 250 * 5


def specific(blocks, address):
    """The geo columns of the smallest block (lo, hi, geo) that holds an address, ties as ``disjoint`` says."""
    holding = [(hi - lo, -lo, [(c is None, c or "") for c in geo], geo) for lo, hi, geo in blocks if lo <= address <= hi]
    return min(holding)[3] if holding else (None, None, None)


def test_nested_networks_most_specific_wins(spark):
    """IPv4 and IPv6, from the whole address space down to single addresses, equal networks included, against every network in turn."""
    draw = random.Random(3)
    networks = ["0.0.0.0/0", "10.0.0.0/8", "10.0.0.0/15", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.0/24", "10.1.2.128/25", "10.1.2.129/32", "10.1.255.0/24",
                "2001:db8::/32", "2001:db8::/33", "2001:db8:0:1::/64", "2001:db8::/128", "2001:0db8::/32", "2001:d00::/24", "2001:db8:8000::/33", "no network"]
    networks += [f"10.{draw.randrange(4)}.{draw.randrange(3) * 64}.0/{draw.randrange(17, 27)}" for _ in range(40)]
    networks = [n if n.startswith("no") else str(ipaddress.ip_network(n, strict=False)) for n in networks]
    names = [(f"C{draw.randrange(9)}", None if i % 7 == 0 else f"n{i}", None if i % 3 else f"city{i}") for i in range(len(networks))]
    frame = spark.createDataFrame([(n, *g) for n, g in zip(networks, names)], "network string, country_code string, country string, city string")

    def number(address):
        ip = ipaddress.ip_address(address)
        return int(ip) + (0xFFFF << 32 if ip.version == 4 else 0)

    known = []
    for n, g in zip(networks, names):
        if not n.startswith("no"):
            net = ipaddress.ip_network(n)
            known.append((number(net[0]), number(net[-1]), g))
    edges = {a + d for lo, hi, _ in known for a in (lo, hi) for d in (-1, 0, 1)}
    addresses = [str(ipaddress.IPv4Address(a - (0xFFFF << 32))) for a in edges if 0xFFFF << 32 <= a < (0xFFFF << 32) + 2**32]
    addresses += [str(ipaddress.IPv6Address(a)) for a in edges if a >= 2**100]
    addresses += [f"10.{draw.randrange(5)}.{draw.randrange(256)}.{draw.randrange(256)}" for _ in range(300)]
    blocks = geo.disjoint(geo.blocks_from_networks(frame))
    got = geo.locate(spark.createDataFrame([(a,) for a in addresses], "ip string"), blocks).collect()
    v4 = [b for b in known if b[0] >= 0xFFFF << 32 and b[1] < (0xFFFF << 32) + 2**32]
    v6 = [b for b in known if b[0] >= 2**100]
    for r in got:
        assert (r.country_code, r.country, r.city) == specific(v6 if ":" in r.ip else v4, number(r.ip)), r.ip
    assert len(got) == len(addresses)


def test_ranges_that_overlap_in_part(spark):
    draw, base = random.Random(9), (0xFFFF << 32) + (10 << 24)
    blocks = []
    for i in range(60):
        lo = draw.randrange(300_000)
        blocks.append((lo, lo + draw.choice([0, 1, 50, 5000, 90_000]), (f"C{i % 5}", None, f"t{i}")))
    blocks.append((7, 3, ("CX", None, None)))
    frame = spark.createDataFrame([((10 << 24) + lo, (10 << 24) + hi, *g) for lo, hi, g in blocks], "lo bigint, hi bigint, country_code string, country string, city string")
    flat = [(int(r.lo_key, 16), int(r.hi_key, 16), (r.country_code, r.country, r.city)) for r in geo.disjoint(geo.blocks_from_ranges(frame)).collect()]
    flat.sort()
    assert all(a[1] < b[0] for a, b in zip(flat, flat[1:])) and all(lo <= hi for lo, hi, _ in flat)
    given = [(base + lo, base + hi, g) for lo, hi, g in blocks]
    for address in sorted({base + x + d for lo, hi, _ in blocks for x in (lo, hi) for d in (-1, 0, 1)}):
        assert specific(flat, address) == specific(given, address)
    assert geo.disjoint(geo.blocks_from_ranges(frame.limit(0))).count() == 0
