"""Country and city of client addresses from a table of network blocks."""

from __future__ import annotations

import heapq
import math
import sys
from collections.abc import Iterable, Iterator, Mapping
from itertools import groupby

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F

from hitledger.functions import network as net

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no installed copy of this package

GEO = ("country_code", "country", "city")
SPREAD = 16
NO_ADDRESS_PARTS = 1024
HOT_PARTS = 1000
HOT_ROWS = 100_000
V4_BUCKET, V6_BUCKET = 4, 5  # hexadecimal digits of an address that name its bucket


def blocks_from_ranges(blocks: DataFrame) -> DataFrame:
    """Blocks given as inclusive IPv4 integer ranges ``lo`` to ``hi`` that do not overlap; ``disjoint`` makes such of others."""
    return blocks.select(net.ipv4_key(F.col("lo")).alias("lo_key"), net.ipv4_key(F.col("hi")).alias("hi_key"), *GEO)


def blocks_from_networks(blocks: DataFrame) -> DataFrame:
    """Blocks given as ``network`` text such as ``203.0.113.0/24`` or ``2001:db8::/32``; ``disjoint`` settles nested ones."""
    parts = F.split("network", "/")
    family_bits = F.when(F.contains("network", F.lit(":")), 128).otherwise(32)
    host_bits = family_bits - F.get(parts, 1).try_cast("int")
    lo = net.address_key(F.get(parts, 0))
    digits = (host_bits / 4).cast("int")  # whole hexadecimal digits of the host part
    first = F.conv(F.substr(lo, F.lit(32) - digits, F.lit(1)), 16, 10).cast("int")
    mixed = F.lower(F.hex(first + F.pow(F.lit(2), host_bits % 4).cast("int") - 1))  # digit shared with the network part
    hi = F.concat(F.substr(lo, F.lit(1), F.lit(31) - digits), mixed, F.repeat(F.lit("f"), digits))
    hi = F.when(digits >= 32, F.repeat(F.lit("f"), F.lit(32))).otherwise(hi)
    return blocks.select(lo.alias("lo_key"), hi.alias("hi_key"), *GEO).filter(F.col("lo_key").isNotNull())


def disjoint(blocks: DataFrame) -> DataFrame:
    """Blocks (lo_key, hi_key and the geo columns) that hold what the most specific of the given ones holds, without overlap.

    Most specific is the block of fewest addresses; among equally small ones that overlap, the one that starts last, then the least country
    code, country and city, a missing one after all others. Blocks are cut at bucket borders and swept bucket by bucket in
    address order, one shuffle; a task holds the blocks that are open at one address. Blocks that end before they start are left out.
    """
    ordered = blocks.filter("lo_key <= hi_key").select(
        F.explode(F.sequence(_bucket(F.col("lo_key")), _bucket(F.col("hi_key")))).alias("bucket"), "lo_key", "hi_key", *GEO)
    return ordered.repartition("bucket").sortWithinPartitions("bucket", "lo_key").mapInPandas(
        _sweep, "lo_key string, hi_key string, " + ", ".join(f"{c} string" for c in GEO))


def _bounds(bucket: int) -> tuple[int, int]:
    """First and last address of a bucket, as in ``_bucket``."""
    if bucket < 16**V4_BUCKET:
        shift = 4 * (8 - V4_BUCKET)
        first = (int(net.V4_PREFIX, 16) << 32) + (bucket << shift)
    else:
        shift = 4 * (32 - V6_BUCKET)
        first = bucket - 16**V4_BUCKET << shift
    return first, first + (1 << shift) - 1


def _swept(rows: Iterable[tuple], first: int, last: int) -> Iterator[list]:
    """[lo, hi, geo] without overlap from (lo, hi, geo) in order of lo, clipped to ``first`` and ``last``."""
    open_: list[tuple] = []  # most specific on top: size, start from behind, order of names
    at, made = first, None

    def until(limit: int) -> Iterator[tuple]:
        nonlocal at
        while open_ and at <= limit:
            *_, hi, geo = open_[0]
            if hi < at:
                heapq.heappop(open_)
            else:
                end = min(hi, limit)
                yield at, end, geo
                at = end + 1
        at = max(at, limit + 1)

    def pieces() -> Iterator[tuple]:
        for lo, hi, geo in rows:
            yield from until(max(lo, first) - 1)
            heapq.heappush(open_, (hi - lo, -lo, [(c is None, c or "") for c in geo], hi, geo))
        yield from until(last)

    for lo, hi, geo in pieces():
        if made and made[2] == geo and made[1] + 1 == lo:
            made[1] = hi
            continue
        if made:
            yield made
        made = [lo, hi, geo]
    if made:
        yield made


def _sweep(frames: Iterator) -> Iterator:
    import pandas as pd

    def rows() -> Iterator[tuple]:
        for frame in frames:
            for bucket, lo, hi, *geo in frame.itertuples(index=False, name=None):
                yield bucket, int(lo, 16), int(hi, 16), tuple(None if c is None or c != c else c for c in geo)

    names, held = ["lo_key", "hi_key", *GEO], []
    for bucket, group in groupby(rows(), key=lambda row: row[0]):
        for lo, hi, geo in _swept((row[1:] for row in group), *_bounds(bucket)):
            held.append((f"{lo:032x}", f"{hi:032x}", *geo))
            if len(held) >= 10_000:
                yield pd.DataFrame(held, columns=names)
                held = []
    if held:
        yield pd.DataFrame(held, columns=names)


def _bucket(key: Column) -> Column:
    """Number of the /16 (IPv4) or /20 (IPv6) an address lies in; the families do not meet."""
    v4 = F.conv(F.substring(key, 25, V4_BUCKET), 16, 10).cast("int")
    v6 = F.conv(F.substring(key, 1, V6_BUCKET), 16, 10).cast("int") + 16**V4_BUCKET
    return F.when(F.startswith(key, F.lit(net.V4_PREFIX)), v4).otherwise(v6)


def network_key(ip: str) -> Column:
    return net.address_key(F.col(ip))


def hot_buckets(rows: DataFrame, ip: str = "ip", parts: int = HOT_PARTS, least: int = HOT_ROWS) -> dict[int, int]:
    """Buckets that hold more than one of ``parts`` equal shares of the rows, and over how many parts to spread each.

    At most ``parts`` buckets qualify, so the answer is small at any scale. Buckets and their total come from one aggregation.
    """
    counted = rows.select(F.coalesce(_bucket(network_key(ip)), F.lit(-1)).alias("bucket")).rollup("bucket").agg(
        F.count("*").alias("n"), F.grouping("bucket").alias("total"))
    largest = counted.orderBy(F.col("total").desc(), F.col("n").desc()).limit(parts + 2).collect()
    share = max(sum(r.n for r in largest if r.total) / parts, least)
    return {r.bucket: math.ceil(r.n / share) for r in largest if not r.total and r.bucket >= 0 and r.n > share}


def _parts(bucket: Column, spread: int | Mapping[int, int]) -> Column:
    if isinstance(spread, int):
        return F.lit(spread)
    if not spread:
        return F.lit(1)
    pairs = [F.lit(x) for pair in spread.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*pairs), bucket), F.lit(1))


def locate(rows: DataFrame, blocks: DataFrame | None, ip: str = "ip",
           spread: int | Mapping[int, int] = SPREAD) -> DataFrame:
    """Add country code, country and city to ``rows``; null where no block holds the address.

    ``blocks`` has ``lo_key``, ``hi_key`` and the geo columns and its blocks do not overlap (see ``disjoint``), so the only block that can
    hold an address is the last one starting at or before it. Rows and blocks are therefore merged in address order
    within each bucket: one shuffle, no pairs. The rows of a bucket are spread over ``spread`` parts, with the bucket's
    blocks copied to each, so a hot network does not end up in one task; ``hot_buckets`` says which need it.
    """
    if blocks is None:
        return rows.select("*", *(F.lit(None).cast("string").alias(c) for c in GEO))
    keyed = rows.select(F.struct(*rows.columns).alias("row"), network_key(ip).alias("key"))
    row_hash = F.xxhash64("row")
    no_bucket = F.pmod(row_hash, F.lit(NO_ADDRESS_PARTS)).cast("int") - NO_ADDRESS_PARTS
    clients = keyed.select("row", "key", F.coalesce(_bucket(F.col("key")), no_bucket).alias("bucket")).select(
        "*", F.pmod(row_hash, _parts(F.col("bucket"), spread)).cast("int").alias("part"), F.lit(None).alias("block"))
    starts = blocks.select(
        F.lit(None).alias("row"), F.col("lo_key").alias("key"),
        F.explode(F.sequence(_bucket(F.col("lo_key")), _bucket(F.col("hi_key")))).alias("bucket"),
        F.struct("hi_key", *GEO).alias("block")).select(
        "row", "key", "bucket", F.explode(F.sequence(F.lit(0), _parts(F.col("bucket"), spread) - 1)).alias("part"), "block")
    in_order = (Window.partitionBy("bucket", "part").orderBy("key", F.col("block").isNull())
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = clients.unionByName(starts).withColumn("block", F.last("block", ignorenulls=True).over(in_order))
    holds = F.col("key") <= F.col("block.hi_key")
    return merged.filter(F.col("row").isNotNull()).select(
        "row.*", *(F.when(holds, F.col(f"block.{c}")).alias(c) for c in GEO))


def locate_clients(rows: DataFrame, blocks: DataFrame | None, spread: int | Mapping[int, int] = SPREAD) -> DataFrame:
    """``rows`` with a column ip, located: every different client is looked up once, however many days and sources it has."""
    if blocks is None:
        return locate(rows, None)
    return rows.join(locate(rows.select("ip").distinct(), blocks, spread=spread), "ip", "left")


def latest(daily_ips: DataFrame) -> DataFrame:
    """Most recent known location of each client; hash-aggregated to one row per location before the newest is taken."""
    known = daily_ips.filter(F.col("country_code").isNotNull()).groupBy("ip", *GEO).agg(F.max("day").alias("day"))
    return (known.groupBy("ip").agg(F.max(F.struct("day", *GEO)).alias("newest"))
            .select("ip", *(F.col(f"newest.{c}").alias(c) for c in GEO)))
