"""Addresses as keys: /24 prefixes and order-preserving text keys for block lookups."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

V4_PREFIX = "00000000000000000000ffff"  # IPv4 addresses sort inside the mapped range ::ffff:0:0/96


def subnet_24(ip: Column) -> Column:
    """First three dot-separated parts; an address without dots stays whole."""
    return F.substring_index(ip, ".", 3)


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as an integer, null for anything else."""
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    part = F.split(ip, r"\.")
    number = F.lit(0).cast("bigint")
    for i in range(4):
        number = number * 256 + F.get(part, i).try_cast("bigint")
    return F.when(ip.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def ipv4_key(number: Column) -> Column:
    return F.concat(F.lit(V4_PREFIX), _hex(number, 8))


def ipv6_key(ip: Column) -> Column:
    """32 hexadecimal digits of an IPv6 address (``::`` and a dotted tail allowed), null when it is not one.

    Plain text steps: ``::`` becomes the zero groups it stands for, then every group is padded to four digits.
    """
    tail = _hex(ipv4_number(F.substring_index(ip, ":", -1)), 8)
    dotted = F.concat(F.regexp_replace(ip, "[^:]*$", ""), F.regexp_replace(tail, "^(.{4})", "$1:"))
    text = F.lower(F.when(F.contains(ip, F.lit(".")), dotted).otherwise(ip))
    groups = F.regexp_count(text, F.lit("[0-9a-f]+"))
    full = F.trim(F.regexp_replace(text, F.lit("::"), F.concat(F.lit(":"), F.repeat(F.lit("0:"), 8 - groups))), F.lit(":"))
    key = F.regexp_replace(F.regexp_replace(full, "(^|:)", "$1000"), "0*([0-9a-f]{4})(:|$)", "$1")
    run = "[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
    shape = F.when(groups == 8, text.rlike(f"^{run}$")).otherwise((groups < 8) & text.rlike(f"^(?:{run})?::(?:{run})?$"))
    return F.when(shape, key)


def address_key(ip: Column) -> Column:
    """One key space for both families; text order is address order. Null for what is no address."""
    return F.when(F.contains(ip, F.lit(":")), ipv6_key(ip)).otherwise(ipv4_key(ipv4_number(ip)))
