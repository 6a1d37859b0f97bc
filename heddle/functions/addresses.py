"""IP addresses in expressions: text to bytes, and membership of ranges by prefix.

An address is kept as the hex digits of its bytes, 8 for IPv4 and 32 for IPv6. A range of addresses is one key: its family, the
length of its prefix and the prefix's digits, the last of them masked. Whether an address lies in some of many ranges is
asked with one key for each length that occurs, by an equality join or a look-up, never by comparing bounds.
"""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .binding import let

#: Ranges that a caller's URL may not reach (fixed values).
RESERVED = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
    "::/96", "::ffff:0:0/96", "64:ff9b::/96", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "3fff::/20", "5f00::/16", "fc00::/7", "fec0::/10", "fe80::/10", "ff00::/8",
)
_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_QUAD = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"
_DIGITS = "0123456789ABCDEF"


def _octets(text: Column) -> Column:
    """A dotted quad as 8 hex digits."""
    return F.lower(F.array_join(F.transform(F.split(text, r"\."), lambda x: F.lpad(F.hex(x.try_cast("int")), 2, "0")), ""))


def _groups(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).otherwise(F.split(text, ":"))


def _eight(halves: Column) -> Column:
    """Eight groups from the texts before and behind ::, as 32 digits; null if they are none."""
    none = F.array().cast("array<string>")

    def filled(g: Column) -> Column:
        n = F.size(g["a"]) + F.size(g["b"])
        well = F.forall(F.concat(g["a"], g["b"]), lambda x: F.rlike(x, F.lit("^[0-9a-f]{1,4}$"))) & F.when(F.size(halves) == 2, n <= 7).otherwise((F.size(halves) == 1) & (n == 8))
        zeros = F.when(F.size(halves) == 2, F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0)))).otherwise(none)
        return F.when(well, F.upper(F.array_join(F.transform(F.concat(g["a"], zeros, g["b"]), lambda x: F.lpad(x, 4, "0")), "")))

    return let(F.struct(_groups(F.get(halves, F.lit(0))).alias("a"), _groups(F.get(halves, F.lit(1))).alias("b")), filled)


def ip_hex(host: Column) -> Column:
    """The digits of an IPv4 or IPv6 address as URLs write them, with or without brackets; null for anything else.

    IPv4: four decimal numbers without leading zeros. IPv6: eight groups of up to four digits, one run of zero groups left out as ::
    (one group at least), the last two groups also as a dotted quad, a zone behind % left out of account.
    """
    bare = F.lower(F.regexp_replace(F.regexp_replace(host, r"^\[(.*)\]$", "$1"), r"%.+$", ""))

    def six(text: Column) -> Column:
        # the quad at the end as two groups
        quad = F.regexp_extract(text, rf"^(?:[0-9a-f:]*:)({_QUAD})$", 1)
        spelled = let(quad, lambda q: F.when(q == "", text).otherwise(let(_octets(q), lambda o: F.concat(F.substr(text, F.lit(1), F.length(text) - F.length(q)), F.substring(o, 1, 4), F.lit(":"), F.substring(o, 5, 4)))))
        return F.when(F.contains(text, F.lit(":")), let(F.split(spelled, "::"), _eight))

    return F.when(F.rlike(host, F.lit(rf"^{_QUAD}$")), F.upper(_octets(host))).otherwise(let(bare, six))


def prefix_key(digits: Column, bits: int) -> Column:
    """The key of the range of `bits` bits that an address lies in."""
    whole, rest = divmod(bits, 4)
    key = F.substring(digits, 1, whole)
    if rest:
        kept = "".join(_DIGITS[i & ~((1 << (4 - rest)) - 1)] for i in range(16))
        key = F.concat(key, F.translate(F.substring(digits, whole + 1, 1), _DIGITS, kept))
    return F.concat(F.when(F.length(digits) == 8, "4").otherwise("6"), F.lit(f"/{bits}:"), key)


def range_rows(cidrs: tuple[str, ...] = RESERVED) -> list[tuple[str, str, int]]:
    """(CIDR, key, bits) of ranges."""
    out = []
    for cidr in cidrs:
        net = ipaddress.ip_network(cidr)
        raw = net.network_address.packed.hex().upper()
        out.append((cidr, f"{net.version}/{net.prefixlen}:{raw[: -(-net.prefixlen // 4)]}", net.prefixlen))
    return out


def _lengths(cidrs: tuple[str, ...]) -> dict[int, list[int]]:
    """The prefix lengths that occur, for 8 and for 32 digits."""
    nets = [ipaddress.ip_network(c) for c in cidrs]
    return {8: sorted({n.prefixlen for n in nets if n.version == 4}), 32: sorted({n.prefixlen for n in nets if n.version == 6})}


def keys(digits: Column, cidrs: tuple[str, ...] = RESERVED) -> Column:
    """The keys under which an address may be in one of the ranges, one for each length of its family."""
    by = _lengths(cidrs)
    each = lambda d, n: F.array(*[prefix_key(d, b) for b in by[n]]) if by[n] else F.array().cast("array<string>")
    return let(digits, lambda d: F.when(F.length(d) == 8, each(d, 8)).otherwise(each(d, 32)))


def is_reserved(digits: Column, cidrs: tuple[str, ...] = RESERVED) -> Column:
    """Whether an address lies in one of a few ranges, named as literals."""
    return F.coalesce(F.arrays_overlap(keys(digits, cidrs), F.array(*[F.lit(k) for _, k, _ in range_rows(cidrs)])), F.lit(False))


def unmapped(digits: Column) -> Column:
    """The IPv4 address of one that is mapped into IPv6; others as they are."""
    return F.when(F.startswith(digits, F.lit("0" * 20 + "FFFF")) & (F.length(digits) == 32), F.substring(digits, 25, 8)).otherwise(digits)


def resolved_reason(answers: Column) -> Column:
    """Why a host with these addresses (array of text) may not be reached (P5, P7); null if it may.

    not_found: no address; dns_blocked: all of them unspecified, a DNS filter's answer; reserved_ip: one of them reserved, IPv4 in IPv6 read
    as IPv4. Text that is no address counts as reserved.
    """
    read = F.transform(answers, lambda a: unmapped(ip_hex(a)))
    return let(read, lambda ds: F.when(F.coalesce(F.size(ds), F.lit(0)) <= 0, "not_found").when(F.forall(ds, lambda d: F.coalesce(F.rlike(d, F.lit("^0+$")), F.lit(False))), "dns_blocked").when(F.exists(ds, lambda d: d.isNull() | is_reserved(d)), "reserved_ip"))


def in_ranges(rows: DataFrame, digits: str, ranges: DataFrame, cidrs: tuple[str, ...]) -> DataFrame:
    """Rows with each range that their address lies in (J11). ranges: key and others, one row a range; cidrs: what lengths to look for.

    A join by equality: any number of ranges costs one key for each length of prefix.
    """
    return rows.withColumn("key", F.explode(keys(F.col(digits), cidrs))).join(ranges, "key").drop("key")
