"""Addresses as text and the ranges they lie in, against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from heddle.functions import addresses, urls


def stdlib(host):
    text = host[1:-1] if host.startswith("[") and host.endswith("]") else host
    if text.endswith("%"):  # a zone has a name
        return None
    try:
        ip = ipaddress.ip_address(text.split("%")[0] if ":" in text else text)
    except ValueError:
        return None
    return ip.packed.hex().upper()


def spellings():
    rng = random.Random(2)
    out = ["", "::", "::1", "[::1]", "1::", ":1::2", "1:::2", "1::2::3", "::ffff:1.2.3.4", "::1.2.3.04", "::1.2.3.256", "1.2.3.4::", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "a.b.c.d", "g::1", "12345::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
           "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "fe80::1%eth0", "FE80::ABCD", "localhost", "1:2", "::%", "0x7f.1", "300.1.1.1"]
    for _ in range(300):
        ip = ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([(1 << 128) - 1, (1 << 64) - 1, ((1 << 32) - 1) << 96, (1 << 16) - 1]))
        out += [ip.compressed, ip.exploded.upper(), f"[{ip}]"]
        out.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
    for net in map(ipaddress.ip_network, addresses.RESERVED):
        edge = [net.network_address, net.broadcast_address]
        out += [str(x) for x in edge] + [str(e + d) for e, d in zip(edge, (-1, 1), strict=True) if 0 <= int(e) + d < 1 << net.max_prefixlen]
    return out


def test_addresses(spark):
    hosts = spellings()
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    digits = addresses.ip_hex(F.col("h"))
    got = {r["h"]: (r["d"], r["inside"]) for r in df.select("h", digits.alias("d"), addresses.is_reserved(digits).alias("inside")).collect()}
    nets = [ipaddress.ip_network(c) for c in addresses.RESERVED]
    for h in hosts:
        want = stdlib(h)
        assert got[h][0] == want, h
        ip = ipaddress.ip_address(bytes.fromhex(want)) if want else None
        assert got[h][1] == any(ip in n for n in nets if ip and n.version == ip.version), h


def test_ranges_are_joined(spark):
    """Any ranges, nested ones too, of any length of prefix."""
    rng = random.Random(3)
    nets = sorted({str(ipaddress.ip_network((rng.getrandbits(32), b), strict=False)) for b in range(1, 33) for _ in range(3)} | {str(ipaddress.ip_network((rng.getrandbits(128), b), strict=False)) for b in range(1, 129, 7)} | {"0.0.0.0/0"})
    hosts = [str(ipaddress.ip_network(n).network_address + rng.randrange(min(ipaddress.ip_network(n).num_addresses, 1 << 30))) for n in nets] + ["1.2.3.4", "::1", "none"]
    rows = spark.createDataFrame([(h,) for h in hosts], "h string").withColumn("d", addresses.ip_hex(F.col("h"))).where("d IS NOT NULL")
    ranges = spark.createDataFrame([(c, k) for c, k, _ in addresses.range_rows(tuple(nets))], "cidr string, key string")
    got = {(r["h"], r["cidr"]) for r in addresses.in_ranges(rows, "d", ranges, tuple(nets)).collect()}
    assert got == {(h, n) for h in hosts if h != "none" for n in nets if ipaddress.ip_address(h) in ipaddress.ip_network(n)}


def test_guard_of_addresses(spark):
    cases = {"http://[::1]/": "reserved_ip", "https://[2606:4700::1111]:443/x": None, "http://[::ffff:8.8.8.8]": "reserved_ip", "http://8.8.8.8/": None, "http://127.1/": "numeric_host", "http://[fe80::1%25eth0]/": "reserved_ip", "http://user@[fc00::1]/": "reserved_ip", "http://1.2.3.4./": "numeric_host", "http://[]/": "no_host"}
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert {r["u"]: r["why"] for r in df.select("u", urls.guard_reason(F.col("u")).alias("why")).collect()} == cases
