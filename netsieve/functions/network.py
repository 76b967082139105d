"""Address, protocol and key-hash expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Protocol name -> IANA number used when mapping text protocols.
PROTO_NUMBERS = {
    "tcp": 6,
    "udp": 17,
    "icmp": 1,
    "arp": 0,
    "ospf": 89,
    "igmp": 2,
    "sctp": 132,
    "gre": 47,
}

# Attack names by IP protocol.
ATTACK_NAMES = {1: "ICMP Flood", 6: "SYN Flood", 17: "UDP Flood"}

# Loose dotted-quad shape accepted in log lines.
LOOSE_IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"
# Strict IPv4: octets 0-255 without leading zeros.
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9])"
STRICT_IPV4 = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def proto_number(c) -> Column:
    """Protocol name (any case, padded) -> number; unknown names -> 0."""
    m = F.create_map(*[x for k, v in PROTO_NUMBERS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.element_at(m, F.lower(F.trim(_c(c)))), F.lit(0)).cast("int")


def attack_type(proto) -> Column:
    """Attack name from the IP protocol number."""
    p = _c(proto)
    e = F.concat(F.lit("Unknown (proto="), p.cast("string"), F.lit(")"))
    for num, name in sorted(ATTACK_NAMES.items(), reverse=True):
        e = F.when(p == num, F.lit(name)).otherwise(e)
    return e


def sanitise_ip(c) -> Column:
    """Keep a dotted-quad looking address, else 'INVALID'."""
    c = _c(c)
    return F.when(c.isNotNull() & c.rlike(LOOSE_IPV4), c).otherwise(F.lit("INVALID"))


def valid_ipv4(c) -> Column:
    """Strict IPv4 check used before installing a block."""
    c = _c(c)
    return F.coalesce(c.rlike(STRICT_IPV4), F.lit(False))


def ip_to_long(c) -> Column:
    """Dotted quad -> 32-bit value as BIGINT (NULL when not an address)."""
    c = _c(c)
    parts = F.split(c, r"\.")
    o = [F.element_at(parts, i + 1).try_cast("bigint") for i in range(4)]
    val = ((o[0] * 16777216) + (o[1] * 65536) + (o[2] * 256) + o[3])
    return F.when(c.rlike(STRICT_IPV4), val)


def md5_bucket(s) -> Column:
    """First 32 bits of md5(s) as BIGINT: a hash both Spark and DuckDB compute."""
    return F.conv(F.substring(F.md5(_c(s).cast("string")), 1, 8), 16, 10).cast("bigint")


def jitter_timeout(key: Column, timeout_sec: int) -> Column:
    """Deterministic timeout in [int(0.8T), int(1.2T)], inclusive.

    The reference draws a random integer; a keyed hash gives the same range
    without any driver-side state and identical values on re-execution.
    """
    lo = math.floor(timeout_sec * 0.8)
    hi = math.floor(timeout_sec * 1.2)
    return (F.lit(lo) + F.pmod(md5_bucket(key), F.lit(hi - lo + 1))).cast("int")
