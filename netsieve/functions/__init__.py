"""Column-level functions (all JVM-side expressions, no Python UDFs)."""

from netsieve.functions.network import (
    attack_type, ip_to_long, jitter_timeout, proto_number, sanitise_ip,
    valid_ipv4, md5_bucket,
)
from netsieve.functions.timefmt import parse_ts, epoch_seconds

__all__ = [
    "attack_type", "ip_to_long", "jitter_timeout", "proto_number", "sanitise_ip",
    "valid_ipv4", "md5_bucket", "parse_ts", "epoch_seconds",
]
