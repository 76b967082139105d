"""Threshold fallback, attack names, address checks."""
from netsieve.functions.network import attack_type, sanitise_ip, valid_ipv4, proto_number
from netsieve.operators.detect import threshold_detect


def test_fallback_thresholds(spark):
    df = spark.createDataFrame([(20000.0, 0.0), (0.0, 1e8), (50.0, 1000.0), (10000.0, 5e7)],
                               "packet_count_per_second DOUBLE, byte_count_per_second DOUBLE")
    r = [(x["is_attack"], x["attack_prob"]) for x in threshold_detect(df).collect()]
    assert r == [(True, 0.5), (True, 0.5), (False, 0.1), (False, 0.1)]  # strict >


def test_attack_names_and_protocols(spark):
    df = spark.createDataFrame([(1,), (6,), (17,), (47,)], "p INT")
    assert [r[0] for r in df.select(attack_type("p")).collect()] == \
        ["ICMP Flood", "SYN Flood", "UDP Flood", "Unknown (proto=47)"]
    t = spark.createDataFrame([(" TCP ",), ("udp",), ("icmp",), ("weird",), (None,)], "s STRING")
    assert [r[0] for r in t.select(proto_number("s")).collect()] == [6, 17, 1, 0, 0]


def test_loose_and_strict_addresses(spark):
    df = spark.createDataFrame([("10.0.0.1",), ("999.1.1.1",), ("01.2.3.4",), ("abc",), (None,)], "a STRING")
    r = [(x[0], x[1]) for x in df.select(sanitise_ip("a"), valid_ipv4("a")).collect()]
    assert r == [("10.0.0.1", True), ("999.1.1.1", False), ("01.2.3.4", False), ("INVALID", False),
                 ("INVALID", False)]
