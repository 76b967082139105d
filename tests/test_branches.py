"""The variants of q_branches reach both outcomes of their rules."""
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_CHECK


def rows(spark, name):
    return E.queries()[name](spark, SF_CHECK)


def shares(df, condition):
    return df.agg(F.sum(F.expr(condition).cast("long")), F.count("*")).first()


def test_both_outcomes_occur(spark):
    for name, condition in (("w1_rate_of_change_dense", "pps_delta <> 0"), ("j5_arp_resolution_local", "resolved_mac is not null"),
                            ("j6_antispoof_local", "spoof_ok"), ("st4_learn_macs_dense", "learned"),
                            ("st4_learn_macs_dense", "evicted_before > 0")):
        some, all_ = shares(rows(spark, name), condition)
        assert 0 < some < all_, name


def test_checked_ports_pass_their_own_hosts(spark):
    df = rows(spark, "j6_antispoof_local").where("dpid = 3 and in_port = 2")
    got = {(r["src_ip"], r["spoof_ok"]) for r in df.collect()}
    assert ("10.0.0.2", True) in got and all(ok == (ip == "10.0.0.2") for ip, ok in got)


def test_unblocking_removes_both_kinds_of_rules(spark):
    before = {r["cookie"]: r["count"] for r in rows(spark, "j3_drop_rules").groupBy("cookie").count().collect()}
    by_src = {r["cookie"]: r["count"] for r in rows(spark, "j8_unblock").groupBy("cookie").count().collect()}
    by_dst = {r["cookie"]: r["count"] for r in rows(spark, "j8_unblock_destinations").groupBy("cookie").count().collect()}
    assert by_src.get(57005, 0) < before[57005]
    assert by_dst.get(48879, 0) < before[48879]


def test_destination_blocks_suppress_too(spark):
    assert rows(spark, "j7_suppressed_by").count() < rows(spark, "j7_suppressed_by_any").count()
