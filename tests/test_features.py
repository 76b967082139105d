"""Feature formulas and validation (cases of the reference's feature tests)."""
import math

from pyspark.sql import functions as F

from netsieve.operators.features import (
    clamped_features, live_features, offline_features, validate_features)
from netsieve.schema import FEATURE_NAMES

SCHEMA = "duration_sec LONG, packet_count LONG, byte_count LONG, ip_proto INT, icmp_code INT, icmp_type INT"
CASES = [(10, 100, 50000, 6, 0, 0), (0, 100, 50000, 6, 0, 0), (10, 0, 0, 17, 0, 0), (5, 50000, 3000000, 1, 0, 8)]


def _rows(df):
    return [r.asDict() for r in df.collect()]


def test_offline_rates(spark):
    r = _rows(offline_features(spark.createDataFrame(CASES, SCHEMA)))
    got = [(x["packet_count_per_second"], x["byte_count_per_second"], x["avg_packet_size"]) for x in r]
    assert got == [(10.0, 5000.0, 500.0), (100.0, 50000.0, 500.0), (0.0, 0.0, 0.0), (10000.0, 600000.0, 60.0)]
    assert list(offline_features(spark.createDataFrame(CASES, SCHEMA)).columns) == FEATURE_NAMES


def test_live_zero_duration_gives_zero_rate(spark):
    r = _rows(live_features(spark.createDataFrame(CASES[1:2], SCHEMA)))[0]
    assert (r["packet_count_per_second"], r["byte_count_per_second"], r["avg_packet_size"]) == (0.0, 0.0, 500.0)


def test_missing_inputs_default_to_zero(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None)], SCHEMA)
    r = _rows(offline_features(df))[0]
    assert all(r[c] == 0 for c in FEATURE_NAMES)


def test_clamped_rule(spark):
    r = _rows(clamped_features(spark.createDataFrame([(0, 0, 100, 6, 0, 0)], SCHEMA)))[0]
    assert r["packet_count_per_second"] == 0.0 and r["avg_packet_size"] == 100.0


def test_validation_nan_and_inf(spark):
    base = offline_features(spark.createDataFrame(CASES[:1], SCHEMA))
    ok = validate_features(base).first()
    assert ok["is_valid"] and ok["error"] is None
    nan = validate_features(base.withColumn("flows_to_dst", F.lit(float("nan")))).first()
    assert not nan["is_valid"] and "NaN" in nan["error"] and "flows_to_dst" in nan["error"]
    inf = validate_features(base.withColumn("avg_packet_size", F.lit(math.inf))).first()
    assert not inf["is_valid"] and "Inf" in inf["error"]
    missing = validate_features(base.drop("icmp_type")).first()
    assert not missing["is_valid"]
