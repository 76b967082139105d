"""Adapters on the reference's literal raw rows."""
import math

from netsieve.operators.adapters import map_cic2017, map_cic2019, map_unsw

CIC17 = ["Flow ID", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
         "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Protocol", "Flow Bytes/s",
         "Flow Packets/s", "Label"]


def test_cic2017_rows(spark):
    rows = [("1", "1000000", "10", "8", "5000", "4000", "6", "9000", "18", "BENIGN"),
            ("2", "500000", "5000", "100", "300000", "50000", "17", "700000", "10200", "DoS Hulk"),
            ("3", "0", "100", "0", "5000", "0", "6", "Infinity", "Infinity", " BENIGN")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in CIC17))
    r = {x["Flow ID"]: x for x in map_cic2017(df, keep=["Flow ID"]).collect()}
    assert r["1"]["flow_duration_sec"] == 1.0 and r["1"]["packet_count"] == 18
    assert r["1"]["packet_count_per_second"] == 18.0 and r["1"]["label"] == 0
    assert r["2"]["flow_duration_sec"] == 0.5 and r["2"]["packet_count"] == 5100
    assert r["2"]["packet_count_per_second"] == 10200.0 and r["2"]["label"] == 1
    assert r["2"]["flows_to_dst"] == 1  # no destination column: aggregates are 1
    for x in r.values():
        assert all(not (isinstance(v, float) and math.isinf(v)) for v in x.asDict().values())


def test_cic2019_aliases(spark):
    cols = ["Flow ID", "Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts",
            "Protocol", "Label"]
    rows = [("1", "2000000", "20", "15", "10000", "8000", "6", "BENIGN"),
            ("2", "100000", "80000", "200", "5000000", "100000", "17", "DDoS-DNS")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in cols))
    r = {x["Flow ID"]: x for x in map_cic2019(df, keep=["Flow ID"]).collect()}
    assert r["1"]["packet_count"] == 35 and r["1"]["flow_duration_sec"] == 2.0 and r["1"]["label"] == 0
    assert r["2"]["packet_count"] == 80200 and r["2"]["label"] == 1 and r["2"]["ip_proto"] == 17


def test_unsw_protocols(spark):
    rows = [("1", "5", "4", "2000", "1500", "1.5", "tcp", "0", "Normal"),
            ("2", "40000", "100", "2000000", "50000", "0.01", "udp", "1", "DoS")]
    df = spark.createDataFrame(rows, "id STRING, spkts STRING, dpkts STRING, sbytes STRING, dbytes STRING, "
                                     "dur STRING, proto STRING, label STRING, attack_cat STRING")
    r = {x["id"]: x for x in map_unsw(df, keep=["id"]).collect()}
    assert r["1"]["ip_proto"] == 6 and r["1"]["packet_count"] == 9 and r["1"]["label"] == 0
    assert r["2"]["ip_proto"] == 17 and r["2"]["label"] == 1


def test_creation_rate_per_row_bad_timestamp(spark):
    cols = CIC17 + ["Destination IP", "Source IP", "Timestamp"]
    base = ("1000000", "10", "8", "5000", "4000", "6", "9000", "18", "BENIGN")
    rows = [("1",) + base + ("10.0.0.7", "10.0.0.1", "01/07/2017 08:00:00"),
            ("2",) + base + ("10.0.0.7", "10.0.0.2", "01/07/2017 08:00:02"),
            ("3",) + base + ("10.0.0.7", "10.0.0.3", "not a time"),
            ("4",) + base + ("10.0.0.7", "10.0.0.4", "01/07/2017 08:00:06")]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` STRING" for c in cols))
    r = {x["Flow ID"]: x for x in map_cic2017(df, keep=["Flow ID"]).collect()}
    assert r["1"]["flow_creation_rate"] == 0.0            # first arrival: no gap
    assert r["2"]["flow_creation_rate"] == 0.5            # 1 / 2 s
    assert r["3"]["flow_creation_rate"] == 0.0            # unparseable: this row only (Q24)
    assert abs(r["4"]["flow_creation_rate"] - (0.5 + 0.25) / 2) < 1e-12   # mean of 1/2 and 1/4
    assert r["1"]["flows_to_dst"] == 4 and r["1"]["unique_sources_to_dst"] == 4


def test_raw_files_grow_with_the_rows(spark, monkeypatch):
    """No raw file holds more than its share of rows, so no task writes or hashes half of them."""
    from netsieve.plans import q_adapters
    from netsieve.sources.datasets import list_files
    from tests.conftest import SF_SMALL
    rows = q_adapters.D.read_table(spark, SF_SMALL, "events").count()
    monkeypatch.setattr(q_adapters, "FILE_ROWS", 100)
    for folder, names in ((q_adapters.cic2017_dir, 2), (q_adapters.cic2019_dir, 3)):
        files = list_files(spark, f"{folder(spark, SF_SMALL)}/*.csv")
        counts = [spark.read.option("header", True).csv(f).count() for f in files]
        assert len(files) == max(names, -(-rows // 100)) and sum(counts) == rows and max(counts) < 200


def test_rate_and_timestamps_are_worked_out_once(spark):
    """The filter on missing values holds no copies of the rate's formula, and no
    pass after the raw text's first parses a timestamp again."""
    from netsieve.operators.adapters import map_cic2017, map_cic2019
    num = ["Flow Duration", "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Protocol"]
    raw = spark.createDataFrame([(*["1"] * 6, "10.0.0.1", "10.0.0.2", t, "BENIGN", str(i)) for i, t in enumerate(["03/07/2017 09:00:00", "03/07/2017 09:00:01", "never", None])],
                                ", ".join(f"`{c}` STRING" for c in [*num, "Source IP", "Destination IP", "Timestamp", "Label", "Flow ID"]))
    for mapper in (map_cic2017, map_cic2019):
        out = mapper(raw, keep=["Flow ID"])
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        filters = [line for line in plan.split("\n") if "Filter" in line and "atleastnnonnulls" in line.lower()]
        assert filters and not any("1000000" in line or "prev" in line for line in filters)
        assert "gettimestamp" not in plan.lower() and "trytotimestamp" not in plan.lower() and "dd/MM/yyyy" not in plan
        assert {r["Flow ID"]: r["flow_creation_rate"] for r in out.collect()} == {"0": 0.0, "1": 1.0, "2": 0.0, "3": 0.0}
