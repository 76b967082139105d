"""Sources and sinks on small files in a scratch folder."""
import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from netsieve.sources.datasets import load_dataset, read_canonical, read_cic2017, read_unsw, verify_files
from netsieve.sources.logs import read_attack_history, read_attack_log
from netsieve.sources.snapshot import read_block_snapshot


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_cic_scan_trims_headers_and_unions(spark):
    d = tempfile.mkdtemp(prefix="netsieve-cic-")
    _write(f"{d}/a.csv", " Flow Duration, Label\n1000000,BENIGN\n")
    _write(f"{d}/b.csv", "Flow Duration ,Label,Extra\n2000000,DDoS,x\n")
    df = read_cic2017(spark, d)
    assert set(df.columns) == {"Flow Duration", "Label", "Extra"}
    assert df.count() == 2


def test_registry_errors(spark):
    with pytest.raises(ValueError):
        load_dataset(spark, "nope", "/tmp")
    with pytest.raises(FileNotFoundError):
        load_dataset(spark, "cic-ids2017", "/tmp/definitely-missing-netsieve")
    with pytest.raises(FileNotFoundError):
        read_cic2017(spark, tempfile.mkdtemp(prefix="netsieve-empty-"))


def test_unsw_predefined_split(spark):
    d = tempfile.mkdtemp(prefix="netsieve-unsw-")
    hdr = "id,dur,proto,spkts,dpkts,sbytes,dbytes,label,attack_cat\n"
    _write(f"{d}/UNSW_NB15_training-set.csv", hdr + "1,1.5,tcp,5,4,2000,1500,0,Normal\n")
    _write(f"{d}/UNSW_NB15_testing-set.csv", hdr + "2,0.01,udp,40000,100,2000000,50000,1,DoS\n")
    r = {x["id"]: x["_split"] for x in read_unsw(spark, d).collect()}
    assert r == {"1": "train", "2": "test"}


def test_canonical_requires_13_columns(spark):
    d = tempfile.mkdtemp(prefix="netsieve-canon-")
    _write(f"{d}/x.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError):
        read_canonical(spark, d)
    names = ("flow_duration_sec,packet_count,byte_count,packet_count_per_second,byte_count_per_second,"
             "avg_packet_size,ip_proto,icmp_code,icmp_type,flows_to_dst,unique_sources_to_dst,"
             "flow_creation_rate,label")
    e = tempfile.mkdtemp(prefix="netsieve-canon-")
    _write(f"{e}/x.csv", names + "\n10,100,50000,Infinity,5000,500,6,0,0,5,3,1.0,0\n10,,1,1,1,1,6,0,0,1,1,1,1\n")
    rows = read_canonical(spark, e).collect()
    assert len(rows) == 1 and rows[0]["packet_count_per_second"] == 0.0


def test_attack_history_and_log(spark):
    d = tempfile.mkdtemp(prefix="netsieve-hist-")
    _write(f"{d}/h.log", "# DDoS Attack History Log\n# Format: x\n---\n"
                         "2024-01-01 10:00:00 | syn_flood | 10.0.0.1 | 30s | completed\n\n"
                         "2024-01-01 11:00:00 | udp_flood | 10.0.0.2 | 15s | failed\n")
    h = sorted(read_attack_history(spark, d).collect(), key=lambda r: r["ts"])
    assert [(r["type"], r["duration_sec"], r["status"]) for r in h] == \
        [("syn_flood", 30, "completed"), ("udp_flood", 15, "failed")]
    assert read_attack_log(spark, f"{d}/missing.csv") is None
    _write(f"{d}/empty/a.csv", "timestamp,src_ip\n")
    assert read_attack_log(spark, f"{d}/empty") is None


def test_snapshot_versions(spark):
    d = tempfile.mkdtemp(prefix="netsieve-snap-")
    now = dt.datetime(2024, 1, 1).timestamp()
    docs = [{"version": 2, "saved_at": "x", "blocked_ips": {"10.0.0.1|10.0.0.7|6": now + 100,
                                                          "*|10.0.0.8|17": now - 5, "bad": now + 100}},
            {"version": 1, "saved_at": "x", "blocked_ips": {"3|10.0.0.2|10.0.0.7|1": now + 50}}]
    _write(f"{d}/s.json", "\n".join(json.dumps(x) for x in docs) + "\n")
    r = sorted((x["block_src"], x["dst_ip"], x["ip_proto"]) for x in
               read_block_snapshot(spark, d, "2024-01-01 00:00:00").collect())
    assert r == [("10.0.0.1", "10.0.0.7", 6), ("10.0.0.2", "10.0.0.7", 1)]


def test_manifest(spark):
    import hashlib
    d = tempfile.mkdtemp(prefix="netsieve-man-")
    _write(f"{d}/a.csv", "x\n1\n")
    _write(f"{d}/b.csv", "y\n2\n")
    good = hashlib.sha256(b"x\n1\n").hexdigest()
    exp = spark.createDataFrame([("a.csv", good), ("b.csv", "0" * 64), ("c.csv", "1" * 64)], "name STRING, sha256 STRING")
    r = {x["name"]: x["status"] for x in verify_files(spark, d, exp).collect()}
    assert r == {"a.csv": "ok", "b.csv": "mismatch", "c.csv": "missing"}


def test_canonical_reads_by_name(spark, tmp_path):
    """Columns in another order, whole numbers written as floats."""
    from netsieve.schema import CANONICAL
    names = [f.name for f in CANONICAL.fields][::-1]
    value = {f.name: ("7.25" if f.dataType.typeName() == "double" else "100.0") for f in CANONICAL.fields}
    value.update(label="1", packet_count="9007199254740993", byte_count="100.0")
    inf = next(f.name for f in CANONICAL.fields if f.dataType.typeName() == "double")
    rows = [value, {**value, inf: "inf"}, {**value, inf: ""}, {**value, inf: "nan"}]
    (tmp_path / "a.csv").write_text("\n".join([",".join(names), *(",".join(r[n] for n in names) for r in rows)]) + "\n")
    got = read_canonical(spark, str(tmp_path / "a.csv")).collect()
    assert len(got) == 2 and {r[inf] for r in got} == {7.25, 0.0}
    assert all(r["packet_count"] == 9007199254740993 and r["byte_count"] == 100 and r["label"] == 1 for r in got)
    (tmp_path / "b.csv").write_text(",".join(["other", *names[1:]]) + "\n")
    with pytest.raises(ValueError):
        read_canonical(spark, str(tmp_path / "b.csv"))


def test_files_of_one_header_are_one_scan(spark, tmp_path):
    heads = ["a,b", "b, c", "a"]
    for i in range(60):
        h = heads[i % 3]
        (tmp_path / f"f{i:03d}.csv").write_text(h + "\n" + ",".join([str(i)] * len(h.split(","))) + "\n")
    (tmp_path / "empty.csv").write_text("")
    with pytest.warns(UserWarning, match="empty.csv"):
        df = read_cic2017(spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 3
    rows = {(r["a"], r["b"], r["c"]) for r in df.collect()}
    want = {(str(i), str(i), None) if i % 3 == 0 else (None, str(i), str(i)) if i % 3 == 1 else (str(i), None, None) for i in range(60)}
    assert rows == want


def test_append_by_job_id_is_once(spark, tmp_path):
    from netsieve.schema import CANONICAL
    from netsieve.sources.datasets import append_labelled
    cols = [f.name for f in CANONICAL.fields]
    rows = spark.range(100).select(*[(F.lit(0) if c == "label" else F.col("id")).cast(CANONICAL[c].dataType).alias(c) for c in cols])
    bad = rows.limit(3).withColumn("label", F.lit(5).cast(CANONICAL["label"].dataType))
    path, aside = str(tmp_path / "d"), str(tmp_path / "q")
    both = rows.unionByName(bad)
    assert append_labelled(both, path, aside, job_id="j1")
    assert not append_labelled(both, path, aside, job_id="j1")
    assert append_labelled(both, path, aside, job_id="j2")
    assert read_canonical(spark, path).count() == 200 and spark.read.json(aside).count() == 6
    # a run that died between moving its files and the marker
    (tmp_path / "d" / "_done.j2").unlink()
    assert append_labelled(both, path, aside, job_id="j2")
    assert read_canonical(spark, path).count() == 200 and spark.read.json(aside).count() == 6
    with pytest.raises(ValueError):
        append_labelled(both, path, job_id="../x")


def test_manifest_hashes_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    from netsieve.sources import datasets
    monkeypatch.setattr(datasets, "CHUNK_BYTES", 1000)
    want = {}
    for i, n in enumerate((0, 999, 1000, 1001, 5_000_000)):
        data = bytes((i + j) % 251 for j in range(n))
        (tmp_path / f"f {i}.csv").write_bytes(data)
        want[f"f {i}.csv"] = (n, hashlib.sha256(data).hexdigest())
    got = verify_files(spark, str(tmp_path), spark.createDataFrame([], "name STRING, sha256 STRING")).collect()
    assert {r["name"]: (r["size"], r["sha256"]) for r in got} == want
    assert verify_files(spark, str(tmp_path / "none"), spark.createDataFrame([("x.csv", "0")], "name STRING, sha256 STRING")).first()["status"] == "missing"
