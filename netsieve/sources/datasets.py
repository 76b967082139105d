"""Dataset scans, the dataset registry and file sinks."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsieve.operators.adapters import map_cic2017, map_cic2019, map_unsw, normalise_header
from netsieve.schema import CANONICAL, FEATURE_NAMES, LABEL


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """File names matching a glob (metadata only: no data passes the driver)."""
    fs, p = _fs(spark, pattern)
    st = fs.globStatus(p)
    return sorted(s.getPath().toString() for s in (st or []) if s.isFile())


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical CSV: exactly the 13 columns, in any order, else an error;
    rows with any null dropped; +-Inf in the features -> 0. Fields are read as
    text and selected by name; whole numbers may be written as ``100.0``."""
    raw = spark.read.option("header", True).csv(path)
    want = [f.name for f in CANONICAL.fields]
    if sorted(raw.columns) != sorted(want):
        raise ValueError(f"A canonical file has the columns {want}, this one {raw.columns}")

    def number(f):
        # as the CSV reader spells them: NaN counts as missing, Inf as a value
        t = F.trim(f.name)
        d = (F.when(F.lower(t).isin("inf", "+inf", "infinity", "+infinity"), F.lit(float("inf")))
              .when(F.lower(t).isin("-inf", "-infinity"), F.lit(float("-inf"))).otherwise(t.try_cast("double")))
        d = F.when(~F.isnan(d), d)
        if f.dataType.typeName() == "double":
            return F.when(F.abs(d) == float("inf"), F.lit(0.0)).otherwise(d).alias(f.name)
        whole = t.try_cast(f.dataType)  # keeps every digit of a plain whole number
        return F.coalesce(whole, F.when(F.abs(d) == float("inf"), F.lit(0).cast(f.dataType)).otherwise(d.try_cast(f.dataType))).alias(f.name)

    return raw.select(*[number(f) for f in CANONICAL.fields]).na.drop(how="any")


CHUNK_BYTES = 4 << 20


def _open_stream(uri: str):
    """A file as an Arrow input stream, inside a task."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + uri[len("file:"):].lstrip("/"), compression=None)
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def _per_file(spark: SparkSession, files: list[str], fn, schema: str) -> DataFrame:
    """``fn`` (uri -> tuple) on every file, each read by one task."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            for uri in pdf["uri"]:
                yield pd.DataFrame([fn(uri)], columns=names)

    names = [c.split()[0] for c in schema.split(", ")]
    tasks = max(1, min(len(files), 4 * spark.sparkContext.defaultParallelism))
    listed = spark.createDataFrame([(i, f) for i, f in enumerate(files)], "n LONG, uri STRING")
    return listed.repartitionByRange(tasks, "n").mapInPandas(run, schema)


def first_lines(spark: SparkSession, files: list[str]) -> dict[str, tuple[str | None, str | None]]:
    """Header line and error (one is NULL) of every file, read by tasks: what
    comes back to the driver is one line a file, as the list of files does."""

    def head(uri):
        try:
            got = b""
            with _open_stream(uri) as f:
                while b"\n" not in got and len(got) < CHUNK_BYTES:
                    more = f.read(16 << 10)
                    if not more:
                        break
                    got += more
            line = got.split(b"\n", 1)[0].decode("utf-8", "replace").lstrip("\ufeff").rstrip("\r")
            return (uri, line, None) if line.strip() else (uri, None, "the file has no header")
        except Exception as e:  # noqa: BLE001
            return uri, None, str(e)[:200]

    got = _per_file(spark, files, head, "uri STRING, line STRING, error STRING").collect()
    return {r["uri"]: (r["line"], r["error"]) for r in got}


def _read_csv_dir(spark: SparkSession, path: str, lower: bool = False,
                  pattern: str = "*.csv") -> DataFrame:
    """Every CSV under ``path``: header names trimmed, files of different
    headers unioned by name; a file that cannot be read is skipped with a
    warning; none -> error. All columns are read as text. Files of one header are
    one scan, so the plan grows with the headers, not with the files."""
    files = list_files(spark, f"{path.rstrip('/')}/{pattern}")
    if not files:
        raise FileNotFoundError(f"there is no CSV file under {path}")
    groups: dict[str, list[str]] = {}
    heads = first_lines(spark, files)
    for f in files:
        line, error = heads[f]
        if error:
            warnings.warn(f"Skipping {f}: {error}")
        else:
            groups.setdefault(line, []).append(f)
    if not groups:
        raise ValueError(f"no CSV file under {path} could be read")
    frames = [normalise_header(spark.read.option("header", True).option("inferSchema", False).csv(same), lower)
              for same in groups.values()]
    out = frames[0]
    for d in frames[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def read_cic2017(spark: SparkSession, path: str) -> DataFrame:
    """CIC-IDS2017 directory scan."""
    return _read_csv_dir(spark, path)


def read_cic2019(spark: SparkSession, path: str) -> DataFrame:
    """S3: CIC-DDoS2019 directory scan."""
    return _read_csv_dir(spark, path)


UNSW_TRAIN = "UNSW_NB15_training-set.csv"
UNSW_TEST = "UNSW_NB15_testing-set.csv"


def read_unsw(spark: SparkSession, path: str) -> DataFrame:
    """The predefined train and test files when both exist (``_split``
    marks them), else ``UNSW-NB15_*.csv``, else any CSV."""
    base = path.rstrip("/")
    tr, te = f"{base}/{UNSW_TRAIN}", f"{base}/{UNSW_TEST}"
    if path_exists(spark, tr) and path_exists(spark, te):
        a = spark.read.option("header", True).csv(tr).withColumn("_split", F.lit("train"))
        b = spark.read.option("header", True).csv(te).withColumn("_split", F.lit("test"))
        return a.unionByName(b, allowMissingColumns=True)
    if list_files(spark, f"{base}/UNSW-NB15_*.csv"):
        return _read_csv_dir(spark, path, pattern="UNSW-NB15_*.csv")
    return _read_csv_dir(spark, path)


# Dataset name -> (scan, map)
DATASETS = {
    "cic-ids2017": (read_cic2017, map_cic2017),
    "cic-ddos2019": (read_cic2019, map_cic2019),
    "unsw-nb15": (read_unsw, map_unsw),
}


def load_dataset(spark: SparkSession, name: str, path: str, **map_kw) -> DataFrame:
    """Registry lookup; unknown name or missing directory -> error."""
    if name == "synthetic":
        return read_canonical(spark, path)
    if name not in DATASETS:
        raise ValueError(f"Unknown dataset {name!r}; choose from {sorted(DATASETS) + ['synthetic']}")
    if not path_exists(spark, path):
        raise FileNotFoundError(f"there is no dataset folder {path}")
    scan, mapper = DATASETS[name]
    return mapper(scan(spark, path), **map_kw)


def split_labelled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S12 check: (valid, invalid) rows. Valid = all 12 features present and
    numeric, label in {0, 1}. Invalid rows carry ``reason``."""
    missing = [c for c in FEATURE_NAMES + [LABEL] if c not in df.columns]
    if missing:
        raise ValueError(f"labelled rows lack {missing}")
    bad_feat = F.array_compact(F.array(*[F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")),
                                                F.lit(c)) for c in FEATURE_NAMES]))
    reason = (F.when(F.size(bad_feat) > 0, F.concat(F.lit("bad features: "), F.array_join(bad_feat, ",")))
               .when(~F.coalesce(F.col(LABEL).isin(0, 1), F.lit(False)), F.lit("label not in {0,1}")))
    x = df.withColumn("reason", reason)
    return (x.filter(F.col("reason").isNull()).select(*FEATURE_NAMES, LABEL),
            x.filter(F.col("reason").isNotNull()))


def append_labelled(df: DataFrame, path: str, quarantine: str | None = None, job_id: str | None = None) -> bool:
    """Append valid rows to the canonical CSV dataset (header in every
    part); invalid rows go to ``quarantine`` when given, else are rejected.

    With a ``job_id`` (letters, digits, ``-``) the rows are appended once, however
    often the job is run: they are written aside, moved in under names that hold the
    id, and a marker ends the job. A run that finds the marker returns False; one that
    finds an unfinished run removes what that left and starts anew. Two runs of one id
    at the same time are not guarded against."""
    spark = df.sparkSession
    valid, invalid = split_labelled(df)
    if path_exists(spark, path) and list_files(spark, f"{path.rstrip('/')}/*.csv"):
        # an existing dataset with another header is appended to anyway, with a warning
        head = spark.read.option("header", True).csv(path).columns
        want = [f.name for f in CANONICAL.fields]
        if head and head != want:
            warnings.warn(f"Header mismatch in {path}: {head} != {want}")
    rows = valid.select(*[F.col(f.name).cast(f.dataType) for f in CANONICAL.fields])
    if job_id is None:
        rows.write.mode("append").option("header", True).csv(path)
        if quarantine:
            invalid.write.mode("append").json(quarantine)
        return True
    if not job_id.replace("-", "").isalnum():
        raise ValueError(f"a job id has letters, digits and '-' only: {job_id!r}")
    parts = [(path, rows.write.option("header", True), "csv")]
    if quarantine:
        parts.append((quarantine, invalid.write, "json"))
    return _commit_once(spark, parts, f"{path.rstrip('/')}/_done.{job_id}", job_id)


def _commit_once(spark: SparkSession, parts: list, marker: str, job_id: str) -> bool:
    """Write each (folder, writer, format) aside and move its files in; then the
    marker. Names that begin with ``_`` are not read as data."""
    if path_exists(spark, marker):
        return False
    for folder, writer, fmt in parts:
        base = folder.rstrip("/")
        aside = f"{base}/_aside.{job_id}"
        fs, target = _fs(spark, base)
        path_of = lambda name: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        for left in list_files(spark, f"{base}/job.{job_id}.*"):
            fs.delete(path_of(left), False)
        writer.mode("overwrite").format(fmt).save(aside)
        for n, f in enumerate(list_files(spark, f"{aside}/part-*")):
            if not fs.rename(path_of(f), path_of(f"{base}/job.{job_id}.{n:05d}.{fmt}")):
                raise OSError(f"could not move {f} into {base}")
        fs.delete(path_of(aside), True)
    fs, p = _fs(spark, marker)
    fs.create(p, True).close()
    return True


def write_results(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables (metric/value rows, transfer matrix, comparison)."""
    w = df.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))


def verify_files(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Per CSV file size, SHA-256 and status against ``expected``
    (name, sha256): ok / mismatch / unexpected; plus rows for expected files
    that are missing (J9, U3). A task hashes a file in chunks of ``CHUNK_BYTES``,
    so files may have any size."""

    def digest(uri):
        import hashlib
        h, size = hashlib.sha256(), 0
        with _open_stream(uri) as f:
            while chunk := f.read(CHUNK_BYTES):
                h.update(chunk)
                size += len(chunk)
        return uri.rsplit("/", 1)[-1], size, h.hexdigest()

    listed = list_files(spark, f"{path.rstrip('/')}/*.csv")
    files = _per_file(spark, listed, digest, "name STRING, size LONG, sha256 STRING")
    e = expected.select("name", F.col("sha256").alias("expected_sha256"))
    found = (files.join(e, "name", "left")
                  .withColumn("status", F.when(F.col("expected_sha256").isNull(), "unexpected")
                              .when(F.col("expected_sha256") == F.col("sha256"), "ok")
                              .otherwise("mismatch")))
    missing = (e.join(files.select("name"), "name", "left_anti")
                .select("name", F.lit(None).cast("long").alias("size"), F.lit(None).cast("string").alias("sha256"),
                        "expected_sha256", F.lit("missing").alias("status")))
    return found.unionByName(missing)


def manifest_summary(report: DataFrame) -> DataFrame:
    """S15 totals: files, total size, missing count, overall ok (a folder
    without files is not)."""
    return report.agg(F.count(F.lit(1)).alias("files"),
                      F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"),
                      F.sum(F.when(F.col("status") == "missing", 1).otherwise(0)).alias("missing"),
                      F.coalesce(F.min(F.col("status").isin("ok", "unexpected")), F.lit(False)).alias("all_ok"))
