"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every netsieve job relies on. AQE re-plans joins (broadcast vs
# sort-merge) and splits skewed partitions at run time; UTC keeps timestamps
# identical to the SQL oracle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, app: str = "netsieve",
                shuffle_partitions: int | None = None, **extra) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in extra.items():
        b = b.config(k.replace("_", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; only when it is unset
    (local tests) do we pick a scratch folder ourselves.
    """
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        # a local session, as in tests: a scratch folder stands in for it
        d = tempfile.mkdtemp(prefix="netsieve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)  # makes a new folder below d each time
    return d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``netsieve`` importable in Python workers (what ``--py-files``
    does for spark-submit): zip the package once per application and
    ``addPyFile`` it. Needed by the operators that run Python in tasks
    (``mapInPandas`` / ``applyInPandasWithState``)."""
    import io
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    target = checkpoint_dir(spark)
    if target.startswith("file:"):
        target = target[len("file:"):]
    if "://" in target:
        # the checkpoint folder is remote: stage the archive on the driver,
        # Spark's file server ships it to the executors
        target = tempfile.mkdtemp(prefix="netsieve-pyfiles-")
    os.makedirs(target, exist_ok=True)
    path = os.path.join(target, f"netsieve-{app}.zip".replace("/", "_"))
    with open(path, "wb") as fh:
        fh.write(buf.getvalue())
    sc.addPyFile(path)
    _SHIPPED.add(app)
