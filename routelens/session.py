"""Session construction and the shared scratch folder.

On a cluster the shared folder comes from ``spark.checkpoint.dir`` (set by the
cluster operator to a distributed file system path).  Only when it is unset,
as in local tests, do we create one ourselves.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "routelens") -> SparkSession:
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide scratch folder: ``spark.checkpoint.dir``.

    A local master without one gets a fresh local folder, so later ``checkpoint()`` calls and written
    tables land there.  On any other master the setting is required: executors would each write to
    their own disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="routelens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    else:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared folder (never reused)."""
    base = shared_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df, name: str):
    """Cut a long or reused lineage: write ``df`` once as parquet below the shared folder and
    read it back (one job; later reads are columnar with pushdown).  Survives executor loss,
    unlike cached or locally checkpointed data."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the jobs that run inside the block (wide rows would make
    the default of 10,000 gigabytes); the session's own setting comes back afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows if int(before) <= 0 else min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``routelens`` importable in Python workers: zip the package once per application and
    hand it to ``addPyFile`` (Spark distributes it to every executor, as ``--py-files`` does)."""
    import zipfile

    import routelens
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(routelens.__file__))
    zpath = os.path.join(tempfile.mkdtemp(prefix="routelens-pyfiles-"), "routelens.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith((".py", ".csv")):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc.applicationId)
