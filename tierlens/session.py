"""Session construction and shared storage locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "tierlens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the library is tuned for.

    On a cluster, pass ``master=None`` and let spark-submit decide.  The shuffle
    partition count should be sized so a partition stays around 128-256 MB at the
    target scale; AQE coalesces small ones and splits skewed join partitions.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
        "spark.sql.parquet.filterPushdown": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if master and master.startswith("local"):
        # local mode: the driver JVM is the only executor, size its heap
        conf["spark.driver.memory"] = os.environ.get("TIERLENS_DRIVER_MEMORY", "8g")
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by all executors, taken from ``spark.checkpoint.dir``.

    The cluster names it; we only invent one when it is unset *and* the master is
    local (tests, laptops).  A machine-local temporary folder is never used on a
    cluster: there we fail loudly instead.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        try:
            jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
            d = jdir.get() if jdir.isDefined() else None
        except Exception:  # noqa: BLE001 - no JVM handle (Spark Connect)
            d = None
    if not d:
        master = spark.conf.get("spark.master", "") or ""
        if not master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="run-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.sparkContext.setCheckpointDir(d)        # found again by the lookup above
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared folder (one per job run)."""
    return f"{shared_dir(spark)}/tierlens/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared folder and read it back: lineage is cut, and a lost
    executor loses nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
