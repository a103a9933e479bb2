"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "textpulse") -> SparkSession:
    """Local/test session. On a cluster the launcher supplies master and sizing."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder
        .master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.files.maxPartitionBytes", str(64 * 1024 * 1024))
        .config("spark.textpulse.text.partitions", cpus)
    )
    if os.environ.get("TEXTPULSE_EVENT_LOG"):
        # stage/task timings for profiling, written to a scratch folder
        builder = builder.config("spark.eventLog.enabled", "true") \
                         .config("spark.eventLog.dir", os.environ["TEXTPULSE_EVENT_LOG"])
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, wiring it into the SparkContext.

    ``spark.checkpoint.dir`` names a folder that driver and executors share and
    is used as is. A scratch folder stands in for it only where there is nothing
    to share: in a local session without the setting. On a cluster a missing
    setting is an error."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="textpulse-ckpt-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"
    _written(spark, path)
    return path


def materialize(df):
    """Cut lineage: write ``df`` as a parquet table under the reliable
    checkpoint folder and read it back.

    For tables that several branches of one plan read, so the scan below them
    runs once and a lost executor does not recompute it. (``Dataset.checkpoint``
    would run the plan twice: once for the eager count and again to write the
    files.) The folder goes when the session's driver ends."""
    spark = df.sparkSession
    path = scratch_path(spark, "tables")
    df.write.mode("error").parquet(path)
    return spark.read.parquet(path)


def _written(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system remove the folder when this driver's JVM ends
    (it asks for an existing path, so the folder is made first)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    fs.deleteOnExit(target)
