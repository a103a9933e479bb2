"""Structured Streaming plumbing: table streams and availableNow runs whose
sink and checkpoint live under the shared checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.session import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None
                 ) -> DataFrame:
    """A file stream over the table ``<sf_dir>/<name>.parquet``: the table's own
    folder of part files, where new ones are picked up by later triggers, or a
    single file of that name."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    r = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getFileStatus(target).isDirectory():
        return r.parquet(path)
    return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def stream_dir(spark: SparkSession) -> str:
    return scratch_path(spark, "streams")


@contextmanager
def settings(spark: SparkSession, conf: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the time being; a query keeps those it starts with."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available_now(df: DataFrame, mode: str = "append", fmt: str = "parquet",
                      foreach_batch=None, base: str | None = None, conf: Mapping[str, str] | None = None) -> str:
    """Run a streaming query over everything available now, exactly once into
    a file sink (or ``foreach_batch``), under the settings ``conf``; returns the
    output path."""
    base = base or stream_dir(df.sparkSession)
    w = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/chk")
         .trigger(availableNow=True))
    if foreach_batch is not None:
        w = w.foreachBatch(foreach_batch)
    else:
        w = w.format(fmt).option("path", f"{base}/out")
    with settings(df.sparkSession, conf or {}):
        q = w.start()
    q.awaitTermination()
    return f"{base}/out"


def run_updates(df: DataFrame, base: str | None = None, conf: Mapping[str, str] | None = None) -> str:
    """Run a stateful stream in update mode: every micro-batch writes the rows it
    changed to a folder of its own (overwritten on a retry), so windows that the
    watermark hasn't closed are there too. Read the result with ``latest``."""
    base = base or stream_dir(df.sparkSession)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch_id={batch_id}")
    run_available_now(df, mode="update", foreach_batch=write, base=base, conf=conf)
    return f"{base}/out"


def update_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The updates that ``run_updates`` writes to ``path``, as a stream of their
    own; a retried batch comes again."""
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(path)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key, the row of the last batch that changed it."""
    values = [c for c in updates.columns if c not in keys and c != "batch_id"]
    newest = updates.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
