"""The run log (A12, E9): one JSON line a run, keyed by what the run is of.

A run's id is made of the data's fingerprint and the run's settings, so a log may
hold runs of many data sets and states: a run that is already in the log is not
written again, and the best run of one data set is found among its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textpulse.sources.sinks import append_json, read_json_log

RUN_SCHEMA = ("run_id string, data string, requested bigint, sample_size bigint, status string, accuracy double, "
              "f1_score double, error string")


def data_id(fingerprints: DataFrame) -> str:
    """One digest of the fingerprints of the tables a run reads (few rows)."""
    rows = F.sort_array(F.collect_list(F.to_json(F.struct(*sorted(fingerprints.columns)))))
    return fingerprints.agg(F.md5(F.to_json(rows)).alias("d")).first()["d"]


def keyed(runs: DataFrame, data: str, settings: Sequence[str]) -> DataFrame:
    """``runs`` with ``data`` and ``run_id``."""
    return runs.withColumn("data", F.lit(data)).withColumn("run_id", F.md5(F.to_json(F.struct("data", *settings))))


def append_runs(runs: DataFrame, path: str, schema: str = RUN_SCHEMA) -> None:
    """Append the runs that the log doesn't have yet."""
    known = read_json_log(runs.sparkSession, path, schema).select("run_id").distinct()
    new = runs.dropDuplicates(["run_id"]).join(known, "run_id", "left_anti")
    append_json(new.select(*[c.split()[0] for c in schema.split(", ")]), path)


def read_runs(spark: SparkSession, path: str, data: str | None = None, schema: str = RUN_SCHEMA) -> DataFrame:
    """The runs of one data set, or all."""
    log = read_json_log(spark, path, schema)
    return log if data is None else log.where(F.col("data") == data)


def best(runs: DataFrame) -> DataFrame:
    """The run with the best accuracy; ties: the larger sample, then the id."""
    return runs.where("status = 'ok' AND accuracy IS NOT NULL").orderBy(
        F.desc("accuracy"), F.desc("sample_size"), "run_id").limit(1)
