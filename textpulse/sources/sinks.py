"""File sources and sinks.

Every log is an append-only folder of files (JSON lines or CSV) written by
Spark tasks, so batch readers and ``readStream`` read the same data; every
reader has an explicit schema (no inference pass over the data).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textpulse.functions.labels import stars_to_sentiment
from textpulse.functions.text import LABEL_COLUMNS, TEXT_COLUMNS, first_present
from textpulse.functions.validation import validate_request
from textpulse.operators.sampling import cap_per_class
from textpulse.session import materialize

# ---- fixed values ---------------------------------------------------------
REVIEW_CSV_COLUMNS = ("text", "label")
STAR_JSON_SCHEMA = "text string, stars double, _bad string"
FEEDBACK_SCHEMA = "timestamp string, text string, prediction string, true_label string, confidence double"
INFERENCE_LOG_SCHEMA = "timestamp string, text string, prediction string, latency_ms double"
FEEDBACK_CSV_SCHEMA = ("timestamp string, text string, predicted_label string, correct_label string, "
                       "is_accurate string, notes string")
ALERT_SCHEMA = "timestamp string, type string, severity string, message string, meta string"
HEALTH_SCHEMA = ("timestamp string, request_count bigint, prediction_count bigint, feedback_count bigint, "
                 "average_latency_ms double, last_request_at string")
# ---------------------------------------------------------------------------


def read_review_csv(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """A1: review CSV as ``(text, sentiment)``, whatever of the known names its
    columns have (B1); rows missing either are left out. Columns are strings, named
    by the header line, which alone is read for that. ``multi_line`` allows line
    breaks in quoted fields, at the price of one task per file."""
    names = spark.read.option("header", False).csv(path).first()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names or REVIEW_CSV_COLUMNS])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"')
          .csv(path))
    text, label = first_present(df.columns, TEXT_COLUMNS), first_present(df.columns, LABEL_COLUMNS)
    return df.select(F.col(text).alias("text"), F.col(label).alias("sentiment")).where(
        F.col("text").isNotNull() & F.col("sentiment").isNotNull())


def write_review_csv(df: DataFrame, path: str) -> None:
    """A1: reviews as quoted CSV that ``read_review_csv`` reads back as they are."""
    (df.write.mode("append").option("header", True).option("quoteAll", True).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_star_reviews(spark: SparkSession, path: str, max_per_class: int | None = None,
                      max_lines: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A2: JSON lines with ``text`` and ``stars``; broken lines and rows missing
    either field are skipped; returns ``(rows with sentiment, line counts)``. Lines
    are read once, with an id each, and counted as they pass. ``max_lines`` takes
    the first raw lines only (A3): by file name and place in the file, which one
    running count over the files' sizes decides. ``max_per_class`` caps the rows of
    each class in seeded hash order of the text (C3); the line's id breaks ties, so
    equal texts don't exceed it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"),
                                         F.monotonically_increasing_id().alias("_id"))
    if max_lines is not None:
        lines = first_lines(lines, max_lines)
    raw = lines.select("_id", F.from_json("value", STAR_JSON_SCHEMA, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("_id", "r.*")
    seen = Observation()
    raw = raw.observe(seen, F.count(F.when(F.col("_bad").isNotNull(), 1)).alias("bad_lines"),
                      F.count(F.when(F.col("_bad").isNull() & F.col("text").isNotNull(), 1)).alias("text_lines"))
    good = raw.where(F.col("_bad").isNull() & F.col("text").isNotNull() & F.col("stars").isNotNull())
    rows = materialize(good.select("_id", "text", "stars", stars_to_sentiment(F.col("stars")).alias("sentiment")))
    counts = spark.createDataFrame([(seen.get["bad_lines"], seen.get["text_lines"])], "bad_lines bigint, text_lines bigint")
    if max_per_class is not None:
        rows = cap_per_class(rows, "sentiment", "_id", max_per_class, order_col="text")
    return rows.drop("_id"), counts


def first_lines(lines: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows of ``(_file, _id, ...)`` by file and place, ids rising
    within a file: files before the cut are taken whole, and of the one file where
    it falls the rows up to an id."""
    lines = materialize(lines)
    sizes = lines.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    quota = materialize(sizes.select("_file", "_n", F.least(F.col("_n"), F.greatest(
        F.lit(0), F.lit(n) - F.coalesce(before, F.lit(0)))).alias("_take")))
    whole = lines.join(quota.where("_take = _n").select("_file"), "_file", "left_semi")
    part = quota.where("_take > 0 AND _take < _n").select("_file", "_take").first()  # one file at most
    if part is None:
        return whole
    return whole.unionByName(lines.where(F.col("_file") == part["_file"]).orderBy("_id").limit(part["_take"]))


def append_json(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines (one file per task)."""
    df.write.mode("append").json(path)


def read_json_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A missing log reads as empty."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as ex:
        if ex.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def write_feedback_csv(df: DataFrame, path: str) -> None:
    """Feedback CSV; nulls written as empty strings."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in
            ("timestamp", "text", "predicted_label", "correct_label", "is_accurate", "notes")]
    df.select(*cols).write.mode("append").option("header", True).csv(path)


def read_feedback_csv(spark: SparkSession, path: str) -> DataFrame:
    """Empty strings read back as nulls; ``is_accurate`` as boolean."""
    df = spark.read.schema(FEEDBACK_CSV_SCHEMA).option("header", True).csv(path)
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) for c in df.columns]).withColumn(
        "is_accurate", F.col("is_accurate").cast("boolean"))


def stamped_alerts(alerts: DataFrame) -> DataFrame:
    """A10: alerts with the time of writing; ``meta`` is ``{}`` where there is
    none, an ``alert_id`` is kept."""
    return alerts.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"),
                         "type", "severity", "message",
                         (F.col("meta") if "meta" in alerts.columns else F.lit("{}")).alias("meta"),
                         *([F.col("alert_id")] if "alert_id" in alerts.columns else []))


def write_alerts(alerts: DataFrame, path: str, overwrite: bool = False) -> None:
    """A10: alerts as JSON lines (appended, or owning ``path`` when ``overwrite``:
    the idempotent form for micro-batches)."""
    if overwrite:
        stamped_alerts(alerts).write.mode("overwrite").json(path)
    else:
        append_json(stamped_alerts(alerts), path)


def write_feedback(df: DataFrame, path: str) -> None:
    """Feedback records as JSON lines, with the time of writing."""
    append_json(_stamped(df, FEEDBACK_SCHEMA), path)


def write_inference_log(df: DataFrame, path: str) -> None:
    """Scored texts as JSON lines."""
    append_json(_stamped(df, INFERENCE_LOG_SCHEMA), path)


def write_health(snapshot: DataFrame, path: str) -> None:
    """A service snapshot as one JSON line."""
    append_json(_stamped(snapshot, HEALTH_SCHEMA), path)


def _stamped(df: DataFrame, schema: str) -> DataFrame:
    """The columns of ``schema``, ``timestamp`` being now where ``df`` has none."""
    names = [c.split()[0] for c in schema.split(", ")]
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return df.select(*[now.alias(c) if c == "timestamp" and c not in df.columns else F.col(c) for c in names])


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as a single JSON document."""
    report.coalesce(1).write.mode("overwrite").json(path)


def write_splits(split_df: DataFrame, path: str) -> str:
    """A5: idempotent write of the train/test splits partitioned by ``split``;
    an existing output is left alone (``ignore``) -> 'skipped'."""
    spark = split_df.sparkSession
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/split=train")) and \
        fs.exists(jvm.org.apache.hadoop.fs.Path(path + "/split=test"))
    if done:
        return "skipped"
    split_df.write.mode("overwrite").partitionBy("split").parquet(path)
    return "written"


def write_validated(df: DataFrame, text_col: str, path: str, mode: str = "append", partition: str = "") -> None:
    """One pass over ``df`` that writes two tables below ``path``: the
    accepted rows, with the stripped text, and the quarantined rows, with the text
    as sent and the reason. Every row lands in one of them. ``partition`` is a
    sub-folder of both (a micro-batch's own)."""
    checked = validate_request(F.col(text_col))
    rows = df.withColumn("reject_reason", checked["reject_reason"])
    rows = rows.withColumn("accepted", F.col("reject_reason").isNull())
    rows = rows.withColumn(text_col, F.when(F.col("accepted"), checked["stripped"]).otherwise(F.col(text_col)))
    rows.write.mode(mode).partitionBy("accepted").parquet(f"{path}/{partition}".rstrip("/"))


def validated_sink(text_col: str, path: str):
    """B17 as a ``foreachBatch`` function: a folder a batch, overwritten when the
    batch is retried."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_validated(batch, text_col, path, "overwrite", f"batch_id={batch_id}")
    return write


def read_accepted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The accepted rows of ``write_validated``; ``schema`` is that of its input."""
    return _validated(spark, path, schema, True).select(*schema.names)


def read_quarantine(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The quarantined rows and why (``reject_reason``)."""
    return _validated(spark, path, schema, False).select(*schema.names, "reject_reason")


def _validated(spark: SparkSession, path: str, schema: T.StructType, accepted: bool) -> DataFrame:
    columns = T.StructType([*schema.fields, T.StructField("reject_reason", T.StringType()),
                            T.StructField("accepted", T.BooleanType())])
    return spark.read.schema(columns).option("basePath", path).parquet(path).where(F.col("accepted") == F.lit(accepted))
