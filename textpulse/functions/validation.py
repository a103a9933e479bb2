"""Request validation (B17) as column expressions: accepted rows and a
quarantine reason instead of exceptions, so one bad text never fails a job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textpulse.functions.text import WS_SET

# ---- fixed values ---------------------------------------------------------
MAX_TEXT_CHARS = 10_000
MIN_BATCH = 1
MAX_BATCH = 128
REASON_MISSING = "missing"
REASON_BLANK = "blank"
REASON_TOO_LONG = "too_long"
# ---------------------------------------------------------------------------

_EDGE_WS = f"^[{WS_SET}]+|[{WS_SET}]+$"


def strip_unicode(text: Column) -> Column:
    """str.strip(): remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(text, _EDGE_WS, "")


def validate_request(text: Column, stripped_length: bool = False) -> dict[str, Column]:
    """A single request's limit holds for the text as sent, before the
    strip; a batch's (``stripped_length``) for the stripped text."""
    stripped = strip_unicode(F.coalesce(text, F.lit("")))
    reason = (F.when(text.isNull(), F.lit(REASON_MISSING))
               .when(F.length(stripped) == 0, F.lit(REASON_BLANK))
               .when(F.length(stripped if stripped_length else text) > MAX_TEXT_CHARS, F.lit(REASON_TOO_LONG)))
    return {"stripped": stripped, "reject_reason": reason}


def validate_batches(df: DataFrame, batch_col: str, text_col: str) -> DataFrame:
    """One row per batch: size, invalid texts, accepted flag (size 1..128 and
    every text valid). Partial aggregation keeps a hot batch id cheap."""
    bad = validate_request(F.col(text_col), stripped_length=True)["reject_reason"].isNotNull()
    agg = df.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_texts"),
                                    F.count(F.when(bad, 1)).alias("n_invalid"))
    return agg.select(batch_col, F.col("n_texts").cast("bigint").alias("n_texts"),
                      F.col("n_invalid").cast("bigint").alias("n_invalid"),
                      (F.col("n_texts").between(MIN_BATCH, MAX_BATCH) & (F.col("n_invalid") == 0))
                      .alias("accepted"))


def sql_validate_request(text: str, stripped_length: bool = False) -> str:
    s = f"regexp_replace(coalesce({text}, ''), '{_EDGE_WS}', '', 'g')"
    return (f"(CASE WHEN {text} IS NULL THEN '{REASON_MISSING}' WHEN length({s}) = 0 THEN '{REASON_BLANK}' "
            f"WHEN length({s if stripped_length else text}) > {MAX_TEXT_CHARS} THEN '{REASON_TOO_LONG}' END)")
