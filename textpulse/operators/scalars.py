"""Attach the values of a one-row aggregate to every row of a frame.

Written as one scalar subquery (a struct of all columns, computed once per
query) instead of a join, so no plan holds a cross product."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """``df`` plus every column of ``one_row`` (which has exactly one row)."""
    s = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.select("*", *[s[c].alias(c) for c in one_row.columns])
