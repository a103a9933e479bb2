"""Registry of named queries: each one is a Spark plan over the driver tables
plus (where SQL can express it) an independent DuckDB SQL oracle.

The Spark side is built from the library operators; the SQL side is written
the plain way (global windows, row_number, joins) so the two are independent
implementations of the same semantics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from textpulse.plans import (  # noqa: F401
        q_cleaning, q_drift, q_sampling, q_evaluation, q_monitoring, q_features, q_model,
        q_sources, q_streaming,
    )
