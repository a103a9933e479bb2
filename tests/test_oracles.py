"""Spark queries against their DuckDB oracles (the driver's check) on sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from textpulse.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
# queries without SQL: what they return is checked in the other test files
NO_SQL = {"lr_test_predictions", "lr_test_metrics", "learning_curve", "best_run", "pruned_comparison"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def _optional():
    """Queries of the optional subpackage; they have tests of their own."""
    from textpulse.plans import catalog
    return set(E.queries()) - set(catalog.QUERIES)


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - _optional()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(scols) == sorted(ocols)
    assert _rows(srows, scols) == _rows(orows, ocols)


def test_every_query_has_docs_and_runs_registered():
    q = set(E.queries()) - _optional()
    assert len(q) >= 80
    assert q - set(E.oracle_sql()) == NO_SQL


def test_model_queries_run(spark):
    q = E.queries()
    pred = q["lr_test_predictions"](spark, SF).collect()
    facts = q["learning_curve_samples"](spark, SF).collect()
    assert pred and all(abs(r.p_negative + r.p_positive - 1) < 1e-9 for r in pred)
    runs = q["learning_curve"](spark, SF).collect()
    assert [(r.requested, r.sample_size) for r in runs] == sorted((r.requested, r.sample_size) for r in facts)
    assert all(r.status == "ok" and 0 <= r.accuracy <= 1 for r in runs)
    best = q["best_run"](spark, SF).first()
    assert best.accuracy == max(r.accuracy for r in runs)
    both = {r.variant: r for r in q["pruned_comparison"](spark, SF).collect()}
    assert both["pruned"].terms == 1000 and both["pruned"].size_reduction_pct > 0
    assert both["baseline"].accuracy_change == 0.0


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["feature", "psi", "status", "reference_rows", "production_rows"]
    assert df.count() == 3
