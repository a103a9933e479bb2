"""Reusable DuckDB SQL fragments for the oracle strings."""

from __future__ import annotations

from textpulse.functions.text import (sql_avg_word_length, sql_char_length, sql_clean,
                                      sql_word_count)
from textpulse.sources.tables import SQL_VIEWS


def cleaned_docs(where: str = "TRUE") -> str:
    """``(doc_id, lang, text, cleaned_text)`` of documents, empty cleaned rows dropped."""
    return (f"(SELECT * FROM (SELECT doc_id, lang, text, {sql_clean('text')} AS cleaned_text "
            f"FROM documents WHERE {where}) WHERE length(cleaned_text) > 0)")


def feature_rows(src: str, col: str) -> str:
    """``(feature, value)`` rows of the three text features of ``src.col``."""
    w = (f"(SELECT CAST({sql_char_length(col)} AS DOUBLE) AS f1, "
         f"CAST({sql_word_count(col)} AS DOUBLE) AS f2, "
         f"CAST({sql_avg_word_length(col)} AS DOUBLE) AS f3 FROM {src})")
    return (f"(SELECT 'char_length' AS feature, f1 AS value FROM {w} "
            f"UNION ALL SELECT 'word_count', f2 FROM {w} "
            f"UNION ALL SELECT 'avg_word_length', f3 FROM {w})")


def psi_sql(ref_rows: str, prod_rows: str, buckets: int = 10, prod_keys: tuple[str, ...] = ()) -> str:
    """PSI per feature (and key) the direct way: row_number quantiles."""
    k = "".join(f"{c}, " for c in prod_keys)
    kp = "".join(f"pf.{c}, " for c in prod_keys)
    kg = "".join(f"g.{c}, " for c in prod_keys)
    kj = "".join(f" AND pb.{c} = g.{c}" for c in prod_keys)
    return f"""
WITH rf AS (SELECT feature, value FROM {ref_rows} WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'Infinity'::DOUBLE),
pf AS (SELECT {k}feature, value FROM {prod_rows} WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 'Infinity'::DOUBLE),
rs AS (SELECT feature, count(*) AS n, min(value) AS vmin, max(value) AS vmax FROM rf GROUP BY feature),
ro AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS rk FROM rf),
tg AS (SELECT rs.feature, t.i, CAST((rs.n - 1) * t.i AS DOUBLE) / {buckets} AS pos FROM rs, range(0, {buckets + 1}) t(i)),
qv AS (SELECT tg.feature, round(lo.value + (hi.value - lo.value) * (tg.pos - floor(tg.pos)), 9) AS edge
       FROM tg JOIN ro lo ON lo.feature = tg.feature AND lo.rk = floor(tg.pos)
               JOIN ro hi ON hi.feature = tg.feature AND hi.rk = ceil(tg.pos)),
ed AS (SELECT feature, list_sort(list_distinct(list(edge))) AS qedges FROM qv GROUP BY feature),
ed2 AS (SELECT ed.feature, rs.n,
          CASE WHEN len(qedges) <= 2 THEN
            [round(vmin + i * ((CASE WHEN vmax = vmin THEN vmin + 1.0 ELSE vmax END - vmin) / {buckets}), 9)
             FOR i IN range(0, {buckets + 1})]
          ELSE qedges END AS edges
        FROM ed JOIN rs ON ed.feature = rs.feature),
inn AS (SELECT feature, n, len(edges) - 1 AS bins, edges[2:len(edges) - 1] AS inner_edges FROM ed2),
rb AS (SELECT rf.feature, len(list_filter(inn.inner_edges, lambda e: rf.value >= e)) AS bucket, count(*) AS c
       FROM rf JOIN inn ON rf.feature = inn.feature GROUP BY ALL),
pb AS (SELECT {kp}pf.feature, len(list_filter(inn.inner_edges, lambda e: pf.value >= e)) AS bucket, count(*) AS c
       FROM pf JOIN inn ON pf.feature = inn.feature GROUP BY ALL),
pn AS (SELECT {k}feature, count(*) AS m FROM pf GROUP BY ALL),
grid AS (SELECT {"".join(f"pn.{c}, " for c in prod_keys)}inn.feature, inn.n, pn.m, t.b AS bucket
         FROM inn JOIN pn ON inn.feature = pn.feature, range(0, inn.bins) t(b)),
sh AS (SELECT {kg}g.feature, g.n, g.m,
         CASE WHEN coalesce(rb.c, 0) = 0 THEN {1e-6} ELSE rb.c / g.n END AS e,
         CASE WHEN coalesce(pb.c, 0) = 0 THEN {1e-6} ELSE pb.c / g.m END AS a
       FROM grid g LEFT JOIN rb ON rb.feature = g.feature AND rb.bucket = g.bucket
                   LEFT JOIN pb ON pb.feature = g.feature AND pb.bucket = g.bucket{kj}),
ps AS (SELECT {k}feature, sum((a - e) * ln(a / e)) AS psi_raw, any_value(n) AS n, any_value(m) AS m
       FROM sh GROUP BY ALL)
SELECT {k}feature, round(psi_raw, 6) AS psi,
       CASE WHEN psi_raw < 0.1 THEN 'No change' WHEN psi_raw <= 0.25 THEN 'Moderate shift'
            ELSE 'Significant shift' END AS status,
       CAST(n AS BIGINT) AS reference_rows, CAST(m AS BIGINT) AS production_rows
FROM ps"""


def view(name: str) -> str:
    return SQL_VIEWS[name]
