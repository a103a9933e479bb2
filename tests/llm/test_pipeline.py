"""The pipeline against a plain version of its stages, and its stages on odd rows."""

import llm_brute as brute
import corpus_pipeline
from test_learned_operators import check_packing
from textpulse.llm import quality
from textpulse.llm.common import table

SF = "/root/testdata/sf0.001"


def plain(spark, docs, labels, items):
    """doc_id to text after the four filtering stages."""
    model = quality.learn(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if model.scores(*quality.encode([(t or "").encode()]))[0] >= quality.THRESHOLD]
    rows = [(d, kept) for d, _, _, kept in brute.line_dedup(rows)]
    first = {d for d, _, name in brute.simhash(rows) if d == name}
    rows = [(d, t) for d, t in rows if d in first]
    return [(d, t) for (d, t), mark in zip(rows, brute.contamination(rows, items)) if not mark[-1]]


def test_pipeline_matches_plain_stages(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = plain(spark, docs, labels, items)
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {p.doc_id for p in pieces} == {d for d, _ in want}
    check_packing(pieces, [t for _, t in want])


def test_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs = brute.frame(spark)
    spark.createDataFrame([(1, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "rest of it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    lines = corpus_pipeline.dedup_lines(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text or "", r.n_chars) for r in lines))) == \
        sorted(map(repr, ((d, k, len(k)) for d, _, _, k in brute.line_dedup(brute.TEXTS))))
    kept = corpus_pipeline.dedup_documents(spark, docs, str(tmp_path)).collect()
    names = {d for d, _, n in brute.simhash(brute.TEXTS) if d is not None and d == n}
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted(names)
    assert sum(r.doc_id is None for r in kept) == 2
