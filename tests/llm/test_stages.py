"""Every stage of the pipeline on odd rows, extra columns and empty tables."""

import pytest

import corpus_pipeline


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, sf_dir, awkward, empty, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    clashing = awkward.selectExpr("*", "'s' as source", "'en' as lang", "1L as n_chars", "text as _text", "'x' as _copy", "'y' as set", "'z' as region", "'k' as key", "'w' as kept")
    out = stage(spark, clashing, sf_dir)
    rows = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert last or out.columns == clashing.columns
    known = {r.doc_id for r in awkward.collect()}
    assert {r.doc_id for r in rows} <= known and (last or all(r.key == "k" and r.kept == "w" for r in rows))
    if name in ("personal data", "SentencePiece encoding"):
        assert len(rows) == 10
    if name == "n-gram Jaccard join":
        assert sorted(str(r.doc_id) for r in rows) == sorted(map(str, [1, 2, 3, 4, 5, None, 7, 8, 9]))
    assert stage(spark, empty, sf_dir).count() == 0
