from collections import Counter

import duckdb
import pytest

from strandloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    frame = queries.queries()[name](spark, sf_dir)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    columns = sorted(frame.columns)
    assert columns == sorted(names)
    want = Counter(tuple(dict(zip(names, row))[c] for c in columns) for row in cursor.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == want


def test_pipeline_runs_stage_by_stage(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kinds, before = docs.dtypes, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.dtypes == kinds, name
        docs = spark.createDataFrame(out.collect(), out.schema)
        assert 0.5 * before < docs.count() <= before, name
    assert len(corpus_pipeline.STAGES) == 5
    assert corpus_pipeline.run(spark, sf_dir).count() > 0.5 * before
