import pytest

from strandloom.llm import jaccard_join, mixing, pii, quality_classifier, quality_rules

NAMES = "score predicted found gone kept row set n_words tokens rate key base region component_id n a b h starts _row _at key2".split()


@pytest.mark.parametrize("name", ["quality", "jaccard", "pii", "mix", "clean"])
def test_columns_and_values_stay(spark, sf_dir, name):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents.selectExpr("*", *(f"concat('{n}', doc_id) as {n}" for n in NAMES))
    run = {
        "quality": lambda d: quality_classifier.good_documents(d, labels),
        "jaccard": jaccard_join.one_of_each,
        "pii": pii.mask_documents,
        "mix": lambda d: mixing.mixed_documents(d, labels),
        "clean": quality_rules.clean,
    }[name]
    out = run(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in run(documents).collect())
