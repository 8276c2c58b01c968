"""The mixing stage: what is kept against the targets, and rows that share an id."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.llm import mixing


@pytest.fixture(scope="module")
def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rated(docs, labels, *columns, factors=mixing.FACTORS):
    rows = mixing.with_posteriors(docs, mixing.learn(docs, labels)).cache()
    rate, _ = mixing.solve_rates(rows, factors, factors=True)
    return rows.select(*columns, "_tokens", rate.alias("rate"), *(f"_p_{d}" for d in factors)).collect()


def test_kept_totals_meet_targets(documents, labels):
    rows = rated(documents, labels, "doc_id")
    kept = Counter(r.doc_id for r in mixing.mixed_documents(documents, labels).collect())
    assert max(kept.values()) > 1
    assert all(math.floor(r.rate) <= kept[r.doc_id] <= math.ceil(r.rate) for r in rows)
    for domain, factor in mixing.FACTORS.items():
        weights = [r._tokens * r[f"_p_{domain}"] for r in rows]
        got = sum(w * kept[r.doc_id] for w, r in zip(weights, rows))
        spread = math.sqrt(sum(w * w * (r.rate % 1) * (1 - r.rate % 1) for w, r in zip(weights, rows)))
        assert abs(got - factor * sum(weights)) < 4 * spread + 1e-3 * sum(weights), domain


def test_rows_of_one_id_are_drawn_each_for_itself(documents, labels):
    docs = documents.union(documents.withColumn("doc_id", F.lit(None).cast("long")))
    factors = {"clean": 0.6, "toxic": 0.3}
    kept = {r.text for r in mixing.mixed_documents(docs, labels, factors).where("doc_id is null").collect()}
    rows = [r for r in rated(docs, labels, "doc_id", "text", factors=factors) if r.doc_id is None and r.rate < 1]
    # with one draw for all of them, the rates of those kept would all lie above the others
    assert min(r.rate for r in rows if r.text in kept) < max(r.rate for r in rows if r.text not in kept)


def test_equal_rows_get_their_rate_together(documents, labels):
    docs = documents
    for _ in range(4):
        docs = docs.union(docs)
    want = Counter()
    for r in rated(docs, labels, "doc_id"):
        want[r.doc_id] += r.rate
    kept = Counter(r.doc_id for r in mixing.mixed_documents(docs, labels).collect())
    assert all(abs(kept[k] - x) < 1 + 1e-6 for k, x in want.items())
