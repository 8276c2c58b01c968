"""A corpus from documents: quality, near copies, personal data, mixing and tokens, stage by stage.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and further columns; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import jaccard_join, mixing, pii, quality_classifier, sentencepiece_codec
from strandloom.llm.queries import piece_model
from strandloom.shipping import ship
from strandloom.sources.work import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the preference model doesn't reject. A null text is judged as an empty one; equal texts are judged alike; without labels of
    both kinds all stay; an empty table stays empty; columns as before."""
    ship(spark)
    return quality_classifier.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word Jaccard similarity 0.8 or more, that of least id. Rows without words and rows of a null id stay; a repeated
    row stays once; an empty table stays empty; columns as before."""
    ship(spark)
    return jaccard_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind in brackets. Every row stays, a null text null; equal rows change alike; an empty table stays empty; columns as
    before."""
    ship(spark)
    return pii.mask_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their rates for the target totals of domains say: a rate above 1 gives further copies. A null text is an empty one; n equal
    rows are one of n times the rate; without labels of two domains all stay; an empty table stays empty; columns as before."""
    ship(spark)
    return mixing.mixed_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every row: a null text is an empty one, repeated rows give equal results, an empty table none."""
    ship(spark)
    return sentencepiece_codec.encode_documents(docs, piece_model())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("mixing to target weights", mix),
    ("SentencePiece encoding", tokens),
]

#: The quality model, the mixing rates and SentencePiece can't be told in SQL; the stages are tested by themselves.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again but the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


