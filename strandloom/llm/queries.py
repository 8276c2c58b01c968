"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import branch_merge, embedding_dedup, hard_negatives, jaccard_join, kneser_ney, line_dedup, mixing, oracles, pii, quality_classifier, quality_rules, sentencepiece_codec, sharding, substring_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_int8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.similar_vectors(_table(spark, sf_dir, "embeddings"))


def op2_voronoi_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_report(_table(spark, sf_dir, "documents"))


def op3_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece_merge_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(_table(spark, sf_dir, "documents"), piece_model())


def op5_preference_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_doubling_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_soft_membership_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_kneser_ney_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_documents(_table(spark, sf_dir, "documents"))


def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op10_line_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(_table(spark, sf_dir, "documents"))


def op11_common_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(_table(spark, sf_dir, "documents"))


def op12_vantage_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.negatives_report(_table(spark, sf_dir, "embeddings"))


def op13_native_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branch_merge.merge_report(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_int8_embedding_dedup,
        op2_voronoi_jaccard_join,
        op3_bootstrapped_pii,
        op4_sentencepiece_merge_rounds,
        op5_preference_quality,
        op6_doubling_substring_dedup,
        op7_soft_membership_mixing,
        op8_kneser_ney_scoring,
        op9_hash_tree_sharding,
        op10_line_quality_rules,
        op11_common_line_dedup,
        op12_vantage_hard_negatives,
        op13_native_branch_merge,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """None for personal data, SentencePiece, the learnt models and mixing: tests hold those against brute force, the library, or held-out rows."""
    return {
        "op1_int8_embedding_dedup": oracles.VECTORS,
        "op2_voronoi_jaccard_join": oracles.DOCUMENTS,
        "op6_doubling_substring_dedup": oracles.SUBSTRINGS,
        "op9_hash_tree_sharding": oracles.SHARDS,
        "op10_line_quality_rules": oracles.RULES,
        "op11_common_line_dedup": oracles.LINES,
        "op12_vantage_hard_negatives": oracles.NEGATIVES,
        "op13_native_branch_merge": oracles.MERGE,
    }
