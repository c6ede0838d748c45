"""The queries of this subpackage over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm import kneser_ney, knn, langid, mixing, ngram_join, packing, quality, secrets, sharding, toxicity
from spanforge.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"))


def op2_score_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_languages(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries are the vectors whose number is divisible by 20, against all vectors."""
    found = knn.nearest(table(spark, sf_dir, "embeddings"), is_query=F.col("vec_id") % 20 == 0)
    return found.withColumn("distance", F.round("distance", 6))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_score_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.score_perplexity(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {
        "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
        "op2_score_toxicity": op2_score_toxicity,
        "op3_language_spans": op3_language_spans,
        "op4_mix_sources": op4_mix_sources,
        "op5_shard": op5_shard,
        "op6_exact_top_k": op6_exact_top_k,
        "op7_pack": op7_pack,
        "op8_scan_secrets": op8_scan_secrets,
        "op9_score_quality": op9_score_quality,
        "op10_perplexity": op10_perplexity,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": ngram_join.oracle(),
        "op4_mix_sources": mixing.oracle(),
        "op5_shard": sharding.oracle(),
        "op6_exact_top_k": knn.oracle(),
    }
