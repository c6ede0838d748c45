"""The pipeline over the table of documents: each stage works on all that the one before it kept.

Defined cases, stage by stage as its operator defines them: an empty table gives an empty one; null, empty and very long texts, null
ids, sources and languages go through (documents without text have no near duplicates, keep one copy of each in the mixture if their
source has no other text, and get a piece without a sequence); documents of which id and text repeat count as copies, and one of
them stays; columns besides those of documents are kept until the last stage, whatever their names, but for copy_no, which the
mixture drops.

A stage's result is written to the shared folder; it is deleted when the next one is written, and the last one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import mixing, ngram_join, packing, secrets, toxicity
from spanforge.llm.common import table
from spanforge.runtime import delete, shared_uri


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents that the toxicity classifier rejects."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that the n-gram Jaccard join links."""
    return ngram_join.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws documents so that the sources have equal shares of the text; a document drawn twice is there twice."""
    return mixing.mix_sources(docs).drop("copy_no")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents in sequences of fixed length."""
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: SQL can express neither the trained classifier nor column generation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = shared_uri(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            delete(spark, f"{base}/{k - 1}")
    return docs
