"""The corpus pipeline: from ``documents`` to token ids of clean, distinct texts.

Toxic documents go, of near copies one stays, documents that hold a benchmark item go, personal data is replaced,
and what is left is encoded. Each stage reads the table its predecessor wrote. All but the last return the
columns of documents; the last returns doc_id, ids (little-endian 32-bit numbers), n_tokens, ids_sha256 and
decoded_sha256.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagewatch.llm import bpe, decontamination, jaccard_join, pii, toxicity
from stagewatch.llm.common import prepare, stored, table
from stagewatch.llm.registry import query

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below a half; the model learns from the labelled documents."""
    return toxicity.acceptable(docs, table(prepare(spark), sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the least doc_id."""
    prepare(spark)
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontamination.clean_documents(docs, table(prepare(spark), sf_dir, "benchmark"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with each personal span replaced by its kind."""
    prepare(spark)
    return pii.redacted(docs, pii.fit(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    prepare(spark)
    return bpe.bpe_encode(docs).withColumn("ids_sha256", F.sha2("ids", 256))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal),
    ("bpe", encode),
]

#: The toxicity model, the span classifier and the encoder are beyond SQL.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
