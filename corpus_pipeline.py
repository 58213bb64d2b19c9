"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Language ID drops documents without an identified language; the Jaccard join
keeps the document with the least id of each near-duplicate class;
decontamination drops documents that hold a benchmark item; mixing orders the
rest by target weights, so that each written file is a stretch of the mix;
sharding names each document's shard. No stage samples or caps its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import decontamination, language_id, mixing, ngram_join, sharding
from panelforge.llm.common import materialize, read

#: Spark's setting for the bytes of an Arrow batch that goes to a Python worker, its default, and what the stages use: JVM and worker both hold each batch.
LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT = f"{64 << 20}b"
BATCH_BYTES = f"{8 << 20}b"
#: Where SQL can express a stage: none of language ID and mixing can be.
ORACLE_SQL = None


def bound_batches(spark: SparkSession) -> None:
    """Bound this session's Arrow batches by bytes: their rows are whole texts or packed blobs. Where the session has its own limit, that stays."""
    if spark.conf.get(LIMIT, DEFAULT) == DEFAULT:
        spark.conf.set(LIMIT, BATCH_BYTES)


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; those without a letter or with a score under 0.5 go."""
    bound_batches(spark)
    langs, model = language_id.learn(docs.select("doc_id", "text", "lang"))
    return language_id.keep_identified(docs, langs, model)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    bound_batches(spark)
    return ngram_join.keep_one(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixed order: each partition, hence each file, is a stretch of the mix."""
    return mixing.in_order(mixing.mix(docs), total=docs.count()).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard."""
    return sharding.place(docs)


STAGES = [("language_id", identify), ("ngram_jaccard_join", deduplicate), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
