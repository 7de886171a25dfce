"""The text pipeline: identify, deduplicate, decontaminate, redact, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from blockloom.llm.decontaminate import remove_contaminated
from blockloom.llm.jaccard import keep_one
from blockloom.llm.langid import keep_identified
from blockloom.llm.pii import redact
from blockloom.llm.queries import packed, ready, table
from blockloom.session import ensure_checkpoint_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models, fitted on these documents, don't reject."""
    ready(spark)
    return keep_identified(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ready(spark)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ready(spark)
    return remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in them replaced by its kind."""
    ready(spark)
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of the packed sequences."""
    ready(spark)
    return packed(docs)


STAGES = [("language_id", language_id), ("jaccard_join", jaccard_join), ("decontamination", decontamination), ("pii", pii), ("packing", packing)]
ORACLE_SQL = None  # models, sketches, bootstrapping and tokenizers aren't SQL; tests/llm compares the operators with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage but the last is written to the checkpoint folder and read again."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
