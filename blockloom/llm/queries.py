"""The text operators as registered queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockloom.llm import oracles
from blockloom.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Session settings of these queries: small Arrow batches, as rows are whole texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def registered(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return build(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@registered("op5_quality_rules", oracles.QUALITY)
def op5(spark, sf_dir):
    from blockloom.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@registered("op1_token_counts")
def op1(spark, sf_dir):
    from blockloom.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@registered("op2_language_id")
def op2(spark, sf_dir):
    from blockloom.llm.langid import identify

    return identify(table(spark, sf_dir, "documents"))


@registered("op9_pii")
def op9(spark, sf_dir):
    from blockloom.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_id")


def packed(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    from blockloom.llm.packing import pack

    return pack(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@registered("op10_retrieval_packing")
def op10(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"))


@registered("op6_decontamination")
def op6(spark, sf_dir):
    from blockloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@registered("op7_jaccard_join", oracles.JACCARD)
def op7(spark, sf_dir):
    from blockloom.llm.jaccard import similar

    return similar(table(spark, sf_dir, "documents"))


@registered("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@registered("op8_html_extraction")
def op8(spark, sf_dir):
    from blockloom.llm.extract import extract

    return extract(table(spark, sf_dir, "pages"))


@registered("op4_lm_scoring", oracles.LM_SCORES)
def op4(spark, sf_dir):
    from blockloom.llm.lm_score import lm_scores

    return lm_scores(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


@registered("op3_suffix_dedup")
def op3(spark, sf_dir):
    from blockloom.llm.substrings import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


@registered("op12_periodic_runs")
def op12(spark, sf_dir):
    from blockloom.llm.periodic import periodic_runs

    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=True).drop("n_words")


@registered("op13_embedding_whitening")
def op13(spark, sf_dir):
    from blockloom.llm.whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


@registered("op11_toxicity")
def op11(spark, sf_dir):
    from blockloom.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "held_out", "score", "predicted",
        F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"]))).alias("spans"))
