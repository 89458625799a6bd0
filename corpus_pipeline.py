"""A training-data pipeline over `documents`: each stage calls one operator and works on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm import decontaminate, line_dedup, minhash_forest, sentencepiece_viterbi, toxicity
from folioforge.llm.common import read, written


#: Rows that go to a Python worker, or come back, at a time: a few MB of texts, held by the executor outside its heap and by the worker.
BATCH = 1000


def in_small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above go."""
    in_small_batches(spark)
    return toxicity.keep_civil(docs, read(spark, sf_dir, "labels"))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line equals or nearly equals are cut out; documents of nothing else go."""
    in_small_batches(spark)
    kept = line_dedup.keep_first_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the first document stays."""
    in_small_batches(spark)
    return minhash_forest.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    in_small_batches(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, exact and ids of each document that is left."""
    in_small_batches(spark)
    return sentencepiece_viterbi.encode(docs).select("doc_id", "n_tokens", "exact", "ids")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_lines),
    ("jaccard_join", drop_copies),
    ("decontamination", drop_contaminated),
    ("sentencepiece", tokenize),
]
#: The classifier and the tokenizer have no SQL form; tests/llm holds each stage's rows against a brute-force version on its input.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of `documents`; each result but the last is written once and read again."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
