"""The registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, lexical_search, license_rules, line_dedup, minhash_forest, packing, quality_compression, secret_markov, sentencepiece_viterbi, suffix_tree_lm, toxicity, url_cascade, vector_codes
from .common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_compression.compression_quality(read(spark, sf_dir, "documents"))


def op2_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return url_cascade.cascade_filter(pages, url_cascade.tracked_keys(pages))


def op3_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.license_scan(read(spark, sf_dir, "documents"))


def op4_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.jaccard_join(read(spark, sf_dir, "documents"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentencepiece_viterbi.encode(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_tokens", "exact", "ids")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_markov.secret_scan(read(spark, sf_dir, "documents"))


def op9_deletion_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(read(spark, sf_dir, "documents"))


def op10_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree_lm.lm_scores(read(spark, sf_dir, "documents"))


def op11_exponion_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(read(spark, sf_dir, "embeddings"))


def op12_windowed_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_monotone_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(read(spark, sf_dir, "documents"))
    return packed.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")


def queries() -> dict[str, Query]:
    own = (op1_compression_bands, op2_bloom_cascade, op3_license_rules, op4_minhash_forest, op5_counterfactual_toxicity, op6_sentencepiece_viterbi, op7_spaced_seeds, op8_markov_secrets, op9_deletion_neighbours, op10_suffix_tree_lm, op11_exponion_codes, op12_windowed_scoring, op13_monotone_packing)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_bloom_cascade": url_cascade.SQL, "op9_deletion_neighbours": line_dedup.SQL, "op12_windowed_scoring": lexical_search.SQL}
