"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hidden_markov, media, near_duplicates, oracles, packing, quality_rules, secret_scans, sentence_pieces, sharding, toxicity, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure(_table(spark, sf_dir, "documents"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.scan(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join(_table(spark, sf_dir, "documents"))


def op3_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(_table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; all machines have it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digest(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(_table(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_quality_rules, op2_secret_scans, op3_hidden_markov_lm, op4_wrapper_induction, op5_sentence_pieces, op6_histogram_sort, op7_media_columns, op8_best_fit_packing, op9_toxicity, op10_jaccard_join)
    return {f.__name__: f for f in found} | oracles.QUERIES


def oracle_sql() -> dict[str, str]:
    return oracles.SQL
