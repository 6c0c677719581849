"""A corpus pipeline: toxicity, quality, near duplicates, secrets, packing.

run() applies the stages to documents; each stage's rows are written as Parquet and read again as
the next one's documents. The first four return the columns of documents: the first three drop rows,
and secret scans replace secrets in the text. The last returns the pieces of the packed sequences.

Further columns of any name pass through the first four stages unread. An empty table stays empty.
Repeated rows are judged alike; near duplicates keep one of them. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from smoothlake.llm import near_duplicates, packing, quality_rules, scratch, secret_scans, toxicity
from smoothlake.llm.entry import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learnt from the labelled ones among them, scores below one half. Null and empty texts have the score of no words, which stays."""
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep the base rules and the compression bands. Null and empty texts go."""
    return quality_rules.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the least id, of each group of near copies; of rows with that id and text, one. A null id comes last. Texts without words stay."""
    return near_duplicates.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark. Null texts stay null."""
    return secret_scans.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places. A null or empty text is a piece of one token."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("near_duplicates", drop_near_copies),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]

# Models, MinHash candidates, compression ratios and a tokenizer have no SQL form; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's own tables and its input are deleted once its rows are written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.owned() as tables:
        for k, (name, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = scratch.save(docs, f"pipeline-{name}")
                scratch.release(spark, tables, but=docs)
    return docs
