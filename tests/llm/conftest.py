import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

DATA = "/root/testdata/sf0.001"
# extra columns carry names that the operators use inside
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("key", StringType()), StructField("cls", IntegerType()), StructField("n", IntegerType()), StructField("host", StringType()), StructField("rank", IntegerType()), StructField("n_chars", LongType())])


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "ti", "sh", "ly", "ou"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(words))


def edge_rows() -> list[tuple]:
    texts = [None, "", " \t\n", "one", "two words", "a b c d e", prose(1, 300), prose(1, 300), prose(1, 299) + " tail", prose(2, 40), prose(3, 20_000), "é́Å😀 ｘ ñ ß " * 9, "x" * 5000, "line one is here\n" * 40, None]
    rows = [(i, t, "k", i, 1, "h", 0, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, prose(4, 50), None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (3, "another text with the id three", "k", 0, 0, "h", 0, 31)]
    return rows


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")
