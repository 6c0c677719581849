"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FORMATS = ("parquet", "orc", "csv", "json")


def table(spark: SparkSession, where: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables."""
    return spark.read.parquet(f"{where}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table of one of the formats; CSV and JSON need a schema, so that nothing is read twice to infer one."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}")
    if kind in ("csv", "json") and not schema:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}")
    df.write.format(kind).mode(mode).partitionBy(*partition_by).save(path)
