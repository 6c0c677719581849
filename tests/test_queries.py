"""Every query with SQL against DuckDB, the others for rows, and the entry points without the training-data subpackage."""

import subprocess
import sys

import duckdb
import pytest

from smoothlake import queries

from .conftest import ROOT

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted((tuple(r) for r in f[columns].astype(object).values.tolist()), key=str)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-5, rel=1e-6) if all(isinstance(v, (int, float)) for v in x) else [v if not isinstance(v, float) else round(v, 4) for v in x] == [v if not isinstance(v, float) else round(v, 4) for v in y]


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_has_rows(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_entry_without_training_data_operators(tmp_path):
    code = f"""
import shutil, sys
shutil.copytree({ROOT!r}, {str(tmp_path / "repo")!r}, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
sys.path.insert(0, {str(tmp_path / "repo")!r})
import __spark_entry__ as e
assert not any(q.startswith("op") or q == "pipeline" for q in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
print("fine")
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path)
    assert done.stdout.strip().endswith("fine"), done.stderr


def test_streaming_sums_equal_batch(spark, tmp_path):
    import numpy as np
    import pandas as pd
    from pyspark.sql import functions as F

    from smoothlake.plans.ksum import ksum
    from smoothlake.plans.spec import Bandwidth, Variable
    from smoothlake.streaming import streaming_ksum

    rows = pd.DataFrame({"value": np.random.default_rng(0).random(200)})
    spark.createDataFrame(rows).repartition(4).write.parquet(str(tmp_path / "in"))
    bw, grid = Bandwidth((Variable("value"),), (0.2,)), pd.DataFrame({"value": [0.1, 0.6]})
    stream = spark.readStream.schema("value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_ksum(stream, bw, grid, {"n": F.lit(1.0)}).writeStream.outputMode("complete").format("memory").queryName("sums").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("sums").toPandas().sort_values("at")
    want = ksum(spark.createDataFrame(rows), bw, grid).toPandas().sort_values("at")
    assert np.allclose(got.n, want.n)


def test_sources(spark, tmp_path):
    from smoothlake import sources

    df = spark.range(10).selectExpr("id", "id % 2 as part")
    for kind in ("parquet", "orc", "json", "csv"):
        sources.write(df, str(tmp_path / kind), kind)
        back = sources.read(spark, str(tmp_path / kind), kind, "id long, part long" if kind in ("json", "csv") else None)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        sources.read(spark, str(tmp_path / "csv"), "csv")
