"""Tables that cut lineage, written to the folder that all executors share.

A table is deleted when the scope that owns it releases it; or else, at the next save(), once no
plan in the JVM can read it any more; or when the process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []
_readers: dict[str, object] = {}  # of each table, a weak reference to what all plans that read it share


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. A temporary folder where it is unset and executors are threads of this machine's driver, an error elsewhere."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="smoothlake-")
        atexit.register(shutil.rmtree, where, True)
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet under the shared folder and returns it reread, with its lineage cut."""
    spark = df.sparkSession
    _sweep(spark)
    path = f"{shared_dir(spark)}/smoothlake/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    jvm = spark.sparkContext._jvm
    _readers[path] = jvm.java.lang.ref.WeakReference(out._jdf.queryExecution().analyzed().relation().location())
    if _scopes:
        _scopes[-1].append(path)
    out.scratch_path = path
    return out


@contextlib.contextmanager
def owned() -> Iterator[list[str]]:
    """A scope: the tables saved inside, for release(). What it does not release passes to the scope around it."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield mine
    finally:
        _scopes.pop()
        if _scopes:
            _scopes[-1].extend(mine)


def release(spark: SparkSession, tables: list[str], but: DataFrame | None = None) -> None:
    """Deletes tables of a scope, which must not be read again; but: what save() returned for one that stays."""
    for path in list(tables):
        if path != getattr(but, "scratch_path", None):
            _delete(spark, path)
            tables.remove(path)


def live() -> int:
    """How many tables there are."""
    return len(_readers)


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _readers.pop(where, None)


def _sweep(spark: SparkSession) -> None:
    owned_now = {p for s in _scopes for p in s}
    for path, reader in list(_readers.items()):
        try:
            gone = path not in owned_now and reader.get() is None
        except Exception as e:  # noqa: BLE001 a reference into a JVM that has ended
            if type(e).__module__.split(".")[0] != "py4j":
                raise
            _readers.pop(path)
            continue
        if gone:
            _delete(spark, path)
