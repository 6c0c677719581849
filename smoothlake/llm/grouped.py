"""Work on groups of rows that arrive one after another, many groups at a time, and components of graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch
from .scratch import save

SALTS = 16  # tasks among which the edges of one node are shared

Rows = Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]]


def map_groups(df: DataFrame, keys: list[str], run: Rows, schema: str, flush: int = 20_000) -> DataFrame:
    """Sends the rows of each group to run(), sorted and whole, with the bounds of the groups in the table.

    Many groups share a call, so that small ones cost little; a call has about flush rows, or one
    group if that has more. Groups must have a bounded size, and all keys must be longs.
    """

    def starts(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for k in keys:
            v = np.asarray(table.column(k))
            change[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(change)

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in source:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < flush:
                continue
            table = pa.Table.from_batches(held)
            at = starts(table)
            if len(at) > 1:
                cut = int(at[-1])
                yield from run(table.slice(0, cut), at)
                held, rows = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
        if rows:
            table = pa.Table.from_batches(held)
            yield from run(table, np.append(starts(table), table.num_rows))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(batches, schema)


def pairs(sizes: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of positions within groups of these sizes that begin at these positions."""
    for s in np.unique(sizes):
        if s < 2:
            continue
        i, j = np.triu_indices(s, 1)
        groups = first[sizes == s]
        step = max(1, 1_000_000 // len(i))
        for k in range(0, len(groups), step):
            g = groups[k : k + step, None]
            yield (g + i).ravel(), (g + j).ravel()


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position of each one's component, for edges between n positions."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        m = np.minimum(label[a], label[b])
        np.minimum.at(label, a, m)
        np.minimum.at(label, b, m)
        label = label[label]
        if (before == label).all():
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """node and component, the least node reached, for edges a, b between longs; nodes without an edge are left out.

    Large and small stars alternate until nothing changes, about log(nodes) rounds; each round is a
    written table, so no lineage builds up and no edge goes to the driver.
    """
    edges = save(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    spark = edges.sparkSession
    while True:
        with scratch.owned() as tables:
            before = _sum(edges)
            both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            # a node of very many edges is dealt to several tasks
            salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            large = both.withColumn("salt", F.pmod(F.hash("b"), F.lit(SALTS))).join(salted.hint("merge"), ["a", "salt"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
            large = save(large, "large-star")
            least = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("x")).select(F.col("x.b").alias("a"), F.col("x.m").alias("b")).where("a != b").distinct()
            edges = save(small, "small-star")
            scratch.release(spark, tables, but=edges)
        if _sum(edges) == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.xxhash64("b", "a") % 998_244_353)).first())
