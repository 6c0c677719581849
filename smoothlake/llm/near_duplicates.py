"""N-gram Jaccard join with Bayesian candidate pruning.

A text is the set of its shingles of five words (one shingle of all its words if it has fewer);
texts with the same words form a text class, and only one of each class is compared. Classes that
agree in a band of MinHash values are candidates. Their MinHash values are compared a few at a
time; a pair is dropped as soon as the posterior probability of a similarity of the threshold or
more, under a uniform prior, falls below a tolerance. What remains joins classes to clusters. Within
a cluster pairs are verified exactly on the shingle sets, without pruning: all of them in a small
cluster; in a large one, cut into blocks by classes and shingles, those of the blocks and classes that
meet in a band, so a long chain of near copies costs as much as it has neighbours. Pairs are counted
in the group that verifies them, never written, and no task holds an unbounded group.

A band of four values misses a pair of similarity 0.8 with probability 0.59, all twenty of them
with 0.00003. Class keys are hashes of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import scratch, words
from .grouped import components, least_labels, map_groups, pairs
from .scratch import save


@dataclass(frozen=True)
class Settings:
    """words, similarity: shingles and what links them. bands, rows: of MinHash values. step, tolerance: of the pruning. bucket_block, cluster_block, cluster_shingles: classes and shingles of a block. broadcast_bytes: tables of up to so many go to all tasks. seen: classes that a task knows again."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 4
    step: int = 8
    tolerance: float = 1e-4
    bucket_block: int = 512
    cluster_block: int = 128
    cluster_shingles: int = 1 << 19
    broadcast_bytes: int = 16 << 20
    seen: int = 1_000_000

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


_rng = np.random.Generator(np.random.PCG64(7))
_MULTIPLY = _rng.integers(1 << 20, 1 << 31, 1024, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, 1024, np.uint32)


@lru_cache
def least_matches(similarity: float, hashes: int, step: int, tolerance: float) -> np.ndarray:
    """Of step, 2 * step, ... compared values, the fewest matches with which a pair stays.

    With m of n matches and a uniform prior, the posterior is Beta(m + 1, n - m + 1), and its tail
    from the similarity on is the chance of at most m successes in n + 1 trials.
    """
    out = []
    for n in range(step, hashes + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return np.array(out)


def shingles(block: words.Block, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes and their rows, in order of rows, and the class key of each row, 0 for one without words."""
    starts, ends, rows = block.spans()
    h = block.hashes(starts, ends)
    n = np.bincount(rows, minlength=block.rows)
    first = np.searchsorted(rows, np.arange(block.rows + 1))
    power, inverse = words._power(words._STEP, len(h))
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=prefix[1:])
    whole = words.mix((prefix[first[1:]] - prefix[first[:-1]]) * inverse[first[:-1]] + n.astype(np.uint64))
    whole[n == 0] = 0
    at, w = words.windows(h, rows, size)
    short = np.flatnonzero((n > 0) & (n < size))
    of = np.concatenate([rows[at], short])
    order = np.argsort(of, kind="stable")
    return np.concatenate([w, words.mix(whole[short])])[order], of[order], whole


def signatures(h: np.ndarray, rows: np.ndarray, n_rows: int, hashes: int) -> np.ndarray:
    """MinHash values, a row for each row; all ones without shingles."""
    out = np.full((n_rows, hashes), 0xFFFFFFFF, np.uint32)
    if not len(h):
        return out
    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    x = (h >> np.uint64(32)).astype(np.uint32)
    y = np.empty_like(x)
    low = np.empty((hashes, len(first)), np.uint32)
    for k in range(hashes):
        np.multiply(x, _MULTIPLY[k], out=y)
        y += _ADD[k]
        np.minimum.reduceat(y, first, out=low[k])
    out[rows[first]] = low.T
    return out


def prune(sig: np.ndarray, i: np.ndarray, j: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that stay after all values, compared a step at a time."""
    m = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches(s.similarity, s.hashes, s.step, s.tolerance)):
        part = slice(k * s.step, (k + 1) * s.step)
        m += (sig[i, part] == sig[j, part]).sum(1)
        keep = m >= least
        i, j, m = i[keep], j[keep], m[keep]
    return i, j


def _fresh(keys: np.ndarray, seen: set[int], most: int) -> np.ndarray:
    """Where a key other than 0 comes for the first time; what is remembered is bounded, so a key may come first again."""
    fresh = np.zeros(len(keys), bool)
    for r, k in enumerate(keys.tolist()):
        if k and k not in seen:
            if len(seen) >= most:
                seen.clear()
            seen.add(k)
            fresh[r] = True
    return fresh


def _signed(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """doc_id, class key (null without words), shingles and MinHash values of each row; rows of a class that a task has just seen have no values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in words.blocks(batch.column(1)):
                h, rows, whole = shingles(block, s.words)
                fresh = _fresh(whole, seen, s.seen)
                keep = fresh[rows]
                sig = signatures(h[keep], rows[keep], block.rows, s.hashes)
                values = [sig[r].tobytes() if f else None for r, f in enumerate(fresh)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(whole.view(np.int64), mask=whole == 0), pa.array(np.bincount(rows, minlength=block.rows)), pa.array(values, pa.binary())], names=["doc_id", "cls", "size", "sig"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, cls long, size long, sig binary")


def _bands(classes: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls = np.asarray(batch.column(0))
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(len(cls), s.bands, s.rows).astype(np.uint64)
            key = np.zeros((len(cls), s.bands), np.uint64) + np.arange(s.bands, dtype=np.uint64)
            for r in range(s.rows):
                key = words.mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(cls, s.bands))], names=["bucket", "cls"])

    return classes.select("cls", "sig").mapInArrow(run, "bucket long, cls long")


def _block_pairs(df: DataFrame, size: str, most: int) -> DataFrame:
    """Rows with their block in a group of so many rows, once for each pair of blocks, low and high, that it belongs to."""
    n = F.ceil(F.col(size) / most).cast("long")
    return df.withColumn("block", F.pmod(F.xxhash64("cls"), n)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other")


def _across(table: pa.Table, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs in groups of two blocks, those between the blocks: those within a block have a group of their own."""
    block, low, high = (np.asarray(table.column(c)) for c in ("block", "low", "high"))
    keep = (low[i] == high[i]) | (block[i] != block[j])
    return i[keep], j[keep]


def _candidates(classes: DataFrame, s: Settings) -> DataFrame:
    """Edges a, b that join the classes of each bucket that pass the pruning, as stars."""
    bands = _bands(classes, s)
    shared = bands.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = _block_pairs(bands.join(shared, "bucket").join(classes.select("cls", "sig"), "cls"), "n", s.bucket_block)

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls = np.asarray(table.column("cls"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(cls), s.hashes)
        a, b = [], []
        for i, j in pairs(np.diff(bounds), bounds[:-1]):
            i, j = prune(sig, *_across(table, i, j), s)
            a.append(i)
            b.append(j)
        if not a:
            return
        label = least_labels(len(cls), np.concatenate(a), np.concatenate(b))
        at = np.flatnonzero(label != np.arange(len(cls)))
        yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(cls[label[at]])], names=["a", "b"])

    return map_groups(rows.select("bucket", "low", "high", "block", "cls", "sig"), ["bucket", "low", "high"], run, "a long, b long")


def _small(df: DataFrame, s: Settings) -> DataFrame:
    """A written table of a few numbers a row, marked to go to all tasks if it is small enough for that."""
    size = df.count() * 8 * len(df.columns)
    return F.broadcast(df) if size <= s.broadcast_bytes else df


def _sets(docs: DataFrame, members: DataFrame, s: Settings, text_col: str) -> DataFrame:
    """Class key and shingle set, in order, of the members."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for block in words.blocks(batch.column(0)):
                whole = shingles(block, s.words)[2]
                take = np.flatnonzero(_fresh(whole, seen, s.seen))
                if len(take):
                    yield pa.RecordBatch.from_arrays([pa.array(whole[take].view(np.int64)), batch.column(0).take(pa.array(block.first + take))], names=["cls", "text"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(1)):
                h, rows, _ = shingles(block, s.words)
                cut = np.searchsorted(rows, np.arange(block.rows + 1)).tolist()
                found = [np.unique(h[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(found, pa.binary())], names=["cls", "shingles"])

    rows = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(texts, "cls long, text string")
    rows = rows.join(_small(members.select("cls"), s), "cls", "left_semi").groupBy("cls").agg(F.min("text").alias("text"))
    return rows.mapInArrow(sets, "cls long, shingles binary")


def _groups(classes: DataFrame, cluster: DataFrame, s: Settings) -> DataFrame:
    """cluster, low, high, block and cls: the groups in which classes are compared, for clusters with their numbers of blocks.

    A cluster of one block is a group. Of a larger one, a pair of blocks is a group with the classes
    of either that share a band with a class of the other.
    """
    none = F.lit(0).cast("long")
    few = cluster.where("blocks = 1").select("cluster", none.alias("low"), none.alias("high"), none.alias("block"), "cls")
    many = cluster.where("blocks > 1").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    many = many.join(classes.select("cls", "sig"), "cls")
    rows = save(_bands(many, s).join(many.select("cls", "cluster", "block", "blocks"), "cls"), "cluster-bands")
    # the blocks of each bucket, null for all of the cluster's, so that a dense cluster's rows stay short
    met = rows.groupBy("bucket", "cluster").agg(F.collect_set("block").alias("others"), F.max("blocks").alias("blocks"))
    met = met.select("bucket", "cluster", F.when(F.size("others") < F.col("blocks"), F.col("others")).alias("others"))
    met = rows.join(met, ["bucket", "cluster"]).groupBy("cluster", "block", "blocks", "cls").agg(F.max(F.col("others").isNull()).alias("all"), F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
    other = F.explode(F.when(F.col("all"), F.sequence(none, F.col("blocks") - 1)).otherwise(F.col("others")))
    met = met.withColumn("other", other).select("cluster", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "cls")
    return few.unionAll(met)


def _shared_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The sizes of the intersections of pairs of sorted sets."""
    members = np.unique(np.concatenate([i, j]))
    if len(i) < 4 * len(members):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64)
    keys, column = np.unique(np.concatenate([sets[m] for m in members]), return_inverse=True)
    row = np.repeat(np.arange(len(members)), [len(sets[m]) for m in members])
    total = np.zeros((len(members), len(members)), np.float32)
    width = max(1, 8_000_000 // len(members))
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for k in range(0, len(keys), width):
        a, b = np.searchsorted(column, [k, k + width])
        x = np.zeros((len(members), min(width, len(keys) - k)), np.float32)
        x[row[a:b], column[a:b] - k] = 1
        total += x @ x.T
    return total[np.searchsorted(members, i), np.searchsorted(members, j)].astype(np.int64)


def _verified(rows: DataFrame, s: Settings) -> DataFrame:
    """Of each class and group: a class b that it links to or itself, and the documents and classes that it links to there. rows: what _groups() returns, with copies and shingles."""

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        cls, copies = np.asarray(table.column("cls")), np.asarray(table.column("copies"))
        n = len(cls)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        sizes = np.array([len(x) for x in sets])
        links, classes, ea, eb = np.zeros(n, np.int64), np.zeros(n, np.int64), [], []
        for i, j in pairs(np.diff(bounds), bounds[:-1]):
            i, j = _across(table, i, j)
            may = np.minimum(sizes[i], sizes[j]) >= s.similarity * np.maximum(sizes[i], sizes[j]) - 1e-9  # no similarity is over the ratio of sizes
            i, j = i[may], j[may]
            if not len(i):
                continue
            both = _shared_counts(sets, i, j) if len(np.unique(np.searchsorted(bounds, i, "right"))) == 1 else np.concatenate([_shared_counts(sets, i[g], j[g]) for g in _by_group(bounds, i)])
            yes = both >= s.similarity * (sizes[i] + sizes[j] - both) - 1e-9
            i, j = i[yes], j[yes]
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            np.add.at(classes, i, 1)
            np.add.at(classes, j, 1)
            ea.append(i)
            eb.append(j)
        label = least_labels(n, np.concatenate(ea), np.concatenate(eb)) if ea else np.arange(n)
        at = np.flatnonzero(classes > 0)
        yield pa.RecordBatch.from_arrays([pa.array(cls[at]), pa.array(cls[label[at]]), pa.array(links[at]), pa.array(classes[at])], names=["a", "b", "links", "classes"])

    return map_groups(rows.select("cluster", "low", "high", "block", "cls", "copies", "shingles"), ["cluster", "low", "high"], run, "a long, b long, links long, classes long", flush=2_000)


def _by_group(bounds: np.ndarray, i: np.ndarray) -> list[np.ndarray]:
    """Positions of the pairs of each group; i is in order of groups."""
    g = np.searchsorted(bounds, i, "right")
    return np.split(np.arange(len(i)), np.flatnonzero(g[1:] != g[:-1]) + 1)


def _classes(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The signed rows, and of each class with words: cls, least doc_id, copies, component, and the documents and classes that it links to."""
    spark = docs.sparkSession
    signed = save(_signed(docs, s, id_col, text_col), "signed")
    with scratch.owned() as tables:
        known = signed.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("size").alias("size"), F.max("sig").alias("sig"))
        classes = save(known, "classes")
        cluster = save(components(_candidates(classes, s)).select(F.col("node").alias("cls"), F.col("component").alias("cluster")).join(classes.select("cls", "copies", "size"), "cls"), "clusters")
        blocks = F.ceil(F.greatest(F.count("*") / s.cluster_block, F.sum("size") / s.cluster_shingles)).cast("long")
        sizes = save(cluster.groupBy("cluster").agg(blocks.alias("blocks")), "cluster-sizes")  # written, so that the join can split a hot cluster
        members = cluster.join(_small(sizes, s), "cluster")
        sets = save(_sets(docs, cluster, s, text_col), "sets")
        rows = _groups(classes, members.select("cluster", "cls", "blocks"), s).join(_small(cluster.select("cls", "copies"), s), "cls").join(sets, "cls")
        found = save(_verified(rows, s), "links")
        part = components(found.select("a", "b"))
        links = found.groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("links"), F.sum("classes").alias("classes"))
        out = classes.select("cls", "least", "copies").join(links, "cls", "left").join(part.select(F.col("node").alias("cls"), "component"), "cls", "left")
        out = save(out.select("cls", "least", "copies", F.coalesce("component", "cls").alias("component"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("classes", F.lit(0)).alias("classes")), "classes-linked")
        scratch.release(spark, tables, but=out)
    return signed, out


def join(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with the class of near copies it belongs to and its number of links.

    class_id is the least id in the connected component of links, text_class_id the least id with
    the same words, n_copies the rows with the same words, n_links the other rows at the similarity
    or above, copies included, and n_linked_classes the text classes among them. A null, empty or
    blank text has no shingles: it is a class of its own, with its own id and no links. Null ids are
    passed over by the least and stay null; repeated rows are copies; other columns are not read.
    """
    signed, classes = _classes(docs, settings, id_col, text_col)
    named = save(classes.groupBy("component").agg(F.min("least").alias("class_id")), "class-ids")
    classes = classes.join(named, "component").select("cls", "class_id", F.col("least").alias("text_class_id"), "copies", (F.col("links") + F.col("copies") - 1).alias("n_links"), "classes")
    return signed.select("doc_id", "cls").join(classes, "cls", "left").select(
        "doc_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("text_class_id")).alias("text_class_id"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("classes", F.lit(0)).cast("long").alias("n_linked_classes"),
    )


def keep_one(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near copies: of each component, the row with the least id, one of them if it is repeated.

    Rows without words all stay. All columns are kept.
    """
    s = settings
    _, classes = _classes(docs, s, id_col, text_col)
    taken = {c.lower() for c in docs.columns}
    cls, id_ = (next(x for k in range(len(taken) + 1) if (x := f"{name}{k}") not in taken) for name in ("cls", "id"))
    last = F.lit(2**63 - 1)
    best = classes.groupBy("component").agg(F.min(F.struct(F.coalesce("least", last).alias("id"), "cls")).alias("x")).select(F.col("x.cls").alias(cls), F.col("x.id").alias(id_))
    at = docs.columns.index(text_col)
    worded = F.coalesce(F.col(text_col).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(at)):
                whole = shingles(block, s.words)[2]
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(whole.view(np.int64))], names=[*batch.schema.names, cls])

    schema = StructType([*docs.schema.fields, StructField(cls, LongType())])
    rows = docs.where(worded).mapInArrow(run, schema).withColumn(id_, F.coalesce(F.col(id_col).cast("long"), last))
    kept = rows.join(best, [cls, id_]).dropDuplicates([cls, id_]).select(*docs.columns)
    return kept.unionAll(docs.where(~worded))
