"""Sharding by histogram sort.

Rows are ordered by a key of 62 bits: the high ones come from a hash of the text, the next from a
hash of the id, the lowest from the row's place in the table, so that equal texts stand together and
yet even a group of copies, or of equal rows, that outgrows a shard can be split. Splitters cut the
order into shards of near equal bytes. They are found by rounds: each counts the exact bytes below
probe keys, between the two probes that enclose a target, until the nearer of the two is within the
tolerance. The first rounds probe group edges only, so a group of equal texts is split only if no
edge is near enough. Then the rows are exchanged once, by ranges of the key, and sorted; slots follow
the key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .scratch import save

KEY_BITS, TEXT_BITS, ID_BITS, ROUND_BITS = 62, 32, 15, 8


@dataclass(frozen=True)
class Settings:
    """tolerance: bytes by which a splitter may miss its target, as a share of a shard. range_rows: rows that a task sorts."""

    shards: int = 16
    tolerance: float = 0.005
    range_rows: int = 500_000
    broadcast_rows: int = 100_000


def _key(text: Column, id_: Column, row: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(text), 64 - TEXT_BITS), KEY_BITS - TEXT_BITS)
    middle = F.shiftleft(F.shiftrightunsigned(F.xxhash64(id_, text), 64 - ID_BITS), KEY_BITS - TEXT_BITS - ID_BITS)
    return high.bitwiseOR(middle).bitwiseOR(F.shiftrightunsigned(F.xxhash64(row), 64 - (KEY_BITS - TEXT_BITS - ID_BITS)))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and key of each row. To be written at once: the key holds the row's place."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("long")
    return docs.select(id_.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), _key(text, id_, F.monotonically_increasing_id()).alias("key"))


def splitters(rows: DataFrame, s: Settings = Settings()) -> list[int]:
    """Keys, shards - 1 of them and in order, at which a shard begins.

    A round is one aggregation to at most shards * 256 sums, so the driver's part is of a fixed size.
    """
    total = rows.agg(F.sum("size")).first()[0] or 0
    slack = s.tolerance * total / s.shards
    found: dict[int, int] = {}
    # of each target still sought: the enclosing keys and the exact bytes below them
    open_ = {t: (0, 1 << KEY_BITS, 0, total) for t in range(1, s.shards)}
    width = KEY_BITS
    while open_:
        for t, (low, high, below_low, below_high) in list(open_.items()):
            target = total * t / s.shards
            key, miss = min((low, abs(below_low - target)), (high, abs(below_high - target)), key=lambda x: x[1])
            if miss <= slack or width == 0:
                found[t] = key
                del open_[t]
        if not open_:
            break
        width -= min(ROUND_BITS, width - (KEY_BITS - TEXT_BITS)) if width > KEY_BITS - TEXT_BITS else min(ROUND_BITS, width)
        ranges = sorted({(low, high) for low, high, *_ in open_.values()})
        inside = None
        for low, high in ranges:
            x = (F.col("key") >= low) & (F.col("key") < high)
            inside = x if inside is None else inside | x
        counts: dict[int, int] = {r["cell"]: r["n"] for r in rows.where(inside).groupBy(F.shiftright("key", width).alias("cell")).agg(F.sum("size").alias("n")).collect()}
        for t, (low, high, below_low, _) in list(open_.items()):
            target, below = total * t / s.shards, below_low
            for cell in range(low >> width, high >> width):
                n = counts.get(cell, 0)
                if below + n >= target:
                    open_[t] = (cell << width, (cell + 1) << width, below, below + n)
                    break
                below += n
    return [found[t] for t in range(1, s.shards)]


def shard(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its shard and its place there; shards hold near equal bytes.

    A null text counts as empty, so every row has a size of 1 or more; null ids stay null. Equal rows
    are interchangeable and may be dealt to several shards. One row longer than a shard is a shard of
    its own, at the cost of its neighbours. An empty table gives no rows. Other columns are not read.
    """
    with scratch.owned() as tables:
        rows = save(keyed(docs, id_col, text_col), "keyed")
        place = F.lit(0)
        for key in splitters(rows, s):
            place = place + (F.col("key") >= key).cast("int")
        ranges = max(s.shards, -(-rows.count() // s.range_rows))
        ordered = rows.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id", "size", "text_crc32")
        # the numbers of a range's rows follow one another, in order
        ordered = save(ordered.select("doc_id", "size", "text_crc32", place.cast("int").alias("shard"), F.monotonically_increasing_id().alias("at")), "ordered")
        scratch.release(docs.sparkSession, tables, but=ordered)
    part = F.shiftright("at", 33)
    base = ordered.groupBy("shard", part.alias("range")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    base = base.withColumn("base", F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).drop("n")
    base = F.broadcast(base) if ranges <= s.broadcast_rows else base  # a row for each shard and range that meet
    return ordered.withColumn("range", part).join(base, ["shard", "range"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard"), (F.col("base") + F.col("at") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
