"""Quality rules by compression bands.

Each text is compressed by zstandard as a whole and in fixed chunks, of which the last may be
shorter. A band of allowed ratios (bytes in for a byte out) depends on the length: short texts
compress little, long ones more. A text above its band is repetitive, one below it is incompressible
noise; a text is also rejected when over a share of its chunks leave their bands, that of full chunks
or, for the last one, that of its length. A text of one chunk is judged as a whole only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words


@dataclass(frozen=True)
class Bands:
    """Bytes up to which a band holds, its least and its greatest ratio; the last holds beyond."""

    upto: tuple[int, ...] = (64, 128, 256, 512, 1024, 2048, 4096, 8192, 1 << 62)
    least: tuple[float, ...] = (0.0, 1.0, 1.1, 1.2, 1.25, 1.4, 1.45, 1.5, 1.5)
    most: tuple[float, ...] = (2.4, 2.4, 2.4, 2.2, 2.2, 2.3, 2.35, 2.45, 2.6)
    chunk_bytes: int = 4096
    chunk_least: float = 1.45
    chunk_most: float = 2.6
    bad_chunks: float = 0.5
    level: int = 1


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_chunks long, n_bad_chunks long, verdict string, kept boolean"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _base(block: words.Block) -> list[np.ndarray]:
    data = block.data
    starts, ends, rows = block.spans()
    h = block.hashes(starts, ends)
    n_words = np.bincount(rows, minlength=block.rows)
    letters = block.per_row(((data & 0xC0) != 0x80) & ~words.SPACES[data])
    symbols = block.per_row(_SYMBOL[data])
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([block.bounds[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    finish = np.append(begin[1:], len(data)).astype(np.int64)
    if len(begin):
        finish -= data[finish - 1] == 10
    filled = np.searchsorted(starts, finish) > np.searchsorted(starts, begin)
    begin, finish = begin[filled], finish[filled]
    of = np.searchsorted(block.bounds, begin, "right") - 1
    keys = words.with_row(block.hashes(begin, finish), of)
    order = np.argsort(keys, kind="stable")
    again = order[1:][keys[order[1:]] == keys[order[:-1]]]
    dup_lines = np.bincount(of[again], minlength=block.rows)
    at, w = words.windows(h, rows, 8)
    twice = at[words.repeated(words.with_row(w, rows[at]))]
    cover = np.zeros(len(h) + 1, np.int32)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + 8, -1)
    repeat = np.bincount(rows[np.cumsum(cover)[:-1] > 0], minlength=block.rows)
    return [n_words, letters, symbols, dup_lines, repeat]


def _band(sizes: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    i = np.searchsorted(np.array(bands.upto), sizes)
    return np.array(bands.least)[i], np.array(bands.most)[i]


def _compressed(block: words.Block, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the ratio, 1 for an empty text, and the chunks in all and outside their bands."""
    press = zstandard.ZstdCompressor(level=bands.level, write_content_size=False, write_checksum=False)
    view, most = memoryview(np.ascontiguousarray(block.data)), bands.chunk_bytes
    sizes = np.diff(block.bounds)
    chunks = -(-sizes // most)
    ratio, bad = np.ones(block.rows), np.zeros(block.rows, np.int64)
    tail_least, tail_most = _band(sizes - (chunks - 1) * most, bands)
    for i, (a, b) in enumerate(zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)):
        if b > a:
            ratio[i] = (b - a) / len(press.compress(view[a:b]))
        for c in range(a, b, most) if b - a > most else ():
            d = min(b, c + most)
            low, high = (bands.chunk_least, bands.chunk_most) if d - c == most else (tail_least[i], tail_most[i])
            bad[i] += not low <= (d - c) / len(press.compress(view[c:d])) <= high
    return ratio, chunks, bad


def _verdict(block: words.Block, bands: Bands) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The base counts, whether they fail, ratio, chunks, bad chunks and verdict of each row."""
    base = _base(block)
    failed = (base[0] < 20) | (100 * base[4] > 30 * base[0])
    ratio, chunks, bad = _compressed(block, bands)
    least, most = _band(np.diff(block.bounds), bands)
    verdict = np.select([failed, ratio > most, ratio < least, bad > bands.bad_chunks * np.maximum(chunks, 1)], ["base", "repetitive", "noise", "chunks"], "ok")
    return base, failed, ratio, chunks, bad, verdict


def measure(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its base counts, ratios, verdict and whether it is kept.

    A null text counts as one without words, which fails the base rules, as does an empty one; a
    null id stays null. Repeated rows each get their row. Very long texts are compressed whole and in
    all their chunks; a ratio on the edge of a band is inside. Columns besides the two are not read.
    verdict: base, repetitive, noise, chunks or ok, the first that holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(1)):
                base, failed, ratio, chunks, bad, verdict = _verdict(block, bands)
                ids = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (*base, failed, ratio, chunks, bad, verdict, verdict == "ok"))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, decided row by row in the same pass."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(at)):
                yield batch.slice(block.first, block.rows).filter(pa.array(_verdict(block, bands)[-1] == "ok"))

    return docs.mapInArrow(run, schema)
