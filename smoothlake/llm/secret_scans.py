"""Secret scans: fixed patterns, and guess costs of the values that credential words introduce.

The dictionary of the costs is built from the documents: their words are counted over all partitions,
without those inside secrets or in a credential's place, and ranked by count.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .guess_cost import LONGEST_WORD, Guesser

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXT = re.compile(r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|(?:access|private|client|auth)[_-]?(?:key|token|secret))["']?[ \t]*(?:[:=]|:=|=>)[ \t]*["']?([^\s"'<>,;]{6,})""", re.IGNORECASE | re.ASCII)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass(frozen=True)
class Settings:
    """least: log10 of the guesses that make a value a secret. dictionary: words of the documents that guesses start with, at most."""

    least: float = 8.0
    dictionary: int = 65_536


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, in code points, by start and then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [Span(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        found += [Span(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [Span(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def spans(text: str, guesser: Guesser, least: float = Settings.least) -> list[Span]:
    """The base spans, and the values in a credential's place that take 10**least guesses or more and that no base span meets."""
    base = base_spans(text)
    starts, reach = [s.start for s in base], list(accumulate((s.end for s in base), max))
    more = []
    for a, b in _values(text):
        k = bisect_left(starts, b)
        if not (k and reach[k - 1] > a) and guesser.log10_guesses(text[a:b]) >= least:
            more.append(Span(a, b, "guess"))
    return sorted(base + more, key=lambda s: (s.start, KINDS.index(s.kind)))


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Where the values stand that a credential word introduces."""
    for m in CONTEXT.finditer(text) if ":" in text or "=" in text else ():
        a, b = m.span(1)
        while b > a and text[b - 1] in ".)]}!?":
            b -= 1
        yield a, b


def dictionary(docs: DataFrame, s: Settings = Settings(), text_col: str = "text") -> Guesser:
    """A guesser with the most frequent words of all documents, of 3 to 24 bytes of letters; of words of equal count, those first in order.

    No more than s.dictionary words reach the driver: as many whole steps of a scale of counts as that.
    """
    docs = docs.select(F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(_masked(batch.column(0))):
                lower = words.Block(_LOWER[block.data], block.bounds, 0)
                starts, ends, _ = lower.spans(~_LETTER)
                fits = (ends - starts >= 3) & (ends - starts <= LONGEST_WORD)
                starts, ends = starts[fits], ends[fits]
                _, one, n = np.unique(lower.hashes(starts, ends), return_index=True, return_counts=True)
                raw = lower.data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[a:b].decode(errors="ignore") for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)], pa.string()), pa.array(n)], names=["word", "n"])

    with scratch.owned() as tables:
        counts = scratch.save(docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "dictionary")
        scale = F.floor(F.log2("n") * 64)
        taken, least = 0, None
        for r in sorted(counts.groupBy(scale.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True):  # no more rows than the scale has steps
            if taken + r["n"] > s.dictionary:
                break
            taken, least = taken + r["n"], r["at"]
        found = counts.where(scale >= least).orderBy(F.desc("n"), "word").select("word").collect() if least is not None else []
        scratch.release(docs.sparkSession, tables)
    return Guesser(r["word"] for r in found)


def _masked(column: pa.Array) -> pa.Array:
    """The texts with blanks for secrets and for what stands in a credential's place."""
    out = column.to_pylist()
    for k, text in enumerate(out):
        found = [(s.start, s.end) for s in base_spans(text)] + list(_values(text)) if text else []
        for a, b in found:
            text = text[:a] + " " * (b - a) + text[b:]
        out[k] = text
    return pa.array(out, pa.string())


def _joined(found: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in found)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string"


def scan(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its spans. A null text is empty and has none; a null id stays null; repeated rows each get a row; very long texts are scanned whole; of spans of equal start the kinds come as listed; other columns are not read."""
    guesser = dictionary(docs, s, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                found = spans(text or "", guesser, s.least)
                kinds = [x.kind for x in found]
                base = _joined([x for x in found if x.kind != "guess"])
                out.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(base.encode()).hexdigest(), _joined(found)))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def redact_text(text: str, guesser: Guesser, least: float = Settings.least, mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for s in spans(text, guesser, least):
        if s.start >= at:
            out += [text[at : s.start], mark]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, s: Settings = Settings(), mark: str = "[SECRET]", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows of docs with secrets replaced in the text and the count of characters, if there is one, set anew. Null texts stay null; other columns pass unread."""
    guesser = dictionary(docs, s, text_col)
    schema = docs.schema
    at = docs.columns.index(text_col)
    count = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = columns[at].to_pylist()
            clean = [t and redact_text(t, guesser, s.least, mark) for t in texts]
            changed = [a != b for a, b in zip(texts, clean, strict=True)]
            columns[at] = pa.array(clean, columns[at].type)
            if count is not None:
                columns[count] = pa.array([len(t) if c else n for t, c, n in zip(clean, changed, columns[count].to_pylist(), strict=True)], columns[count].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
