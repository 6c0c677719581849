"""Toxicity by maximum-scoring segments.

Training takes a bounded sample of labelled documents and counts in how many toxic and other ones
each feature occurs; near copies of one sketch count as one together. A feature is a word or the
first four, five or six bytes of one. Its score is the log-ratio of its odds to those of all
documents, with a Dirichlet prior in the proportion that the feature above it has: a word leans on
its first six bytes, these on five, and so on. It is the end nearest to 0 of the posterior's interval,
so that what was seen once or twice says little. Every token has the score of its most specific
feature that training has seen, less a drift, such that the mean of exp(score) is 1 in clean text.

The maximal scoring segments of a text (Ruzzo and Tompa) are found in linear time. With that drift
the extreme-value law of the best segment of n words of clean text has a scale of 1, so that a
segment of score S has an expectation of K * n * exp(-S). Segments with an expectation below a level
are passages. A logistic curve maps the log-expectation of all passages to a score from 0 to 1. Drift,
K and curve come from rows scored by features of the other folds of the sample, never of their own.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch, words
from .grouped import map_groups
from .scratch import save

_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_SEPARATORS = ~_LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PREFIXES = (6, 5, 4)
FOLDS = 3
ONE = 1 << 20  # the weight of a document


@dataclass(frozen=True)
class Settings:
    """sample: labelled rows to learn from, at most. prior: weight of the Dirichlet prior in documents. width: deviations by which a score is drawn to 0. expectation: what a passage has at most."""

    sample: int = 20_000
    prior: float = 3.0
    width: float = 2.0
    expectation: float = 0.01


@dataclass(frozen=True)
class Model:
    """keys of features in order and their scores; what is taken from each token's score; the extreme-value law and the curve."""

    keys: np.ndarray
    scores: np.ndarray
    drift: float
    log_k: float
    slope: float
    intercept: float
    expectation: float


def _features(block: words.Block) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word and of its prefixes, and the words' rows."""
    lower = _LOWER[block.data]
    starts, ends, rows = block.spans(_SEPARATORS, lower)
    whole = words.Block(lower, block.bounds, 0)
    out = [whole.hashes(starts, ends)]
    for n in PREFIXES:
        h = whole.hashes(starts, np.minimum(starts + n, ends)) ^ np.uint64(n)
        h[ends - starts < n] = 0
        out.append(h)
    return out, rows


def _sketch(block: words.Block) -> np.ndarray:
    """Of each row, the least hash of five words; of a shorter one, that of all its bytes."""
    starts, ends, rows = block.spans()
    at, h = words.windows(block.hashes(starts, ends), rows, 5)
    out = block.hashes(block.bounds[:-1], block.bounds[1:])
    if len(at):
        first = np.flatnonzero(np.r_[True, rows[at][1:] != rows[at][:-1]])
        out[rows[at][first]] = np.minimum.reduceat(h, first)
    return out


def _sample(docs: DataFrame, labels: DataFrame, settings: Settings, id_col: str, text_col: str) -> DataFrame:
    """Text, label, weight and fold of the sampled rows. Rows of one sketch and label weigh one together and have one fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id is not null and toxic in (0, 1) and crc32(cast(id as string)) % 5 != 0")
        .groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("hash", F.xxhash64("id"))
    )
    # a bound on the hash that leaves some more than the sample, so that no task sends the driver as many rows as that
    n = known.count()
    if n > 2 * settings.sample:
        known = known.where(F.col("hash") < int(-(2**63) + 2**64 * 1.25 * settings.sample / n))
    ids = known.orderBy("hash", "id").limit(settings.sample).select("id", "toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(0)):
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays([pa.array(_sketch(block).view(np.int64)), *part.columns], names=["sketch", "text", "toxic"])

    # the sample's size is a parameter, so it may be broadcast
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(ids), "id").select("text", "toxic")
    found = save(rows.mapInArrow(run, "sketch long, text string, toxic int"), "toxicity-sample")
    copies = found.groupBy("sketch", "toxic").agg(F.count("*").alias("copies"))
    return found.join(F.broadcast(copies), ["sketch", "toxic"]).select("text", "toxic", F.round(F.lit(float(ONE)) / F.col("copies")).cast("long").alias("weight"), F.pmod("sketch", F.lit(FOLDS)).cast("int").alias("fold"))


def _counts(sample: DataFrame) -> DataFrame:
    """Of each feature: the one above it, 0 for none, the topmost one, and the weights of the documents with it, by label and fold."""
    names = [f"n{k}" for k in range(2 * FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, weight, fold = (np.asarray(batch.column(k)) for k in (1, 2, 3))
            for block in words.blocks(batch.column(0), 1 << 19):
                features, rows = _features(block)
                above, up = np.zeros(len(rows), np.uint64), []
                for h in features[:0:-1]:  # from the shortest prefix on
                    up.append(above)
                    above = np.where(h != 0, h, above)
                up.append(above)
                top = features[0].copy()
                for h in features[1:]:  # to the shortest prefix
                    top[h != 0] = h[h != 0]
                h, r, u, t = np.concatenate(features), np.tile(rows, len(features)), np.concatenate(up[::-1]), np.tile(top, len(features))
                real = np.flatnonzero(h)
                order = real[np.lexsort((r[real], h[real]))]
                h, r, u, t = h[order], r[order], u[order], t[order]
                new = np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])][: len(h)]
                keys, at = np.unique(h, return_index=True)
                if len(keys):
                    doc = block.first + r
                    cell = toxic[doc] * FOLDS + fold[doc]
                    sums = [np.add.reduceat(np.where(new & (cell == k), weight[doc], 0), at) for k in range(2 * FOLDS)]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(u[at].view(np.int64)), pa.array(t[at].view(np.int64)), *map(pa.array, sums)], names=["key", "above", "top", *names])

    found = sample.select("text", "toxic", "weight", "fold").mapInArrow(run, "key long, above long, top long, " + ", ".join(f"{x} long" for x in names))
    return found.groupBy("key").agg(F.max("above").alias("above"), F.max("top").alias("top"), *(F.sum(x).alias(x) for x in names))


def odds(keys: np.ndarray, above: np.ndarray, bad: np.ndarray, good: np.ndarray, n1: float, n0: float, prior: float, width: float) -> np.ndarray:
    """The score of each feature, keys being in order: the log-ratio of its documents, with a prior of so many that part as those of the feature above it do, drawn to 0 by so many of its deviations. One without documents has the score of that above it."""
    score = np.zeros(len(keys))
    parent = np.searchsorted(keys, above)
    parent[above == 0] = -1
    done = np.zeros(len(keys), bool)
    now = np.flatnonzero(parent < 0)
    while len(now):
        base = np.where(parent[now] >= 0, score[parent[now]], 0.0)
        share = 1 / (1 + np.exp(-base) * n0 / n1)  # of toxic documents among those with the feature above
        y1, y0 = bad[now] + prior * share, good[now] + prior * (1 - share)
        middle = np.log(y1 / y0) - math.log(n1 / n0)
        drawn = np.sign(middle) * np.maximum(np.abs(middle) - width * np.sqrt(1 / y1 + 1 / y0), 0)
        score[now] = np.where(bad[now] + good[now] > 0, drawn, base)
        done[now] = True
        now = np.flatnonzero(~done & done[parent])
    return score


def scored(counts: DataFrame, total: np.ndarray, settings: Settings) -> DataFrame:
    """key and scores of the features: s from all folds, s0, s1, ... from all but that one. A feature that scores as the one above it in each of them is left out, since a word without it has that score anyway."""
    n0, n1 = total.sum(1).tolist()
    others = total.sum(1, keepdims=True) - total

    def run(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys = np.asarray(table.column("key")).view(np.uint64)
        order = np.argsort(keys)
        keys, above = keys[order], np.asarray(table.column("above")).view(np.uint64)[order]
        cells = np.stack([np.asarray(table.column(f"n{k}"))[order] for k in range(2 * FOLDS)], 1).reshape(-1, 2, FOLDS) / ONE
        good, bad = cells.sum(2).T
        score = [odds(keys, above, bad, good, n1, n0, settings.prior, settings.width)]
        score += [odds(keys, above, bad - cells[:, 1, j], good - cells[:, 0, j], others[1, j], others[0, j], settings.prior, settings.width) for j in range(FOLDS)]
        both = np.stack(score, 1)
        base = np.where((above != 0)[:, None], both[np.minimum(np.searchsorted(keys, above), len(keys) - 1)], 0.0)
        keep = np.flatnonzero((both != base).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), *(pa.array(both[keep, k]) for k in range(FOLDS + 1))], names=["key", "s", *(f"s{k}" for k in range(FOLDS))])

    return map_groups(counts, ["top"], run, "key long, s double, " + ", ".join(f"s{k} double" for k in range(FOLDS)))


def values(block: words.Block, keys: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of each word, 0 for one without a known feature, and its row. scores may have several columns."""
    features, rows = _features(block)
    _, one, which = np.unique(features[0], return_index=True, return_inverse=True)
    entry = np.full(len(one), -1, np.int64)
    for h in features if len(keys) else ():
        at = np.flatnonzero(entry < 0)
        k = np.minimum(np.searchsorted(keys, h[one[at]]), len(keys) - 1)
        good = keys[k] == h[one[at]]
        entry[at[good]] = k[good]
    found = np.where((entry >= 0).reshape(-1, *[1] * (scores.ndim - 1)), scores[entry] if len(keys) else 0.0, 0.0)
    return found[which] if len(which) else np.zeros((0, *scores.shape[1:])), rows


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments of a sequence, in order: start, end and score."""
    total = np.zeros(len(scores) + 1)
    np.cumsum(scores, out=total[1:])
    plus = np.zeros(len(scores) + 2, bool)
    plus[1:-1] = scores > 0
    begin, end = np.flatnonzero(plus[1:] & ~plus[:-1]), np.flatnonzero(plus[:-1] & ~plus[1:])
    # of each segment so far: start, end, sums before and after, and the nearest earlier one with a lower sum before
    found: list[tuple[int, int, float, float, int]] = []
    for a, b, left, right in zip(begin.tolist(), end.tolist(), total[begin].tolist(), total[end].tolist(), strict=True):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right, j))
                break
            a, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - q) for a, b, q, r, _ in found]


Evidence = tuple[float, int, float, list[tuple[int, int, float]]]


def _evidence(scores: np.ndarray, rows: np.ndarray, n_rows: int, log_k: float, expectation: float) -> list[Evidence]:
    """Of each row: minus the log-expectation of its passages together, its words, its best segment's score, and the passages."""
    first = np.searchsorted(rows, np.arange(n_rows + 1)).tolist()
    limit = math.log(expectation) if expectation < math.inf else math.inf
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        level = log_k + math.log(max(b - a, 1))
        found = segments(scores[a:b])
        passages = [x for x in found if level - x[2] < limit]
        out.append((sum(s for *_, s in passages) - level, b - a, max((s for *_, s in found), default=0.0), passages))
    return out


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learns from the labelled rows whose crc32 of the id as text, modulo 5, is not 0.

    No more than settings.sample labelled rows are used, those with the least hash of the id. Rows
    with a null id, text or label are left out; an id with both labels is toxic. Without toxic or
    without other rows there are no features and every score is the share of toxic rows, smoothed.
    """
    with scratch.owned() as tables:
        model = _fit(_sample(docs, labels, settings, id_col, text_col), settings)
        scratch.release(docs.sparkSession, tables)
    return model


def _fit(sample: DataFrame, settings: Settings) -> Model:
    total = np.zeros((2, FOLDS))
    for r in sample.groupBy("toxic", "fold").agg(F.sum("weight").alias("n")).collect():
        total[r["toxic"], r["fold"]] = r["n"] / ONE
    n0, n1 = total.sum(1)
    rate = (n1 + 0.5) / (n1 + n0 + 1)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0), 0.01, 0.0, 0.0, math.log(rate / (1 - rate)), settings.expectation)
    others = total.sum(1, keepdims=True) - total
    if not n1 or not n0 or not others.all():
        return empty
    table = scored(_counts(sample), total, settings).toPandas()  # features of a sample of so many rows that say something
    keys = table["key"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, scores = keys[order], table["s"].to_numpy()[order]
    apart = table[[f"s{k}" for k in range(FOLDS)]].to_numpy()[order]  # a column for each fold, from the others

    def own(block: words.Block, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found, rows = values(block, keys, apart)
        return found[np.arange(len(rows)), fold[block.first + rows]], rows

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.asarray(batch.column(1))
            for block in words.blocks(batch.column(0)):
                found, rows = own(block, fold)
                n = np.bincount(rows, minlength=block.rows)
                yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(np.bincount(rows, np.exp(found), block.rows) / np.maximum(n, 1))], names=["n", "mean"])

    clean = sample.where("toxic = 0").select("text", "fold").mapInArrow(means, "n long, mean double").where("n > 0").agg(F.sum(F.col("mean") * F.col("n")).alias("sum"), F.sum("n").alias("n")).first()
    drift = max(math.log(clean["sum"] / clean["n"]) if clean["n"] else 0.0, 1e-3)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, weight, fold = (np.asarray(batch.column(k)) for k in (1, 2, 3))
            for block in words.blocks(batch.column(0)):
                found, rows = own(block, fold)
                part = slice(block.first, block.first + block.rows)
                _, n, best, passages = zip(*_evidence(found - drift, rows, block.rows, 0.0, math.inf), strict=True)
                kept = [[s for *_, s in p] for p in passages]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[part]), pa.array(weight[part]), pa.array(n, pa.int64()), pa.array(best, pa.float64()), pa.array(kept, pa.list_(pa.float64()))], names=["toxic", "weight", "n", "best", "scores"])

    seen = sample.select("text", "toxic", "weight", "fold").mapInArrow(evidence, "toxic int, weight long, n long, best double, scores array<double>")
    # the expectation of clean texts' best segments: K is the mean of exp(S) / n, robustly from their upper tail
    seen = seen.withColumn("level", F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")))
    log_k = seen.where("toxic = 0").agg(F.percentile(F.col("best") - F.col("level"), 0.99)).first()[0] + math.log(0.01)
    log_k = float(np.clip(log_k, -12, 2))
    level = F.col("level") + log_k
    kept = F.aggregate(F.filter("scores", lambda x: level - x < math.log(settings.expectation)), F.lit(0.0), lambda a, x: a + x)
    table = seen.select("toxic", "weight", (kept - level).alias("x")).toPandas()  # as many rows as the sample, a parameter
    slope, intercept = _logistic(table["x"].to_numpy(), table["toxic"].to_numpy(), table["weight"].to_numpy() / ONE)
    return Model(keys, scores, drift, log_k, slope, intercept, settings.expectation)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope, at least 0, and intercept by Newton's method with a ridge on the standardised slope."""
    mean, sd = float(np.mean(x)), float(np.std(x)) or 1.0
    z = np.stack([(x - mean) / sd, np.ones(len(x))], 1)
    b = np.zeros(2)
    penalty = np.diag([ridge, 1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * p * (1 - p))[:, None]) + penalty, z.T @ (weight * (y - p)) - penalty @ b)
        b += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    slope = max(b[0], 0.0) / sd
    return slope, float(b[1] - slope * mean)


def _judged(block: words.Block, model: Model) -> list[Evidence]:
    found, rows = values(block, model.keys, model.scores)
    return _evidence(found - model.drift, rows, block.rows, model.log_k, model.expectation)


def _score(evidence: float, model: Model) -> float:
    return 1 / (1 + math.exp(-min(max(model.slope * evidence + model.intercept, -30), 30)))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_tokens long, n_passages long, passages string"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its score and passages, as a JSON list of first word, word after the last and score.

    A null or empty text has no passages and the score of that. A null id stays null and is not held
    out. Repeated rows each get a row; very long texts are scored whole, in time linear in their
    words; of equal segments the longer is one passage; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(1)):
                found = _judged(block, model)
                value = [_score(e, model) for e, *_ in found]
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array(value, pa.float64()), pa.array([int(v >= 0.5) for v in value], pa.int32()), pa.array([n for _, n, *_ in found], pa.int64()), pa.array([len(p) for *_, p in found], pa.int64()), pa.array([json.dumps([[a, b, round(s, 3)] for a, b, s in p]) for *_, p in found], pa.string())],
                    names=[x.split()[0] for x in SCHEMA.split(", ")],
                )

    id_ = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(id_.cast("string")) % 5 == 0, F.lit(False))
    return docs.select(id_.alias("doc_id"), F.col(text_col).cast("string").alias("text"), held.alias("held")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs with a score below one half, with all their columns."""
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(at)):
                clean = [_score(e, model) < 0.5 for e, *_ in _judged(block, model)]
                yield batch.slice(block.first, block.rows).filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, schema)
