"""A hidden Markov language model.

Tokens are words, with A to Z in lower case, and an end. Words map to classes by a fixed rule: the
most frequent ones are classes of their own, all others share a class with the words whose last
bytes have the same hash. States emit classes; a word's chance within its class comes from its
count, with 0.1 added and one place for all unknown words, so that the chances of all texts add up.

Baum-Welch counts come from all training texts: each task adds up the expected counts of its whole
texts, many of them in step, the counts are summed across tasks by state and class, and only those
sums, of a fixed size, reach the driver. States start as clusters of
frequent words by their neighbours, which are counted over all training texts too. Scores are exact:
the scaled forward recursion runs over whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .scratch import save


@dataclass(frozen=True)
class Settings:
    """own: words with a class of their own. shared: classes of the others. known: words whose counts all tasks hold; others are joined. neighbours: words that are clustered. stretch, together: steps and sequences that a task holds at once; they change no result."""

    states: int = 12
    own: int = 1024
    shared: int = 1024
    suffix: int = 3
    known: int = 65_536
    neighbours: int = 256
    rounds: int = 5
    stretch: int = 256
    together: int = 512
    add: float = 0.1

    @property
    def classes(self) -> int:
        return 1 + self.own + self.shared


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tokens(block: words.Block, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, shared classes and rows of the words."""
    lower = words.Block(_LOWER[block.data], block.bounds, block.first)
    starts, ends, rows = lower.spans()
    tails = lower.hashes(np.maximum(starts, ends - s.suffix), ends) % np.uint64(s.shared)
    return lower.hashes(starts, ends), tails.astype(np.int32), rows


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    id_ = F.col(id_col).cast("long")
    held = F.coalesce(F.crc32(id_.cast("string")) % 10 == 0, F.lit(False))
    return docs.select(id_.alias("doc_id"), held.alias("held_out"), F.col(text_col).cast("string").alias("text"))


def _vocabulary(docs: DataFrame, s: Settings) -> DataFrame:
    """key, tail and count of each training word; tasks add up their own words first."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, t, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        keys, one, which = np.unique(h, return_index=True, return_inverse=True)
        return keys, t[one], np.bincount(which, n, len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            keys, tails, n = merged(parts)
            for k in range(0, len(keys), 100_000):
                p = slice(k, k + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[p].view(np.int64)), pa.array(tails[p]), pa.array(n[p])], names=["key", "tail", "n"])

        for batch in batches:
            for block in words.blocks(batch.column(0)):
                h, t, _ = _tokens(block, s)
                keys, one, n = np.unique(h, return_index=True, return_counts=True)
                parts.append((keys, t[one], n))
                held += len(keys)
                if held > 4_000_000:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if held > 2_000_000:
                        yield from out()
                        parts, held = [], 0
        if parts:
            yield from out()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "key long, tail int, n long").groupBy("key").agg(F.max("tail").alias("tail"), F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """keys in order, their rank by count and count; of the shared classes: the log10 of their denominators; totals of the training tokens."""

    keys: np.ndarray
    rank: np.ndarray
    counts: np.ndarray
    log_shared: np.ndarray
    class_counts: np.ndarray
    tokens: int
    distinct: int


def _lexicon(vocabulary: DataFrame, texts: int, s: Settings) -> Lexicon:
    # the least count that no more than so many words reach, by a histogram of counts on a log scale
    scale = F.floor(F.log2("n") * 64)
    words_at = sorted(((r["at"], r["v"]) for r in vocabulary.groupBy(scale.alias("at")).agg(F.count("*").alias("v")).collect()), reverse=True)
    taken, least = 0, None
    for at, v in words_at:
        if taken + v > s.known:
            break
        taken, least = taken + v, at
    top = (vocabulary.where(scale >= least) if least is not None else vocabulary.limit(0)).orderBy(F.desc("n"), "key").select("key", "n").toPandas()
    keys, counts = top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    shared = vocabulary.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # as many rows as shared classes
    n, v = np.zeros(s.shared), np.zeros(s.shared)
    for r in shared:
        n[r["tail"]], v[r["tail"]] = r["n"], r["v"]
    tokens, distinct = int(n.sum()) + texts, int(v.sum()) + (texts > 0)
    own = keys[: s.own]
    tails = {}
    if len(own):
        tails = {r["key"]: r["tail"] for r in vocabulary.where(F.col("key").isin(own.view(np.int64).tolist())).select("key", "tail").collect()}
    for k, c in zip(own.view(np.int64).tolist(), counts[: s.own].tolist(), strict=True):
        n[tails[k]] -= c
        v[tails[k]] -= 1
    class_counts = np.concatenate([[texts], np.pad(counts[: s.own], (0, s.own - len(own))), n]).astype(float)
    order = np.argsort(keys)
    return Lexicon(keys[order], order.astype(np.int32), counts[order], np.log10(n + s.add * (v + 1)), class_counts, tokens, distinct)


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, sum_base double, sum_within double, classes binary, rare array<long>, times array<int>"


def _encoded(docs: DataFrame, lexicon: Lexicon, texts: int, s: Settings) -> DataFrame:
    """Of each row: the classes of its tokens, the sums of log10 of counts of its known words, and its other words."""
    bitmap = np.zeros(1 << 20, bool)
    bitmap[(lexicon.keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
    log_count = np.log10(lexicon.counts + s.add)
    end = math.log10(texts + s.add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column(3)):
                h, tails, rows = _tokens(block, s)
                entry = np.full(len(h), -1, np.int64)
                at = np.flatnonzero(bitmap[(h & np.uint64(0xFFFFF)).astype(np.int64)])
                if len(at):
                    k = np.minimum(np.searchsorted(lexicon.keys, h[at]), len(lexicon.keys) - 1)
                    good = lexicon.keys[k] == h[at]
                    entry[at[good]] = k[good]
                known = entry >= 0
                rank = np.where(known, lexicon.rank[entry] if len(lexicon.rank) else 0, s.known)
                own = rank < s.own
                value = np.where(known, log_count[entry] if len(log_count) else 0.0, 0.0)
                base = np.bincount(rows, value, block.rows) + end
                within = np.bincount(rows, np.where(own, 0.0, value - lexicon.log_shared[tails]), block.rows)
                classes = np.where(own, 1 + rank, 1 + s.own + tails).astype("<u2")
                first = np.searchsorted(rows, np.arange(block.rows + 1))
                n_known = np.bincount(rows[known], minlength=block.rows) + (texts > 0)
                raw, cut = classes.tobytes(), (2 * first).tolist()
                rare = np.flatnonzero(~known)
                _, one, times = np.unique(words.with_row(h[rare], rows[rare]), return_index=True, return_counts=True)
                order = np.argsort(one)
                one, times = rare[one[order]], times[order].astype(np.int32)
                offsets = pa.array(np.searchsorted(rows[one], np.arange(block.rows + 1)).astype(np.int32))
                part = batch.slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(np.diff(first) + 1), pa.array(n_known), pa.array(base), pa.array(within), pa.array([raw[a:b] + b"\0\0" for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(h[one].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(times))],
                    names=[x.split()[0] for x in ENCODED.split(", ")],
                )

    return docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "held_out", "text").mapInArrow(run, ENCODED)


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, bounds = words.as_bytes(column)
    return np.ascontiguousarray(data).view("<u2"), bounds // 2


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # classes by states


def _neighbour_counts(encoded: DataFrame, s: Settings) -> np.ndarray:
    """Counts of the pairs of neighbouring tokens, all words beyond the most frequent ones as one."""
    m = s.neighbours + 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(m * m, np.int64)
        for batch in batches:
            seq, bounds = _sequences(batch.column(0))
            x = np.minimum(seq, m - 1).astype(np.int64)
            inner = np.ones(len(x), bool)
            inner[bounds[:-1][np.diff(bounds) > 0]] = False
            at = np.flatnonzero(inner)
            total += np.bincount(x[at - 1] * m + x[at], minlength=m * m)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], names=["pair", "n"])

    out = np.zeros(m * m)
    for r in encoded.where(~F.col("held_out")).select("classes").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most (neighbours + 2) squared
        out[r["pair"]] = r["n"]
    return out.reshape(m, m)


def _start_model(counts: np.ndarray, pairs: np.ndarray, s: Settings) -> Model:
    """Clusters of the frequent words by their neighbours as states."""
    m = s.neighbours
    profile = np.concatenate([pairs[1 : m + 1], pairs[:, 1 : m + 1].T], 1) + 1e-3
    profile = np.sqrt(profile / profile.sum(1, keepdims=True))
    weight = counts[1 : m + 1] + 1e-9
    centres = [int(np.argmax(weight))]
    distance = np.full(m, np.inf)
    for _ in range(s.states - 1):
        distance = np.minimum(distance, ((profile - profile[centres[-1]]) ** 2).sum(1))
        centres.append(int(np.argmax(distance * np.sqrt(weight))))
    centre = profile[centres]
    for _ in range(20):
        label = ((profile[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        for k in range(s.states):
            if (label == k).any():
                centre[k] = np.average(profile[label == k], 0, weight[label == k])
    share = np.full((s.classes, s.states), 1.0 / s.states)
    share[1 : m + 1] = 0.1 / s.states
    share[np.arange(1, m + 1), label] += 0.9
    # a shared class or a rarer word leans by chance, so that states can part where clusters say nothing
    rng = np.random.default_rng(5)
    share[m + 1 :] *= rng.uniform(0.8, 1.2, share[m + 1 :].shape)
    emit = share * (counts[:, None] + 0.5)
    move = np.ones((s.states, s.states))
    np.add.at(move, (label[:, None].repeat(m, 1), label[None].repeat(m, 0)), pairs[1 : m + 1, 1 : m + 1])
    return Model(np.full(s.states, 1.0 / s.states), 0.5 * np.eye(s.states) + 0.5 * move / move.sum(1, keepdims=True), emit / emit.sum(0))


def expected_counts(seq: np.ndarray, bounds: np.ndarray, model: Model, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions, and the log-likelihood, of whole sequences.

    Sequences of like length run in step, a stretch of steps at a time: a first pass keeps the
    forward values at the stretches' edges, then stretches are gone through from the last to the
    first, forward again from the kept edge and backward from the next stretch. So memory is that of
    a stretch, and the counts are those of the uncut sequences.
    """
    k = s.states
    emit = np.concatenate([model.emit, np.ones((1, k))]).astype(np.float32)
    move, start = model.move.astype(np.float32), model.start.astype(np.float32)
    back = move.T.copy()
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    order = order[: int((size > 0).sum())]
    starts, moves, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((s.classes + 1, k)), 0.0
    for g in range(0, len(order), s.together):
        begin, length = bounds[:-1][order[g : g + s.together]], size[order[g : g + s.together]]
        stretches = -(-int(length[0]) // s.stretch)
        alive = [int(np.searchsorted(-length, -c * s.stretch, "left")) for c in range(stretches)]  # sequences of more than so many steps

        def emitted(c: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n, steps = alive[c], min(s.stretch, int(length[0]) - c * s.stretch)
            at = c * s.stretch + np.arange(steps)[:, None]
            real = at < length[None, :n]
            tok = np.where(real, seq[np.minimum(begin[None, :n] + at, len(seq) - 1)], s.classes)
            return tok, real, emit[tok]

        edge = [np.broadcast_to(start, (alive[0], k))]  # what stands for the forward values before each stretch, moved
        a = None
        for c in range(stretches - 1):
            # states of sequences that end before the next stretch are not needed
            n = alive[c + 1]
            b = emit[seq[begin[:n] + c * s.stretch + np.arange(s.stretch)[:, None]]]
            a = edge[c][:n] * b[0]
            for t in range(1, s.stretch):
                a = (a @ move) * b[t]
                if t % 2 == 0:
                    a /= a.sum(1, keepdims=True)
            edge.append((a / a.sum(1, keepdims=True)) @ move)
        after = None  # emission times backward value over scale, at the first step of the next stretch
        for c in reversed(range(stretches)):
            tok, real, b = emitted(c)
            steps = len(tok)
            alpha = np.empty_like(b)
            scale = np.empty(tok.shape, np.float32)
            for t in range(steps):
                a = (alpha[t - 1] @ move if t else edge[c]) * b[t]
                scale[t] = a.sum(1)
                np.divide(a, scale[t][:, None], out=alpha[t])
            beta = np.ones_like(alpha[0])
            if after is not None:
                n = len(after)
                beta[:n] = after @ back
                moves += model.move * (alpha[-1][:n].T @ after)
            gamma = np.empty_like(alpha)
            for t in range(steps - 1, -1, -1):
                np.multiply(alpha[t], beta, out=gamma[t])
                b[t] *= beta
                b[t] /= scale[t][:, None]
                if t:
                    beta = b[t] @ back
            after = b[0].copy()
            gamma *= real[:, :, None]
            b *= real[:, :, None]
            if c == 0:
                starts += gamma[0].sum(0)
            moves += model.move * (alpha[:-1].reshape(-1, k).T @ b[1:].reshape(-1, k))
            flat, each = tok.ravel(), gamma.reshape(-1, k)
            for j in range(k):
                emits[:, j] += np.bincount(flat, each[:, j], s.classes + 1)
            total += float(np.log(scale[real]).sum())
    return starts, moves, emits[:-1], total


def _round(encoded: DataFrame, model: Model, prior: np.ndarray, s: Settings) -> Model:
    """One round of Baum-Welch over all training texts."""
    k, c = s.states, s.classes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + c * k)
        for batch in batches:
            if batch.num_rows:
                a, b, e, _ = expected_counts(*_sequences(batch.column(0)), model, s)
                total += np.concatenate([a, b.ravel(), e.ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    total = np.zeros(k + k * k + c * k)
    for r in encoded.where(~F.col("held_out")).select("classes").mapInArrow(run, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # one row for each parameter of the model
        total[r["cell"]] = r["n"]
    start, move, emit = total[:k] + 1.0, total[k : k + k * k].reshape(k, k) + 1.0, total[k + k * k :].reshape(c, k) + prior[:, None]
    return Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def log10_likelihood(seq: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """The exact log10 probability of each sequence by the scaled forward recursion, all sequences in step."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][order], size[order]
    out = np.zeros(len(size))
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left")  # so many are longer than t
    alpha = np.zeros((0, len(model.start)))
    for t, n in enumerate(active.tolist()):
        b = model.emit[seq[begin[:n] + t]]
        alpha = (alpha[:n] @ model.move if t else model.start) * b
        c = alpha.sum(1)
        out[:n] += np.log10(c)
        alpha /= c[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


def score(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs with its unigram and its hidden Markov log10 probability, learnt from the rows that are not held out.

    A null text is empty: its one token is the end. A null id stays null and is trained on. Repeated
    rows each count and get a row. Without training rows all counts are 0. Other columns are not read.
    """
    source = _source(docs, id_col, text_col)
    texts = source.where(~F.col("held_out")).count()
    vocabulary = save(_vocabulary(source, s), "vocabulary")
    lexicon = _lexicon(vocabulary, texts, s)
    encoded = save(_encoded(source, lexicon, texts, s), "encoded")
    model = _start_model(lexicon.class_counts, _neighbour_counts(encoded, s), s)
    prior = lexicon.class_counts / max(lexicon.class_counts.sum(), 1.0) + 1e-6
    for _ in range(s.rounds):
        model = _round(encoded, model, prior, s)
    tokens = math.log10(lexicon.tokens + s.add * (lexicon.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(log10_likelihood(*_sequences(batch.column(7)), model))], names=[*batch.schema.names[:-1], "states"])

    scored = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "sum_base", "sum_within", "classes").mapInArrow(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, sum_base double, sum_within double, states double")
    # frequent words are not among these, so no key is hot
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    rare = rare.join(vocabulary.select("key", "n"), "key", "left").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + s.add)).alias("more"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.join(rare, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(lexicon.tokens).cast("long").alias("train_tokens"),
        (F.col("sum_base") + more - F.col("n_tokens") * tokens).alias("base_score"), (F.col("sum_within") + more + F.col("states")).alias("score"),
    )
