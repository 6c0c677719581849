"""Best-fit packing by a configuration linear program.

A configuration is a multiset of lengths that fits a sequence. The program is to cover the length
histogram with the fewest configurations; its dual gives each length a price, so that no
configuration costs more than one sequence, and the prices of all pieces are a bound from below.
Multiplicative weights solve both: the price of a length starts as its share of a sequence and falls
exponentially with the share of its pieces that is covered; dynamic programming over the capacity
finds the configuration of greatest price, which enters the solution, and whose price makes the
prices feasible. The fractional solution is scaled until it covers all, rounded down, and what is
left is filled by a bounded knapsack, that gives each longest piece the company that leaves the least
room. Rounds go on until the best packing found meets the bound, or for a number of rounds. All this
sees only the histogram, so its cost does not depend on the number of documents.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .scratch import save
from .unit_cache import UnitCache

Configuration = tuple[tuple[int, int], ...]  # lengths, longest first, and how often each


@dataclass(frozen=True)
class Settings:
    """capacity: tokens of a sequence. least_rounds, rounds: prices tried, at least and, if the bound is not met, at most. batch: so many at once, all but one of them a little shaken by noise. rate, step: of the weights, and of the coverage that a round gives a configuration. salt_rows: pieces of one length that are ranked together."""

    capacity: int = 2048
    least_rounds: int = 4
    rounds: int = 160
    batch: int = 16
    noise: float = 0.02
    rate: float = 8.0
    step: float = 0.05
    salt_rows: int = 50_000
    seed: int = 11


@dataclass(frozen=True)
class Plan:
    """Configurations and how often each is used; the bound from below on their number, the value of the fractional solution, and the rounds it took."""

    configurations: list[tuple[Configuration, int]]
    bound: int
    fractional: float
    rounds: int

    @property
    def sequences(self) -> int:
        return sum(n for _, n in self.configurations)


def price(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of whole prices by length, 0 included: the greatest price at each capacity and the length last added. Lengths of price 0 are not used."""
    n, size = prices.shape
    best, last = np.zeros((n, size), np.int64), np.zeros((n, size), np.int32)
    back = np.zeros((n, size), np.int64)  # best, from the end on: back[:, size - 1 - c] is best[:, c]
    rows = np.arange(n)
    for c in range(1, size):
        total = prices[:, 1 : c + 1] + back[:, size - c : size]
        at = total.argmax(1)
        value = total[rows, at]
        fits = value > best[:, c - 1]
        best[:, c] = np.where(fits, value, best[:, c - 1])
        last[:, c] = np.where(fits, at + 1, 0)
        back[:, size - 1 - c] = best[:, c]
    return best, last


def _configuration(last: np.ndarray) -> Configuration:
    c, found = len(last) - 1, {}
    while c > 0:
        if length := int(last[c]):
            found[length] = found.get(length, 0) + 1
            c -= length
        else:
            c -= 1
    return tuple(sorted(found.items(), reverse=True))


def fill(counts: np.ndarray, capacity: int) -> dict[Configuration, int]:
    """All pieces in configurations: again and again the longest one left and, by a bounded knapsack over what else is left, the pieces that leave the least room beside it, long ones first; each configuration as often as its pieces last."""
    left, out = counts.copy(), {}
    while True:
        lengths = np.flatnonzero(left)[::-1].tolist()
        if not lengths:
            return out
        first = lengths[0]
        room = capacity - first
        left[first] -= 1
        # bit c of a number: whether some of the pieces gone through have c tokens together
        sums, parts, reach = 1, [], [1]
        mask = (1 << (room + 1)) - 1
        for length in lengths:
            n, k = min(int(left[length]), room // length), 1
            while n > 0:
                take = min(k, n)
                sums |= (sums << (length * take)) & mask
                parts.append((length, take))
                reach.append(sums)
                n, k = n - take, 2 * k
            if sums >> room & 1:
                break
        at, found = sums.bit_length() - 1, {first: 1}
        for k in range(len(parts) - 1, -1, -1):
            if not reach[k] >> at & 1:
                length, take = parts[k]
                at -= length * take
                found[length] = found.get(length, 0) + take
                left[length] -= take
        times = 1 + min(int(left[k]) // a for k, a in found.items())
        for k, a in found.items():
            left[k] -= a * (times - 1)
        p = tuple(sorted(found.items(), reverse=True))
        out[p] = out.get(p, 0) + times


def solve(counts: np.ndarray, s: Settings = Settings()) -> Plan:
    """A packing of all pieces, counted by length from 0 on, and the bound."""
    full = int(counts[s.capacity])
    counts = np.array(counts, np.int64)
    counts[s.capacity] = 0
    done = [(((s.capacity, 1),), full)] if full else []
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return Plan(done, full, float(full), 0)
    rng = np.random.default_rng(s.seed)
    wanted = counts[lengths].astype(float)
    best = fill(counts, s.capacity)
    bound, value, used, rounds = 0, float("inf"), {}, 0
    covered, mean = np.zeros(len(lengths)), np.zeros(len(lengths))
    while rounds < s.least_rounds or rounds < s.rounds and sum(best.values()) > bound:
        rounds += 1
        lag = np.exp(-s.rate * (covered - covered.min()))
        prices = np.zeros((s.batch, s.capacity + 1), np.int64)
        if rounds == 1:  # tokens
            prices[0, lengths] = lengths
        else:
            prices[0, lengths] = np.floor(lengths * lag * (1 << 24))
        prices[1:, lengths] = np.floor(lengths * lag * rng.uniform(1 - s.noise, 1, (s.batch - 1, len(lengths))) * (1 << 24))
        mean += lengths * lag / (wanted @ (lengths * lag))  # the mean of all rounds' prices is nearer to the best ones than any of them
        prices[1, lengths] = np.floor(mean / mean.max() * (1 << 30))
        top, last = price(prices)
        # whole numbers, so that the bound is exact: the prices over the greatest one of a configuration are feasible
        bound = max([bound, *(-(-sum(int(n) * int(p) for n, p in zip(counts[lengths], row[lengths], strict=True)) // int(t)) for row, t in zip(prices[:2], top[:2, -1], strict=True) if t)])
        for row in last:
            p = _configuration(row)
            at = np.searchsorted(lengths, [k for k, _ in p])
            times = np.array([a for _, a in p])
            amount = s.step * float((wanted[at] / times).min())
            used[p] = used.get(p, 0.0) + amount
            covered[at] += amount * times / wanted[at]
        if covered.min() > 0:
            value = min(value, sum(used.values()) / float(covered.min()))
        if rounds % 8 == 0 or rounds == s.least_rounds:
            best = min(best, _rounded(used, covered, counts, s), key=lambda x: sum(x.values()))
    return Plan(done + list(best.items()), bound + full, min(value, float(sum(best.values()))) + full, rounds)


def _rounded(used: dict[Configuration, float], covered: np.ndarray, counts: np.ndarray, s: Settings) -> dict[Configuration, int]:
    """The fractional solution, scaled to the coverage of most lengths and rounded down, with what is left filled."""
    left, out = counts.copy(), {}
    scale = 1 / max(float(np.median(covered)), 1e-9)
    for p, amount in sorted(used.items(), reverse=True):
        if n := min([int(amount * scale), *(int(left[k]) // a for k, a in p)]):
            out[p] = n
            for k, a in p:
                left[k] -= n * a
    for p, n in fill(left, s.capacity).items():
        out[p] = out.get(p, 0) + n
    return out


# How a tokenizer must prepare text for encode() to cut it before; any other gets whole rows.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class _Vocabulary(UnitCache):
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # each worker has one core
        from tokenizers import Tokenizer

        super().__init__(most=1_500_000)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.cuts = spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER
        self.special = tuple(x["content"].encode() for x in spec["added_tokens"])


_loaded: dict[str, _Vocabulary] = {}
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def encode(block: words.Block, vocabulary: _Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, each followed by 0, and where the rows begin.

    A tokenizer that drops white space, puts letters in lower case and cuts between letters and marks
    gets the parts between those cuts alone, each distinct one once. The special tokens' strings have
    such cuts inside; a block that holds one is cut at white space only. Any other tokenizer gets
    whole rows.
    """
    data = block.data
    raw = data.tobytes()
    if not vocabulary.cuts:
        found = [vocabulary.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)]
        return np.array([x for ids in found for x in (*ids, 0)], np.uint32), np.cumsum([0, *(len(ids) + 1 for ids in found)])
    if any(x in raw for x in vocabulary.special):
        lower, cuts = data, None
    else:
        lower = _LOWER[data]
        letter, mark = _LETTER[data], _MARK[data]
        cuts = np.zeros(len(data), bool)
        cuts[1:] = letter[1:] & mark[:-1] | mark[1:] & letter[:-1]
        raw = lower.tobytes()
    starts, ends, rows = block.spans(words.SPACES, lower, cuts)
    h = words.Block(lower, block.bounds, 0).hashes(starts, ends)

    def words_ids(part: np.ndarray, one: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        spelled = [raw[a:b].decode() for a, b in zip(starts[one[part]].tolist(), ends[one[part]].tolist(), strict=True)]
        got = [e.ids for e in vocabulary.tokenizer.encode_batch_fast(spelled, add_special_tokens=False)]
        size = np.fromiter(map(len, got), np.int32, len(got))
        return np.fromiter((x for e in got for x in e), np.uint32, int(size.sum())), size

    ids, total = vocabulary.spread(h, words_ids)
    first = np.searchsorted(rows, np.arange(block.rows + 1))
    bounds = total[first] + np.arange(block.rows + 1)
    out = np.zeros(bounds[-1], np.uint32)
    # each row's ids move on by the zeros before them
    shift = np.repeat(np.arange(block.rows), np.diff(total[first]))
    out[np.arange(total[-1]) + shift] = ids
    return out, bounds


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of each row's ids: one, or as many full ones as it takes and a rest. A null text is empty, and its one id is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = _Vocabulary(tokenizer)
        for batch in batches:
            for block in words.blocks(batch.column(1), 1 << 20):
                ids, bounds = encode(block, _loaded[tokenizer])
                size = np.diff(bounds)
                n = -(-size // s.capacity)
                row = np.repeat(np.arange(block.rows), n)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * s.capacity
                length = np.minimum(size[row] - start, s.capacity)
                raw, at = memoryview(ids.astype("<u4").tobytes()), bounds[row] + start
                crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(block.first + row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, PIECES)


def _cells(found: list[tuple[Configuration, int]]) -> tuple[np.ndarray, ...]:
    """For each length in each configuration, in order of lengths: the length, the first rank of its pieces there, the first sequence, how often a sequence has it, and the place of the first."""
    cells, sequence = [], 0
    for p, n in found:
        place = 0
        for length, a in p:
            cells.append((length, n * a, sequence, a, place))
            place += length * a
        sequence += n
    x = np.array(cells, np.int64).reshape(-1, 5)
    x = x[np.argsort(x[:, 0], kind="stable")]
    before = np.cumsum(x[:, 1]) - x[:, 1]
    start = np.searchsorted(x[:, 0], x[:, 0])
    return x[:, 0], before - before[start], x[:, 2], x[:, 3], x[:, 4]


def pack(docs: DataFrame, tokenizer: str, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece with its sequence and its place there; sequences are numbered from 0.

    Null texts are empty and take one token; null ids stay null; repeated rows are packed each, and
    rows of one id are dealt out like any others; very long texts are cut in pieces; other columns
    are not read. An empty table has no pieces.
    """
    cut = save(pieces(docs, tokenizer, s, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pieces")  # written, so a row's number is fixed
    counts = np.zeros(s.capacity + 1, np.int64)
    for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect():  # no more rows than the capacity
        counts[r["length"]] = r["n"]
    length, rank, sequence, times, place = _cells(solve(counts, s).configurations)
    salts = int(max(64, -(-int(counts.max()) // s.salt_rows)))
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)))
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("row")) - 1).join(base, ["length", "salt"])
    key = length * (1 << 44)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = np.asarray(batch.column(3)), np.asarray(batch.column(5))
            cell = np.searchsorted(key + rank, n * (1 << 44) + r, "right") - 1
            r = r - rank[cell]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence[cell] + r // times[cell]), pa.array(place[cell] + r % times[cell] * n)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).cast("long").alias("at")).mapInArrow(run, f"{PIECES}, sequence_id long, offset long")
