"""SentencePiece encoding and decoding by suffix-array matching.

The texts of a batch stand one after another in index texts of a fixed size. They are cut into units, each
a run of spaces and what follows up to the next space; no piece of the model crosses such a cut. The suffixes of the index text, each up to the end of its unit, are sorted as far as the
longest piece tells them apart; binary search finds the range of suffixes that begin with each piece,
which are the piece's occurrences. The occurrences are edges; sorted by position they are relaxed:
for a unigram model, by the best path to each position; for a merge model, by joining, in each unit,
the two neighbours whose joint edge has the best score, until none is left. All units are relaxed in
step, equal ones once; a very long one has a heap of its own. Bytes without an edge fall back to byte pieces.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

BAR = "▁".encode()
UNIGRAM, MERGES = 1, 2
WIDTH = 10  # bits of a piece's bytes in the key of an edge
LONGEST = (1 << WIDTH) - 1  # bytes; a longer piece is refused
INDEX_BYTES = 1 << 18  # text that is indexed together, so that its arrays stay in a core's cache; a longer unit stands alone
IN_STEP = 256  # characters of a unit up to which it is relaxed in step with others; it changes no result


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        tag, at = _varint(raw, at)
        if tag & 7 == 0:
            value, at = _varint(raw, at)
        else:
            size, at = _varint(raw, at) if tag & 7 == 2 else (4 if tag & 7 == 5 else 8, at)
            value, at = raw[at : at + size], at + size
        yield tag >> 3, value


class Model:
    """The pieces of a model file, spaces in them as such, with their ids and scores; the ids of bytes; and the bytes of each id."""

    def __init__(self, proto: bytes):
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        top = list(_fields(proto))
        trainer = dict(_fields(next(v for f, v in top if f == 2)))
        normaliser = dict(_fields(next(v for f, v in top if f == 3)))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, MERGES) or normaliser.get(2) or normaliser.get(4, 1):
            raise ValueError("only unigram and merge models that leave the text as it is are supported")
        self.prefix = bool(normaliser.get(3, 1))
        size = library.get_piece_size()
        self.byte_ids, self.out = np.full(256, library.unk_id(), np.uint32), [b""] * size
        found = []
        for i in range(size):
            piece = library.id_to_piece(i)
            if library.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                self.out[i] = bytes([int(piece[1:-1], 16)])
            elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
                self.out[i] = piece.encode().replace(BAR, b" ")
                found.append((self.out[i], i, library.get_score(i)))
        self.pieces, ids, scores = zip(*sorted(found), strict=True)
        if max(map(len, self.pieces)) > LONGEST or any(b" " in p.lstrip(b" ") for p in self.pieces):
            raise ValueError(f"pieces across words or of over {LONGEST} bytes are not supported")
        self.ids, self.scores = np.array(ids, np.uint32), np.array(scores)
        self.sizes = np.array(list(map(len, self.pieces)))
        self.levels = -(-int(self.sizes.max()) // 8)
        padded = np.zeros((len(self.pieces), 8 * self.levels), np.uint8)
        for k, p in enumerate(self.pieces):
            padded[k, : len(p)] = np.frombuffer(p, np.uint8)
        self.keys = np.ascontiguousarray(padded).view(">u8").astype(np.uint64)
        rest = np.clip(8 * (np.arange(self.levels) + 1) - self.sizes[:, None], 0, 8)
        self.upper = self.keys | np.where(rest == 8, np.uint64(2**64 - 1), (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1))
        self.out_sizes = np.array(list(map(len, self.out)))
        self.out_at = np.cumsum(self.out_sizes) - self.out_sizes
        self.out_bytes = np.frombuffer(b"".join(self.out), np.uint8)


@lru_cache(2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def _word(text: np.ndarray, rest: np.ndarray, level: int) -> np.ndarray:
    """Eight bytes of each suffix from 8 * level on as a number, 0 beyond the unit. text has 8 bytes more than there are suffixes."""
    out = np.zeros(len(rest), np.uint64)
    at = np.flatnonzero(rest > 8 * level)
    part = np.lib.stride_tricks.sliding_window_view(text, 8)[at + 8 * level].view(">u8").ravel().astype(np.uint64)
    over = 8 * level + 8 - rest[at]
    part &= np.left_shift(np.uint64(2**64 - 1), (8 * np.clip(over, 0, 7)).astype(np.uint64))
    out[at] = part
    return out


def suffixes(text: np.ndarray, rest: np.ndarray, levels: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order of their first 8 * levels bytes within their unit, and their keys in that order by level."""
    text = np.concatenate([text, np.zeros(8, np.uint8)])
    first = _word(text, rest, 0)
    order = np.argsort(first)
    keys = [first[order]]
    same = np.r_[False, keys[0][1:] == keys[0][:-1]]
    for level in range(1, levels):
        word = _word(text, rest, level)
        run = np.cumsum(~same)
        long_run = np.bincount(run, rest[order] > 8 * level) > 0
        at = np.flatnonzero(long_run[run])
        if len(at):
            inner = np.lexsort((word[order[at]], run[at]))
            order[at] = order[at][inner]
        keys.append(word[order])
        same &= np.r_[False, keys[-1][1:] == keys[-1][:-1]]
    return order, keys


def _bound(key: np.ndarray, low: np.ndarray, high: np.ndarray, sought: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of each sought number between its own bounds."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        below = key[mid] <= sought[open_] if right else key[mid] < sought[open_]
        low[open_[below]] = mid[below] + 1
        high[open_[~below]] = mid[~below]


def edges(text: np.ndarray, rest: np.ndarray, model: Model, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of pieces, each as its position and bytes in one number, in order, and the pieces' numbers in the model. wanted: positions whose edges are sorted."""
    order, keys = suffixes(text, rest, model.levels)
    low = np.searchsorted(keys[0], model.keys[:, 0], "left")
    high = np.searchsorted(keys[0], model.upper[:, 0], "right")
    for level in range(1, model.levels):
        at = np.flatnonzero((model.sizes > 8 * level) & (low < high))
        a, b = _bound(keys[level], low[at], high[at], model.keys[at, level], False), _bound(keys[level], low[at], high[at], model.upper[at, level], True)
        low[at], high[at] = a, b
    n = high - low
    piece = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(piece)) + np.repeat(low - (np.cumsum(n) - n), n)
    at = order[at]
    if wanted is not None:
        here = wanted[at]
        at, piece = at[here], piece[here]
    key = (at << WIDTH) + model.sizes[piece]
    by = np.argsort(key)
    return key[by], piece[by]


class _Edges:
    def __init__(self, key: np.ndarray, piece: np.ndarray):
        self.key, self.piece = key, piece

    def find(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The piece from start to end, or -1."""
        if not len(self.key):
            return np.full(len(start), -1)
        size = end - start
        k = (start << WIDTH) + np.minimum(size, LONGEST)
        at = np.minimum(np.searchsorted(self.key, k), len(self.key) - 1)
        return np.where((self.key[at] == k) & (size <= LONGEST), self.piece[at], -1)


def _merge(starts: np.ndarray, ends: np.ndarray, unit: np.ndarray, found: _Edges, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends after joining, in each unit, the best pair of neighbours, the first of equals, again and again."""
    done_s, done_e = [], []
    first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])[: len(starts)]
    size = np.diff(np.append(first, len(starts)))
    for k in np.flatnonzero(size > IN_STEP).tolist():
        part = slice(first[k], first[k] + size[k])
        a, b = _merge_long(starts[part], ends[part], found, model)
        done_s.append(a)
        done_e.append(b)
    if done_s:
        short = np.repeat(size <= IN_STEP, size)
        starts, ends, unit = starts[short], ends[short], unit[short]

    def scores(i: np.ndarray) -> np.ndarray:
        out = np.full(len(i), -np.inf)
        ok = np.flatnonzero(i + 1 < len(starts))
        ok = ok[unit[i[ok]] == unit[i[ok] + 1]]
        piece = found.find(starts[i[ok]], ends[i[ok] + 1])
        out[ok] = np.where(piece >= 0, model.scores[piece], -np.inf)
        return out

    score = scores(np.arange(len(starts)))
    while len(starts):
        first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
        best = np.maximum.reduceat(score, first)
        size = np.diff(np.append(first, len(starts)))
        over = np.repeat(best == -np.inf, size)
        if over.any():
            done_s.append(starts[over])
            done_e.append(ends[over])
            starts, ends, unit, score = starts[~over], ends[~over], unit[~over], score[~over]
            best, size = best[best > -np.inf], size[best > -np.inf]
        if not len(starts):
            break
        local = np.repeat(np.arange(len(size)), size)
        hit = np.flatnonzero(score == best[local])
        hit = hit[np.r_[True, local[hit][1:] != local[hit][:-1]]]
        ends[hit] = ends[hit + 1]
        keep = np.ones(len(starts), bool)
        keep[hit + 1] = False
        hit = hit - np.arange(len(hit))
        starts, ends, unit, score = starts[keep], ends[keep], unit[keep], score[keep]
        changed = np.zeros(len(starts), bool)
        changed[hit] = changed[hit[hit > 0] - 1] = True
        again = np.flatnonzero(changed)
        score[again] = scores(again)
    starts, ends = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_s, done_e))
    order = np.argsort(starts)
    return starts[order], ends[order]


def _merge_long(starts: np.ndarray, ends: np.ndarray, found: _Edges, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The same for one unit, by a heap of neighbours: n log n steps."""
    n, score = len(starts), model.scores.tolist()
    low = np.searchsorted(found.key, starts << WIDTH).tolist()
    high = np.searchsorted(found.key, (starts + 1) << WIDTH).tolist()
    key, piece = found.key[low[0] : high[-1]].tolist(), found.piece[low[0] : high[-1]].tolist()
    low, high = [x - low[0] for x in low], [x - low[0] for x in high]
    start, end = starts.tolist(), ends.tolist()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap: list[tuple[float, int, int]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            sought = (start[i] << WIDTH) + end[j] - start[i]
            for k in range(low[i], high[i]):
                if key[k] == sought:
                    heapq.heappush(heap, (-score[piece[k]], i, end[j]))
                    break

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        end[i], alive[j], after[i] = stop, False, after[j]
        if after[i] < n:
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    kept = [i for i in range(n) if alive[i]]
    return starts[kept], np.array([end[i] for i in kept], np.int64)


def _best_path(starts: np.ndarray, chars_end: np.ndarray, unit_start: np.ndarray, unit_end: np.ndarray, rank: np.ndarray, found: _Edges, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces on the best path through each unit; rank counts the characters before a position in its unit.

    A character without a piece costs ten more than the worst piece. Of equal paths, the one whose
    last piece begins first is taken.
    """
    n = len(rank)
    single = found.find(starts, chars_end)
    missing = np.flatnonzero(single < 0)
    a = np.concatenate([found.key >> WIDTH, starts[missing]])
    b = np.concatenate([(found.key >> WIDTH) + (found.key & LONGEST), chars_end[missing]])
    value = np.concatenate([model.scores[found.piece], np.full(len(missing), model.scores.min() - 10)])
    step = rank[b - 1] + 1  # characters of the unit up to the edge's end
    order = np.lexsort((a, b, step))
    a, b, value, step = a[order], b[order], value[order], step[order]
    best, back = np.full(n + 1, -np.inf), np.zeros(n + 1, np.int64)
    head = np.zeros(n + 1, bool)
    head[unit_start] = True
    cut = np.searchsorted(step, np.arange(1, int(step.max(initial=0)) + 2))
    for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        total = np.where(head[a[i:j]], 0.0, best[a[i:j]]) + value[i:j]
        first = np.flatnonzero(np.r_[True, b[i:j][1:] != b[i:j][:-1]])
        top = np.maximum.reduceat(total, first)
        size = np.diff(np.append(first, j - i))
        hit = np.flatnonzero(total == np.repeat(top, size))
        hit = hit[np.r_[True, b[i:j][hit][1:] != b[i:j][hit][:-1]]]
        best[b[i:j][hit]], back[b[i:j][hit]] = total[hit], a[i:j][hit]
    at, out_s, out_e = unit_end, [], []
    floor = unit_start
    while len(at):
        out_s.append(back[at])
        out_e.append(at)
        at = back[at]
        at, floor = at[at > floor], floor[at > floor]
    s, e = np.concatenate(out_s), np.concatenate(out_e)
    order = np.argsort(s)
    return s[order], e[order]


def encode_units(text: np.ndarray, unit_start: np.ndarray, model: Model, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of units that stand one after another, and how many each has. Units of one key are equal, and one of them is relaxed."""
    n = len(text)
    unit_end = np.append(unit_start[1:], n)
    size = unit_end - unit_start
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    first = np.zeros(len(unit_start), bool)
    first[one] = True
    wanted = np.repeat(first, size)
    found = _Edges(*edges(text, np.repeat(unit_end, size) - np.arange(n), model, wanted))
    chars = (text & 0xC0) != 0x80
    starts = np.flatnonzero(chars)
    ends = np.append(starts[1:], n)
    starts, ends = starts[wanted[starts]], ends[wanted[starts]]
    if model.kind == MERGES:
        starts, ends = _merge(starts, ends, np.searchsorted(unit_start, starts, "right") - 1, found, model)
    else:
        count = np.cumsum(chars)
        starts, ends = _best_path(starts, ends, unit_start[first], unit_end[first], count - np.repeat(count[unit_start], size), found, model)
    piece = found.find(starts, ends)
    times = np.where(piece >= 0, 1, ends - starts)
    part = np.repeat(np.arange(len(starts)), times)
    step = np.arange(len(part)) - np.repeat(np.cumsum(times) - times, times)
    ids = np.where(piece[part] >= 0, model.ids[piece[part]], model.byte_ids[text[np.minimum(starts[part] + step, n - 1)]]).astype(np.uint32)
    of = np.bincount(np.searchsorted(unit_start, starts[part], "right") - 1, minlength=len(unit_start))
    # from the relaxed units, in order of their places, to all that are equal
    begin = (np.cumsum(of) - of)[one][which]
    counts = of[one][which]
    bounds = np.cumsum(counts) - counts
    return ids[np.repeat(begin - bounds, counts) + np.arange(int(counts.sum()))], counts.astype(np.int32)


def _spaced(block: words.Block, model: Model) -> words.Block:
    """The rows with a space before each that is not empty, and bars as spaces."""
    raw = block.data.tobytes()
    texts = [raw[a:b].replace(BAR, b" ") for a, b in zip(block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True)]
    texts = [b" " + t if t and model.prefix else t for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=bounds[1:])
    return words.Block(np.frombuffer(b"".join(texts), np.uint8), bounds, block.first)


def encode_block(block: words.Block, model: Model) -> tuple[np.ndarray, np.ndarray, words.Block]:
    """The ids of all rows, where the rows begin, and the rows as they were encoded."""
    spaced = _spaced(block, model)
    data, n = spaced.data, len(spaced.data)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(block.rows + 1, np.int64), spaced
    space = data == 0x20
    start = space.copy()
    start[1:] &= ~space[:-1]
    start[spaced.bounds[:-1][np.diff(spaced.bounds) > 0]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)

    ids, counts = [], []
    keys = spaced.hashes(starts, ends)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + INDEX_BYTES, "right")))
        part, size = encode_units(data[starts[a] : ends[b - 1]], starts[a:b] - starts[a], model, keys[a:b])
        ids.append(part)
        counts.append(size)
        a = b
    total = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.concatenate(counts), out=total[1:])
    return np.concatenate(ids), total[np.searchsorted(starts, spaced.bounds)], spaced


def decode_ids(ids: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, and where each id's begin, with the end of the last."""
    size = model.out_sizes[ids]
    bounds = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(size, out=bounds[1:])
    return model.out_bytes[np.repeat(model.out_at[ids] - bounds[:-1], size) + np.arange(bounds[-1])], bounds


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each row. A null or empty text has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            for block in words.blocks(batch.column(1)):
                ids, bounds, _ = encode_block(block, model)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids; bytes that are no UTF-8 become replacement characters. Null ids have an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                text = decode_ids(np.array(x or [], np.int64), model)[0].tobytes().decode(errors="replace")
                out.append(text[1:] if model.prefix and text.startswith(" ") else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


DIGEST = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean"


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row: its ids and their text, decoded again, as checksums, and whether that is the text.

    ids_crc32 is over little-endian numbers of 32 bits. A text with the model's bar in it comes back
    with spaces there, so its round trip fails. A null text is empty; a null id stays null; repeated
    rows each get a row; very long texts are indexed by parts that end between units; of equal scores
    the first pair is joined; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path)
        is_byte = np.zeros(len(model.out), bool)
        is_byte[model.byte_ids] = True
        for batch in batches:
            for block in words.blocks(batch.column(1)):
                ids, bounds, _ = encode_block(block, model)
                text, at = decode_ids(ids, model)
                at, raw, whole, source = at[bounds], ids.astype("<u4").tobytes(), text.tobytes(), block.data.tobytes()
                rows = []
                for a, b, c, d, e, f in zip(bounds[:-1].tolist(), bounds[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), block.bounds[:-1].tolist(), block.bounds[1:].tolist(), strict=True):
                    back = whole[c + (model.prefix and whole[c : c + 1] == b" " and d > c) : d]
                    rows.append((f - e, b - a, zlib.crc32(raw[4 * a : 4 * b]), zlib.crc32(back), back == source[e:f]))
                size, n, crc, back, same = zip(*rows, strict=True)
                total = np.zeros(len(ids) + 1, np.int64)
                np.cumsum(is_byte[ids], out=total[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.first, block.rows), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(np.diff(total[bounds])), pa.array(crc, pa.int64()), pa.array(back, pa.int64()), pa.array(same)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, DIGEST)
