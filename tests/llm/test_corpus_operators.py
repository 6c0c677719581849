"""Language model, sharding, media, packing, toxicity and near duplicates against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from smoothlake.llm import hidden_markov, media, near_duplicates, packing, sharding, toxicity, words

from .conftest import DATA, edge_rows, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_language_model(which, request):
    docs = request.getfixturevalue(which).select("doc_id", "text")
    rows = [(r["doc_id"], [*WORD.findall(lower(r["text"])), None]) for r in docs.collect()]
    train = [w for i, w in rows if i is None or zlib.crc32(str(i).encode()) % 10]
    c = Counter(itertools.chain(*train))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 5)) for i, w in rows)
    got = hidden_markov.score(docs, hidden_markov.Settings(rounds=1, known=500, own=50, shared=64, neighbours=20, states=3)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    if which == "documents":
        held = [r for r in got if r["held_out"]]
        assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def _hmm(states=3):
    s = hidden_markov.Settings(states=states, own=3, shared=2, stretch=7, together=2)
    r = np.random.default_rng(3)
    model = hidden_markov.Model(*(x / x.sum(axis, keepdims=True) for x, axis in ((r.random(states), 0), (r.random((states, states)), 1), (r.random((s.classes, states)), 0))))
    return s, model


def test_forward_scores_are_exact():
    s, m = _hmm()
    seqs = [[1, 2, 0], [5, 4, 3, 3, 0], [0], list(range(6)) * 40]
    bounds = np.cumsum([0, *map(len, seqs)])
    got = hidden_markov.log10_likelihood(np.array(sum(seqs, []), np.uint16), bounds, m)
    for seq, g in zip(seqs[:3], got, strict=False):
        total = 0.0
        for path in itertools.product(range(3), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, x in zip(path, path[1:], seq[1:], strict=False):
                p *= m.move[a, b] * m.emit[x, b]
            total += p
        assert g == pytest.approx(math.log10(total))


def test_expected_counts_are_exact():
    s, m = _hmm(2)
    seqs = [[1, 2, 0], [5, 4, 3, 0]]
    starts, moves, emits, total = np.zeros(2), np.zeros((2, 2)), np.zeros((s.classes, 2)), 0.0
    for seq in seqs:
        weights = {}
        for path in itertools.product(range(2), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, x in zip(path, path[1:], seq[1:], strict=False):
                p *= m.move[a, b] * m.emit[x, b]
            weights[path] = p
        z = sum(weights.values())
        total += math.log(z)
        for path, p in weights.items():
            starts[path[0]] += p / z
            for a, b in zip(path, path[1:], strict=False):
                moves[a, b] += p / z
            for x, k in zip(seq, path, strict=True):
                emits[x, k] += p / z
    got = hidden_markov.expected_counts(np.array(sum(seqs, []), np.uint16), np.cumsum([0, *map(len, seqs)]), m, s)
    for a, b in zip(got, (starts, moves, emits, total), strict=True):
        assert np.allclose(a, b, atol=1e-4)


def test_stretches_change_no_counts():
    """Expected counts of texts of up to 1,000 tokens, cut in stretches, against one run over each whole text in doubles."""
    s, m = _hmm()
    r = np.random.default_rng(8)
    seqs = [r.integers(0, s.classes, n) for n in (1000, 257, 256, 255, 14, 7, 8, 1)]
    starts, moves, emits, total = np.zeros(3), np.zeros((3, 3)), np.zeros((s.classes, 3)), 0.0
    for seq in seqs:
        b, n = m.emit[seq], len(seq)
        alpha, scale, beta = np.zeros((n, 3)), np.zeros(n), np.ones((n, 3))
        for t in range(n):
            a = (alpha[t - 1] @ m.move if t else m.start) * b[t]
            scale[t] = a.sum()
            alpha[t] = a / scale[t]
        for t in range(n - 2, -1, -1):
            beta[t] = m.move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
            moves += m.move * np.outer(alpha[t], b[t + 1] * beta[t + 1] / scale[t + 1])
        starts += alpha[0] * beta[0]
        np.add.at(emits, seq, alpha * beta)
        total += np.log(scale).sum()
    for stretch, together in ((7, 2), (256, 3), (5000, 50)):
        own = hidden_markov.Settings(states=3, own=3, shared=2, stretch=stretch, together=together)
        got = hidden_markov.expected_counts(np.concatenate(seqs).astype(np.uint16), np.cumsum([0, *map(len, seqs)]), m, own)
        for a, b in zip(got, (starts, moves, emits, total), strict=True):
            assert np.allclose(a, b, rtol=1e-4, atol=1e-3)


@pytest.mark.parametrize("which", ["edge", "documents"])
def test_sharding(which, request):
    docs = request.getfixturevalue(which).select("doc_id", "text")
    rows = docs.collect()
    got = sharding.shard(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in rows)
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r["shard"] < 16 and r["law"] == "bytes"
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_shards_are_even_though_a_third_is_copies(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 3 = 0, repeat('copy ', 50), repeat(concat('w', id, ' '), 30 + id % 60)) as text")
    got = sharding.shard(docs).collect()
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    mean = sum(size.values()) / 16
    assert len(size) == 16 and max(abs(x - mean) for x in size.values()) < 0.02 * mean


def test_shards_of_equal_rows_are_even(spark):
    same = spark.range(2000).selectExpr("7L as doc_id", "'one text' as text")
    empty = spark.range(2000).selectExpr("cast(null as long) as doc_id", "cast(null as string) as text")
    for docs in (same, empty, same.unionAll(empty)):
        size = Counter()
        for r in sharding.shard(docs.repartition(5)).collect():
            size[r["shard"]] += r["size"]
        mean = sum(size.values()) / 16
        assert len(size) == 16 and max(abs(x - mean) for x in size.values()) < 0.1 * mean


def test_slots_follow_the_key(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('text ', id % 700) as text").repartition(6)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for s in (sharding.Settings(), sharding.Settings(range_rows=50, broadcast_rows=0)):
        got = sorted((r["shard"], r["slot"], texts[r["doc_id"]]) for r in sharding.shard(docs, s).collect())
        runs = [t for t, _ in itertools.groupby(x[2] for x in got)]
        assert len(runs) == len(set(runs)) == 700  # equal texts stand together
        assert len({(a, t) for a, _, t in got}) <= 715  # all but those at a splitter in one shard


def test_media(edge, documents):
    for docs in (edge, documents):
        want = Counter()
        for r in docs.collect():
            data = (r["text"] or "").encode()
            padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
            want[r["doc_id"], len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])] += 1
        got = media.text_media(docs).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
        values = defaultdict(set)
        for r in got:
            values[r["payload_sha256"], r["n_bytes"]].add((r["media_sha256"], r["media_bytes"], r["feature"]))
            assert r["caption"] == f"Document {'?' if r['doc_id'] is None else r['doc_id']}, {r['n_bytes']} bytes" and r["position"] == 1 and r["n_items"] == r["n_texts"] + 1
        lines = Counter()
        for r in docs.collect():
            texts = [" ".join(x.split()) for x in (r["text"] or "").split("\n")]
            lines[r["doc_id"], 1 + sum(map(bool, texts)), len(f"Document {'?' if r['doc_id'] is None else r['doc_id']}") + sum(map(len, texts))] += 1
        assert Counter((r["doc_id"], r["n_texts"], r["text_chars"]) for r in got) == lines
        assert all(len(x) == 1 for x in values.values())


def test_interleaved_items(spark):
    page = '<p>Hi &amp; <b>bold</b> x</p><figure><img src="sha256:ab"><img src=sha256:cd><figcaption>Cap <i>t</i></figcaption></figure>tail<script>no</script><img src="http://y"> end'
    assert media.items(page) == [(0, "text", "Hi & bold x", None, None), (1, "media", None, "ab", "Cap t"), (2, "media", None, "cd", "Cap t"), (3, "text", "tail end", None, None)]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "doc_id long, html string")
    known = spark.createDataFrame([("ab", 5)], "digest string, n_bytes long")
    got = {(r["id"], r["position"]): r["n_bytes"] for r in media.resolve(media.interleave(pages), known).collect()}
    assert got == {(1, 0): None, (1, 1): 5, (1, 2): None, (1, 3): None}
    deep = "<div>" * 5000 + "x<figure>" * 3000 + "<img src=sha256:ab>" + "<i>" * 2000 + "y"
    assert [(k, d) for _, k, _, d, _ in media.items(deep)][-2:] == [("media", "ab"), ("text", None)]
    data = np.random.default_rng(0).integers(0, 256, 640, np.uint8)
    assert (media.load(media.store(data.tobytes())).ravel() == data).all()


def test_sequences_of_real_pages_hold_their_media(spark):
    """Pages with images put between their paragraphs: texts and images come back in order, with payloads and captions."""
    r = random.Random(12)
    texts = [prose(k, 1 + 7 * k) for k in range(8)]
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    rows = []
    for x in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        parts = re.split(r"(?<=</p>)", x["html"])
        for k in range(1, len(parts)):
            if r.random() < 0.5:
                which = r.choice([0, 0, 0, r.randrange(8), 99])  # one image is hot, one has no media
                parts[k] = f'<figure><img src="sha256:{digests[which] if which < 99 else "ff"}"><figcaption>No. <b>{which}</b></figcaption></figure>' + parts[k]
        rows.append((x["page_id"], "".join(parts)))
    rows += [(None, rows[0][1]), rows[0], (-1, None), (-2, "")]
    pages = spark.createDataFrame(rows, "page_id long, html string").repartition(3)
    stored = media.stored_texts(spark.createDataFrame([(t,) for t in texts], "text string")).dropDuplicates(["digest"])
    got = media.sequences(pages, stored).collect()
    payload = {d: media.store(media.payload(t.encode())) for d, t in zip(digests, texts, strict=True)}
    want = Counter()
    for i, page in rows:
        want[i, tuple((p, k, t, d, c, payload.get(d)) for p, k, t, d, c in media.items(page or ""))] += 1
    assert Counter((x["id"], tuple((y["position"], y["kind"], y["text"], y["digest"], y["caption"], y["media"] and bytes(y["media"])) for y in x["items"])) for x in got) == want
    held = [y for x in got for y in x["items"] if y["kind"] == "media"]
    assert held and any(y["media"] is None for y in held) and all(y["caption"].startswith("No. ") for y in held) and max(y["position"] for y in held) > 3


def _packed_well(rows, docs):
    t = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for r in docs.collect():
        ids = [*t.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            want[r["doc_id"], k // 2048, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for a, n in sorted(parts):
            assert a == at
            at += n
        assert at <= 2048
    return len(sequences), -(-sum(r["length"] for r in rows) // 2048)


def test_packing(edge, documents):
    _packed_well(packing.pack(edge, TOKENIZER).collect(), edge)
    n, least = _packed_well(packing.pack(documents, TOKENIZER).collect(), documents)
    assert n <= least * 1.03 + 1


def best_fit_decreasing(counts, capacity):
    """The number of sequences that best fit, the longest piece first, needs."""
    rooms = np.zeros(capacity + 1, int)
    sequences = 0
    for length in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[length])):
            fits = np.flatnonzero(rooms[length:])
            if len(fits):
                room = length + int(fits[0])
                rooms[room] -= 1
            else:
                room, sequences = capacity, sequences + 1
            rooms[room - length] += 1
    return sequences


def test_plans_cover_histograms():
    r = np.random.default_rng(5)
    for counts in (np.zeros(65, int), np.eye(65, dtype=int)[64] * 5, r.integers(0, 40, 65) * (np.arange(65) > 0), r.integers(0, 3, 65) * (np.arange(65) > 30), r.integers(0, 9, 65) * (np.arange(65) > 17)):
        s = packing.Settings(capacity=64, rounds=60)
        plan = packing.solve(counts, s)
        total = np.zeros(65, int)
        for p, n in plan.configurations:
            assert sum(a * b for a, b in p) <= 64 and n > 0
            for a, b in p:
                total[a] += b * n
        assert (total == counts).all()
        assert plan.bound <= plan.sequences <= best_fit_decreasing(counts, 64) and plan.bound - 1 < plan.fractional <= plan.sequences + 1e-9
    w = r.integers(0, 1000, (2, 65))
    best, _ = packing.price(w)
    for row, got in zip(w, best, strict=True):
        plain = [0] * 65
        for c in range(1, 65):
            plain[c] = max(plain[c - 1], *(row[k] + plain[c - k] for k in range(1, c + 1)))
        assert plain == got.tolist()


def _optimum(counts, capacity):
    """The least number of sequences, by search over what is left."""
    from functools import cache

    lengths = [k for k in range(capacity + 1) if counts[k]]

    @cache
    def least(left):
        if not any(left):
            return 0
        first = max(k for k, n in enumerate(left) if n)
        best = 10**9

        def put(k, room, now):
            nonlocal best
            if k < 0:
                best = min(best, 1 + least(now))
                return
            for n in range(min(now[k], room // lengths[k]), -1, -1):
                put(k - 1, room - n * lengths[k], (*now[:k], now[k] - n, *now[k + 1 :]))

        rest = (*left[:first], left[first] - 1, *left[first + 1 :])
        put(len(lengths) - 1, capacity - lengths[first], rest)
        return best

    return least(tuple(int(counts[k]) for k in lengths))


def test_plans_against_the_least_number():
    """Histograms without small pieces, where prices by tokens alone bound badly."""
    r = np.random.default_rng(1)
    met = 0
    for _ in range(12):
        counts = np.zeros(31, int)
        counts[r.choice(np.arange(6, 20), 4, replace=False)] = r.integers(1, 5, 4)
        plan = packing.solve(counts, packing.Settings(capacity=30))
        least = _optimum(counts, 30)
        assert plan.bound <= least <= plan.sequences <= least + 1 and plan.sequences <= best_fit_decreasing(counts, 30)
        met += plan.sequences == least
    assert met >= 11
    counts = np.zeros(101, int)
    counts[[35, 51]] = 600, 10  # three of 35 do not fit, so the tokens' bound is 216
    assert packing.solve(counts, packing.Settings(capacity=100)).bound >= 300


@pytest.mark.parametrize("times", [1, 10])
def test_plans_meet_the_bound_on_documents(spark, times):
    cut = packing.pieces(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), TOKENIZER)
    counts = np.zeros(2049, np.int64)
    for r in cut.groupBy("length").count().collect():
        counts[r["length"]] = times * r["count"]
    plan = packing.solve(counts)
    assert plan.sequences == plan.bound <= best_fit_decreasing(counts, 2048)


def test_tokenizers_that_prepare_text_otherwise():
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    texts = ["Hello  World, it's 12.5!", "", " a\nB ", "<|endoftext|> x"]
    ids, bounds = packing.encode(next(words.blocks(pa.array(texts))), packing._Vocabulary(path))
    for k, text in enumerate(texts):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == [*library.encode(text, add_special_tokens=False).ids, 0]


def test_segments_are_maximal():
    def plain(scores):
        """All maximal segments by the definition: take the best, then go on to both sides of it."""
        best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
        if best[0] <= 1e-12:
            return []
        i = -best[2]
        j = i - best[1]
        shift = [(a + j, b + j, s) for a, b, s in plain(scores[j:])]
        return plain(scores[:i]) + [(i, j, best[0])] + shift

    r = random.Random(2)
    for _ in range(300):
        scores = [r.choice([-2.05, -1.05, -0.3, 0.0, 0.7, 1.3, 2.9]) for _ in range(r.randint(1, 14))]
        assert [(a, b, round(s, 6)) for a, b, s in toxicity.segments(np.array(scores))] == [(a, b, round(s, 6)) for a, b, s in plain(scores)]
    n = 300_000  # a falling staircase, on which a search through all earlier segments would be quadratic
    assert len(toxicity.segments(np.tile([1.0, -2.0], n))) == n


def test_odds_against_plain_counts(spark):
    """Counts by label and fold, and scores, against dictionaries of the words of each document."""
    r = random.Random(4)
    texts = [" ".join(r.choices(["idiot", "idiotic", "idea", "the", "of", "Zürich", "a1b", "worthless", "worthy"], k=r.randint(0, 12))) for _ in range(60)]
    rows = [(t, r.randint(0, 1), r.choice([1, 2]) * toxicity.ONE // 2, r.randint(0, 2)) for t in texts]
    found = toxicity._counts(spark.createDataFrame(rows, "text string, toxic int, weight long, fold int").repartition(3)).toPandas().sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
    keys = found["key"].to_numpy().view(np.uint64)
    names, above, plain = {}, {}, defaultdict(lambda: [0.0] * 6)
    for text, toxic, weight, fold in rows:
        seen = set()
        for word in re.findall(rb"[a-z\x80-\xff]+", lower(text).encode()):
            chain = [(0, word)] + [(n, word[:n]) for n in (6, 5, 4) if len(word) >= n]
            above |= dict(zip(chain, [*chain[1:], None], strict=True))
            seen |= set(chain)
        for f in seen:
            names[f] = words.hash_word(f[1]) ^ f[0]
            plain[f][toxic * 3 + fold] += weight / toxicity.ONE
    assert len(names) == len(keys)
    at = {f: int(np.searchsorted(keys, np.uint64(h))) for f, h in names.items()}
    cells = found[[f"n{k}" for k in range(6)]].to_numpy() / toxicity.ONE
    for f, k in at.items():
        assert cells[k].tolist() == plain[f] and found["above"].to_numpy().view(np.uint64)[k] == (names[above[f]] if above[f] else 0)
    n1, n0 = 25.0, 30.0
    got = toxicity.odds(keys, found["above"].to_numpy().view(np.uint64), cells[:, 3:].sum(1), cells[:, :3].sum(1), n1, n0, 3.0, 0.5)

    def score(f):
        base = score(above[f]) if above[f] else 0.0
        p = 1 / (1 + math.exp(-base) * n0 / n1)
        y1, y0 = sum(plain[f][3:]) + 3 * p, sum(plain[f][:3]) + 3 * (1 - p)
        middle = math.log(y1 / y0 * n0 / n1)
        return math.copysign(max(abs(middle) - 0.5 * math.sqrt(1 / y1 + 1 / y0), 0), middle)

    for f, k in at.items():
        assert got[k] == pytest.approx(score(f), abs=1e-9)
    block = next(words.blocks(pa.array(["The idiots of Xyz", "", "idi"])))
    value, row = toxicity.values(block, keys, got)
    assert value.tolist() == pytest.approx([score((0, b"the")), score((5, b"idiot")), score((0, b"of")), 0.0, 0.0]) and row.tolist() == [0, 0, 0, 0, 2]


def test_calibration_against_a_plain_run(spark):
    """Drift, K and the evidence for the curve from rows scored by the other folds, against a run over the collected sample."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity._sample(docs, labels, toxicity.Settings(), "doc_id", "text")
    model = toxicity._fit(sample, toxicity.Settings())
    rows = sample.collect()
    assert len(rows) == sum(zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0 for r in labels.join(docs.select("doc_id"), "doc_id").collect())
    scored = []
    for fold in range(toxicity.FOLDS):
        other = spark.createDataFrame([r for r in rows if r["fold"] != fold], sample.schema)
        counts = toxicity._counts(other).toPandas().sort_values("key", key=lambda k: k.to_numpy().view(np.uint64))
        weight = [sum(r["weight"] for r in rows if r["fold"] != fold and r["toxic"] == t) / toxicity.ONE for t in (1, 0)]
        bad, good = (counts[[f"n{t * 3 + k}" for k in range(3)]].sum(axis=1).to_numpy() / toxicity.ONE for t in (1, 0))
        keys = counts["key"].to_numpy().view(np.uint64)
        odds = toxicity.odds(keys, counts["above"].to_numpy().view(np.uint64), bad, good, *weight, 3.0, 2.0)
        for r in rows:
            if r["fold"] == fold:
                scored.append((r["toxic"], toxicity.values(next(words.blocks(pa.array([r["text"]]))), keys, odds)[0]))
    clean = np.concatenate([v for t, v in scored if not t])
    assert model.drift == pytest.approx(max(math.log(np.exp(clean).mean()), 1e-3), abs=1e-5)
    best = [max((s for *_, s in toxicity.segments(v - model.drift)), default=0.0) - math.log(max(len(v), 1)) for t, v in scored if not t]
    assert model.log_k == pytest.approx(float(np.quantile(best, 0.99)) + math.log(0.01), abs=1e-3)


def test_toxicity_held_out(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert len(got) == docs.count()
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0 and i in got]
    assert len(held) > 500 and all(got[i]["held_out"] for i in held)
    right = {t: np.mean([got[i]["predicted"] == t for i in held if truth[i] == t]) for t in (0, 1)}
    assert right[1] > 0.8 and right[0] > 0.99  # by halves, where one answer for all gets 0.5
    clean = {r["doc_id"] for r in toxicity.keep(docs, model).collect()}
    assert clean == {i for i, r in got.items() if r["score"] < 0.5}


def test_toxicity_edges(spark, edge, no_rows):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (6, None), (9, 0), (9, 0)], "doc_id long, toxic int")
    for labels in (none, odd):
        got = toxicity.score(edge, toxicity.fit(edge, labels)).collect()
        assert len(got) == len(edge_rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(no_rows, toxicity.fit(no_rows, none)).count() == 0


def shingle_set(text):
    w = WORD.findall(text or "")
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_clusters_are_verified_without_pruning(spark):
    words_ = prose(11, 200).split()
    texts = [" ".join(w + "x" * (k in at) for k, w in enumerate(words_)) for at in ((), (0, 20, 40), (60, 80, 100), (120, 140), (160, 180))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    s = near_duplicates.Settings(tolerance=0.99)
    members = near_duplicates._signed(docs, s, "doc_id", "text").selectExpr("cls", "1L as cluster", "1L as copies")
    rows = members.join(near_duplicates._sets(docs, members, s, "text"), "cls").selectExpr("*", "0L as low", "0L as high", "0L as block")
    got = near_duplicates._verified(rows, s).selectExpr("sum(links)").first()[0]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for t in texts]
    want = sum(len(a & b) >= 0.8 * len(a | b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert got == want > 8


def plain_join(texts):
    """Links of each row and the components, over all pairs."""
    sets = list(map(shingle_set, texts))
    links, parent = [0] * len(sets), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b) - 1e-9:
            links[i] += 1
            links[j] += 1
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return links, [root(i) for i in range(len(sets))]


def near_copies(n, seed=0):
    r = random.Random(seed)
    out = []
    for k in range(n):
        w = prose(k % 7, 120).split()
        for _ in range(r.randint(0, 4)):
            w[r.randrange(len(w))] = "edit" + str(r.randrange(1000))
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_all_pairs(spark):
    texts = near_copies(150) + ["a b", "a b", "b a", "", " ", None, "solo"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    links, part = plain_join(texts)
    # small blocks, so that buckets and clusters are cut
    for s in (near_duplicates.Settings(), near_duplicates.Settings(bucket_block=8, cluster_block=8), near_duplicates.Settings(cluster_shingles=500, broadcast_bytes=0, seen=3)):
        got = {r["doc_id"]: r for r in near_duplicates.join(docs, s).collect()}
        assert [got[i]["n_links"] for i in range(len(texts))] == links
        assert [got[i]["class_id"] for i in range(len(texts))] == part
    kept = sorted(r["doc_id"] for r in near_duplicates.keep_one(docs).collect())
    assert kept == sorted(set(part))


def test_a_long_chain_of_near_copies(spark):
    """Each text is near the two before and after it only; the whole chain is one class, at a cost in proportion to its length."""
    n, step = 5000, 4
    chain = [f"w{k}" for k in range(80 + n * step)]
    docs = spark.range(n).withColumn("text", F.expr(f"concat_ws(' ', transform(sequence(id * {step}, id * {step} + 79), x -> concat('w', x)))"))
    assert docs.where("id = 3").first()["text"] == " ".join(chain[12:92])
    held = []
    real = near_duplicates._verified
    near_duplicates._verified = lambda rows, s: held.append(rows.count()) or real(rows, s)
    try:
        got = {r["doc_id"]: r for r in near_duplicates.join(docs, id_col="id").collect()}
    finally:
        near_duplicates._verified = real
    sets = [set(range(i * step, i * step + 76)) for i in range(20)]
    near = max(k for k in range(20) if len(sets[0] & sets[k]) >= 0.8 * len(sets[0] | sets[k]))
    assert near == 2 and {r["class_id"] for r in got.values()} == {0}
    assert [got[i]["n_links"] for i in range(n)] == [min(i, near) + min(n - 1 - i, near) for i in range(n)]
    assert held[0] < 40 * n  # all pairs of its 40 blocks would be 200,000


def test_links_of_queries_against_all_rows(spark):
    """Recall of links between the rows whose id is divisible by 50 and all others, on documents with near copies."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    got = {r["doc_id"]: r for r in near_duplicates.join(docs).collect()}
    for q in rows:
        near = [i for i, x in rows.items() if i != q and x and rows[q] and min(len(x), len(rows[q])) >= 0.8 * max(len(x), len(rows[q])) and len(x & rows[q]) >= 0.8 * len(x | rows[q]) - 1e-9] if q % 50 == 0 else None
        if near is not None:
            assert got[q]["n_links"] == len(near) and all(got[i]["class_id"] == got[q]["class_id"] for i in near)


def test_columns_of_any_name_are_kept(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, 6, "x", 1), (2, "a b c", 7, 8, "y", 2), (3, None, 9, 9, "z", 3)], "doc_id long, text string, __cls int, __id int, cls0 string, ID0 int")
    got = near_duplicates.keep_one(docs)
    assert got.schema == docs.schema and sorted(map(tuple, got.collect()), key=lambda r: r[0]) == [(1, "a b c", 5, 6, "x", 1), (3, None, 9, 9, "z", 3)]


def test_near_duplicates_edges(edge, no_rows):
    got = near_duplicates.join(edge).collect()
    assert len(got) == len(edge_rows())
    assert {r["n_copies"] for r in got if r["doc_id"] == 6} == {4}
    assert all(r["n_links"] == 0 and r["class_id"] == r["doc_id"] for r in got if r["doc_id"] in (0, 1, 2, 14, None) and r["n_copies"] == 1 and r["doc_id"] is not None)
    kept = near_duplicates.keep_one(edge)
    assert kept.schema == edge.schema
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[6] == 1 and 7 not in ids and 8 not in ids and ids[0] == ids[1] == 1
    assert near_duplicates.join(no_rows).count() == near_duplicates.keep_one(no_rows).count() == 0


def test_pruning_keeps_likely_pairs():
    s = near_duplicates.Settings()
    least = near_duplicates.least_matches(s.similarity, s.hashes, s.step, s.tolerance)
    for k, m in enumerate(least.tolist(), 1):
        n = k * s.step
        tail = lambda m: sum(math.comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(m + 1))  # noqa: E731,B023
        assert tail(m) >= s.tolerance and (m == 0 or tail(m - 1) < s.tolerance)


def test_no_rows(no_rows):
    assert hidden_markov.score(no_rows).count() == 0
    assert sharding.shard(no_rows).count() == 0
    assert media.text_media(no_rows).count() == 0
    assert packing.pack(no_rows, TOKENIZER).count() == 0


def test_queries_read_whole_tables(spark):
    from smoothlake.llm import entry

    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op1_quality_rules", "op2_secret_scans", "op6_histogram_sort"):
        assert entry.queries()[name](spark, DATA).count() == n
