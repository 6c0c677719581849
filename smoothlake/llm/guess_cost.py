"""The cost of guessing a password: the cheapest segmentation into guessable parts.

A value is cut into words, dates, repeats, keyboard walks, runs of neighbouring characters and
brute-force spans; each part has a number of guesses, and dynamic programming finds the cut with the
least product. All costs are log10 of a number of guesses. Words are those of a ranked dictionary.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

# Common password words, most common first.
COMMON = (
    "password 123456 qwerty admin letmein welcome monkey dragon master login princess football baseball shadow sunshine superman "
    "iloveyou trustno1 hello freedom whatever secret test guest root user default changeme example sample demo dummy none null true false "
    "required optional string value token key your my the this that here there redacted hidden masked removed unknown empty "
    "summer winter spring autumn monday friday january march april june july august october december love angel tiger lion bear eagle "
    "batman spider hunter ranger soccer hockey golf tennis computer internet server client system network database backup public private "
    "access account email phone number name first last home work office school family mother father sister brother friend "
    "green black white blue orange purple yellow silver gold diamond star moon light dark fire water earth power magic "
    "apple banana cherry coffee cookie pepper ginger chocolate pizza house garden flower money dollar bank credit card"
).split()
# Rows of a keyboard, each shifted by half a key against the one above.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("40318!$5@7+", "aoeibissatt")
DATE = re.compile(r"(?:19|20)\d\d([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\2(?:19|20)?\d\d|(?:19|20)\d\d")
NEAR = {c: {ROWS[y + dy][x + dx]: (dy, dx) for dy, dx in ((0, -1), (0, 1), (-1, 0), (-1, 1), (1, -1), (1, 0)) if 0 <= y + dy < len(ROWS) and 0 <= x + dx < len(ROWS[y + dy])} for y, row in enumerate(ROWS) for x, c in enumerate(row)}
LONGEST_WORD = 24


def brute(c: str) -> float:
    """The log10 of the size of the character's class."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isalpha() else math.log10(33)


def _dates(value: str):
    for i in range(len(value)):
        if m := DATE.match(value, i):
            whole = m.end() - i > 4
            yield i, m.end(), math.log10(365 * 130) if whole else math.log10(130)


def _ranks(codes: np.ndarray) -> list[np.ndarray]:
    """At level k the rank of each place's next 2**k characters; at the last level all ranks differ."""
    n = len(codes)
    levels, width = [np.unique(codes, return_inverse=True)[1].astype(np.int32)], 1
    while levels[-1].max() < n - 1:
        key = levels[-1].astype(np.int64) * (n + 1)
        key[: n - width] += levels[-1][width:] + 1
        levels.append(np.unique(key, return_inverse=True)[1].astype(np.int32))
        width *= 2
    return levels


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many characters from i on equal those from j on, for pairs i < j."""
    n, out = len(levels[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        same = levels[k][np.minimum(i + out, n - 1)] == levels[k][np.minimum(j + out, n - 1)]
        out += (same & (j + out < n)) * (1 << k)
    return out


def _stretches(value: str) -> list[tuple[int, int, int]]:
    """All maximal stretches that repeat with a least period of half their length or less: start, end and period, in n log n steps.

    Each has, in the order of characters or its reverse, a longest Lyndon word as its root; these are extended both ways.
    """
    n = len(value)
    if n < 3:
        return [(0, n, 1)] if n == 2 and value[0] == value[1] else []
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    forward, backward = _ranks(codes), _ranks(codes[::-1])
    found = set()
    for order in (forward[-1], _ranks(-codes)[-1]):
        rank, after, open_ = order.tolist(), [n] * n, []
        for j, r in enumerate(rank):
            while open_ and rank[open_[-1]] > r:
                after[open_.pop()] = j
            open_.append(j)
        i, j = np.arange(n), np.array(after)
        right, left = _common(forward, i, j), _common(backward, n - j, n - i)
        start, end = i - left, j + right
        yes = end - start >= 2 * (j - i)
        found.update(zip(start[yes].tolist(), end[yes].tolist(), (j - i)[yes].tolist(), strict=True))
    return sorted(found)


def _walks(value: str):
    low = value.lower()
    i = 0
    while i < len(low) - 2:
        j, turns, was = i + 1, 0, None
        while j < len(low) and low[j] in NEAR.get(low[j - 1], ()):
            step = NEAR[low[j - 1]][low[j]]
            turns += was is not None and step != was
            was = step
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(len(NEAR)) + math.log10(j - i) + turns * math.log10(6)
        i = max(i + 1, j - 1)


def _runs(value: str):
    i = 0
    while i < len(value) - 2:
        step, j = ord(value[i + 1]) - ord(value[i]), i + 1
        while j < len(value) and abs(step) == 1 and ord(value[j]) - ord(value[j - 1]) == step:
            j += 1
        if j - i >= 3:
            yield i, j, math.log10(26) + math.log10(j - i)
        i = max(i + 1, j - 1)


class Guesser:
    """Costs by a dictionary: the common password words, then further words, most common first."""

    def __init__(self, further: Iterable[str] = ()):
        self.ranks: dict[str, int] = {}
        for w in (*COMMON, *further):
            if 3 <= len(w) <= LONGEST_WORD:
                self.ranks.setdefault(w, len(self.ranks) + 1)
        self.beginnings = {w[:k] for w in self.ranks for k in range(3, len(w) + 1)}
        self.log10_guesses = lru_cache(4096)(self._log10_guesses)

    def __reduce__(self):
        return Guesser, (list(self.ranks),)

    def words(self, value: str):
        """Start, end and cost of each dictionary word, as it is, with letters for look-alikes, and backwards."""
        low, n = value.lower(), len(value)
        if len(low) != n:  # letters whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        back = low[::-1]
        for text, extra, turned in ((low, 0.0, False), (low.translate(LEET), 0.3, False), (back, 0.3, True)):
            if extra and text == low:
                continue
            for i in range(n - 2):
                for j in range(i + 3, min(n, i + LONGEST_WORD) + 1):
                    part = text[i:j]
                    if part not in self.beginnings:
                        break
                    if rank := self.ranks.get(part):
                        a, b = (n - j, n - i) if turned else (i, j)
                        upper = sum(c.isupper() for c in value[a:b])
                        yield a, b, math.log10(rank) + extra + (upper > 0) * 0.3 + (1 < upper < b - a) * math.log10(math.comb(b - a, upper))

    def repeats(self, value: str, depth: int = 0):
        """Repeats of a unit: the least period of a stretch, or several of them while a word can lie across their borders; longer ones hold nothing more."""
        for a, b, period in _stretches(value):
            for times in range(1, min((b - a) // (2 * period), 1 + -(-LONGEST_WORD // period)) + 1):
                unit = times * period
                k = (b - a) // unit
                if k * unit >= 3:
                    base = sum(map(brute, value[a : a + unit])) if depth else self.log10_guesses(value[a : a + unit], 1)
                    yield a, a + k * unit, base + math.log10(k)

    def parts(self, value: str, depth: int = 0):
        return [*self.words(value), *_dates(value), *_walks(value), *_runs(value), *self.repeats(value, depth)]

    def _log10_guesses(self, value: str, depth: int = 0) -> float:
        """The least log10 of guesses over all segmentations; 0 for an empty value. Values of every length are costed alike."""
        ends: dict[int, list[tuple[int, float]]] = {}
        for a, b, cost in self.parts(value, depth):
            ends.setdefault(b, []).append((a, cost))
        # the least cost up to i: ending in brute force, and ending in another part, which opens a new segment
        opened = math.log10(2)
        best = [0.0]
        for i, c in enumerate(value, 1):
            best.append(min([best[-1] + brute(c), *(best[a] + cost + opened * (a > 0) for a, cost in ends.get(i, ()))]))
        return best[-1]
