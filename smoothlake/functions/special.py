"""Special functions that neither Spark nor numpy has: normal distribution, gamma, beta and their derivatives."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_STEP, _END = 1 / 64, 6.5


@lru_cache(1)
def _erf_table() -> np.ndarray:
    """erf and its first five derivatives, divided by factorials, on a grid."""
    x = np.arange(0, _END + _STEP, _STEP)
    g = 2 / math.sqrt(math.pi) * np.exp(-x * x)
    d = [np.array([math.erf(v) for v in x]), g, -2 * x * g, (4 * x * x - 2) * g, (-8 * x**3 + 12 * x) * g, (16 * x**4 - 48 * x * x + 12) * g, (-32 * x**5 + 160 * x**3 - 120 * x) * g]
    return np.stack([v / math.factorial(k) for k, v in enumerate(d)])


def erf(x: np.ndarray) -> np.ndarray:
    """The error function, to about 1e-15, by Taylor series about the nearest grid point."""
    x = np.asarray(x, float)
    a = np.minimum(np.abs(x), _END)
    k = np.rint(a / _STEP).astype(np.int64)
    d = a - k * _STEP
    t = _erf_table()
    out = t[6][k]
    for c in t[5::-1]:
        out = out * d + c[k]
    return np.copysign(out, x)


def pnorm(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + erf(np.asarray(x, float) / math.sqrt(2)))


def dnorm(x: np.ndarray) -> np.ndarray:
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def qnorm(p: float) -> float:
    return NormalDist().inv_cdf(p)


@np.vectorize
def lgamma(x: float) -> float:
    return math.lgamma(x)


def digamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8 and the asymptotic series; x is positive."""
    x = np.array(x, float)
    out = np.zeros_like(x)
    for _ in range(8):
        small = x < 8
        out -= np.where(small, 1 / np.where(small, x, 1), 0)
        x = np.where(small, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def log_beta_pdf(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The log density of Beta(a, b) at z in [0, 1]; -inf where it is 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(a == 1, 0.0, (a - 1) * np.log(z))
        right = np.where(b == 1, 0.0, (b - 1) * np.log1p(-z))
        out = left + right - (lgamma(a) + lgamma(b) - lgamma(a + b))
    return np.where((z >= 0) & (z <= 1), out, -np.inf)


def beta_cdf(z: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function, by its continued fraction (Lentz)."""
    z, a, b = np.broadcast_arrays(np.clip(np.asarray(z, float), 0, 1), np.asarray(a, float), np.asarray(b, float))
    swap = z > (a + 1) / (a + b + 2)
    x, p, q = np.where(swap, 1 - z, z), np.where(swap, b, a), np.where(swap, a, b)
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(p * np.log(x) + q * np.log1p(-x) - (lgamma(p) + lgamma(q) - lgamma(p + q))) / p
    front = np.where((x <= 0) | (x >= 1), 0.0, front)
    tiny = 1e-300
    c, d = np.ones_like(x), 1 - (p + q) * x / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * c * d
        if np.all(np.abs(c * d - 1) < 1e-15):
            break
    out = front * h
    return np.where(z <= 0, 0.0, np.where(z >= 1, 1.0, np.where(swap, 1 - out, out)))
