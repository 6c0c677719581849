"""Kernels of continuous, unordered and ordered variables, and their integrals, convolutions and derivatives.

Continuous kernels take z = (x - X) / h. Higher orders are derived, not listed: a Gaussian kernel of
order 2r is a normal density times the polynomial of degree 2r - 2, and an Epanechnikov kernel the
density times the polynomial of that degree, for which the moments up to 2r - 2 vanish.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from numpy.polynomial import Polynomial
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import special

ROOT5 = math.sqrt(5)
TYPES = ("gaussian", "epanechnikov", "uniform")
ORDERS = (2, 4, 6, 8)
OPERATORS = ("normal", "integral", "convolution", "derivative")


def _check(kind: str, order: int) -> None:
    if kind not in TYPES or order not in ORDERS:
        raise ValueError(f"no kernel {kind} of order {order}")


def _normal_moment(k: int) -> float:
    return 0.0 if k % 2 else float(math.prod(range(1, k, 2)))


@lru_cache
def gaussian_polynomial(order: int) -> Polynomial:
    """q such that q * dnorm is the kernel: the even polynomial with unit mass and vanishing moments."""
    r = order // 2
    a = [[_normal_moment(2 * (j + s)) for s in range(r)] for j in range(r)]
    c = np.linalg.solve(a, [1.0] + [0.0] * (r - 1))
    return Polynomial(np.ravel([[v, 0.0] for v in c])[:-1])


@lru_cache
def epanechnikov_polynomial(order: int) -> Polynomial:
    """The kernel itself on the support."""
    r = order // 2
    base = Polynomial([1, 0, -0.2])

    def moment(p: Polynomial) -> float:
        q = p.integ()
        return q(ROOT5) - q(-ROOT5)

    power = [Polynomial([0.0] * (2 * s) + [1.0]) for s in range(r + r)]
    a = [[moment(base * power[j + s]) for s in range(r)] for j in range(r)]
    c = np.linalg.solve(a, [1.0] + [0.0] * (r - 1))
    return base * Polynomial(np.ravel([[v, 0.0] for v in c])[:-1])


@lru_cache
def _gaussian_integral(order: int) -> Polynomial:
    """p such that the integral is pnorm(z) + p(z) * dnorm(z)."""
    q = gaussian_polynomial(order)
    # (p * dnorm)' = (p' - z p) dnorm = (q - 1) dnorm
    p, rest = Polynomial([0.0]), q - 1
    for k in range(order - 2, 0, -1):
        c = rest.coef[k] if k < len(rest.coef) else 0.0
        term = Polynomial([0.0] * (k - 1) + [-c])
        p, rest = p + term, rest - (term.deriv() - Polynomial([0, 1]) * term)
    return p


@lru_cache
def _gaussian_convolution(order: int) -> Polynomial:
    """p such that the convolution is p(z) times the normal density of variance 2."""
    q = gaussian_polynomial(order)
    nodes, weights = np.polynomial.hermite_e.hermegauss(24)
    v, w = nodes / math.sqrt(2), weights / weights.sum()
    z = np.linspace(-3, 3, 2 * order - 3) if order > 2 else np.zeros(1)
    y = [(w * q(x / 2 + v) * q(x / 2 - v)).sum() for x in z]
    return Polynomial(np.linalg.solve(np.vander(z, len(z), increasing=True), y)) if order > 2 else Polynomial([y[0]])


@lru_cache
def _epanechnikov_convolution(order: int) -> Polynomial:
    """The convolution as a polynomial in the distance, up to twice the support."""
    k = epanechnikov_polynomial(order)
    degree = 2 * order + 1
    nodes, weights = np.polynomial.legendre.leggauss(order + 4)
    t = np.cos(np.pi * (np.arange(degree + 1) + 0.5) / (degree + 1))
    z = ROOT5 * (t + 1)
    half = ROOT5 - z / 2
    u = z[:, None] / 2 + half[:, None] * nodes
    y = (half[:, None] * weights * k(u) * k(z[:, None] - u)).sum(1)
    fit = np.polynomial.chebyshev.chebfit(t, y, degree)
    return Polynomial(np.polynomial.chebyshev.cheb2poly(fit))(Polynomial([-1, 1 / ROOT5]))


class UserKernel:
    """A kernel of the user's own: its density at z, and a column expression of it for plans in the JVM.

    The integral, the convolution and the derivative may be given too; else they are numerical, on so
    many points of the support.
    """

    def __init__(self, pdf: Callable[[np.ndarray], np.ndarray], support: float, *, column: Callable[[Column], Column] | None = None, cdf: Callable | None = None, convolution: Callable | None = None, derivative: Callable | None = None, points: int = 4001):
        self.given = {"normal": pdf, "integral": cdf, "convolution": convolution, "derivative": derivative}
        self.support, self.column, self.points = float(support), column, points

    def __call__(self, operator: str, z: np.ndarray) -> np.ndarray:
        z = np.asarray(z, float)
        if self.given[operator] is not None:
            return np.asarray(self.given[operator](z), float)
        x = np.linspace(-self.support, self.support, self.points)
        k, step = self.given["normal"](x), x[1] - x[0]
        if operator == "integral":
            return np.interp(z, x, np.concatenate([[0.0], np.cumsum((k[1:] + k[:-1]) / 2) * step]), 0.0, 1.0)
        if operator == "derivative":
            return np.interp(z, x, np.gradient(k, step), 0.0, 0.0)
        both = np.convolve(k, k) * step
        return np.interp(z, np.linspace(-2 * self.support, 2 * self.support, len(both)), both, 0.0, 0.0)


def pdf(z: np.ndarray, kind: str = "gaussian", order: int = 2) -> np.ndarray:
    if isinstance(kind, UserKernel):
        return kind("normal", z)
    _check(kind, order)
    z = np.asarray(z, float)
    if kind == "gaussian":
        k = special.dnorm(z)
        return k if order == 2 else k * gaussian_polynomial(order)(z)
    if kind == "uniform":
        return np.where(np.abs(z) < 1, 0.5, 0.0)
    return np.where(z * z < 5, epanechnikov_polynomial(order)(z), 0.0)


def cdf(z: np.ndarray, kind: str = "gaussian", order: int = 2) -> np.ndarray:
    if isinstance(kind, UserKernel):
        return kind("integral", z)
    _check(kind, order)
    z = np.asarray(z, float)
    if kind == "gaussian":
        return special.pnorm(z) + (_gaussian_integral(order)(z) * special.dnorm(z) if order > 2 else 0.0)
    if kind == "uniform":
        return np.clip((z + 1) / 2, 0, 1)
    p = epanechnikov_polynomial(order).integ()
    return np.where(z <= -ROOT5, 0.0, np.where(z >= ROOT5, 1.0, p(np.clip(z, -ROOT5, ROOT5)) - p(-ROOT5)))


def convolution(z: np.ndarray, kind: str = "gaussian", order: int = 2) -> np.ndarray:
    if isinstance(kind, UserKernel):
        return kind("convolution", z)
    _check(kind, order)
    z = np.abs(np.asarray(z, float))
    if kind == "gaussian":
        return _gaussian_convolution(order)(z) * np.exp(-z * z / 4) / (2 * math.sqrt(math.pi))
    if kind == "uniform":
        return np.maximum(0.0, (2 - z) / 4)
    return np.where(z < 2 * ROOT5, _epanechnikov_convolution(order)(np.minimum(z, 2 * ROOT5)), 0.0)


def derivative(z: np.ndarray, kind: str = "gaussian", order: int = 2) -> np.ndarray:
    """In z; the uniform kernel's is 0."""
    if isinstance(kind, UserKernel):
        return kind("derivative", z)
    _check(kind, order)
    z = np.asarray(z, float)
    if kind == "gaussian":
        q = gaussian_polynomial(order)
        return (q.deriv()(z) - z * q(z)) * special.dnorm(z)
    if kind == "uniform":
        return np.zeros_like(z)
    return np.where(z * z < 5, epanechnikov_polynomial(order).deriv()(z), 0.0)


CONTINUOUS = {"normal": pdf, "integral": cdf, "convolution": convolution, "derivative": derivative}


@lru_cache
def roughness(kind: str, order: int = 2) -> float:
    """The integral of the squared kernel."""
    return float(convolution(np.zeros(1), kind, order)[0])


def unordered(same: np.ndarray, lam: float, kind: str = "aitchisonaitken", levels: int = 2) -> np.ndarray:
    """Weights by whether two levels are the same; with fewer than two levels, an indicator."""
    if levels < 2:
        return np.where(same, 1.0, 0.0)
    if kind == "aitchisonaitken":
        return np.where(same, 1 - lam, lam / (levels - 1))
    if kind == "geometric":
        return np.where(same, 1.0, lam)
    raise ValueError(f"no unordered kernel {kind}")


def unordered_cdf(x: np.ndarray, y: np.ndarray, lam: float, kind: str = "aitchisonaitken", levels: int = 2) -> np.ndarray:
    """Weights of a training level y summed over the levels up to x, in their order; levels are 1, 2, ..., and one that training lacks, below 1, has none."""
    a, b = unordered(np.array([True, False]), lam, kind, levels)
    n, own = np.maximum(x, 0), (y <= x) & (x >= 1)
    return (n - own) * b + own * a


def unordered_convolution(same: np.ndarray, lam: float, kind: str = "aitchisonaitken", levels: int = 2) -> np.ndarray:
    """The sum over levels of products of weights."""
    a, b = unordered(np.array([True, False]), lam, kind, levels)
    return np.where(same, a * a + (levels - 1) * b * b, 2 * a * b + (levels - 2) * b * b)


def ordered(x: np.ndarray, y: np.ndarray, lam: float, kind: str = "wangvanryzin", support: np.ndarray | None = None) -> np.ndarray:
    """Weights of an evaluation level x and a training level y; levels are whole numbers."""
    d = np.abs(x - y)
    with np.errstate(invalid="ignore"):
        power = np.where(d == 0, 1.0, np.power(float(lam), d))
    if kind == "wangvanryzin":
        return np.where(d == 0, 1 - lam, 0.5 * (1 - lam) * power)
    if kind == "geometric":
        return power
    if kind == "ngeometric":
        return power * (1 - lam) / (1 + lam)
    if kind == "sgeometric":
        if support is None:
            raise ValueError("sgeometric needs the levels of the training data")
        total = sum(np.where(np.abs(y - s) == 0, 1.0, np.power(float(lam), np.abs(y - s))) for s in support)
        return power / total
    raise ValueError(f"no ordered kernel {kind}")


def ordered_cdf(x: np.ndarray, y: np.ndarray, lam: float, kind: str, support: np.ndarray) -> np.ndarray:
    """Weights summed over levels up to x: over the training levels, or, for kernels on all whole numbers, from one range below the least on."""
    low, high = float(np.min(support)), float(np.max(support))
    levels = support if kind == "sgeometric" else np.arange(low - (high - low), high + 1)
    return sum(np.where(s <= x, ordered(np.asarray(s, float), y, lam, kind, support), 0.0) for s in levels)


def ordered_convolution(x: np.ndarray, y: np.ndarray, lam: float, kind: str, support: np.ndarray) -> np.ndarray:
    if kind == "sgeometric":
        return sum(ordered(np.asarray(s, float), x, lam, kind, support) * ordered(np.asarray(s, float), y, lam, kind, support) for s in support)
    return sum(ordered(x, np.asarray(s, float), lam, kind) * ordered(y, np.asarray(s, float), lam, kind) for s in support)


def beta(x: np.ndarray, X: np.ndarray, h: np.ndarray, a: float, b: float, order: int = 2, operator: str = "normal") -> np.ndarray:
    """Chen's beta kernel on [a, b] about the evaluation point x; higher orders combine bandwidths h * sqrt(s).

    integral is the mass that the kernels put on [a, x], observation by observation: with the shapes
    of the evaluation point, the distribution function of X's kernel is taken at X from above.
    """
    m, size = order // 2, b - a
    t, z = (x - a) / size, (X - a) / size
    out = 0.0
    for s in range(1, m + 1):
        c = (-1) ** (s + 1) * math.comb(m, s)
        tau = (size / h) ** 2 / s
        p, q = 1 + t * tau, 1 + (1 - t) * tau
        if operator == "normal":
            out = out + c * np.exp(special.log_beta_pdf(z, p, q)) / size
        elif operator == "derivative":
            k = np.exp(special.log_beta_pdf(z, p, q)) / size
            with np.errstate(divide="ignore", invalid="ignore"):
                out = out + c * tau / size * k * (np.log(z) - np.log1p(-z) - special.digamma(p) + special.digamma(q))
        elif operator == "integral":
            pz, qz = 1 + z * tau, 1 + (1 - z) * tau
            out = out + c * special.beta_cdf(t, pz, qz)
        else:
            raise ValueError(f"no beta kernel operator {operator}")
    return out


def bounded_mass(x: np.ndarray, h: np.ndarray, a: float, b: float, kind: str, order: int) -> np.ndarray:
    """The kernel's mass on [a, b] about x; bounds may be infinite."""
    upper = cdf((b - x) / h, kind, order) if math.isfinite(b) else 1.0
    lower = cdf((a - x) / h, kind, order) if math.isfinite(a) else 0.0
    return upper - lower


# column expressions, for plans that stay in the JVM


def _poly(z: Column, p: Polynomial) -> Column:
    out = F.lit(float(p.coef[-1]))
    for c in p.coef[-2::-1]:
        out = out * z + F.lit(float(c))
    return out


def pdf_column(z: Column, kind: str = "gaussian", order: int = 2) -> Column:
    if isinstance(kind, UserKernel):
        if kind.column is None:
            raise ValueError("the user's kernel has no column form")
        return kind.column(z)
    _check(kind, order)
    if kind == "gaussian":
        k = F.exp(z * z * -0.5) * (1 / math.sqrt(2 * math.pi))
        return k if order == 2 else k * _poly(z, gaussian_polynomial(order))
    if kind == "uniform":
        return F.when(F.abs(z) < 1, 0.5).otherwise(0.0)
    return F.when(z * z < 5, _poly(z, epanechnikov_polynomial(order))).otherwise(0.0)


def cdf_column(z: Column, kind: str = "epanechnikov", order: int = 2) -> Column:
    """Of compact kernels; the Gaussian one needs erf, which Spark lacks."""
    if isinstance(kind, UserKernel):
        raise ValueError("a user's kernel has a column form of its density only")
    _check(kind, order)
    if kind == "uniform":
        return F.when(z <= -1, 0.0).when(z >= 1, 1.0).otherwise((z + 1) / 2)
    if kind == "gaussian":
        raise ValueError("the integral of a Gaussian kernel has no column form")
    p = epanechnikov_polynomial(order).integ()
    return F.when(z <= -ROOT5, 0.0).when(z >= ROOT5, 1.0).otherwise(_poly(z, p - p(-ROOT5)))


def convolution_column(z: Column, kind: str = "gaussian", order: int = 2) -> Column:
    if isinstance(kind, UserKernel):
        raise ValueError("a user's kernel has a column form of its density only")
    _check(kind, order)
    if kind == "gaussian":
        return F.exp(z * z * -0.25) * (1 / (2 * math.sqrt(math.pi))) * _poly(z, _gaussian_convolution(order))
    if kind == "uniform":
        return F.greatest(F.lit(0.0), (2 - F.abs(z)) / 4)
    return F.when(F.abs(z) < 2 * ROOT5, _poly(F.abs(z), _epanechnikov_convolution(order))).otherwise(0.0)


def derivative_column(z: Column, kind: str = "gaussian", order: int = 2) -> Column:
    if isinstance(kind, UserKernel):
        raise ValueError("a user's kernel has a column form of its density only")
    _check(kind, order)
    if kind == "gaussian":
        q = gaussian_polynomial(order)
        return F.exp(z * z * -0.5) * (1 / math.sqrt(2 * math.pi)) * _poly(z, q.deriv() - Polynomial([0, 1]) * q)
    if kind == "uniform":
        return F.lit(0.0)
    return F.when(z * z < 5, _poly(z, epanechnikov_polynomial(order).deriv())).otherwise(0.0)


CONTINUOUS_COLUMN = {"normal": pdf_column, "integral": cdf_column, "convolution": convolution_column, "derivative": derivative_column}


def unordered_column(same: Column, lam: float, kind: str = "aitchisonaitken", levels: int = 2) -> Column:
    a, b = unordered(np.array([True, False]), lam, kind, levels)
    return F.when(same, float(a)).otherwise(float(b))


def ordered_column(x: Column, y: Column, lam: float, kind: str = "wangvanryzin") -> Column:
    d = F.abs(x - y)
    power = F.when(d == 0, 1.0).otherwise(F.pow(F.lit(float(lam)), d))
    if kind == "wangvanryzin":
        return F.when(d == 0, 1 - lam).otherwise(power * (0.5 * (1 - lam)))
    if kind == "geometric":
        return power
    if kind == "ngeometric":
        return power * ((1 - lam) / (1 + lam))
    raise ValueError(f"no column form of the ordered kernel {kind}")
