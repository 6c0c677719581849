"""Kernel functions against their definitions."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from smoothlake.functions import kernels, special

X = np.linspace(-12, 12, 240_001)
D = X[1] - X[0]
CASES = [(k, o) for k in ("gaussian", "epanechnikov") for o in kernels.ORDERS] + [("uniform", 2)]


@pytest.mark.parametrize("kind,order", CASES)
def test_moments(kind, order):
    p = kernels.pdf(X, kind, order)
    assert p.sum() * D == pytest.approx(1, abs=1e-4)
    for m in range(2, order, 2):
        assert (p * X**m).sum() * D == pytest.approx(0, abs=1e-4)
    assert (p * p).sum() * D == pytest.approx(kernels.roughness(kind, order), abs=1e-4)


@pytest.mark.parametrize("kind,order", CASES)
def test_integrals_and_convolutions(kind, order):
    p = kernels.pdf(X, kind, order)
    assert np.abs(np.cumsum(p) * D - kernels.cdf(X, kind, order)).max() < 1e-3
    for z in (0.0, 0.4, 1.7, 3.9):
        assert (p * kernels.pdf(z - X, kind, order)).sum() * D == pytest.approx(float(kernels.convolution(np.array([z]), kind, order)[0]), abs=1e-4)


@pytest.mark.parametrize("kind,order", CASES[:8])
def test_derivatives(kind, order):
    z = np.array([-1.9, -0.3, 0.2, 1.1])
    numeric = (kernels.pdf(z + 1e-6, kind, order) - kernels.pdf(z - 1e-6, kind, order)) / 2e-6
    assert np.allclose(numeric, kernels.derivative(z, kind, order), atol=1e-6)


def test_support_is_open():
    assert kernels.pdf(np.array([kernels.ROOT5]), "epanechnikov")[0] == 0
    assert kernels.pdf(np.array([1.0, -1.0]), "uniform").tolist() == [0, 0]


def test_fixed_polynomials():
    assert np.allclose(kernels.gaussian_polynomial(8).coef[::2], [35 / 16, -35 / 16, 7 / 16, -1 / 48])
    z = np.linspace(-2, 2, 9)
    assert np.allclose(kernels.pdf(z, "epanechnikov", 4), 0.008385254916 * (-15 + 7 * z * z) * (-5 + z * z))


def test_special_functions():
    x = np.linspace(-7, 7, 3001)
    assert np.abs(special.erf(x) - [math.erf(v) for v in x]).max() < 1e-15
    assert special.digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329)
    grid = np.linspace(0, 1, 20001)
    for a, b in ((2.5, 3.5), (40.0, 7.0), (1.0, 1.0)):
        d = np.exp(special.log_beta_pdf(grid, a, b))
        total = np.concatenate([[0], np.cumsum((d[1:] + d[:-1]) / 2) * (grid[1] - grid[0])])
        assert np.abs(total - special.beta_cdf(grid, a, b)).max() < 1e-4


@settings(max_examples=40, deadline=None)
@given(st.floats(0, 0.8), st.integers(2, 6))
def test_category_weights_add_up(lam, levels):
    same = np.arange(levels) == 1
    if lam <= (levels - 1) / levels:
        assert kernels.unordered(same, lam, levels=levels).sum() == pytest.approx(1)
    k = np.arange(-400, 401.0)
    assert kernels.ordered(k, np.zeros(1), lam, "wangvanryzin").sum() == pytest.approx(1)
    assert kernels.ordered(k, np.zeros(1), lam, "ngeometric").sum() == pytest.approx(1)
    support = np.arange(1.0, levels + 1)
    assert kernels.ordered(support, np.full(levels, 2.0), lam, "sgeometric", support).sum() == pytest.approx(1)
    a = kernels.unordered_convolution(np.array([True, False]), lam, "aitchisonaitken", levels)
    w = lambda i, j: kernels.unordered(np.array([i == j]), lam, "aitchisonaitken", levels)[0]
    assert a[0] == pytest.approx(sum(w(0, m) ** 2 for m in range(levels)))
    assert a[1] == pytest.approx(sum(w(0, m) * w(1, m) for m in range(levels)))


@pytest.mark.parametrize("order", kernels.ORDERS)
def test_beta_kernels(order):
    grid = np.linspace(0, 2, 20001)
    k = kernels.beta(np.array([0.6]), grid, 0.3, 0.0, 2.0, order)
    assert ((k[1:] + k[:-1]) / 2).sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-6)
    x = np.array([0.5, 1.3])
    numeric = (kernels.beta(x + 1e-6, np.array([0.9]), 0.3, 0, 2, order) - kernels.beta(x - 1e-6, np.array([0.9]), 0.3, 0, 2, order)) / 2e-6
    assert np.allclose(numeric, kernels.beta(x, np.array([0.9]), 0.3, 0, 2, order, "derivative"), rtol=1e-4)


def test_bounded_kernels_have_mass_one():
    grid = np.linspace(0, 1, 20001)
    for kind in ("gaussian", "epanechnikov"):
        k = kernels.pdf((0.1 - grid) / 0.2, kind) / 0.2 / kernels.bounded_mass(np.array([0.1]), 0.2, 0, 1, kind, 2)
        assert k.sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=1e-3)


def test_unknown_kernels_are_refused():
    for f in (lambda: kernels.pdf(X, "cosine"), lambda: kernels.pdf(X, "gaussian", 3), lambda: kernels.unordered(X > 0, 0.1, "x"), lambda: kernels.ordered(X, X, 0.1, "x")):
        with pytest.raises(ValueError):
            f()
