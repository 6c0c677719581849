"""Local polynomials: bases, moments and their solutions."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from numpy.polynomial import Legendre, Polynomial
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ksum import Points
from ..plans.spec import Bandwidth


def terms(degree: tuple[int, ...], basis: str = "glp") -> list[tuple[int, ...]]:
    """Exponents of the basis: additive has one variable a term, tensor all products, and glp the products up to the greatest degree. After a colon, the family of the polynomials, see family()."""
    basis = basis.partition(":")[0]
    full = itertools.product(*(range(d + 1) for d in degree))
    if basis == "tensor":
        return list(full)
    if basis == "additive":
        return [t for t in full if sum(e > 0 for e in t) <= 1]
    if basis == "glp":
        return [t for t in full if sum(t) <= max(degree, default=0)]
    raise ValueError(f"no basis {basis}")


def dimension(degree: tuple[int, ...], basis: str = "additive") -> int:
    return len(terms(degree, basis))


@lru_cache
def family(name: str, degree: int) -> tuple[Polynomial, ...]:
    """The polynomials of one variable of degrees 0 to degree: raw powers, Legendre's, or, with 1 for the first, Bernstein's of that degree, on three deviations about the mean."""
    if name in ("", "raw"):
        return tuple(Polynomial([0.0] * e + [1.0]) for e in range(degree + 1))
    to = Polynomial([0.0, 1 / 3])
    if name == "legendre":
        return tuple(Legendre.basis(e).convert(kind=Polynomial)(to) for e in range(degree + 1))
    if name == "bernstein":
        t = (1 + to) / 2
        return (Polynomial([1.0]), *(math.comb(degree, e) * t**e * (1 - t) ** (degree - e) for e in range(1, degree + 1)))
    raise ValueError(f"no polynomials {name}")


def powers(columns: list[np.ndarray], degree: tuple[int, ...], basis: str, by: tuple[int, ...] = ()) -> np.ndarray:
    """The basis at points, or its derivative of so many times by each variable."""
    n = len(columns[0]) if columns else 0
    by = by or (0,) * len(degree)
    kind = basis.partition(":")[2]
    value = [[p.deriv(d)(c) if d else p(c) for p in family(kind, e)] for c, e, d in zip(columns, degree, by, strict=True)]
    out = []
    for t in terms(degree, basis):
        v = np.ones(n)
        for each, e in zip(value, t, strict=True):
            v = v * each[e]
        out.append(v)
    return np.stack(out, 1)


def scaled(columns: list[np.ndarray], like: list[np.ndarray]) -> tuple[list[np.ndarray], list[float]]:
    """Columns moved and scaled by the mean and deviation of others, for stable moments, and the scales."""
    out, scales = [], []
    for c, r in zip(columns, like, strict=True):
        s = float(np.std(r)) or 1.0
        out.append((c - np.mean(r)) / s)
        scales.append(s)
    return out, scales


RIDGES = (0.0, 1e-10, 1e-7, 1e-4, 1e-2, 1e-1, 1.0)


def _ridged(moments: np.ndarray):
    """Of many small systems, with the constant first: which are solved with which ridge, the systems with it on their diagonals, and it itself."""
    p = moments.shape[-1]
    diag = np.abs(moments[:, range(p), range(p)]).max(1)
    diag = np.where(diag > 0, diag, 1.0)
    todo = np.arange(len(moments))
    for ridge in RIDGES:
        a = moments[todo] + ridge * diag[todo, None, None] * np.eye(p)
        with np.errstate(all="ignore"):
            good = np.linalg.cond(a) < 1e14
        if good.any():
            yield todo[good], a[good], ridge * diag[todo[good]]
        todo = todo[~good]
        if not len(todo):
            return


def solve(moments: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Solutions of many small systems, with the constant first. A singular one gets a growing ridge on its diagonal, which draws it to the local-constant mean; nan is left where there is no weight."""
    out = np.full(sums.shape, np.nan)
    for at, a, ridge in _ridged(moments):
        right = sums[at].copy()
        weight = moments[at, 0, 0]
        with np.errstate(all="ignore"):
            right[:, 0] += ridge[:, None] * np.where(weight[:, None] > 0, right[:, 0] / weight[:, None], np.nan)
        out[at] = np.linalg.solve(a, right)
    return out


def design(data: DataFrame, names: list[str], degree: tuple[int, ...], basis: str = "glp") -> float:
    """The condition number of the basis over the table's complete rows, from moments that tasks add up; an error if the basis is not of full rank there."""
    c = [F.col(f"`{n}`").cast("double") for n in names]
    rows = data.select(*(x.alias(f"v{i}") for i, x in enumerate(c))).na.drop()
    centre = rows.agg(*(F.avg(f"v{i}").alias(f"m{i}") for i in range(len(c))), *(F.stddev_pop(f"v{i}").alias(f"s{i}") for i in range(len(c)))).first()
    move, scale = [centre[f"m{i}"] for i in range(len(c))], [centre[f"s{i}"] or 1.0 for i in range(len(c))]
    p = len(terms(degree, basis))

    def run(batches):
        total = np.zeros((p, p))
        for batch in batches:
            if batch.num_rows:
                B = powers([(x.to_numpy(zero_copy_only=False) - m) / s for x, m, s in zip(batch.columns, move, scale, strict=True)], degree, basis)
                total += B.T @ B
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p * p)), pa.array(total.ravel())], names=["cell", "x"])

    total = np.zeros(p * p)
    for r in rows.mapInArrow(run, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect():  # the basis squared
        total[r["cell"]] = r["x"]
    total = total.reshape(p, p)
    size = np.sqrt(np.where(np.diag(total) > 0, np.diag(total), 1.0))
    values = np.linalg.eigvalsh(total / size[:, None] / size)
    if values[0] <= 1e-10 * values[-1]:
        raise ValueError(f"the basis of degree {degree} has no full rank on {', '.join(names)}")
    return float(np.sqrt(values[-1] / values[0]))


def hat_rows(K: np.ndarray, train: Points, bw: Bandwidth, x: list[np.ndarray], degree: tuple[int, ...], basis: str = "glp", by: tuple[int, ...] = (), like: list[np.ndarray] | None = None) -> np.ndarray:
    """The weights that give the fit at each point, or its derivative, from the responses. like: the columns whose mean and deviation scale the variables, if not those of train."""
    at = bw.continuous
    if not degree or not any(degree):
        return K / K.sum(1, keepdims=True)
    like = [(like or train.columns)[i] for i in at]
    X, scales = scaled([train.columns[i] for i in at], like)
    x, _ = scaled([x[i] for i in at], like)
    B = powers(X, degree, basis)
    b = powers(x, degree, basis, by)
    if by:
        b = b / math.prod(s**d for s, d in zip(scales, by, strict=True))
    M = np.einsum("ij,jp,jq->ipq", K, B, B, optimize=True)
    out = np.full((len(K), len(B)), np.nan)
    for i, a, ridge in _ridged(M):
        c = np.linalg.solve(a, b[i][:, :, None])[:, :, 0]
        with np.errstate(all="ignore"):
            mean = np.where(M[i, 0, 0] > 0, ridge * c[:, 0] / M[i, 0, 0], np.nan)  # what the ridge adds of the local-constant mean
        out[i] = K[i] * (c @ B.T + mean[:, None])
    return out


def fit_rows(K: np.ndarray, train: Points, bw: Bandwidth, y: np.ndarray, x: list[np.ndarray], degree: tuple[int, ...], basis: str = "glp", own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Fits at points, and the weights of their own responses if own says which rows they are."""
    if not degree or not any(degree):
        total = K.sum(1)
        fit = (K @ y) / total
        return fit, None if own is None else K[np.arange(len(K)), own] / total
    H = hat_rows(K, train, bw, x, degree, basis)
    return H @ y, None if own is None else H[np.arange(len(K)), own]
