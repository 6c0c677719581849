"""Univariate densities on a bounded range: boundary kernels, reflection and shape constraints."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..plans.ksum import TILE
from ..plans.spec import Bandwidth, Variable
from . import density, search

TYPES = ("gaussian1", "gaussian2", "beta1", "beta2", "gamma", "rigaussian", "fb", "fbl", "fbu")


def _biweight(t: np.ndarray) -> np.ndarray:
    return np.where(np.abs(t) < 1, 15 / 16 * (1 - t * t) ** 2, 0.0)


def _floating(t: np.ndarray, c: np.ndarray, side: int) -> np.ndarray:
    """Scott's floating kernel for a bound at distance c, in bandwidths, below (side 1) or above (side -1)."""
    u = side * (t - c)
    inside = (u >= 0) & (u <= 2)
    return np.where(inside, 0.75 * (side * c + 1 - 1.25 * (1 + 2 * side * c) * u * u) * (u - 2) ** 2, 0.0)


def kernel(x: np.ndarray, X: np.ndarray, h: float, a: float = 0.0, b: float = 1.0, kind: str = "gaussian1") -> np.ndarray:
    """Values for evaluation points x (a column) and observations X (a row)."""
    x, X = np.asarray(x, float), np.asarray(X, float)
    size = b - a
    if kind in ("gaussian1", "gaussian2"):
        z, za, zb = (x - X) / h, (a - x) / h, (b - x) / h
        mass = special.pnorm(zb) - special.pnorm(za)
        if kind == "gaussian1":
            return special.dnorm(z) / (h * mass)
        if not math.isfinite(size):
            raise ValueError("gaussian2 needs finite bounds")
        if size / h <= 1e-4:
            return np.full(np.broadcast(x, X).shape, 1 / size)
        da, db = special.dnorm(za), special.dnorm(zb)
        m1, m2, m3 = (da - db) / mass, 1 + (za * da - zb * db) / mass, ((za * za + 2) * da - (zb * zb + 2) * db) / mass
        scale = m3 - m1 * m2
        even = np.abs(scale) < 1e-12  # in the middle of the range no reweighting is needed
        first = np.where(even, 1.0, m3 / np.where(even, 1.0, scale))
        second = np.where(even, 0.0, m1 / np.where(even, 1.0, scale))
        return (first - second * z * z) * special.dnorm(z) / (h * mass)
    if kind in ("beta1", "beta2"):
        t, z = (x - a) / size, (X - a) / size
        if kind == "beta1":
            return np.exp(special.log_beta_pdf(z, t / h + 1, (1 - t) / h + 1)) / size
        with np.errstate(invalid="ignore", divide="ignore"):
            rho = lambda u: 2 * h * h + 2.5 - np.sqrt(4 * h**4 + 6 * h * h + 2.25 - u * u - u / h)
            p = np.where((t < 2 * h) & (h < size), rho(t), t / h)
            q = np.where((t > 1 - 2 * h) & (t >= 2 * h) & (h < size), rho(1 - t), (1 - t) / h)
        return np.exp(special.log_beta_pdf(z, p, q)) / size
    if kind == "gamma":
        t, z = x - a, X - a
        shape = t / h + 1
        with np.errstate(divide="ignore"):
            return np.exp((shape - 1) * np.log(z / h) - z / h - special.lgamma(shape)) / h
    if kind == "rigaussian":
        t, z = x - a, X - a
        r = np.sqrt(t * t + h * t)
        with np.errstate(divide="ignore", invalid="ignore"):
            k = np.exp(-r / (2 * h) * (z / r + r / z - 2)) / np.sqrt(2 * math.pi * h * z)
        return np.where(np.isnan(k), 0.0, k)
    t = (X - x) / h
    wide = h >= size
    low = _floating(t, (a - x) / h, 1) / h
    high = _floating(t, (b - x) / h, -1) / h
    if kind == "fbl":
        return np.where(x < a + h, low, _biweight(t) / h)
    if kind == "fbu":
        return np.where(x <= b - h, _biweight(t) / h, high)
    if kind == "fb":
        za, zb = (a - x) / h, (b - x) / h
        mass = np.minimum((3 * (zb**5 - za**5) - 10 * (zb**3 - za**3) + 15 * (zb - za)) / 16, 1.0)
        middle = _biweight(t) / (h * mass)
        return middle if wide else np.where(x < a + h, low, np.where(x > b - h, high, middle))
    raise ValueError(f"no boundary kernel {kind}")


def _mean_kernel(data: DataFrame, name: str, points: np.ndarray, h: float, a: float, b: float, kind: str) -> np.ndarray:
    """The mean of kernel values at points of a bounded number; rows stay where they are."""
    step = max(1, TILE // max(1, len(points)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(points)), 0
        for batch in batches:
            X = batch.column(0).to_numpy(zero_copy_only=False)
            n += len(X)
            for k in range(0, len(X), step):
                total += kernel(points[:, None], X[None, k : k + step], h, a, b, kind).sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(points))), pa.array(total), pa.array([n] * len(points), pa.int64())], names=["at", "s", "n"])

    got = data.select(F.col(name).cast("double")).na.drop().mapInArrow(run, "at long, s double, n long").groupBy("at").agg((F.sum("s") / F.sum("n")).alias("f")).collect()
    out = np.zeros(len(points))
    for r in got:
        out[r["at"]] = r["f"]
    return out


def npuniden_boundary(data: DataFrame, name: str, points: np.ndarray, h: float | None = None, a: float | None = None, b: float | None = None, kind: str = "gaussian1", method: str = "cv.ls", proper: bool = False) -> tuple[DataFrame, float]:
    """x, f and dist at points, and the bandwidth, found on a grid that is refined if it is not given. dist is the integral of f by trapezoids from the lower bound."""
    c = F.col(name).cast("double")
    low, high = data.agg(F.min(c), F.max(c)).first()
    a, b = low if a is None else a, high if b is None else b
    if low < a or high > b:
        raise ValueError("observations lie outside the bounds")
    if h is not None and h <= 0:
        raise ValueError("the bandwidth must be positive")
    if h is None:
        h = _search(data, name, a, b, kind, method)
    end = b if math.isfinite(b) else max(high, float(np.max(points))) + 3 * (high - low)
    start = a if math.isfinite(a) else low - 3 * (high - low)
    fine = np.linspace(start, end, 1001)
    both = _mean_kernel(data, name, np.concatenate([points, fine]), h, a, b, kind)
    f, g = both[: len(points)], both[len(points) :]
    if proper:
        f, g = np.maximum(f, 0), np.maximum(g, 0)
    cumulative = np.concatenate([[0.0], np.cumsum(np.diff(fine) * (g[1:] + g[:-1]) / 2)])
    if proper:
        f, cumulative = f / cumulative[-1], cumulative / cumulative[-1]
    out = pd.DataFrame({"x": points, "f": f, "dist": np.interp(points, fine, cumulative)})
    return data.sparkSession.createDataFrame(out), h


def _search(data: DataFrame, name: str, a: float, b: float, kind: str, method: str) -> float:
    x = data.select(F.col(name).cast("double").alias("x")).na.drop().limit(20_001).toPandas()["x"].to_numpy()
    if len(x) > 20_000:
        raise ValueError("the search takes 20,000 rows; give a bandwidth")
    n = len(x)
    low, high = (a if math.isfinite(a) else x.min() - 3 * x.std()), (b if math.isfinite(b) else x.max() + 3 * x.std())
    grid = np.linspace(low, high, 1000)

    def value(h: float) -> float:
        K = kernel(x[:, None], x[None], h, a, b, kind)
        loo = (K.sum(1) - np.diag(K)) / (n - 1)
        if method == "cv.ml":
            return -float(np.log(np.maximum(loo, 1e-300)).mean())
        f = kernel(grid[:, None], x[None], h, a, b, kind).mean(1)
        return float((np.diff(grid) * (f[1:] ** 2 + f[:-1] ** 2) / 2).sum() - 2 * loo.mean())

    scale = 1.0 if kind.startswith("beta") else min(x.std(), high - low)
    tried = {h: value(h) for h in scale * np.geomspace(0.005, 1.0, 20)}
    for _ in range(3):
        best = min(tried, key=tried.get)
        tried |= {h: value(h) for h in best * np.geomspace(0.75 ** (1 / (_ + 1)), 1.35 ** (1 / (_ + 1)), 7)}
    return float(min(tried, key=tried.get))


def npuniden_reflect(data: DataFrame, name: str, points: np.ndarray, h: float | None = None, a: float = 0.0, b: float = 1.0) -> DataFrame:
    """x, f and dist by an estimate on the data and their mirror images at the finite bounds."""
    c = F.col(name).cast("double")
    rows = data.select(c.alias("x")).na.drop()
    h = h or search.normal_reference(rows, ["x"]).h[0]
    copies = 1 + math.isfinite(a) + math.isfinite(b)
    if copies == 1:
        raise ValueError("reflection needs a finite bound")
    mirrored = rows
    for bound in (a, b):
        if math.isfinite(bound):
            mirrored = mirrored.unionAll(rows.select((2 * bound - F.col("x")).alias("x")))
    bw = Bandwidth((Variable("x"),), (h,))
    frame = pd.DataFrame({"x": points})
    f = density.npudens(mirrored, bw, frame).select("at", "x", (F.col("dens") * copies).alias("f"))
    # below a lower bound lies one copy, of all that there are
    dist = density.npudist(mirrored, bw, frame).select("at", (F.col("dist") * copies - (1 if math.isfinite(a) else 0)).alias("dist"))
    return f.join(dist, "at").select("x", "f", "dist")


def hildreth(G: np.ndarray, g: np.ndarray, target: np.ndarray, sweeps: int = 20_000, tolerance: float = 1e-12) -> np.ndarray:
    """The point nearest to target with G x >= g, by dual coordinate ascent."""
    x, dual = target.copy(), np.zeros(len(G))
    norm = (G * G).sum(1)
    for _ in range(sweeps):
        moved = 0.0
        for i in range(len(G)):
            if norm[i]:
                step = max(-dual[i], (g[i] - G[i] @ x) / norm[i])
                if step:
                    dual[i] += step
                    x += step * G[i]
                    moved = max(moved, abs(step) * norm[i] ** 0.5)
        if moved < tolerance:
            break
    return x


SHAPES = ("density", "mono.incr", "mono.decr", "concave", "convex", "log-concave", "log-convex")


def npuniden_sc(data: DataFrame, name: str, h: float, a: float = 0.0, b: float = 1.0, shape: str = "density", points: int = 60, lb: float = 0.0, ub: float = math.inf, kind: str = "gaussian1") -> DataFrame:
    """x, f (unconstrained) and f_sc, the values on a grid that are nearest to f under the shape and bounds, with its integral."""
    if shape not in SHAPES:
        raise ValueError(f"no shape {shape}")
    grid = np.linspace(a, b, points)
    f = _mean_kernel(data, name, grid, h, a, b, kind)
    logs = shape.startswith("log-")
    y = np.log(np.maximum(f, 1e-12)) if logs else f
    rows, right = [], []
    if not logs:
        rows.append(np.eye(points))
        right.append(np.full(points, lb))
        if math.isfinite(ub):
            rows.append(-np.eye(points))
            right.append(np.full(points, -ub))
    first, second = np.diff(np.eye(points), axis=0), np.diff(np.eye(points), 2, axis=0)
    sign = {"mono.incr": first, "mono.decr": -first, "concave": -second, "log-concave": -second, "convex": second, "log-convex": second}.get(shape)
    if sign is not None:
        rows.append(sign)
        right.append(np.zeros(len(sign)))
    weights = np.full(points, (b - a) / (points - 1))
    weights[[0, -1]] /= 2
    if not logs:
        total = weights @ f
        rows += [weights[None], -weights[None]]
        right += [np.array([total]), np.array([-total])]
    out = hildreth(np.concatenate(rows), np.concatenate(right), y) if rows else y
    if logs:
        out = np.exp(out)
        out *= (weights @ f) / (weights @ out)
    return data.sparkSession.createDataFrame(pd.DataFrame({"x": grid, "f": f, "f_sc": out}))
