"""Bandwidth search: cross-validation objectives, evaluated for many candidates in one job, and the search itself.

A job shares out the training rows as evaluation rows; all training rows go to every task, within a
checked number. Each task adds up the losses of its rows for every candidate, and only those sums
return, so a round of the search costs one pass whatever the number of candidates.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ksum import TILE, Points, encoded, lengths, many, numbered, product, sums_at
from ..plans.spec import CONTINUOUS, Bandwidth, Kernel, Variable, greatest, variables
from . import metrics, polynomials

#: Gives for some rows their terms: sums of a few kinds, which finish() turns into the objective.
Loss = Callable[[Bandwidth, Points, list[np.ndarray | None], np.ndarray], np.ndarray]
TINY = 2.2250738585072014e-308


def _kernel(bw: Bandwidth, train: Points, sorted_values, rows: np.ndarray, operators: dict[str, str] | None = None, divide: bool = True, own: bool = False, h_same: bool = True) -> np.ndarray:
    """Kernel values of training rows by all training rows, 0 for the own one unless it stays."""
    x = train[rows]
    K = product(bw, x, train.columns, lengths(bw, x, train.columns, sorted_values, h_same), operators or {}, divide)
    if not own:
        K = K.copy()
        K[np.arange(len(rows)), rows] = 0.0
    return K


def density_ml(bw, train, sv, rows):
    f = _kernel(bw, train, sv, rows).sum(1) / (train.n - 1)
    return -np.log(np.maximum(f, TINY))[:, None]


def density_ls(bw, train, sv, rows):
    n = train.n
    if bw.kind == "adaptive_nn":
        if bw.kernel.continuous != "gaussian" or bw.kernel.order != 2 or len(bw.continuous) != len(bw.variables):
            raise ValueError("least squares with adaptive neighbours is for Gaussian kernels of order 2")
        x = train[rows]
        h_rows, h_all = lengths(bw, x, x, sv, True), lengths(bw, x, train.columns, sv, True)
        c = 1.0
        for i in range(len(bw.variables)):
            s = np.sqrt(h_rows[i].T ** 2 + h_all[i] ** 2)
            z = (x[i][:, None] - train.columns[i][None]) / s
            c = c * np.exp(-0.5 * z * z) / (s * math.sqrt(2 * math.pi))
    else:
        c = _kernel(bw, train, sv, rows, {v.name: "convolution" for v in bw.variables}, own=True)
    return (c.sum(1) / (n * n) - 2 * _kernel(bw, train, sv, rows).sum(1) / (n * (n - 1)))[:, None]


def _whole(train: DataFrame, bw: Bandwidth, names: list[str], columns: dict[str, Column], operators: dict[str, str] | None = None, divide: bool = True) -> DataFrame:
    """Complete rows, of any number, with each response r, its sum all_r, loo_r without the own row, and k0, the kernel of no distance."""
    rows = encoded(train, bw, **{n: c.cast("double") for n, c in columns.items()})
    keys = [f"v{i}" for i in range(len(bw.variables))]
    sums = sums_at(rows, bw, names, rows, operators, 1, divide).withColumnsRenamed({n: f"s_{n}" for n in names})
    k0 = F.col("k0")
    return rows.join(sums, keys).select(*names, *((F.col(f"s_{n}") + k0 * F.col(f"same_{n}")).alias(f"all_{n}") for n in names), *((F.col(f"s_{n}") + k0 * (F.col(f"same_{n}") - F.col(n))).alias(f"loo_{n}") for n in names), "k0")


def _density_whole(kind: str):
    def sums(train: DataFrame, bw: Bandwidth, extra: dict[str, Column]) -> tuple[list[float], int]:
        one = {"n": F.lit(1.0)}
        rows = _whole(train, bw, ["n"], one)
        if kind == "ml":
            n = encoded(train, bw).count()
            return [rows.agg(F.sum(-F.log(F.greatest(F.col("loo_n") / (n - 1), F.lit(TINY))))).first()[0]], n
        n, f = rows.agg(F.count("*"), F.sum("loo_n")).first()
        c = _whole(train, bw, ["n"], one, {v.name: "convolution" for v in bw.variables}).agg(F.sum("all_n")).first()[0]
        return [c / (n * n) - 2 * f / (n * (n - 1))], n

    return sums


#: Of losses that have one, their sums over tables of any size.
density_ml.whole, density_ls.whole = _density_whole("ml"), _density_whole("ls")


def distribution_cdf(bw, train, sv, rows):
    """Rows are grid points here; each training row but that one is left out in turn."""
    n = train.n
    G = _kernel(bw, train, sv, rows, {v.name: "integral" for v in bw.variables}, own=True, h_same=False)
    below = np.ones(G.shape, bool)
    for c in train.columns:
        below &= c[None] <= c[rows][:, None]
    e = (below - (G.sum(1, keepdims=True) - G) / (n - 1)) ** 2
    e[np.arange(len(rows)), rows] = 0.0
    return e.sum(1)[:, None] / (n * (n - 1))


def regression(method: str, degree: tuple[int, ...] = (), basis: str = "glp", response: str = "y"):
    """ls, aic, ks (the log-likelihood of a binary response) or a check loss for a probability."""

    def loss(bw, train, sv, rows):
        y = train.extra[response]
        if method == "aic":
            K = _kernel(bw, train, sv, rows, own=True, divide=False)
            fit, own = polynomials.fit_rows(K, train, bw, y, train[rows], degree, basis, rows)
            return np.stack([(y[rows] - fit) ** 2, own], 1)
        K = _kernel(bw, train, sv, rows, divide=False)
        fit, _ = polynomials.fit_rows(K, train, bw, y, train[rows], degree, basis)
        if method == "ls":
            return np.where(np.isfinite(fit), (y[rows] - fit) ** 2, 1e300)[:, None]
        if method == "ks":
            p = np.clip(fit, 1e-10, 1 - 1e-10)
            return -(y[rows] * np.log(p) + (1 - y[rows]) * np.log(1 - p))[:, None]
        tau, u = float(method), train.extra["target"][rows] - fit
        return (u * (tau - (u < 0)))[:, None]

    def whole(train: DataFrame, bw: Bandwidth, extra: dict[str, Column]) -> tuple[list[float], int]:
        y = F.col("y")
        rows = _whole(train, bw, ["n", "y"], {"n": F.lit(1.0), "y": extra[response]}, divide=False)
        if method == "ls":
            fit = F.col("loo_y") / F.when(F.col("loo_n") != 0, F.col("loo_n"))
            got = rows.agg(F.count("*"), F.sum(F.coalesce((y - fit) ** 2, F.lit(1e300)))).first()
        else:
            got = rows.agg(F.count("*"), F.sum((y - F.col("all_y") / F.col("all_n")) ** 2), F.sum(F.col("k0") / F.col("all_n"))).first()
        return list(got[1:]), got[0]

    if method in ("ls", "aic") and not any(degree):
        loss.whole = whole
    return loss


def aic_corrected(sums: np.ndarray, n: int) -> float:
    s2, trace = sums[0] / n, sums[1]
    room = 1 - (trace + 2) / n
    return math.log(s2) + (1 + trace / n) / room if room > 0 and s2 > 0 else math.inf


def conditional_ml(y_names: list[str]):
    def loss(bw, train, sv, rows):
        at = [i for i, v in enumerate(bw.variables) if v.name not in y_names]
        x_bw = bw.of([bw.variables[i].name for i in at])
        x_train = Points([train.columns[i] for i in at], {}, train.n)
        both = _kernel(bw, train, sv, rows).sum(1)
        given = _kernel(x_bw, x_train, [sv[i] for i in at], rows).sum(1)
        return -np.log(np.maximum(both / np.maximum(given, TINY), TINY))[:, None]

    return loss


def _split(bw: Bandwidth, train: Points, sv, y_names: list[str]):
    part = lambda at: (bw.of([bw.variables[i].name for i in at]), Points([train.columns[i] for i in at], {}, train.n), [sv[i] for i in at])
    y = [i for i, v in enumerate(bw.variables) if v.name in y_names]
    return part([i for i in range(len(bw.variables)) if i not in y]), part(y)


def conditional_ls(y_names: list[str]):
    """The integrated squared density less twice the density at the row, both without the row."""

    def loss(bw, train, sv, rows):
        (xb, xt, xs), (yb, yt, ys) = _split(bw, train, sv, y_names)
        s = _kernel(xb, xt, xs, rows)
        s /= np.maximum(s.sum(1, keepdims=True), TINY)
        square = np.zeros(len(rows))
        step = max(1, TILE // train.n)
        for k in range(0, train.n, step):
            some = np.arange(k, min(train.n, k + step))
            c = _kernel(yb, yt, ys, some, {v.name: "convolution" for v in yb.variables}, own=True)
            square += ((s @ c.T) * s[:, some]).sum(1)
        cross = (s * _kernel(yb, yt, ys, rows, own=True)).sum(1)
        return (square - 2 * cross)[:, None]

    return loss


def conditional_cdf(y_names: list[str]):
    def loss(bw, train, sv, rows):
        n = train.n
        (xb, xt, xs), (yb, yt, ys) = _split(bw, train, sv, y_names)
        s = _kernel(xb, xt, xs, rows)
        s /= np.maximum(s.sum(1, keepdims=True), TINY)
        total = np.zeros(len(rows))
        step = max(1, TILE // n)
        for k in range(0, n, step):
            some = np.arange(k, min(n, k + step))
            g = _kernel(yb, yt, ys, some, {v.name: "integral" for v in yb.variables}, own=True, h_same=False)
            below = np.ones((len(rows), len(some)), bool)
            for c in yt.columns:
                below &= c[rows][:, None] <= c[some][None]
            e = (below - s @ g.T) ** 2
            e[rows[:, None] == some[None]] = 0.0
            total += e.sum(1)
        return total[:, None] / (n * (n - 1))

    return loss


def evaluate(train: DataFrame, candidates: list[Bandwidth], loss: Loss, extra: dict[str, Column] | None = None, finish: Callable[[np.ndarray, int], float] | None = None, derive: Callable[[Points, Bandwidth], Points] | None = None, points: Points | None = None) -> list[float]:
    """The objective of each candidate: the sum of the losses of all rows, or what finish makes of the sums."""
    if points is None and hasattr(loss, "whole") and not derive and all(bw.kind == "fixed" for bw in candidates) and many(train, candidates[0], **(extra or {})):
        sums = [loss.whole(train, bw, extra or {}) for bw in candidates]
        values = [float(finish(np.array(x), n) if finish else x[0]) for x, n in sums]
        return [v if math.isfinite(v) else math.inf for v in values]
    if points is None:
        _, points = numbered(train, candidates[0], extra or {})
    n = points.n
    if n < 3:
        raise ValueError("three complete rows are needed at least")
    spark = train.sparkSession
    step = max(1, TILE // n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for k, bw in enumerate(candidates):
                here = derive(points, bw) if derive else points
                sv = [np.sort(c) if v.kind == CONTINUOUS and bw.kind != "fixed" else None for c, v in zip(here.columns, bw.variables, strict=True)]
                with np.errstate(all="ignore"):
                    total = sum(loss(bw, here, sv, rows[a : a + step]).sum(0) for a in range(0, len(rows), step))
                m = len(total)
                yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int32()), pa.array(range(m), pa.int32()), pa.array(total)], names=["candidate", "part", "total"])

    tasks = min(spark.sparkContext.defaultParallelism, max(1, n // 50))
    got = spark.range(0, n, 1, tasks).mapInArrow(run, "candidate int, part int, total double").groupBy("candidate", "part").agg(F.sum("total").alias("total")).collect()
    sums: dict[int, dict[int, float]] = {}
    for r in got:
        sums.setdefault(r["candidate"], {})[r["part"]] = r["total"]
    out = []
    for k in range(len(candidates)):
        x = np.array([sums[k][j] for j in sorted(sums[k])])
        value = float(finish(x, n) if finish else x[0])
        out.append(value if math.isfinite(value) else math.inf)
    return out


def nelder_mead(batch: Callable[[list[tuple[float, ...]]], list[float]], start: tuple[float, ...], step: tuple[float, ...], lower: tuple[float, ...], upper: tuple[float, ...], rounds: int = 200, tolerance: float = 1e-6) -> tuple[tuple[float, ...], float, int]:
    """The simplex search of Nelder and Mead within bounds. A round's reflection, expansion and both contractions are valued in one call, since a call is a job."""
    lo, hi = np.array(lower), np.array(upper)
    tried = 0

    def value(points: list[np.ndarray]) -> list[float]:
        nonlocal tried
        tried += len(points)
        return list(batch([tuple(float(v) for v in np.clip(p, lo, hi)) for p in points]))

    simplex = [np.array(start, float), *(np.clip(np.array(start, float) + s * e, lo, hi) for s, e in zip(step, np.eye(len(start)), strict=True))]
    values = value(simplex)
    for _ in range(rounds):
        order = np.argsort(values, kind="stable")
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) <= tolerance * (abs(values[0]) + tolerance) and max(np.abs(p - simplex[0]).max() for p in simplex) <= tolerance ** 0.5:
            break
        centre = np.mean(simplex[:-1], axis=0)
        away = centre - simplex[-1]
        tries = [np.clip(centre + f * away, lo, hi) for f in (1.0, 2.0, 0.5, -0.5)]
        reflected, expanded, outside, inside = value(tries)
        if reflected < values[0]:
            new = (tries[1], expanded) if expanded < reflected else (tries[0], reflected)
        elif reflected < values[-2]:
            new = (tries[0], reflected)
        elif reflected < values[-1] and outside <= reflected:
            new = (tries[2], outside)
        elif reflected >= values[-1] and inside < values[-1]:
            new = (tries[3], inside)
        else:  # towards the best
            simplex = [simplex[0], *(simplex[0] + 0.5 * (p - simplex[0]) for p in simplex[1:])]
            values = [values[0], *value(simplex[1:])]
            continue
        simplex[-1], values[-1] = new
    k = int(np.argmin(values))
    return tuple(float(v) for v in np.clip(simplex[k], lo, hi)), float(values[k]), tried


def minimise(batch: Callable[[list[tuple[float, ...]]], list[float]], start: list[tuple[float, ...]], lower: tuple[float, ...], upper: tuple[float, ...], log: tuple[bool, ...], whole: tuple[bool, ...] = (), rounds: int = 16, tolerance: float = 1e-3) -> tuple[tuple[float, ...], float, int]:
    """A pattern search whose every round tries all steps at once, descending from every start."""
    p = len(lower)
    whole = whole or (False,) * p
    up = lambda x: np.array([math.log(v) if f else v for v, f in zip(x, log, strict=True)])
    lo, hi = up(lower), up(upper)

    def down(u: np.ndarray) -> tuple[float, ...]:
        u = np.clip(u, lo, hi)
        return tuple(float(round(math.exp(v) if f else v)) if w else float(math.exp(v) if f else v) for v, f, w in zip(u, log, whole, strict=True))

    seen: dict[tuple[float, ...], float] = {}

    def value(points: list[np.ndarray]) -> list[float]:
        asked = list(dict.fromkeys(x for x in map(down, points) if x not in seen))
        if asked:
            seen.update(zip(asked, batch(asked), strict=True))
        return [seen[down(u)] for u in points]

    @dataclass
    class Descent:
        best: np.ndarray
        step: np.ndarray
        last_move: np.ndarray
        open: bool = True

    descents = [Descent(up(s), np.where(log, 0.7, (hi - lo) * 0.25), np.zeros(p)) for s in start]
    value([d.best for d in descents])
    for _ in range(rounds):
        tries = {}
        for i, d in enumerate(descents):
            if d.open:
                tries[i] = [d.best + f * d.step * e for e in np.eye(p) for f in (-1, 1, -0.5, 0.5)]
                if d.last_move.any():
                    tries[i] += [d.best + d.last_move, d.best + 2 * d.last_move]
        if not tries:
            break
        value([u for t in tries.values() for u in t])
        for i, t in tries.items():
            d = descents[i]
            got = value(t)
            k = int(np.argmin(got))
            if got[k] < seen[down(d.best)]:
                d.last_move = np.clip(t[k], lo, hi) - d.best
                d.best = np.clip(t[k], lo, hi)
            else:
                d.step = d.step * 0.35
                d.open = not np.all(d.step < tolerance)
    best = min((d.best for d in descents), key=lambda u: seen[down(u)])
    x = down(best)
    return x, seen[x], len(seen)


def limits(train: DataFrame, vs: list[Variable], kernel: Kernel, kind: str, n: int, floor: float = 0.1) -> tuple[list[tuple[float, ...]], tuple[float, ...], tuple[float, ...], tuple[bool, ...], tuple[bool, ...]]:
    """Starts, bounds, and which are searched on a log scale or over whole numbers."""
    c = sum(v.kind == CONTINUOUS for v in vs)
    rate = n ** (-1 / (2 * kernel.order + max(c, 1)))
    start, lower, upper, log, whole = [], [], [], [], []
    for v in vs:
        if v.kind != CONTINUOUS:
            top = greatest(v, kernel)
            start.append(top / 2)
            lower.append(0.0)
            upper.append(top)
            log.append(False)
            whole.append(False)
        elif kind == "fixed":
            s = metrics.spread(train, v.name)
            start.append(1.06 * s * rate)
            lower.append(floor * s * rate)
            upper.append(1000 * s)
            log.append(True)
            whole.append(False)
        else:
            start.append(float(max(2, round(math.sqrt(n)))))
            lower.append(2.0)
            upper.append(float(n - 1))
            log.append(True)
            whole.append(True)
    other = tuple(min(u, max(lo, x * 2.5)) if f else x / 3 for x, lo, u, f in zip(start, lower, upper, log, strict=True))
    return [tuple(start), other], tuple(lower), tuple(upper), tuple(log), tuple(whole)


def select(train: DataFrame, names: list, loss: Loss, kernel: Kernel = Kernel(), kind: str = "fixed", extra: dict[str, Column] | None = None, finish=None, method: str = "", rounds: int = 16) -> Bandwidth:
    """The bandwidth that minimises an objective."""
    vs = variables(train, names)
    probe = Bandwidth(tuple(vs), tuple(1.0 if v.kind == CONTINUOUS else 0.0 for v in vs), kernel, "fixed" if kind == "fixed" else kind)
    _, points = numbered(train, probe, extra or {})
    starts, lower, upper, log, whole = limits(train.na.drop(subset=[v.name for v in vs]), vs, kernel, kind, points.n)
    make = lambda h: replace(probe, h=h, kind=kind)
    batch = lambda hs: evaluate(train, [make(h) for h in hs], loss, finish=finish, points=points)
    h, value, n = minimise(batch, starts, lower, upper, log, whole, rounds)
    return replace(make(h), value=value, method=method, evaluations=n)


def normal_reference(train: DataFrame, names: list, kernel: Kernel = Kernel(), distribution: bool = False) -> Bandwidth:
    """1.06 times the spread times the rate of densities, or 1.587 times that of distributions; categories have 0."""
    vs = variables(train, names)
    rows = train.na.drop(subset=[v.name for v in vs])
    n, p = rows.count(), sum(v.kind == CONTINUOUS for v in vs)
    rate = n ** (-1 / (p + kernel.order)) if distribution else n ** (-1 / (2 * kernel.order + p))
    h = tuple((1.587 if distribution else 1.06) * metrics.spread(rows, v.name) * rate if v.kind == CONTINUOUS else 0.0 for v in vs)
    return Bandwidth(tuple(vs), h, kernel, method="normal-reference")
