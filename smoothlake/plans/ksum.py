"""The plans of kernel sums.

A kernel sum is S(x) = sum over training rows j of R_j * prod_d K_d(x_d, X_jd; h_d) ** power. Three plans
compute it; all add up within tasks before the one exchange, by evaluation row:

- blocks: training rows stay where they are, evaluation points, of a checked number, go to all tasks,
  and each task multiplies kernel matrices of bounded size with its responses;
- native: the evaluation points are broadcast and joined, kernels are column expressions;
- buckets: for compact kernels of one variable, an equi-join on buckets of the kernel's width, for
  evaluation tables of any size.

Rows with equal variables may be added up first, which is exact: within each batch in the first plan,
and by an aggregation in the others.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .line import NODES, Line, on_line, smooth
from .spec import CONTINUOUS, ORDERED, UNORDERED, Bandwidth

MOST_POINTS = 200_000  # evaluation or training rows that may go to all tasks
MOST_PAIRS = 5e11
TILE = 1 << 21  # kernel values held at once


Expand = Callable[[list[np.ndarray], np.ndarray], np.ndarray]


class TooManyPairs(ValueError):
    pass


@dataclass
class Points:
    """Encoded rows: a column of doubles for each variable, and more columns of doubles."""

    columns: list[np.ndarray]
    extra: dict[str, np.ndarray]
    n: int

    def __getitem__(self, part) -> list[np.ndarray]:
        return [c[part] for c in self.columns]


def encoded(df: DataFrame, bw: Bandwidth, **extra: Column) -> DataFrame:
    """The variables as doubles v0, v1, ... and more columns, without rows that lack any of them."""
    columns = {f"v{i}": v.encode() for i, v in enumerate(bw.variables)} | extra
    return df.select(*(c.alias(k) for k, c in columns.items())).na.drop()


def collect(df: DataFrame, bw: Bandwidth, most: int | None = MOST_POINTS, **extra: Column) -> Points:
    """Encoded rows on the driver, refused beyond a number if there is one."""
    rows = encoded(df, bw, **extra)
    got = (rows if most is None else rows.limit(most + 1)).toPandas()
    if most is not None and len(got) > most:
        raise TooManyPairs(f"over {most} points; use a grid, or a sample of evaluation points")
    return Points([got[f"v{i}"].to_numpy(float) for i in range(len(bw.variables))], {k: got[k].to_numpy() for k in extra}, len(got))


def nn_distance(sorted_values: np.ndarray, at: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """The distance from each point to its k-th nearest value; a point's own value is left out once.

    Beyond the values that there are, the farthest distance grows in proportion.
    """
    n = len(sorted_values) - skip_self
    if n < 1:
        raise ValueError("no neighbours")
    want = min(k, n) + skip_self
    low = np.searchsorted(sorted_values, at)
    left, right = np.zeros(len(at), np.int64), np.full(len(at), want)
    # so many of the want nearest ones lie below: the least number for which the next one below is not nearer
    while True:
        open_ = np.flatnonzero(left < right)
        if not len(open_):
            break
        mid = (left[open_] + right[open_]) >> 1
        below = low[open_] - mid - 1
        above = low[open_] + want - mid - 1
        d_below = np.where(below >= 0, at[open_] - sorted_values[np.maximum(below, 0)], np.inf)
        d_above = np.where(above < len(sorted_values), sorted_values[np.minimum(above, len(sorted_values) - 1)] - at[open_], np.inf)
        take = d_below < d_above
        left[open_[take]] = mid[take] + 1
        right[open_[~take]] = mid[~take]
    i, j = low - left, low + want - left
    d_left = np.where(left > 0, at - sorted_values[np.clip(i, 0, len(sorted_values) - 1)], 0.0)
    d_right = np.where(want > left, sorted_values[np.clip(j - 1, 0, len(sorted_values) - 1)] - at, 0.0)
    return np.maximum(d_left, d_right) * (k / n if k > n else 1.0)


def factor(bw: Bandwidth, i: int, x: np.ndarray, X: np.ndarray, h: np.ndarray | float, operator: str, divide: bool) -> np.ndarray:
    """One variable's kernel values; x is a column of evaluation points, X a row of training points."""
    v, k = bw.variables[i], bw.kernel
    if v.kind == CONTINUOUS:
        bounds = k.bounds.get(v.name)
        if k.continuous == "beta":
            if not bounds:
                raise ValueError(f"beta kernels need bounds for {v.name}")
            return kernels.beta(x, X, np.asarray(h, float), *bounds, k.order, operator)
        z = (x - X) / h
        if operator == "score":  # the derivative by the bandwidth
            if bounds:
                raise ValueError("bounded kernels have no score here")
            slope = z * kernels.derivative(z, k.continuous, k.order)
            return -(kernels.pdf(z, k.continuous, k.order) + slope) / (h * h) if divide else -slope / h
        out = kernels.CONTINUOUS[operator](z, k.continuous, k.order)
        if bounds and operator == "normal":
            out = out / kernels.bounded_mass(x, np.asarray(h, float), *bounds, k.continuous, k.order)
        elif bounds and operator == "integral":
            low = kernels.cdf((bounds[0] - X) / h, k.continuous, k.order) if math.isfinite(bounds[0]) else 0.0
            out = (out - low) / kernels.bounded_mass(X, np.asarray(h, float), *bounds, k.continuous, k.order)
        if divide and operator != "integral":
            out = out / h
            if operator == "derivative":
                out = out / h
        return out
    if v.kind == UNORDERED:
        if operator == "normal":
            return kernels.unordered(x == X, bw.h[i], k.unordered, len(v.levels))
        if operator == "integral":
            return kernels.unordered_cdf(x, X, bw.h[i], k.unordered, len(v.levels))
        if operator == "convolution":
            return kernels.unordered_convolution(x == X, bw.h[i], k.unordered, len(v.levels))
    elif v.kind == ORDERED:
        if operator == "normal":
            return kernels.ordered(x, X, bw.h[i], k.ordered, v.codes())
        if operator == "integral":
            return kernels.ordered_cdf(x, X, bw.h[i], k.ordered, v.codes())
        if operator == "convolution":
            return kernels.ordered_convolution(x, X, bw.h[i], k.ordered, v.codes())
    raise ValueError(f"no operator {operator} for {v.kind} variables")


def lengths(bw: Bandwidth, x: list[np.ndarray], X: list[np.ndarray], sorted_values: list[np.ndarray | None], same: bool) -> list[np.ndarray | float]:
    """Bandwidths, shaped to divide a matrix of evaluation by training points."""
    out: list[np.ndarray | float] = []
    for i, v in enumerate(bw.variables):
        if v.kind != CONTINUOUS or bw.kind == "fixed":
            out.append(bw.h[i])
        elif bw.kind == "generalized_nn":
            out.append(nn_distance(sorted_values[i], x[i], int(bw.h[i]), same)[:, None])
        else:
            out.append(nn_distance(sorted_values[i], X[i], int(bw.h[i]), True)[None])
    return out


def product(bw: Bandwidth, x: list[np.ndarray], X: list[np.ndarray], h: list[np.ndarray | float], operators: dict[str, str], divide: bool) -> np.ndarray:
    """The product kernel of evaluation by training points."""
    out: np.ndarray | float = 1.0
    for i, v in enumerate(bw.variables):
        out = out * factor(bw, i, x[i][:, None], X[i][None], h[i], operators.get(v.name, "normal"), divide)
    return np.broadcast_to(out, (len(x[0]), len(X[0]))) if bw.variables else np.ones((0, 0))


def products(bw: Bandwidth, x: list[np.ndarray], X: list[np.ndarray], h: list[np.ndarray | float], operators: dict[str, str], divide: bool, powers: tuple[int, ...], permute: str | None) -> Iterator[np.ndarray]:
    """The product kernel to each power, then, for each continuous variable in turn, the product with that variable's operator exchanged; each factor is worked out once."""
    shape = len(x[0]), len(X[0])
    parts = [np.broadcast_to(factor(bw, i, x[i][:, None], X[i][None], h[i], operators.get(v.name, "normal"), divide), shape) for i, v in enumerate(bw.variables)]
    K = math.prod(parts[1:], start=parts[0])
    for p in powers:
        yield K if p == 1 else K**p
    for i in bw.continuous if permute else ():
        other = np.broadcast_to(factor(bw, i, x[i][:, None], X[i][None], h[i], permute, divide), shape)
        yield math.prod((p for j, p in enumerate(parts) if j != i), start=other)


def _sorted_training(train: DataFrame, bw: Bandwidth) -> list[np.ndarray | None]:
    if bw.kind == "fixed":
        return [None] * len(bw.variables)
    got = collect(train, bw)
    return [np.sort(c) if v.kind == CONTINUOUS else None for c, v in zip(got.columns, bw.variables, strict=True)]


def compressed(rows: DataFrame, keys: list[str], values: list[str], threshold: float = 0.5) -> DataFrame:
    """Rows with equal keys added up, if an estimate says that this leaves few enough."""
    n, distinct = rows.agg(F.count("*"), F.approx_count_distinct(F.struct(*keys))).first()
    if not n or distinct > threshold * n:
        return rows
    return rows.groupBy(*keys).agg(*(F.sum(v).alias(v) for v in values))


def folded(X: list[np.ndarray], R: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows with equal variables added up, if that leaves at most half of them."""
    key = np.zeros(len(R), np.uint64)
    for c in X:
        key = (key ^ (c + 0.0).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    some = key[:2000]
    if 2 * len(np.unique(some)) > len(some):
        return X, R
    _, first, which = np.unique(key, return_index=True, return_inverse=True)
    if any((c != c[first][which]).any() for c in X):  # two keys of the same hash
        return X, R
    return [c[first] for c in X], np.stack([np.bincount(which, r, len(first)) for r in R.T], 1)


def ksum(train: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, responses: dict[str, Column] | None = None, *, operators: dict[str, str] | None = None, power: int | tuple[int, ...] = 1, divide: bool = True, compress: bool = True, leave_one_out: bool = False, engine: str = "blocks", expand: Expand | None = None, outputs: list[str] | None = None, weights: dict[str, Column] | None = None, permute: str | None = None, apart: bool = False) -> DataFrame:
    """at, the number of the evaluation row, its variables, and a sum for each response.

    points: evaluation rows, with the variables' columns; at is their order, or a column of that name.
    responses: columns of train; by default one of ones, n. leave_one_out: each training row is an
    evaluation row too, and its own term is left out; points is ignored. expand: makes more responses
    from the variables and the given ones inside the tasks, which are then called outputs; it must be
    linear in the given ones, since rows may have been added up. power: of the kernel; of several, the
    sums of those after the first are called name_p2 and so on, all from one pass. weights: columns of
    train; there is a sum weight_response for each of them and each response. permute: an operator; the
    same pass gives variable_name, the sums with that continuous variable's operator exchanged for it.
    apart: training rows equal to the evaluation row in all variables add nothing.
    """
    responses = responses or {"n": F.lit(1.0)}
    operators = operators or {}
    powers = (power,) if isinstance(power, int) else tuple(power)
    if not powers or any(p < 1 or p != int(p) for p in powers):
        raise ValueError("the power must be a whole number of 1 or more")
    if weights:
        responses = {f"{w}_{k}": a.cast("double") * c.cast("double") for w, a in weights.items() for k, c in responses.items()}
    if (len(powers) > 1 or permute) and (leave_one_out or engine != "blocks"):
        raise ValueError("several powers and permutations are for the blocks engine")
    power = powers[0]
    spark = train.sparkSession
    rows = encoded(train, bw, **{k: c.cast("double") for k, c in responses.items()})
    names, keys = list(responses), [f"v{i}" for i in range(len(bw.variables))]
    if expand and (leave_one_out or engine != "blocks"):
        raise ValueError("responses are expanded by the blocks engine")
    if leave_one_out:
        return _leave_one_out(train, bw, responses, operators, power, divide, engine)
    if isinstance(points, pd.DataFrame):
        points = points.copy()
        if "at" not in points:
            points["at"] = np.arange(len(points))
        points = spark.createDataFrame(points)
    if engine == "native":
        return _native(rows, bw, points, names, operators, power, divide, compress)
    if engine != "blocks":
        raise ValueError(f"no engine {engine}")
    at = collect(points, bw, at=F.col("at").cast("long"))
    for v, x in zip(bw.variables, at.columns, strict=True):
        low, high = bw.kernel.bounds.get(v.name, (-math.inf, math.inf))
        if ((x < low) | (x > high)).any():
            raise ValueError(f"evaluation points of {v.name} lie outside its bounds")
    sorted_values = _sorted_training(train, bw)
    step = max(1, TILE // max(1, at.n))
    if expand:
        names = list(outputs)
    d, base = len(keys), list(names)
    names = [*names, *(f"{n}_p{p}" for p in powers[1:] for n in base), *(f"{bw.variables[i].name}_{n}" for i in (bw.continuous if permute else ()) for n in base)]
    r, b = len(names), len(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((at.n, r))
        seen = False
        h = None
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not batch.num_rows:
                continue
            all_x, all_r = columns[:d], np.stack(columns[d:], 1)
            if compress:
                all_x, all_r = folded(all_x, all_r)
            for k in range(0, len(all_r), step):
                seen = True
                X = [c[k : k + step] for c in all_x]
                R = all_r[k : k + step]
                if expand:
                    R = expand(X, R)
                if h is None or bw.kind == "adaptive_nn":
                    h = lengths(bw, at.columns, X, sorted_values, False)
                for j, K in enumerate(products(bw, at.columns, X, h, operators, divide, powers, permute)):
                    if apart:
                        K = np.where(np.logical_and.reduce([x[:, None] == c for x, c in zip(at.columns, X, strict=True)]), 0.0, K)
                    total[:, j * b : (j + 1) * b] += K @ R
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(at.extra["at"].astype(np.int64)), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(r))], names=["at", *names])

    sums = rows.mapInArrow(run, ", ".join(["at long", *(f"{n} double" for n in names)])).groupBy("at").agg(*(F.sum(n).alias(n) for n in names))
    grid = spark.createDataFrame(pd.DataFrame({"at": at.extra["at"].astype(np.int64)} | {f"v{i}": c for i, c in enumerate(at.columns)}))
    out = grid.join(F.broadcast(sums), "at", "left")  # as many rows as the evaluation points, which are bounded
    return out.select("at", *(F.col(f"v{i}").alias(v.name) for i, v in enumerate(bw.variables)), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in names))


def permuted(train: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, responses: dict[str, Column] | None = None, operator: str = "derivative", **options) -> DataFrame:
    """The sums, and under name_response those with one continuous variable's operator exchanged, for each in turn.

    operator: normal, derivative, integral or score, the derivative by the variable's bandwidth.
    """
    return ksum(train, bw, points, responses, permute=operator, **options)


def kernel_weights(train: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, row: str, *, operators: dict[str, str] | None = None, power: int = 1, divide: bool = True) -> DataFrame:
    """at, row and weight, the kernel's value, for each evaluation row and training row where it is not 0. row: a column of train that tells its rows apart."""
    if isinstance(points, pd.DataFrame):
        points = train.sparkSession.createDataFrame(points.assign(at=np.arange(len(points))) if "at" not in points else points)
    at = collect(points, bw, at=F.col("at").cast("long"))
    sorted_values = _sorted_training(train, bw)
    step, d, ids = max(1, TILE // max(1, at.n)), len(bw.variables), at.extra["at"].astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for k in range(0, batch.num_rows, step):
                X = [c[k : k + step] for c in columns[:d]]
                K = product(bw, at.columns, X, lengths(bw, at.columns, X, sorted_values, False), operators or {}, divide) ** power
                i, j = np.nonzero(K)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(columns[d][k : k + step][j].astype(np.int64)), pa.array(K[i, j])], names=["at", "row", "weight"])

    return encoded(train, bw, row=F.col(row).cast("double")).mapInArrow(run, "at long, row long, weight double")


def at_reference(train: DataFrame, bw: Bandwidth, points: pd.DataFrame, name: str, level, responses: dict[str, Column] | None = None, **options) -> DataFrame:
    """The sums with one category's evaluation level set to a reference."""
    return ksum(train, bw, points.assign(**{name: level}), responses, **options)


def _factor_column(bw: Bandwidth, i: int, operator: str, divide: bool) -> Column:
    v, k, h = bw.variables[i], bw.kernel, bw.h[i]
    x, X = F.col(f"e{i}"), F.col(f"v{i}")
    if v.kind == CONTINUOUS:
        if k.bounds.get(v.name) or k.continuous == "beta":
            raise ValueError("bounded kernels need the blocks engine")
        out = kernels.CONTINUOUS_COLUMN[operator]((x - X) / h, k.continuous, k.order)
        if divide and operator != "integral":
            out = out / (h * h if operator == "derivative" else h)
        return out
    if operator != "normal":
        raise ValueError("categories need the blocks engine for this operator")
    return kernels.unordered_column(x == X, h, k.unordered, len(v.levels)) if v.kind == UNORDERED else kernels.ordered_column(x, X, h, k.ordered)


def _native(rows: DataFrame, bw: Bandwidth, points: DataFrame, names: list[str], operators: dict[str, str], power: int, divide: bool, compress: bool) -> DataFrame:
    if bw.kind != "fixed":
        raise ValueError("nearest neighbours need the blocks engine")
    grid = encoded(points, bw, at=F.col("at").cast("long"))
    grid = grid.select("at", *(F.col(f"v{i}").alias(f"e{i}") for i in range(len(bw.variables))))
    if (n := grid.count()) > 10_000:
        raise TooManyPairs(f"{n} points; the native engine takes 10,000")
    if compress:
        rows = compressed(rows, [f"v{i}" for i in range(len(bw.variables))], names)
    k = None
    for i, v in enumerate(bw.variables):
        f = _factor_column(bw, i, operators.get(v.name, "normal"), divide)
        k = f if k is None else k * f
    pairs = rows.crossJoin(F.broadcast(grid))
    if power > 1:
        k = F.pow(k, F.lit(float(power)))
    return pairs.withColumn("k", k).groupBy("at", *(F.col(f"e{i}").alias(v.name) for i, v in enumerate(bw.variables))).agg(*(F.sum(F.col("k") * F.col(n)).alias(n) for n in names))


def bucket_ksum(train: DataFrame, bw: Bandwidth, points: DataFrame, responses: dict[str, Column], key: str = "at") -> DataFrame:
    """Sums of a compact kernel of one continuous variable by an equi-join on buckets; points may be as many as train."""
    v, h, k = bw.variables[0], bw.h[0], bw.kernel
    if len(bw.variables) != 1 or v.kind != CONTINUOUS or k.continuous not in ("epanechnikov", "uniform") or bw.kind != "fixed" or k.bounds:
        raise ValueError("buckets need one continuous variable, a compact kernel and a fixed bandwidth")
    width = h * (kernels.ROOT5 if k.continuous == "epanechnikov" else 1.0)
    rows = compressed(encoded(train, bw, **{n: c.cast("double") for n, c in responses.items()}), ["v0"], list(responses))
    rows = rows.withColumn("bucket", F.floor(F.col("v0") / width))
    grid = points.select(F.col(key).alias("at"), v.encode().alias("e0")).na.drop()
    if k.continuous == "epanechnikov" and k.order == 2:
        sums = _moments(rows, grid, h, width, list(responses))
        if sums is not None:
            return sums.select("at", F.col("e0").alias(v.name), *responses)
    near = grid.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("e0") / width) - 1, F.floor(F.col("e0") / width) + 1)))
    z = (F.col("e0") - F.col("v0")) / h
    inside = z * z < 5 if k.continuous == "epanechnikov" else F.abs(z) < 1
    value = kernels.pdf_column(z, k.continuous, k.order) / h
    sums = near.join(rows, "bucket").where(inside).groupBy("at").agg(*(F.sum(value * F.col(n)).alias(n) for n in responses))
    return grid.join(sums, "at", "left").select("at", F.col("e0").alias(v.name), *(F.coalesce(n, F.lit(0.0)).alias(n) for n in responses))


def _moments(rows: DataFrame, grid: DataFrame, h: float, width: float, names: list[str]) -> DataFrame | None:
    """Sums of the parabola at at and e0 without pairs: cells that lie wholly within reach add their moments, the two at its ends
    those of their rows on the near side, sorted once. None where there are too many cells for the driver."""
    least, most = rows.agg(F.min("v0"), F.max("v0")).first()
    if least is None:
        return None
    reach = max(1, math.ceil(256 * width / max(most - least, width)))  # cells in the kernel's width
    size = width / reach
    cell, place = lambda x: F.floor(F.col(x) / size), lambda x: F.col(x) / size - F.floor(F.col(x) / size)
    rows = rows.select(cell("v0").alias("cell"), place("v0").alias("u"), *names)
    sums = rows.groupBy("cell").agg(*(F.sum(F.col(n) * (F.lit(1.0) if m == 0 else F.pow("u", F.lit(float(m))))).alias(f"m{m}_{n}") for m in range(3) for n in names)).limit(100_001).toPandas()
    if len(sums) > 100_000:
        return None
    r, ratio = len(names), (size / h) ** 2 / 5
    whole = dict(zip(sums["cell"].tolist(), sums[[f"m{m}_{n}" for m in range(3) for n in names]].to_numpy().reshape(-1, 3, r), strict=True))
    top = float(kernels.pdf(np.zeros(1), "epanechnikov")[0]) / h

    def value(at: np.ndarray, m: np.ndarray) -> np.ndarray:
        """From places relative to a cell and its moments, or some for each."""
        at = at[:, None]
        return top * (m[..., 0, :] - ratio * (at * at * m[..., 0, :] - 2 * at * m[..., 1, :] + m[..., 2, :]))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        c = int(key[0])
        points = part[part["side"] == 0]
        o = points["u"].to_numpy()
        total = np.zeros((len(o), r))
        if len(o):
            for d in range(1 - reach, reach):
                if c - d in whole:
                    total += value(o + d, whole[c - d])
            for side, d in ((1, reach), (2, -reach)):
                edge = part[part["side"] == side].sort_values("u")
                u, R = edge["u"].to_numpy(), edge[names].to_numpy(float)
                m = np.concatenate([np.zeros((1, 3, r)), np.cumsum(np.stack([R, R * u[:, None], R * (u * u)[:, None]], 1), 0)])
                below = m[np.searchsorted(u, o)]
                total += value(o + d, m[-1] - below if side == 1 else below)
        return pd.DataFrame({"at": points["at"], "e0": points["e0"]} | {n: total[:, j] for j, n in enumerate(names)})

    nothing = [F.lit(None).cast("double").alias(n) for n in ("at", "e0")]
    both = grid.select(cell("e0").alias("cell"), F.lit(0).alias("side"), place("e0").alias("u"), F.col("at").cast("double").alias("at"), F.col("e0").cast("double").alias("e0"), *(F.lit(0.0).alias(n) for n in names))
    for side, d in ((1, reach), (2, -reach)):
        both = both.unionAll(rows.select((F.col("cell") + d).alias("cell"), F.lit(side).alias("side"), "u", *nothing, *names))
    out = both.groupBy("cell").applyInPandas(run, ", ".join(f"`{n}` double" for n in ("at", "e0", *names)))
    return out.withColumn("at", F.col("at").cast(grid.schema["at"].dataType))


Tile = Callable[[np.ndarray, np.ndarray, "Points", list[np.ndarray]], np.ndarray]


def map_points(points: DataFrame, train: Points, bw: Bandwidth, run: Tile, outputs: list[str], carry: dict[str, Column] | None = None, *, operators: dict[str, str] | None = None, divide: bool = True, power: int = 1, leave_one_out: bool = False) -> DataFrame:
    """For each evaluation row, outputs from its kernel values over all training rows, which go to all tasks.

    run(K, carried, train, x) gets a tile of evaluation rows by training rows and gives a row of
    outputs for each. carry: columns of points, as doubles, that it needs and that are returned.
    leave_one_out: points are the training rows, and carry has row, each one's number in train; its
    own kernel value is 0.
    """
    carry = carry or {}
    operators = operators or {}
    rows = encoded(points, bw, **{k: c.cast("double") for k, c in carry.items()})
    if points.sparkSession is not None and train.n > MOST_POINTS:
        raise TooManyPairs(f"{train.n} training rows")
    sorted_values = [np.sort(c) if v.kind == CONTINUOUS and bw.kind != "fixed" else None for c, v in zip(train.columns, bw.variables, strict=True)]
    step, d = max(1, TILE // max(1, train.n)), len(bw.variables)
    names = [v.name for v in bw.variables]
    carried_names = list(carry)
    row_at = carried_names.index("row") if leave_one_out else -1

    def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            for k in range(0, batch.num_rows, step):
                part = [c[k : k + step] for c in columns]
                x, carried = part[:d], np.stack(part[d:], 1) if carried_names else np.zeros((len(part[0]), 0))
                h = lengths(bw, x, train.columns, sorted_values, leave_one_out)
                K = product(bw, x, train.columns, h, operators, divide)
                if power > 1:
                    K = K**power
                if leave_one_out:
                    K = K.copy()
                    K[np.arange(len(K)), carried[:, row_at].astype(np.int64)] = 0.0
                out = run(K, carried, train, x)
                yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(c)) for c in part), *(pa.array(np.ascontiguousarray(out[:, j])) for j in range(len(outputs)))], names=[*names, *carried_names, *outputs])

    # one part for each core at least: the work is in the pairs, not in the bytes of the rows
    rows = rows.repartition(max(points.sparkSession.sparkContext.defaultParallelism, 1))
    return rows.mapInArrow(tiles, ", ".join(f"`{c}` double" for c in [*names, *carry, *outputs]))


def _leave_one_out(train: DataFrame, bw: Bandwidth, responses: dict[str, Column], operators: dict[str, str], power: int, divide: bool, engine: str) -> DataFrame:
    """Sums at each training row without its own term, with the responses under the names own_*.

    Up to MOST_POINTS rows go to all tasks. Beyond, or with the engine buckets, a compact kernel of one
    variable joins buckets; any other is summed at the distinct values of the variables, so many at a
    time, and the own term, the kernel at no distance, is taken off.
    """
    names = list(responses)
    rows = encoded(train, bw, **{n: c.cast("double") for n, c in responses.items()})
    small = engine != "buckets" and rows.limit(MOST_POINTS + 1).count() <= MOST_POINTS
    if small or bw.kind != "fixed":
        table, points = numbered(train, bw, responses)
        R = np.stack([points.extra[n] for n in names], 1)
        return map_points(table, points, bw, lambda K, c, t, x: K @ R, names, {"row": F.col("row")} | {f"own_{n}": F.col(n) for n in names}, operators=operators, divide=divide, power=power, leave_one_out=True)
    keys = [f"v{i}" for i in range(len(bw.variables))]
    plain = bw.kernel.continuous in ("epanechnikov", "uniform") and len(keys) == 1 and bw.continuous == [0] and not bw.kernel.bounds and not operators and power == 1
    if plain:
        decoded = rows.withColumnRenamed("v0", bw.names[0])
        points = decoded.groupBy(bw.names[0]).agg(F.count("*").alias("at")).withColumn("at", F.col(bw.names[0]))
        sums = bucket_ksum(decoded, bw, points, {n: F.col(n) for n in names}).drop("at")
        scale = 1.0 if divide else bw.h[0]
        sums = sums.select(F.col(bw.names[0]).alias("v0"), *((F.col(n) * scale).alias(n) for n in names), F.lit(float(kernels.pdf(np.zeros(1), bw.kernel.continuous, bw.kernel.order)[0]) * scale / bw.h[0]).alias("k0"))
    else:
        sums = sums_at(rows, bw, names, rows.select(*keys), operators, power, divide)
        carried = rows.select(*keys, *(F.col(n).alias(f"own_{n}") for n in names))
        return carried.join(sums, keys).select(*(F.col(k).alias(n) for k, n in zip(keys, bw.names, strict=True)), *(f"own_{n}" for n in names), *((F.col(n) + F.col("k0") * (F.col(f"same_{n}") - F.col(f"own_{n}"))).alias(n) for n in names))
    carried = rows.select(*keys, *(F.col(n).alias(f"own_{n}") for n in names))
    return carried.join(sums, keys).select(*(F.col(k).alias(n) for k, n in zip(keys, bw.names, strict=True)), *(f"own_{n}" for n in names), *((F.col(n) - F.col("k0") * F.col(f"own_{n}")).alias(n) for n in names))


def many(train: DataFrame, bw: Bandwidth, **extra: Column) -> bool:
    """Whether there are more complete rows than may go to all tasks."""
    return encoded(train, bw, **extra).limit(MOST_POINTS + 1).count() > MOST_POINTS


def sums_at(rows: DataFrame, bw: Bandwidth, names: list[str], at: DataFrame, operators: dict[str, str] | None = None, power: int = 1, divide: bool = True) -> DataFrame:
    """Sums at the distinct values of at, of encoded rows of any number: the variables v0, v1, ..., for each response n the sum n over
    rows that differ from the value, same_n of those that do not, and k0, the kernel of no distance.

    A Gaussian kernel of one variable is interpolated; where that could lose digits, as at lone values,
    and for other kernels, each part of the values is one pass over the rows.
    """
    if bw.kind != "fixed":
        raise TooManyPairs("nearest neighbours take as many rows as may go to all tasks")
    operators = operators or {}
    keys = [f"v{i}" for i in range(len(bw.variables))]
    same = rows.groupBy(*keys).agg(*(F.sum(n).alias(f"same_{n}") for n in names))
    values = at.select(*keys).distinct()
    out, rest = None, values
    if smooth(bw):
        cells, distinct = rows.select(F.countDistinct(F.floor(F.col("v0") / bw.h[0])), F.approx_count_distinct("v0")).first()
        if NODES * cells < distinct:
            out = _interpolated(rows, bw, names, values, operators.get(bw.names[0], "normal"), power, divide, same)
            rest = out.where("__exact").select(*keys)
            out = out.where("NOT __exact").drop("__exact")
    parts = -(-rest.count() // max(1, MOST_POINTS // 2))
    table = rows.select(*(_decoded(v, k) for v, k in zip(bw.variables, keys, strict=True)), *names)
    for k in range(parts):
        here = rest.where(F.pmod(F.xxhash64(*keys), F.lit(parts)) == k).toPandas()
        if here.empty:
            continue
        X = [here[c].to_numpy(float) for c in keys]
        own = np.concatenate([_own(bw, [c[i : i + 1000] for c in X], operators, divide, power) for i in range(0, len(here), 1000)])
        frame = pd.DataFrame({v.name: _decode(v, c) for v, c in zip(bw.variables, X, strict=True)} | {"at": np.arange(len(here))})
        got = ksum(table, bw, frame, {n: F.col(n) for n in names}, operators=operators, power=power, divide=divide, apart=True)
        extra = rows.sparkSession.createDataFrame(pd.DataFrame(dict(zip(keys, X, strict=True)) | {"at": np.arange(len(here)), "k0": own}))
        got = got.select("at", *names).join(extra, "at").join(same, keys, "left").select(*keys, *names, *(F.coalesce(f"same_{n}", F.lit(0.0)).alias(f"same_{n}") for n in names), "k0")
        out = got if out is None else out.unionAll(got)
    return out if out is not None else values.select(*keys, *(F.lit(0.0).alias(n) for n in (*names, *(f"same_{n}" for n in names), "k0")))


def _interpolated(rows: DataFrame, bw: Bandwidth, names: list[str], values: DataFrame, operator: str, power: int, divide: bool, same: DataFrame) -> DataFrame:
    """The columns of sums_at, and __exact where the kernel's sum is so small beside the greatest about it that digits are lost."""
    h, m = bw.h[0], len(names) + 1
    columns = [f"w{i}" for i in range(NODES * m)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v, *R = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                line = Line(np.unique(Line.cell(v, h)), h)
                w = line.spread(v, np.stack([np.ones(len(v)), *R], 1)).reshape(len(line.cells), -1)
                yield pa.RecordBatch.from_arrays([pa.array(line.cells), *map(pa.array, np.ascontiguousarray(w.T))], names=["cell", *columns])

    got = rows.select("v0", *names).mapInArrow(spread, ", ".join(["cell long", *(f"{c} double" for c in columns)])).groupBy("cell").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().sort_values("cell")
    # values of no training row have cells of their own
    cells, w = got["cell"].to_numpy(), got[columns].to_numpy().reshape(-1, NODES, m)
    asked = values.select(F.floor(F.col("v0") / h).alias("cell")).distinct().toPandas()["cell"].to_numpy(np.int64)
    line = Line(np.union1d(cells, asked), h)
    weights = np.zeros((len(line.cells), NODES, m))
    weights[np.searchsorted(line.cells, cells)] = w
    f = line.apply(on_line(bw, operator, divide, power), weights)
    greatest = np.abs(f[:, :, 0]).max(1)
    k0 = float(on_line(bw, operator, divide, power)(np.zeros(1))[0])
    table = values.join(same, "v0", "left").join(rows.groupBy("v0").agg(F.count("*").cast("double").alias("__n")), "v0", "left").na.fill(0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, *own, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            sums = line.at(v, f)
            rest = sums[:, 0] - k0 * np.maximum(n - 1, 0)
            exact = np.abs(sums[:, 0] - k0 * n) < 1e-6 * greatest[np.searchsorted(line.cells, Line.cell(v, h))]
            exact &= (n < 2) | (np.abs(rest) < 1e-6 * k0)  # equal rows stand for themselves
            yield pa.RecordBatch.from_arrays([pa.array(v), *(pa.array(sums[:, 1 + j] - k0 * o) for j, o in enumerate(own)), *map(pa.array, own), pa.array(np.full(len(v), k0)), pa.array(exact)], names=["v0", *names, *(f"same_{x}" for x in names), "k0", "__exact"])

    return table.select("v0", *(f"same_{x}" for x in names), "__n").mapInArrow(run, ", ".join([f"`{c}` double" for c in ("v0", *names, *(f"same_{x}" for x in names), "k0")] + ["__exact boolean"]))


def _decoded(v, key: str) -> Column:
    """The variable under its own name from its code."""
    if v.kind == CONTINUOUS or v.numeric_levels:
        return F.col(key).alias(v.name)
    return F.element_at(F.array(*(F.lit(str(x)) for x in v.levels)), F.col(key).cast("int")).alias(v.name)


def _own(bw: Bandwidth, x: list[np.ndarray], operators: dict[str, str], divide: bool, power: int) -> np.ndarray:
    """The kernel of each row with itself."""
    out = np.ones(len(x[0]))
    for i, v in enumerate(bw.variables):
        f = factor(bw, i, x[i][:, None], x[i][:, None], bw.h[i], operators.get(v.name, "normal"), divide)
        out = out * np.broadcast_to(f, (len(x[0]), 1))[:, 0]
    return out**power


def numbered(train: DataFrame, bw: Bandwidth, extra: dict[str, Column]) -> tuple[DataFrame, Points]:
    """The complete rows of train, with their variables under their own names, more columns and a row number, and the same on the driver."""
    got = collect(train, bw, **{k: c.cast("double") for k, c in extra.items()})
    frame = pd.DataFrame({v.name: _decode(v, got.columns[i]) for i, v in enumerate(bw.variables)} | {k: v for k, v in got.extra.items()} | {"row": np.arange(got.n, dtype=float)})
    return train.sparkSession.createDataFrame(frame) if got.n else train.sparkSession.createDataFrame(frame.astype(object), ", ".join(f"`{c}` double" for c in frame)), got


def _decode(v, codes: np.ndarray) -> np.ndarray:
    if v.kind == CONTINUOUS or v.numeric_levels:
        return codes
    return np.array([str(x) for x in v.levels], object)[codes.astype(int) - 1]
