"""Regression: local constant, linear and polynomial, with gradients, operators and location-scale quantiles."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.special import qnorm
from ..plans.ksum import Points, collect, encoded, ksum, many, map_points, sums_at
from ..plans.spec import CONTINUOUS, Bandwidth, Kernel
from . import polynomials, search

REGRESSION_KERNEL = Kernel()


def degrees(bw: Bandwidth, regtype: str = "lc", degree: tuple[int, ...] = ()) -> tuple[int, ...]:
    """lc is degree 0 and ll degree 1 in each continuous variable; lp takes degrees."""
    n = len(bw.continuous)
    if regtype == "lp":
        if len(degree) != n:
            raise ValueError("a degree for each continuous variable is needed")
        return tuple(degree)
    return ({"lc": 0, "ll": 1}[regtype],) * n


def npregbw(data: DataFrame, y: str | Column, x: list, method: str = "cv.ls", regtype: str = "lc", degree: tuple[int, ...] = (), basis: str = "glp", kernel: Kernel = REGRESSION_KERNEL, kind: str = "fixed", rounds: int = 16) -> Bandwidth:
    """cv.ls or cv.aic."""
    vs = search.variables(data, x)
    d = degrees(Bandwidth(tuple(vs), tuple(1.0 if v.kind == CONTINUOUS else 0.0 for v in vs)), regtype, degree)
    loss = search.regression({"cv.ls": "ls", "cv.aic": "aic"}[method], d, basis)
    return search.select(data, vs, loss, kernel, kind, {"y": F.col(y) if isinstance(y, str) else y}, search.aic_corrected if method == "cv.aic" else (lambda s, n: s[0] / n), method, rounds)


def degree_search(data: DataFrame, y: str, x: list, most: int = 3, method: str = "cv.ls", basis: str = "glp", kernel: Kernel = REGRESSION_KERNEL, exhaustive: bool = True, rounds: int = 8) -> tuple[tuple[int, ...], Bandwidth]:
    """The degrees up to most, and their bandwidth, with the best objective: over all, or by changing one variable's degree at a time."""
    n = sum(v.kind == CONTINUOUS for v in search.variables(data, x))
    found: dict[tuple[int, ...], Bandwidth] = {}

    def value(d: tuple[int, ...]) -> float:
        if d not in found:
            found[d] = npregbw(data, y, x, method, "lp", d, basis, kernel, rounds=rounds)
        return found[d].value

    if exhaustive:
        best = min(np.ndindex(*(most + 1,) * n), key=value)
    else:
        best, last = (0,) * n, None
        while best != last:
            last = best
            for i in range(n):
                best = min(((*best[:i], e, *best[i + 1 :]) for e in range(most + 1)), key=value)
    return tuple(best), found[tuple(best)]


def npreg(data: DataFrame, bw: Bandwidth, y: str | Column, points: pd.DataFrame | DataFrame, regtype: str = "lc", degree: tuple[int, ...] = (), basis: str = "glp", engine: str = "blocks") -> DataFrame:
    """at, the variables, mean, merr, the asymptotic standard error, and grad_* of continuous variables, at evaluation rows.

    The data may be of any size: their kernel moments are added up within tasks. The local-constant fit
    is a ratio of two sums; others solve the moments' small system at each point.
    """
    d = degrees(bw, regtype, degree)
    y = F.col(y) if isinstance(y, str) else y
    data = data.withColumn("__y", y.cast("double")).na.drop(subset=[*bw.names, "__y"])
    q = len(bw.continuous)
    rough = kernels.roughness(bw.kernel.continuous, bw.kernel.order) ** q if bw.kernel.continuous != "beta" else math.nan
    if not any(d):
        out = ksum(data, bw, points, {"s0": F.lit(1.0), "s1": F.col("__y"), "s2": F.col("__y") * F.col("__y")}, divide=False, engine=engine)
        mean = F.col("s1") / F.col("s0")
        variance = F.greatest(F.col("s2") / F.col("s0") - mean * mean, F.lit(0.0))
        return out.withColumn("mean", mean).withColumn("merr", F.sqrt(variance * rough / F.col("s0"))).drop("s0", "s1", "s2")
    c = [bw.variables[i].name for i in bw.continuous]
    centre = data.agg(*(F.avg(n).alias(f"m{i}") for i, n in enumerate(c)), *(F.stddev_samp(n).alias(f"s{i}") for i, n in enumerate(c))).first()
    move, scale = [centre[f"m{i}"] for i in range(len(c))], [centre[f"s{i}"] or 1.0 for i in range(len(c))]
    at, p = bw.continuous, len(polynomials.terms(d, basis))
    upper = np.triu_indices(p)

    def moments(X: list[np.ndarray], R: np.ndarray) -> np.ndarray:
        B = polynomials.powers([(X[k] - m) / s for k, m, s in zip(at, move, scale, strict=True)], d, basis)
        return np.concatenate([B[:, upper[0]] * B[:, upper[1]] * R[:, :1], B * R[:, 1:2], R[:, 2:3]], 1)

    names = [*(f"a{i}_{j}" for i, j in zip(*upper, strict=True)), *(f"b{i}" for i in range(p)), "s2"]
    base = {"n": F.lit(1.0), "y": F.col("__y"), "yy": F.col("__y") * F.col("__y")}
    sums = ksum(data, bw, points, base, divide=False, engine=engine, expand=moments, outputs=names)
    cs = [sums.columns.index(n) for n in c]
    outputs = ["mean", "merr", *(f"grad_{n}" for n in c)]

    def solve(batches):
        for batch in batches:
            get = lambda n: batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            m = batch.num_rows
            M, v = np.empty((m, p, p)), np.empty((m, p))
            for i in range(p):
                v[:, i] = get(f"b{i}")
                for j in range(i, p):
                    M[:, i, j] = M[:, j, i] = get(f"a{i}_{j}")
            beta = polynomials.solve(M, v[:, :, None])[:, :, 0] if m else v
            x = [(batch.column(k).to_numpy(zero_copy_only=False).astype(float) - move[i]) / scale[i] for i, k in enumerate(cs)]
            mean = (polynomials.powers(x, d, basis) * beta).sum(1)
            with np.errstate(all="ignore"):
                around = get("s2") - 2 * (beta * v).sum(1) + np.einsum("mi,mij,mj->m", beta, M, beta)
                err = np.sqrt(np.maximum(around / M[:, 0, 0], 0) * rough / M[:, 0, 0])
            grads = [(polynomials.powers(x, d, basis, tuple(int(i == k) for i in range(len(c)))) * beta).sum(1) / scale[k] for k in range(len(c))]
            keep = [k for k, n in enumerate(batch.schema.names) if n not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(mean), pa.array(err), *map(pa.array, grads)], names=[*(batch.schema.names[k] for k in keep), *outputs])

    kept = sums.drop(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"`{n}` double" for n in outputs])
    return sums.mapInArrow(solve, schema)


def lc_gradients(data: DataFrame, bw: Bandwidth, y: str, points: pd.DataFrame | DataFrame) -> DataFrame:
    """at and the derivatives of the local-constant fit by each continuous variable, all from sums at the same points."""
    data = data.na.drop(subset=[*bw.names, y])
    r = {"s0": F.lit(1.0), "s1": F.col(y).cast("double")}
    if isinstance(points, pd.DataFrame):
        points = data.sparkSession.createDataFrame(points.assign(at=np.arange(len(points))) if "at" not in points else points)
    out = ksum(data, bw, points, r, permute="derivative")
    for i in bw.continuous:
        name = bw.variables[i].name
        d0, d1 = F.col(f"{name}_s0"), F.col(f"{name}_s1")
        out = out.withColumn(f"grad_{name}", (d1 * F.col("s0") - F.col("s1") * d0) / (F.col("s0") * F.col("s0"))).drop(f"{name}_s0", f"{name}_s1")
    return out.withColumn("mean", F.col("s1") / F.col("s0")).drop("s0", "s1")


def fitted(data: DataFrame, bw: Bandwidth, y: str | Column, regtype: str = "lc", degree: tuple[int, ...] = (), basis: str = "glp", leave_one_out: bool = False, carry: dict[str, Column] | None = None) -> DataFrame:
    """The complete training rows with y, mean and resid, and carried columns. Beyond the rows that may go to all tasks, local-constant fits are sums at distinct values; others are refused."""
    d = degrees(bw, regtype, degree)
    y = (F.col(y) if isinstance(y, str) else y).cast("double")
    rows = data.withColumn("__y", y).na.drop(subset=[*bw.names, "__y"])
    if not any(d) and bw.kind == "fixed" and many(rows, bw):
        return _fitted_whole(rows, bw, leave_one_out, carry or {})
    train = collect(rows, bw, y=F.col("__y"))

    def run(K, carried, t, x):
        if leave_one_out:
            own = np.stack(x, 1)
            for i in range(len(K)):  # the first row equal in all variables and the response stands for the own one
                same = np.flatnonzero((t.extra["y"] == carried[i, 0]) & np.all([c == v for c, v in zip(t.columns, own[i], strict=True)], 0))
                K[i, same[0]] = 0.0
        return polynomials.fit_rows(K, t, bw, t.extra["y"], x, d, basis)[0][:, None]

    out = map_points(rows, train, bw, (lambda K, c, t, x: run(K.copy(), c, t, x)) if leave_one_out else run, ["mean"], {"y": F.col("__y")} | (carry or {}), divide=False)
    return out.withColumn("resid", F.col("y") - F.col("mean"))


def _fitted_whole(rows: DataFrame, bw: Bandwidth, leave_one_out: bool, carry: dict[str, Column]) -> DataFrame:
    rows = encoded(rows, bw, **({"y": F.col("__y"), "__n": F.lit(1.0)} | {k: c.cast("double") for k, c in carry.items()}))
    keys = [f"v{i}" for i in range(len(bw.variables))]
    sums = sums_at(rows, bw, ["__n", "y"], rows, divide=False).withColumnsRenamed({"__n": "s0", "y": "s1"})
    s0, s1 = (F.col(s) + F.col("k0") * (F.col(f"same_{n}") - (F.col(n) if leave_one_out else 0.0)) for s, n in (("s0", "__n"), ("s1", "y")))
    out = rows.join(sums, keys).withColumn("mean", s1 / F.when(s0 != 0, s0))
    return out.select(*(F.col(k).alias(n) for k, n in zip(keys, bw.names, strict=True)), "y", *carry, "mean", (F.col("y") - F.col("mean")).alias("resid"))


def npreghat(data: DataFrame, bw: Bandwidth, points: DataFrame, key: str = "at", row: str = "row", regtype: str = "lc", degree: tuple[int, ...] = (), basis: str = "glp", by: tuple[int, ...] = ()) -> DataFrame:
    """The operator as a long table: at, row, weight. Weights times responses add up to the fit, or to its derivative."""
    d = degrees(bw, regtype, degree)
    train = collect(data, bw, row=F.col(row).cast("double"))
    got = map_points(points, train, bw, lambda K, c, t, x: polynomials.hat_rows(K, t, bw, x, d, basis, by), [f"w{j}" for j in range(train.n)], {"at": F.col(key)}, divide=False)
    pairs = F.arrays_zip(F.array(*(F.lit(float(r)) for r in train.extra["row"])).alias("row"), F.array(*(F.col(f"w{j}") for j in range(train.n))).alias("weight"))
    return got.select("at", F.explode(pairs).alias("x")).select(F.col("at").cast("long").alias("at"), F.col("x.row").cast("long").alias("row"), F.col("x.weight").alias("weight"))


def hat_apply(hat: DataFrame, responses: DataFrame, row: str = "row", y: str = "y") -> DataFrame:
    """at and the operator times y."""
    return hat.join(responses.select(F.col(row).cast("long").alias("row"), F.col(y).alias("__y")), "row").groupBy("at").agg(F.sum(F.col("weight") * F.col("__y")).alias("hy"))


@dataclass(frozen=True)
class LocationScale:
    """A bandwidth, the quantile index delta that goes with a probability, and the scale's bandwidth."""

    bw: Bandwidth
    delta: float
    tau: float


def scale_pilot(data: DataFrame, bw: Bandwidth, y: str) -> tuple[Points, np.ndarray]:
    """Training rows and the scale at each: the root of the smoothed squared residuals of a mean fit, not below a hundredth of its mean."""
    rows = data.na.drop(subset=[*bw.names, y])
    train = collect(rows, bw, y=F.col(y).cast("double"))
    step = max(1, (1 << 21) // max(train.n, 1))
    from ..plans.ksum import lengths, product

    def smooth(v: np.ndarray) -> np.ndarray:
        out = np.empty(train.n)
        for a in range(0, train.n, step):
            x = train[slice(a, a + step)]
            K = product(bw, x, train.columns, lengths(bw, x, train.columns, [np.sort(c) for c in train.columns], True), {}, False)
            out[a : a + step] = K @ v / K.sum(1)
        return out

    variance = smooth((train.extra["y"] - smooth(train.extra["y"])) ** 2)
    return train, np.sqrt(np.maximum(variance, 1e-4 * variance.mean()))


def nplsqregbw(data: DataFrame, y: str, x: list, tau: float = 0.5, kernel: Kernel = REGRESSION_KERNEL, rounds: int = 10) -> LocationScale:
    """Bandwidth and delta that minimise the leave-one-out check loss of the fit of y + scale * qnorm(delta)."""
    pilot = search.normal_reference(data, x, kernel)
    train, scale = scale_pilot(data, pilot, y)
    vs = list(pilot.variables)
    starts, lower, upper, log, whole = search.limits(data.na.drop(subset=[*pilot.names, y]), vs, kernel, "fixed", train.n)
    original = train.extra["y"]

    def batch(points: list[tuple[float, ...]]) -> list[float]:
        out = []
        by_delta: dict[float, list[tuple[float, ...]]] = {}
        for p in points:
            by_delta.setdefault(p[-1], []).append(p)
        found = {}
        for delta, group in by_delta.items():
            here = Points(train.columns, {"y": original + scale * qnorm(delta), "target": original}, train.n)
            for p, v in zip(group, search.evaluate(data, [replace(pilot, h=p[:-1]) for p in group], search.regression(str(tau)), finish=lambda s, n: s[0] / n, points=here), strict=True):
                found[p] = v
        out = [found[p] for p in points]
        return out

    h, _, _ = search.minimise(batch, [(*s, 0.5) for s in starts], (*lower, 1e-4), (*upper, 1 - 1e-4), (*log, False), (*whole, False), rounds)
    return LocationScale(replace(pilot, h=h[:-1]), h[-1], tau)


def nplsqreg(data: DataFrame, model: LocationScale, y: str, points: pd.DataFrame | DataFrame) -> DataFrame:
    """at, the variables and the quantile at evaluation rows; fits of different probabilities may cross."""
    pilot = search.normal_reference(data, list(model.bw.variables), model.bw.kernel)
    train, scale = scale_pilot(data, pilot, y)
    frame = pd.DataFrame({f"v{i}": c for i, c in enumerate(train.columns)} | {"shifted": train.extra["y"] + scale * qnorm(model.delta)})
    coded = data.sparkSession.createDataFrame(frame)
    plain = replace(model.bw, variables=tuple(replace(v, name=f"v{i}", levels=tuple(v.codes()) if v.levels else ()) for i, v in enumerate(model.bw.variables)))
    if isinstance(points, DataFrame):
        points = points.toPandas()
    asked = pd.DataFrame({f"v{i}": points[v.name] if v.kind == CONTINUOUS else [v.codes()[list(v.levels).index(x)] for x in points[v.name]] for i, v in enumerate(model.bw.variables)})
    return npreg(coded, plain, "shifted", asked).select("at", *(F.col(f"v{i}").alias(v.name) for i, v in enumerate(model.bw.variables)), F.col("mean").alias("quantile"))
