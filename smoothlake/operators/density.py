"""Density and distribution estimates, their bandwidths, operators and quantiles."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..plans.ksum import collect, ksum, map_points
from ..plans.spec import CONTINUOUS, UNORDERED, Bandwidth, Kernel
from . import search

DENSITY_KERNEL = Kernel(ordered="ngeometric")  # ordered weights that add up to one


def npudensbw(data: DataFrame, names: list, method: str = "cv.ml", kernel: Kernel = DENSITY_KERNEL, kind: str = "fixed", rounds: int = 16) -> Bandwidth:
    """cv.ml, cv.ls or normal-reference."""
    if method == "normal-reference":
        return search.normal_reference(data, names, kernel)
    return search.select(data, names, {"cv.ml": search.density_ml, "cv.ls": search.density_ls}[method], kernel, kind, method=method, rounds=rounds)


def npudistbw(data: DataFrame, names: list, method: str = "cv.cdf", kernel: Kernel = DENSITY_KERNEL, kind: str = "fixed", rounds: int = 16) -> Bandwidth:
    """cv.cdf on the sample's own grid, or normal-reference. Unordered variables have no distribution."""
    if method == "normal-reference":
        return search.normal_reference(data, names, kernel, True)
    return search.select(data, names, search.distribution_cdf, kernel, kind, method=method, rounds=rounds)


def range_bounds(data: DataFrame, names: list[str], kernel: Kernel) -> Kernel:
    """The kernel with the ranges of the data as bounds; those of beta kernels reach half a step beyond the outermost values."""
    out = {}
    for n in names:
        c = F.col(n).cast("double")
        low, high = data.agg(F.min(c), F.max(c)).first()
        if kernel.continuous == "beta":
            second, last = data.agg(F.min(F.when(c > low, c)), F.max(F.when(c < high, c))).first()
            if second is None:
                raise ValueError(f"{n} has fewer than two values")
            low, high = low - (second - low) / 2, high + (high - last) / 2
        out[n] = (low, high)
    return replace(kernel, bounds=kernel.bounds | out)


def _count(data: DataFrame, bw: Bandwidth) -> int:
    return data.na.drop(subset=bw.names).count()


def npudens(data: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, engine: str = "blocks") -> DataFrame:
    """at, the variables, dens and derr, its asymptotic standard error, at evaluation rows.

    Where all variables are categories without smoothing, the estimate is a share, and so is its error.
    """
    n = _count(data, bw)
    out = ksum(data, bw, points, engine=engine).withColumn("dens", F.col("n") / n)
    if not bw.continuous and not any(bw.h):
        return out.withColumn("derr", F.sqrt(F.col("dens") * (1 - F.col("dens")) / n)).drop("n")
    if bw.kernel.continuous == "beta":
        return out.drop("n")
    volume = math.prod(bw.h[i] for i in bw.continuous) if bw.kind == "fixed" else math.nan
    rough = kernels.roughness(bw.kernel.continuous, bw.kernel.order) ** len(bw.continuous)
    return out.withColumn("derr", F.sqrt(F.greatest(F.col("dens"), F.lit(0.0)) * (rough / (n * volume)))).drop("n")


def log_likelihood(data: DataFrame, bw: Bandwidth) -> float:
    """The sum of log densities at the training rows, which must be few enough to go to all tasks."""
    train = collect(data, bw)
    got = map_points(data, train, bw, lambda K, c, t, x: np.log(np.maximum(K.sum(1, keepdims=True) / t.n, search.TINY)), ["ll"])
    return float(got.agg(F.sum("ll")).first()[0])


def npudist(data: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, engine: str = "blocks") -> DataFrame:
    """at, the variables, dist and derr at evaluation rows."""
    if any(v.kind == UNORDERED for v in bw.variables):
        raise ValueError("unordered variables have no distribution")
    n = _count(data, bw)
    out = ksum(data, bw, points, operators={v.name: "integral" for v in bw.variables}, engine=engine).withColumn("dist", F.col("n") / n)
    p = F.least(F.greatest(F.col("dist"), F.lit(0.0)), F.lit(1.0))
    return out.withColumn("derr", F.sqrt(p * (1 - p) / n)).drop("n")


def hat(data: DataFrame, bw: Bandwidth, points: DataFrame, key: str = "at", row: str = "row", distribution: bool = False) -> DataFrame:
    """The operator as a long table: at, row, weight. Weights times ones add up to the estimate.

    data has the number of each row, points of each evaluation row. As many rows come out as there are
    pairs, so both sides are checked.
    """
    train = collect(data, bw, row=F.col(row).cast("double"))
    operators = {v.name: "integral" for v in bw.variables} if distribution else {}
    got = map_points(points, train, bw, lambda K, c, t, x: K / t.n, [f"w{j}" for j in range(train.n)], {"at": F.col(key)}, operators=operators)
    pairs = F.arrays_zip(F.array(*(F.lit(float(r)) for r in train.extra["row"])).alias("row"), F.array(*(F.col(f"w{j}") for j in range(train.n))).alias("weight"))
    return got.select("at", F.explode(pairs).alias("x")).select(F.col("at").cast("long").alias("at"), F.col("x.row").cast("long").alias("row"), F.col("x.weight").alias("weight"))


def hat_apply(data: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, y: str, distribution: bool = False) -> DataFrame:
    """at and the operator times y, without the operator."""
    operators = {v.name: "integral" for v in bw.variables} if distribution else None
    n = _count(data.na.drop(subset=[y]), bw)
    return ksum(data, bw, points, {"hy": F.col(y)}, operators=operators).withColumn("hy", F.col("hy") / n)


def npquantile(data: DataFrame, name: str, tau: list[float], bw: Bandwidth | None = None, num_eval: int = 10_000, f: float = 1.0, engine: str = "blocks") -> DataFrame:
    """tau and quantile: the least point of a grid, extended by the share f of the range on both sides, at which the distribution reaches tau."""
    bw = bw or npudistbw(data, [name], "normal-reference")
    c = F.col(name).cast("double")
    low, high, q = data.agg(F.min(c), F.max(c), F.percentile(c, F.array(*map(F.lit, tau)))).first()
    x = np.unique(np.concatenate([np.linspace(low - f * (high - low), high + f * (high - low), num_eval), q]))
    dist = npudist(data, bw, pd.DataFrame({name: x}), engine)
    ends = dist.agg(F.min("dist").alias("least"), F.max("dist").alias("most"))
    asked = data.sparkSession.createDataFrame([(float(t),) for t in tau], "tau double").crossJoin(ends).withColumn("want", F.least(F.greatest("tau", "least"), "most"))
    return asked.join(dist, F.col("dist") >= F.col("want")).groupBy("tau").agg(F.min(name).alias("quantile"))


def grid(data: DataFrame, bw: Bandwidth, neval: int = 50, trim: float = 0.0) -> pd.DataFrame:
    """neval points over the range of each continuous variable and all levels of each category, crossed; trim cuts, or if negative extends, both ends by a share of rows."""
    axes = []
    for v in bw.variables:
        if v.kind == CONTINUOUS:
            c = F.col(v.name).cast("double")
            t = abs(trim)
            low, a, b, high = data.agg(F.min(c), F.percentile(c, t), F.percentile(c, 1 - t), F.max(c)).first()
            ends = (2 * low - a, 2 * high - b) if trim < 0 else (a, b)
            axes.append(np.linspace(*ends, neval))
        else:
            axes.append(np.array(v.levels, object))
    mesh = np.meshgrid(*axes, indexing="ij")
    return pd.DataFrame({v.name: m.ravel() for v, m in zip(bw.variables, mesh, strict=True)}).infer_objects()
