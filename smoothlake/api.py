"""The public surface: estimators by formula, with fit objects that predict.

    fit = npreg("y ~ x + ordered(z)", data)
    fit.predict(points)     # a DataFrame of evaluation rows with the estimate
    fit.bw, fit.summary(), fit.fitted(), fit.residuals(), fit.se(points), fit.gradients(points)

A formula's plus only separates columns. Without a bandwidth, one is searched for. Rows that lack a
column of the model are left out of training; predictions for them are null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import kernels  # noqa: F401
from .operators import boundary, conditional, density, inference, instrumental, metrics, plotdata, polynomials, regression, semiparametric
from .plans import ksum as plans
from .plans.spec import Bandwidth, Formula, Kernel, Variable, formula, ordered, unordered, variables  # noqa: F401


def npseed(seed: int) -> int:
    """Seeds are arguments of the tests; this gives the one to pass."""
    return abs(int(seed))


def names_of(items) -> list[str]:
    return [i if isinstance(i, str) else i.name for i in items]


def _subset(data: DataFrame, subset: str | None) -> DataFrame:
    return data.where(subset) if subset else data


@dataclass
class Fit:
    """A model on its training data. kind: regression, density, distribution, condensity, condistribution or quantile."""

    kind: str
    data: DataFrame
    bw: Bandwidth
    y: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)

    value_name = {"regression": "mean", "density": "dens", "distribution": "dist", "condensity": "condens", "condistribution": "condist"}

    def _estimate(self, points: pd.DataFrame | DataFrame) -> DataFrame:
        if self.kind == "regression":
            return regression.npreg(self.data, self.bw, self.y[0], points, **self.options)
        if self.kind == "density":
            return density.npudens(self.data, self.bw, points)
        if self.kind == "distribution":
            return density.npudist(self.data, self.bw, points)
        if self.kind == "condensity":
            return conditional.npcdens(self.data, self.bw, self.y, points)
        return conditional.npcdist(self.data, self.bw, self.y, points)

    def predict(self, points: pd.DataFrame | DataFrame, row_id: str | None = None) -> DataFrame:
        """The points with the estimate. row_id numbers the rows; without it they are numbered from 0 if they come from pandas."""
        spark = self.data.sparkSession
        if isinstance(points, pd.DataFrame):
            points = spark.createDataFrame(points.assign(at=np.arange(len(points))))
        elif row_id:
            points = points.withColumn("at", F.col(row_id))
        elif "at" not in points.columns:
            raise ValueError("rows of a table need a number: give row_id")
        got = self._estimate(points)
        return points.join(got.drop(*self.bw.names), "at", "left")

    def fitted(self) -> DataFrame:
        """The training rows with the estimate, within the checked number of rows."""
        if self.kind == "regression":
            return regression.fitted(self.data, self.bw, self.y[0], **self.options)
        rows = self.data.na.drop(subset=self.bw.names).select(*self.bw.names)
        frame = rows.limit(plans.MOST_POINTS + 1).toPandas()
        if len(frame) > plans.MOST_POINTS:
            raise plans.TooManyPairs(f"over {plans.MOST_POINTS} rows; predict on a grid")
        return self.predict(frame)

    def residuals(self) -> DataFrame:
        if self.kind != "regression":
            raise TypeError("only regressions have residuals")
        return self.fitted().select(*self.bw.names, "y", "resid")

    def se(self, points: pd.DataFrame | DataFrame) -> DataFrame:
        name = {"regression": "merr", "density": "derr", "distribution": "derr", "condensity": "conderr"}[self.kind]
        return self._estimate(points).select("at", F.col(name).alias("se"))

    def gradients(self, points: pd.DataFrame | DataFrame) -> DataFrame:
        if self.kind != "regression":
            raise TypeError("only regressions have gradients here")
        if any(regression.degrees(self.bw, self.options.get("regtype", "lc"), self.options.get("degree", ()))):
            got = self._estimate(points)
        else:
            got = regression.lc_gradients(self.data, self.bw, self.y[0], points)
        return got.select("at", *(c for c in got.columns if c.startswith("grad_")))

    def goodness_of_fit(self) -> DataFrame:
        return metrics.goodness_of_fit(self.fitted(), "y", "mean")

    def summary(self) -> dict:
        out = {"kind": self.kind, "bandwidths": dict(zip(self.bw.names, self.bw.h, strict=True)), "type": self.bw.kind, "method": self.bw.method, "objective": self.bw.value, "evaluations": self.bw.evaluations, "rows": self.data.na.drop(subset=self.bw.names).count()}
        if self.kind == "regression":
            out |= self.goodness_of_fit().first().asDict()
        if self.kind == "density":
            out["log_likelihood"] = density.log_likelihood(self.data, self.bw)
        return out

    def __repr__(self) -> str:
        return f"{self.kind} of {', '.join(self.y) or ', '.join(self.bw.names)}: " + ", ".join(f"{n} {h:.6g}" for n, h in zip(self.bw.names, self.bw.h, strict=True))


def _right(text: str) -> Formula:
    return formula(text)


def npreg(text: str, data: DataFrame, bw: Bandwidth | None = None, subset: str | None = None, regtype: str = "lc", degree: tuple[int, ...] = (), basis: str = "glp", **search_options) -> Fit:
    f, data = _right(text), _subset(data, subset)
    y = names_of(f.left)[0]
    bw = bw or regression.npregbw(data, y, list(f.right), regtype=regtype, degree=degree, basis=basis, **search_options)
    return Fit("regression", data, bw, [y], {"regtype": regtype, "degree": degree, "basis": basis})


def npudens(text: str, data: DataFrame, bw: Bandwidth | None = None, subset: str | None = None, **search_options) -> Fit:
    f, data = _right(text), _subset(data, subset)
    return Fit("density", data, bw or density.npudensbw(data, list(f.right), **search_options))


def npudist(text: str, data: DataFrame, bw: Bandwidth | None = None, subset: str | None = None, **search_options) -> Fit:
    f, data = _right(text), _subset(data, subset)
    return Fit("distribution", data, bw or density.npudistbw(data, list(f.right), **search_options))


def npcdens(text: str, data: DataFrame, bw: Bandwidth | None = None, subset: str | None = None, **search_options) -> Fit:
    f, data = _right(text), _subset(data, subset)
    return Fit("condensity", data, bw or conditional.npcdensbw(data, list(f.left), list(f.right), **search_options), names_of(f.left))


def npcdist(text: str, data: DataFrame, bw: Bandwidth | None = None, subset: str | None = None, **search_options) -> Fit:
    f, data = _right(text), _subset(data, subset)
    return Fit("condistribution", data, bw or conditional.npcdistbw(data, list(f.left), list(f.right), **search_options), names_of(f.left))


def npconmode(text: str, data: DataFrame, bw: Bandwidth | None = None, points: DataFrame | None = None, **search_options) -> DataFrame:
    f = _right(text)
    y = [i if isinstance(i, Variable) else unordered(i) for i in f.left]
    bw = bw or conditional.npcdensbw(data, y, list(f.right), **search_options)
    return conditional.npconmode(data, bw, y[0].name, points)


def npqreg(text: str, data: DataFrame, tau: list[float], points: DataFrame, bw: Bandwidth | None = None, key: str = "at", **search_options) -> DataFrame:
    f = _right(text)
    bw = bw or conditional.npcdistbw(data, list(f.left), list(f.right), **search_options)
    return conditional.npqreg(data, bw, names_of(f.left)[0], tau, points, key)


def npksum(text: str, data: DataFrame, bw: Bandwidth, points: pd.DataFrame | DataFrame, **options) -> DataFrame:
    """Sums of the left columns, or of ones, weighted by the kernel of the right ones."""
    f = _right(text)
    responses = {n: F.col(n) for n in names_of(f.left)} or None
    return plans.ksum(data, bw, points, responses, **options)


def npplreg(text: str, data: DataFrame, bws: dict[str, Bandwidth] | None = None, **search_options):
    """y ~ x | z."""
    f = _right(text)
    y, x = names_of(f.left)[0], names_of(f.right)
    bws = bws or semiparametric.npplregbw(data, y, x, list(f.smooth), **search_options)
    return semiparametric.npplreg(data, y, x, bws)


def npindex(text: str, data: DataFrame, method: str = "ichimura", **search_options) -> semiparametric.SingleIndex:
    f = _right(text)
    return semiparametric.npindexbw(data, names_of(f.left)[0], names_of(f.right), method, **search_options)


def npscoef(text: str, data: DataFrame, points: pd.DataFrame | DataFrame, bw: Bandwidth | None = None, **search_options) -> DataFrame:
    """y ~ x | z."""
    f = _right(text)
    y, x = names_of(f.left)[0], names_of(f.right)
    bw = bw or semiparametric.npscoefbw(data, y, x, list(f.smooth), **search_options)
    return semiparametric.npscoef(data, bw, y, x, points)


def npindexhat(data: DataFrame, model: semiparametric.SingleIndex, points: DataFrame, key: str = "at", row: str = "row") -> DataFrame:
    """The operator of the fit along the index."""
    return regression.npreghat(data.withColumn("__index", model.index), model.bw, points.withColumn("__index", model.index), key, row)


def npplreghat(data: DataFrame, y: str, x: list[str], bws: dict[str, Bandwidth], points: DataFrame, key: str = "at", row: str = "row") -> DataFrame:
    """The operator of the smooth part, for the response's bandwidth: with the linear part's coefficients it gives the fit."""
    return regression.npreghat(data, bws[y], points, key, row)


def npscoefhat(data: DataFrame, bw: Bandwidth, x: list[str], points: DataFrame, key: str = "at", row: str = "row") -> DataFrame:
    """The operator of the smooth-coefficient fit at points, which have the linear columns too: at, row, weight."""
    train = plans.collect(data.na.drop(subset=[*bw.names, *x]), bw, 20_000, row=F.col(row).cast("double"), **{f"x{i}": F.col(n).cast("double") for i, n in enumerate(x)})
    W = np.column_stack([np.ones(train.n), *(train.extra[f"x{i}"] for i in range(len(x)))])

    def run(K, carried, t, z):
        M = np.einsum("ij,jp,jq->ipq", K, W, W, optimize=True)
        w = np.column_stack([np.ones(len(K)), carried[:, 1:]])
        return K * (polynomials.solve(M, w[:, :, None])[:, :, 0] @ W.T)

    got = plans.map_points(points, train, bw, run, [f"w{j}" for j in range(train.n)], {"at": F.col(key)} | {f"x{i}": F.col(n) for i, n in enumerate(x)}, divide=False)
    pairs = F.arrays_zip(F.array(*(F.lit(float(r)) for r in train.extra["row"])).alias("row"), F.array(*(F.col(f"w{j}") for j in range(train.n))).alias("weight"))
    return got.select("at", F.explode(pairs).alias("p")).select(F.col("at").cast("long").alias("at"), F.col("p.row").cast("long").alias("row"), F.col("p.weight").alias("weight"))


def npcdenshat(data: DataFrame, bw: Bandwidth, y: str, points: DataFrame, key: str = "at", row: str = "row", distribution: bool = False) -> DataFrame:
    """The operator of the conditional density or distribution: the condition's weights times the response's kernel."""
    xs = [n for n in bw.names if n != y]
    i = bw.names.index(y)
    train = plans.collect(data, bw, 20_000, row=F.col(row).cast("double"))
    ys = train.columns[i]
    x_bw, x_train = bw.of(xs), plans.Points([c for j, c in enumerate(train.columns) if j != i], {}, train.n)
    h, k = bw.h[i], bw.kernel

    def run(K, carried, t, x):
        z = (carried[:, [1]] - ys) / h
        return K / K.sum(1, keepdims=True) * (kernels.cdf(z, k.continuous, k.order) if distribution else kernels.pdf(z, k.continuous, k.order) / h)

    got = plans.map_points(points, x_train, x_bw, run, [f"w{j}" for j in range(train.n)], {"at": F.col(key), y: F.col(y)})
    pairs = F.arrays_zip(F.array(*(F.lit(float(r)) for r in train.extra["row"])).alias("row"), F.array(*(F.col(f"w{j}") for j in range(train.n))).alias("weight"))
    return got.select("at", F.explode(pairs).alias("p")).select(F.col("at").cast("long").alias("at"), F.col("p.row").cast("long").alias("row"), F.col("p.weight").alias("weight"))


def npcdisthat(data: DataFrame, bw: Bandwidth, y: str, points: DataFrame, key: str = "at", row: str = "row") -> DataFrame:
    return npcdenshat(data, bw, y, points, key, row, True)


npudensbw, npudistbw, npquantile = density.npudensbw, density.npudistbw, density.npquantile
npregbw, npreghat, nplsqregbw, nplsqreg = regression.npregbw, regression.npreghat, regression.nplsqregbw, regression.nplsqreg
npcdensbw, npcdistbw, npcopula = conditional.npcdensbw, conditional.npcdistbw, conditional.npcopula
npplregbw, npindexbw, npscoefbw = semiparametric.npplregbw, semiparametric.npindexbw, semiparametric.npscoefbw
def npregiv(text: str, data: DataFrame, subset: str | None = None, **options) -> instrumental.Instrumental:
    """y ~ z | w: the response, the endogenous variables and the instruments, all continuous."""
    y, z, w = _instruments(text)
    return instrumental.npregiv(_subset(data, subset), y, z, w, **options)


def npregivderiv(text: str, data: DataFrame, subset: str | None = None, **options) -> instrumental.Instrumental:
    """y ~ z | w with one z: phi and its derivative."""
    y, z, w = _instruments(text)
    if len(z) != 1:
        raise ValueError("the derivative takes one endogenous variable")
    return instrumental.npregivderiv(_subset(data, subset), y, z[0], w, **options)


def _instruments(text: str) -> tuple[str, list[str], list[str]]:
    f = formula(text)
    if len(f.left) != 1 or not f.smooth:
        raise ValueError(f"a formula y ~ z | w is needed: {text}")
    return names_of(f.left)[0], names_of(f.right), names_of(f.smooth)


npuniden_boundary, npuniden_reflect, npuniden_sc = boundary.npuniden_boundary, boundary.npuniden_reflect, boundary.npuniden_sc
npcmstest, npqcmstest, npsigtest, npdeneqtest = inference.npcmstest, inference.npqcmstest, inference.npsigtest, inference.npdeneqtest
npunitest, npsymtest, npdeptest, npsdeptest = inference.npunitest, inference.npsymtest, inference.npdeptest, inference.npsdeptest
b_star, uocquantile, dim_bs = metrics.block_length, metrics.quantiles, polynomials.dimension
np_boot_control, np_grid_control, np_pairs = plotdata.BootControl, plotdata.GridControl, plotdata.pairs


def npudenshat(data: DataFrame, bw: Bandwidth, points: DataFrame, key: str = "at", row: str = "row") -> DataFrame:
    return density.hat(data, bw, points, key, row)


def npudisthat(data: DataFrame, bw: Bandwidth, points: DataFrame, key: str = "at", row: str = "row") -> DataFrame:
    return density.hat(data, bw, points, key, row, True)


def se(fit: Fit, points) -> DataFrame:
    return fit.se(points)


def gradients(fit: Fit, points) -> DataFrame:
    return fit.gradients(points)
