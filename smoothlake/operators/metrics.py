"""Goodness of fit, spreads and quantiles, as plain aggregations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.spec import CONTINUOUS, ORDERED, Variable

# The normal distribution's interquartile range and the scale of the median absolute deviation.
IQR_SCALE, MAD_SCALE = 1.349, 1.4826


def goodness_of_fit(df: DataFrame, y: str, fit: str) -> DataFrame:
    """One row: r2, mse, mae, mape, corr and sign. r2 is the squared correlation; a response of 0 counts 2 in mape."""
    a, b = F.col(y), F.col(fit)
    rho = F.corr(a, b)
    return df.where(a.isNotNull() & b.isNotNull()).agg(
        (rho * rho).alias("r2"), F.avg((a - b) * (a - b)).alias("mse"), F.avg(F.abs(a - b)).alias("mae"),
        F.avg(F.when(a == 0, 2.0).otherwise(F.abs((a - b) / a))).alias("mape"), F.abs(rho).alias("corr"), F.avg((F.signum(a) == F.signum(b)).cast("double")).alias("sign"),
    )


def spread(df: DataFrame, name: str) -> float:
    """The least positive of the standard deviation, the scaled interquartile range and the scaled median absolute deviation."""
    c = F.col(name).cast("double")
    sd, q1, med, q3 = df.agg(F.stddev_samp(c), F.percentile(c, 0.25), F.percentile(c, 0.5), F.percentile(c, 0.75)).first()
    mad = df.agg(F.percentile(F.abs(c - F.lit(med)), 0.5)).first()[0]
    found = [v for v in (sd, (q3 - q1) / IQR_SCALE, mad * MAD_SCALE) if v and v > 0]
    if not found:
        raise ValueError(f"{name} is constant")
    return min(found)


def quantiles(df: DataFrame, v: Variable, prob: list[float]) -> DataFrame:
    """prob and value: linear quantiles of a continuous variable, the first level with that cumulative share of an ordered one, the commonest level of an unordered one."""
    spark = df.sparkSession
    if any(not 0 <= p <= 1 for p in prob):
        raise ValueError("probabilities lie in [0, 1]")
    if v.kind == CONTINUOUS:
        got = df.agg(F.percentile(F.col(v.name).cast("double"), F.array(*map(F.lit, prob))).alias("q"))
        return got.select(F.explode(F.arrays_zip(F.array(*map(F.lit, prob)).alias("prob"), F.col("q").alias("value"))).alias("x")).select("x.prob", "x.value")
    counts = df.where(F.col(v.name).isNotNull()).groupBy(F.col(v.name).alias("value")).agg(F.count("*").alias("n"))
    if v.kind == ORDERED:
        order = v.encode() if v.levels else F.col("value")
        named = counts.withColumnRenamed("value", v.name).withColumn("code", order).withColumnRenamed(v.name, "value")
        # levels are bounded, so one window holds them
        named = named.withColumn("share", F.sum("n").over(Window.orderBy("code")) / F.sum("n").over(Window.partitionBy(F.lit(1))))
        asked = spark.createDataFrame([(float(p),) for p in prob], "prob double")
        return asked.join(named, F.col("share") >= F.col("prob") - 1e-12).groupBy("prob").agg(F.min_by("value", "code").alias("value"))
    mode = counts.agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))
    return mode.crossJoin(spark.createDataFrame([(float(p),) for p in prob], "prob double")).select("prob", "value")


SERIES_ROWS = 200_000  # rows of a series that a task orders


def lags(df: DataFrame, value: Column, order: str, which: list[int], rows: int | None = None) -> DataFrame:
    """l0, the value, and l1, l2, ...: those so many rows earlier in the order, null before the start.

    A long series is cut by quantiles of the order into parts, whose counts number all rows; rows then
    go to blocks of equal length, and the last ones of a block to the next one too, so that no task
    holds the series.
    """
    rows = rows or SERIES_ROWS
    most = max(which, default=0)
    source = df.select(value.alias("l0"), F.col(f"`{order}`").alias("o"))
    columns = ["l0", *(f"l{k}" for k in which)]

    def lagged(w) -> list[Column]:
        return [F.lag("l0", k).over(w).alias(f"l{k}") for k in which]

    parts = -(-source.count() // rows)
    if parts <= 1:
        return source.select("l0", *lagged(Window.orderBy("o")))
    cuts = sorted(set(source.agg(F.percentile_approx("o", [k / parts for k in range(1, parts)], 10_000)).first()[0] or []))
    part = F.lit(0)
    for c in cuts:
        part = part + F.coalesce((F.col("o") >= F.lit(c)).cast("int"), F.lit(0))
    source = source.withColumn("part", part)
    base, counts = 0, {r["part"]: r["n"] for r in source.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each part
    before = F.lit(0)
    for k in range(len(cuts) + 1):
        before = F.when(F.col("part") == k, F.lit(base)).otherwise(before)
        base += counts.get(k, 0)
    at = F.col("at")
    size = max(rows, most + 1)
    numbered = source.withColumn("at", before + F.row_number().over(Window.partitionBy("part").orderBy("o")) - 1).withColumn("own", F.floor(at / size))
    copies = F.explode(F.when(at % size >= size - most, F.array("own", F.col("own") + 1)).otherwise(F.array("own")))
    dealt = numbered.withColumn("block", copies)
    return dealt.select("l0", "own", "block", *lagged(Window.partitionBy("block").orderBy("at"))).where("own = block").select(*columns)


def autocorrelations(df: DataFrame, value: str, order: str, lags_: int, covariance: bool = False) -> list[float]:
    """Of lags 0 to lags_, with the divisor n, as sums over lagged pairs in one pass."""
    n, mean = df.agg(F.count(value), F.avg(value)).first()
    pairs = lags(df, F.col(value) - mean, order, list(range(1, lags_ + 1)))
    sums = pairs.agg(*(F.sum(F.col("l0") * F.col(f"l{k}")).alias(f"l{k}") for k in range(lags_ + 1))).first()
    return [(s or 0.0) / n / (1.0 if covariance else sums[0] / n) for s in sums]


def block_length(df: DataFrame, value: str, order: str, kn: int | None = None, mmax: int | None = None, bmax: int | None = None, c: float = 1.959963984540054, rounded: bool = False) -> tuple[float, float]:
    """Optimal block lengths of the stationary and the circular bootstrap (Politis and White)."""
    n = df.where(F.col(value).isNotNull()).count()
    kn = kn or max(5, math.ceil(math.log10(n)))
    mmax = mmax or math.ceil(math.sqrt(n)) + kn
    bmax = bmax or math.ceil(min(3 * math.sqrt(n), n / 3))
    cov = autocorrelations(df, value, order, mmax, True)
    rho = [v / cov[0] for v in cov[1:]]
    small = [abs(v) < c * math.sqrt(math.log10(n) / n) for v in rho]
    quiet = [j + 1 for j in range(mmax - kn + 1) if all(small[j : j + kn])]
    loud = [j + 1 for j, s in enumerate(small) if not s]
    m = quiet[0] if quiet else max(loud, default=1)
    m = min(2 * m, mmax)
    lam = lambda t: 1.0 if abs(t) <= 0.5 else 2 * (1 - abs(t)) if abs(t) <= 1 else 0.0  # noqa: E731  the flat-top lag window
    both = [(k, cov[abs(k)] * lam(k / m)) for k in range(-m, m + 1)]
    g, s = sum(abs(k) * v for k, v in both), sum(v for _, v in both)
    out = [((2 * g * g) / (f * s * s)) ** (1 / 3) * n ** (1 / 3) for f in (2.0, 4 / 3)]
    return tuple(float(max(1, min(bmax, round(v)))) if rounded else min(v, bmax) for v in out)


def column_rounded(c: str | Column, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)
