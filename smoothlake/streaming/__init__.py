"""Kernel sums on a fixed grid, kept up to date as rows arrive.

With fixed bandwidths a kernel sum is a plain sum over rows, so a streaming aggregation maintains it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ksum import _factor_column
from ..plans.spec import Bandwidth


def streaming_ksum(rows: DataFrame, bw: Bandwidth, grid: pd.DataFrame, responses: dict[str, Column], window: str | None = None, time: str = "ts", delay: str = "0 seconds", divide: bool = True) -> DataFrame:
    """at, the window if one is asked for, and the sums; a streaming or a batch table alike."""
    points = [(i, *(float(c) for c in r)) for i, r in enumerate(grid[bw.names].itertuples(index=False))]
    if len(points) > 1000:
        raise ValueError("a streaming grid has 1000 points at most")
    names = ["at", *(f"e{i}" for i in range(len(bw.variables)))]
    cells = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, p, strict=True))) for p in points)))
    if window:
        rows = rows.withWatermark(time, delay)
    coded = rows.select(*([F.window(time, window).alias("window")] if window else []), *(v.encode().alias(f"v{i}") for i, v in enumerate(bw.variables)), *(c.cast("double").alias(k) for k, c in responses.items()), cells.alias("p"))
    coded = coded.select("*", *(F.col(f"p.{n}").alias(n) for n in names)).drop("p")
    k = F.lit(1.0)
    for i in range(len(bw.variables)):
        k = k * _factor_column(bw, i, "normal", divide)
    return coded.groupBy(*(["window"] if window else []), "at").agg(*(F.sum(k * F.col(n)).alias(n) for n in responses))
