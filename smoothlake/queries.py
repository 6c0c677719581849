"""The queries of the estimators on the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api, streaming
from .functions import kernels
from .operators import boundary, conditional, density, inference, instrumental, metrics, plotdata, polynomials, regression, search, semiparametric
from .plans import ksum as plans
from .plans.spec import Bandwidth, Kernel, Variable, ordered, variables
from .sources import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EPAN, GAUSS, UNIFORM = Kernel("epanechnikov"), Kernel("gaussian"), Kernel("uniform")
EPAN_D = Kernel("epanechnikov", ordered="ngeometric")


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            # "at" is a keyword of some dialects; lists of numbers are doubles, as in the queries
            text = re.sub(r'(?<![\w."])at(?![\w"])', '"at"', " ".join(sql.split()))
            SQL[f.__name__] = re.sub(r"unnest\((\[[\d., ]*\.[\d., ]*\])\)", r"unnest(CAST(\1 AS DOUBLE[]))", text)
        return f

    return keep


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


def numbers(low: float, high: float, n: int, name: str) -> pd.DataFrame:
    return pd.DataFrame({name: np.linspace(low, high, n)})


def series(low: float, high: float, n: int, name: str) -> str:
    """The same numbers in SQL, with at."""
    return f"(SELECT i AS at, CAST({low!r} AS DOUBLE) + i * (CAST({high!r} AS DOUBLE) - {low!r}) / {n - 1} AS {name} FROM range({n}) t(i))"


def epan(z: str) -> str:
    return f"(CASE WHEN ({z})*({z}) < 5 THEN 0.33541019662496845446 * (1 - 0.2*({z})*({z})) ELSE 0 END)"


def epan_cdf(z: str) -> str:
    r5 = "2.23606797749978969641"
    return f"(CASE WHEN ({z}) <= -{r5} THEN 0 WHEN ({z}) >= {r5} THEN 1 ELSE 0.5 + 0.33541019662496845446 * (({z}) - ({z})*({z})*({z})/15) END)"


def gauss(z: str) -> str:
    return f"(0.39894228040143267794 * exp(-0.5*({z})*({z})))"


def con(name: str, h: float, kernel: Kernel = EPAN) -> Bandwidth:
    return Bandwidth((Variable(name),), (h,), kernel)


# kernel functions


@query(f"""
    WITH g AS {series(-3.1, 3.1, 32, "z")}, k AS (
      SELECT z, 'gaussian2' AS kernel, {gauss("z")} AS pdf FROM g UNION ALL
      SELECT z, 'gaussian4', {gauss("z")} * (1.5 - 0.5*z*z) FROM g UNION ALL
      SELECT z, 'gaussian6', {gauss("z")} * (1.875 - 1.25*z*z + 0.125*z*z*z*z) FROM g UNION ALL
      SELECT z, 'gaussian8', {gauss("z")} * (2.1875 - 2.1875*z*z + 0.4375*z*z*z*z - z*z*z*z*z*z/48) FROM g UNION ALL
      SELECT z, 'epanechnikov2', {epan("z")} FROM g UNION ALL
      SELECT z, 'epanechnikov4', {epan("z")} * (1.875 - 0.875*z*z) FROM g UNION ALL
      SELECT z, 'epanechnikov6', {epan("z")} * (2.734375 - 3.28125*z*z + 0.721875*z*z*z*z) FROM g UNION ALL
      SELECT z, 'epanechnikov8', {epan("z")} * (3.5888671875 - 7.8955078125*z*z + 4.1056640625*z*z*z*z - 0.5865234375*z*z*z*z*z*z) FROM g UNION ALL
      SELECT z, 'uniform2', CASE WHEN abs(z) < 1 THEN 0.5 ELSE 0 END FROM g)
    SELECT kernel, round(z, 6) AS z, round(pdf, 6) + 0.0 AS pdf FROM k""")
def kernel_pdf(spark, sf):
    z = spark.createDataFrame(numbers(-3.1, 3.1, 32, "z"))
    names = [("gaussian", o) for o in kernels.ORDERS] + [("epanechnikov", o) for o in kernels.ORDERS] + [("uniform", 2)]
    values = F.explode(F.array(*(F.struct(F.lit(f"{k}{o}").alias("kernel"), kernels.pdf_column(F.col("z"), k, o).alias("pdf")) for k, o in names))).alias("k")
    return z.select("z", values).select("k.kernel", F.round("z", 6).alias("z"), (F.round("k.pdf", 6) + 0.0).alias("pdf"))


@query(f"""
    WITH g AS {series(-5.05, 5.05, 32, "z")}
    SELECT round(z, 6) AS z, round({epan_cdf("z")}, 6) AS cdf_epanechnikov, round(CASE WHEN z <= -1 THEN 0 WHEN z >= 1 THEN 1 ELSE (z + 1) / 2 END, 6) AS cdf_uniform,
      round(exp(-z*z/4) * 0.28209479177387814347, 6) AS conv_gaussian,
      round(CASE WHEN abs(z) < 4.47213595499957939282 THEN 3.0/160 * power(2 - abs(z)/2.23606797749978969641, 3) * (z*z/5 + 6*abs(z)/2.23606797749978969641 + 4) / 2.23606797749978969641 ELSE 0 END, 6) AS conv_epanechnikov,
      round(greatest(0, (2 - abs(z)) / 4), 6) AS conv_uniform, round(-z * {gauss("z")}, 6) AS d_gaussian, round(CASE WHEN z*z < 5 THEN -0.4 * 0.33541019662496845446 * z ELSE 0 END, 6) AS d_epanechnikov
    FROM g""")
def kernel_integrals_convolutions_derivatives(spark, sf):
    z = F.col("z")
    r = lambda c, n: F.round(c, 6).alias(n)
    return spark.createDataFrame(numbers(-5.05, 5.05, 32, "z")).select(
        r(z, "z"), r(kernels.cdf_column(z), "cdf_epanechnikov"), r(kernels.cdf_column(z, "uniform"), "cdf_uniform"), r(kernels.convolution_column(z), "conv_gaussian"), r(kernels.convolution_column(z, "epanechnikov"), "conv_epanechnikov"),
        r(kernels.convolution_column(z, "uniform"), "conv_uniform"), r(kernels.derivative_column(z), "d_gaussian"), r(kernels.derivative_column(z, "epanechnikov"), "d_epanechnikov"),
    )


HIGHER = {
    "gaussian4": lambda z: f"{gauss(z)} * (1.5 - 0.5*({z})*({z}))",
    "gaussian6": lambda z: f"{gauss(z)} * (1.875 - 1.25*({z})*({z}) + 0.125*power({z}, 4))",
    "gaussian8": lambda z: f"{gauss(z)} * (2.1875 - 2.1875*({z})*({z}) + 0.4375*power({z}, 4) - power({z}, 6)/48)",
    "epanechnikov4": lambda z: f"{epan(z)} * (1.875 - 0.875*({z})*({z}))",
    "epanechnikov6": lambda z: f"{epan(z)} * (2.734375 - 3.28125*({z})*({z}) + 0.721875*power({z}, 4))",
    "epanechnikov8": lambda z: f"{epan(z)} * (3.5888671875 - 7.8955078125*({z})*({z}) + 4.1056640625*power({z}, 4) - 0.5865234375*power({z}, 6))",
}


@query(f"""
    WITH g AS {series(-5.05, 5.05, 16, "z")}, u AS (SELECT -9.0 + i * 18.0 / 36000 AS u FROM range(36001) t(i)), k AS (
      {" UNION ALL ".join(f"SELECT '{n}' AS kernel, z, sum(CASE WHEN u <= z THEN {f('u')} ELSE 0 END) * 18.0 / 36000 AS cdf, sum({f('u')} * {f('(z - u)')}) * 18.0 / 36000 AS conv, max({f('(z + 1e-5)')} - {f('(z - 1e-5)')}) / 2e-5 AS d FROM g, u GROUP BY z" for n, f in HIGHER.items())})
    SELECT kernel, round(z, 6) AS z, round(cdf, 2) + 0.0 AS cdf, round(conv, 4) + 0.0 AS conv, round(d, 4) + 0.0 AS derivative FROM k""")
def kernel_higher_orders(spark, sf):
    """Integrals, convolutions and derivatives of orders 4, 6 and 8; SQL integrates by sums."""
    z = np.linspace(-5.05, 5.05, 16)
    rows = [pd.DataFrame({"kernel": n, "z": z} | {c: f(z, n[:-1], int(n[-1])) for c, f in (("cdf", kernels.cdf), ("conv", kernels.convolution), ("derivative", kernels.derivative))}) for n in HIGHER]
    got = spark.createDataFrame(pd.concat(rows))
    return got.select("kernel", F.round("z", 6).alias("z"), (F.round("cdf", 2) + 0.0).alias("cdf"), *((F.round(c, 4) + 0.0).alias(c) for c in ("conv", "derivative")))


@query(f"""
    WITH u AS (SELECT -9.0 + i * 18.0 / 36000 AS u FROM range(36001) t(i))
    {" UNION ALL ".join(f"SELECT '{n}' AS kernel, round(sum(power({f('u')}, 2)) * 18.0 / 36000, 5) AS roughness FROM u" for n, f in (HIGHER | {"gaussian2": gauss, "epanechnikov2": epan}).items())}""")
def kernel_roughness(spark, sf):
    return spark.createDataFrame([(n, round(kernels.roughness(n[:-1], int(n[-1])), 5)) for n in [*HIGHER, "gaussian2", "epanechnikov2"]], "kernel string, roughness double")


@query("""
    WITH l AS (SELECT CAST(i AS DOUBLE) AS x FROM range(1, 6) t(i)), s AS (SELECT CAST(i AS DOUBLE) AS s FROM range(1, 6) t(i)),
    o AS (SELECT a.x, b.x AS y, s, CASE WHEN a.x = s THEN 0.6 ELSE 0.4 / 4 END AS ua, CASE WHEN b.x = s THEN 0.6 ELSE 0.4 / 4 END AS ub, power(0.4, abs(a.x - s)) * 0.6 / 1.4 AS oa, power(0.4, abs(b.x - s)) * 0.6 / 1.4 AS ob, CASE WHEN a.x = s THEN 0.6 ELSE 0.3 * power(0.4, abs(a.x - s)) END AS wa, CASE WHEN b.x = s THEN 0.6 ELSE 0.3 * power(0.4, abs(b.x - s)) END AS wb FROM l a, l b, s)
    SELECT x, y, round(sum(ua * ub), 8) AS "unordered", round(sum(oa * ob), 8) AS ngeometric, round(sum(wa * wb), 8) AS wangvanryzin, round(sum(CASE WHEN s <= x THEN ub ELSE 0 END), 8) AS unordered_cdf FROM o GROUP BY x, y""")
def kernel_category_convolutions(spark, sf):
    x, y = (m.ravel() for m in np.meshgrid(np.arange(1.0, 6), np.arange(1.0, 6), indexing="ij"))
    support = np.arange(1.0, 6)
    columns = {"unordered": kernels.unordered_convolution(x == y, 0.4, levels=5), "unordered_cdf": kernels.unordered_cdf(x, y, 0.4, levels=5)} | {k: kernels.ordered_convolution(x, y, 0.4, k, support) for k in ("ngeometric", "wangvanryzin")}
    return rounded(spark.createDataFrame(pd.DataFrame({"x": x, "y": y} | columns)), *columns, digits=8)


LEVELS = "(SELECT i AS x FROM range(1, 8) t(i))"


@query(f"""
    SELECT CAST(a.x AS BIGINT) AS x, CAST(b.x AS BIGINT) AS y, round(CASE WHEN a.x = b.x THEN CAST(0.7 AS DOUBLE) ELSE 0.05 END, 6) AS aitchison, round(CASE WHEN a.x = b.x THEN CAST(1 AS DOUBLE) ELSE 0.3 END, 6) AS geometric_u,
      round(CASE WHEN a.x = b.x THEN 0.7 ELSE 0.35 * power(0.3, abs(a.x - b.x)) END, 6) AS wangvanryzin, round(power(0.3, abs(a.x - b.x)), 6) AS geometric, round(power(0.3, abs(a.x - b.x)) * 0.7 / 1.3, 6) AS ngeometric,
      round(power(0.3, abs(a.x - b.x)) / (SELECT sum(power(0.3, abs(b.x - c.x))) FROM {LEVELS} c), 6) AS sgeometric
    FROM {LEVELS} a, {LEVELS} b""")
def kernel_categories(spark, sf):
    x, y = (m.ravel() for m in np.meshgrid(np.arange(1.0, 8), np.arange(1.0, 8), indexing="ij"))
    support = np.arange(1.0, 8)
    out = {"x": x.astype(int), "y": y.astype(int), "aitchison": kernels.unordered(x == y, 0.3, levels=7), "geometric_u": kernels.unordered(x == y, 0.3, "geometric", 7)}
    out |= {k: kernels.ordered(x, y, 0.3, k, support) for k in ("wangvanryzin", "geometric", "ngeometric", "sgeometric")}
    return rounded(spark.createDataFrame(pd.DataFrame(out)), *list(out)[2:])


# kernel sums


@query(f"""
    WITH g AS {series(1.0, 50.0, 50, "l_quantity")}
    SELECT CAST(g.at AS BIGINT) AS at, round(g.l_quantity, 6) AS l_quantity, round(sum(k * l_extendedprice) / sum(k), 6) AS mean
    FROM (SELECT g.*, t.l_extendedprice, {epan("(g.l_quantity - t.l_quantity) / 3.0")} AS k FROM g, lineitem t) g GROUP BY ALL""")
def reg_lc_epan_price_on_quantity(spark, sf):
    got = regression.npreg(table(spark, sf, "lineitem"), con("l_quantity", 3.0), "l_extendedprice", numbers(1, 50, 50, "l_quantity"), engine="native")
    return rounded(got.select("at", "l_quantity", "mean"), "l_quantity", "mean")


@query(f"""
    WITH g AS {series(0.0, 500000.0, 50, "o_totalprice")}
    SELECT CAST(at AS BIGINT) AS at, round(1e6 * avg(k) / 20000, 6) AS dens FROM (SELECT at, {gauss("(g.o_totalprice - t.o_totalprice) / 20000")} AS k FROM g, orders t) GROUP BY at""")
def dens_gauss_totalprice(spark, sf):
    got = density.npudens(table(spark, sf, "orders"), con("o_totalprice", 20000.0, GAUSS), numbers(0, 500000, 50, "o_totalprice"))
    return got.select("at", F.round(F.col("dens") * 1e6, 6).alias("dens"))


@query(f"""
    WITH g AS {series(0.0, 0.1, 21, "l_discount")}
    SELECT CAST(at AS BIGINT) AS at, round(sum(k*k), 4) AS s0, round(sum(k*k*l_quantity), 3) AS s1 FROM (SELECT at, l_quantity, {gauss("(g.l_discount - t.l_discount) / 0.02")} / 0.02 AS k FROM g, lineitem t) GROUP BY at""")
def ksum_power_two(spark, sf):
    got = plans.ksum(table(spark, sf, "lineitem"), con("l_discount", 0.02, GAUSS), numbers(0, 0.1, 21, "l_discount"), {"s0": F.lit(1.0), "s1": F.col("l_quantity")}, power=2)
    return got.select("at", F.round("s0", 4).alias("s0"), F.round("s1", 3).alias("s1"))


MIXED_SQL = f"""
    WITH g AS (SELECT q AS l_quantity, f AS l_returnflag, n AS l_linenumber FROM (SELECT unnest([5.0, 20.0, 45.0]) AS q), (SELECT unnest(['A', 'N', 'R']) AS f), (SELECT unnest([1, 4]) AS n)),
    t AS (SELECT l_quantity, l_returnflag, l_linenumber, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL)
    SELECT g.l_quantity, g.l_returnflag, CAST(g.l_linenumber AS BIGINT) AS l_linenumber, round(sum(k*s) / sum(k*n), 5) AS mean FROM (
      SELECT g.*, n, s, {gauss("(g.l_quantity - t.l_quantity) / 2.5")} * (CASE WHEN g.l_returnflag = t.l_returnflag THEN 0.8 ELSE 0.1 END) * power(0.4, abs(g.l_linenumber - t.l_linenumber)) AS k FROM g, t) g GROUP BY ALL"""


def _mixed(data: DataFrame) -> tuple[Bandwidth, pd.DataFrame]:
    vs = variables(data, ["l_quantity", "l_returnflag", ordered("l_linenumber")])
    mesh = np.meshgrid([5.0, 20.0, 45.0], np.array(["A", "N", "R"], object), [1, 4], indexing="ij")
    return Bandwidth(tuple(vs), (2.5, 0.2, 0.4), GAUSS), pd.DataFrame({v.name: m.ravel() for v, m in zip(vs, mesh, strict=True)}).infer_objects()


@query(MIXED_SQL)
def reg_lc_mixed(spark, sf):
    data = table(spark, sf, "lineitem")
    bw, points = _mixed(data)
    got = regression.npreg(data, bw, "l_extendedprice", points)
    labels = spark.createDataFrame(points.assign(at=range(len(points))))
    return labels.join(got.select("at", "mean"), "at").select("l_quantity", "l_returnflag", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.round("mean", 5).alias("mean"))


@query(f"""
    SELECT c.c_mktsegment, round(avg({gauss("(g.x - t.c_acctbal) / 500")} / 500 * (CASE WHEN c.c_mktsegment = t.c_mktsegment THEN 0.9 ELSE 0.1 / (m - 1) END)) * 1e4, 6) AS dens, CAST(g.at AS BIGINT) AS at
    FROM {series(-500.0, 9500.0, 11, "x")} g, (SELECT DISTINCT c_mktsegment FROM customer) c, customer t, (SELECT count(DISTINCT c_mktsegment) AS m FROM customer) GROUP BY ALL""")
def dens_mixed_unordered(spark, sf):
    data = table(spark, sf, "customer")
    vs = variables(data, ["c_acctbal", "c_mktsegment"])
    points = pd.MultiIndex.from_product([np.linspace(-500, 9500, 11), vs[1].levels], names=["c_acctbal", "c_mktsegment"]).to_frame(index=False)
    points["at"] = range(len(points))
    got = density.npudens(data, Bandwidth(tuple(vs), (500.0, 0.1), density.DENSITY_KERNEL), points)
    labels = spark.createDataFrame(points.assign(cell=points["at"] // len(vs[1].levels))[["at", "c_mktsegment", "cell"]])
    return labels.join(got.select("at", "dens"), "at").select("c_mktsegment", F.round(F.col("dens") * 1e4, 6).alias("dens"), F.col("cell").cast("long").alias("at"))


@query("""
    SELECT l_returnflag, l_linestatus, round(n / t, 8) AS dens, round(sqrt(n / t * (1 - n / t) / t), 8) AS derr FROM (SELECT l_returnflag, l_linestatus, CAST(count(*) AS DOUBLE) AS n, (SELECT CAST(count(*) AS DOUBLE) FROM lineitem) AS t FROM lineitem GROUP BY ALL)""")
def dens_categories_frequency(spark, sf):
    data = table(spark, sf, "lineitem")
    vs = variables(data, ["l_returnflag", "l_linestatus"])
    points = data.select("l_returnflag", "l_linestatus").distinct().toPandas()
    points["at"] = range(len(points))
    got = density.npudens(data, Bandwidth(tuple(vs), (0.0, 0.0)), points)
    return spark.createDataFrame(points).join(got.select("at", "dens", "derr"), "at").select("l_returnflag", "l_linestatus", F.round("dens", 8).alias("dens"), F.round("derr", 8).alias("derr"))


@query(f"""
    WITH g AS {series(0.0, 500000.0, 41, "x")}
    SELECT CAST(at AS BIGINT) AS at, round(avg({epan_cdf("(g.x - t.o_totalprice) / 15000")}), 6) AS dist FROM g, orders t GROUP BY at""")
def dist_epan_totalprice(spark, sf):
    got = density.npudist(table(spark, sf, "orders"), con("o_totalprice", 15000.0), numbers(0, 500000, 41, "o_totalprice"), "native")
    return got.select("at", F.round("dist", 6).alias("dist"))


@query("""
    WITH p AS (SELECT o_orderpriority AS v, dense_rank() OVER (ORDER BY o_orderpriority) AS c FROM (SELECT DISTINCT o_orderpriority FROM orders)), r AS (SELECT min(c) AS lo, max(c) AS hi FROM p), n AS (SELECT c, count(*) AS n FROM orders JOIN p ON v = o_orderpriority GROUP BY c)
    SELECT p.v AS o_orderpriority, round(sum(n.n * power(0.3, abs(s.l - n.c)) * 0.7 / 1.3) / (SELECT count(*) FROM orders), 6) AS dist FROM p, n, r, (SELECT i AS l FROM range(-100, 100) t(i)) s WHERE s.l BETWEEN 2 * r.lo - r.hi AND r.hi AND s.l <= p.c GROUP BY ALL""")
def dist_ordered_priority(spark, sf):
    data = table(spark, sf, "orders")
    vs = variables(data, [ordered("o_orderpriority")])
    points = pd.DataFrame({"o_orderpriority": vs[0].levels, "at": range(len(vs[0].levels))})
    got = density.npudist(data, Bandwidth(tuple(vs), (0.3,), density.DENSITY_KERNEL), points)
    return spark.createDataFrame(points).join(got.select("at", "dist"), "at").select("o_orderpriority", F.round("dist", 6).alias("dist"))


@query(f"""
    WITH g AS {series(100000.0, 400000.0, 13, "x")}, t AS (SELECT o_totalprice AS v FROM orders)
    SELECT CAST(g.at AS BIGINT) AS at, round(sum({epan("(g.x - t.v) / 500")} / 500), 6) AS n FROM g, t GROUP BY g.at""")
def ksum_buckets(spark, sf):
    grid = spark.createDataFrame(numbers(100000, 400000, 13, "o_totalprice").assign(at=range(13)))
    got = plans.bucket_ksum(table(spark, sf, "orders"), con("o_totalprice", 500.0), grid, {"n": F.lit(1.0)})
    return got.select("at", F.round("n", 6).alias("n"))


@query(f"""
    WITH g AS {series(0.0, 0.1, 11, "x")}, k AS (SELECT g.at, l_quantity AS y, (g.x - t.l_discount) / 0.02 AS z, {gauss("(g.x - t.l_discount) / 0.02")} AS k FROM g, lineitem t)
    SELECT CAST(k.at AS BIGINT) AS at, round(sum(k) / 50 / 1000, 5) AS n, round(sum(-z * k / 0.0004) / 1e6, 5) AS derivative, round(sum((z*z - 1) * k / 0.0004) / 1e6, 5) AS score FROM k GROUP BY k.at""")
def ksum_permutations(spark, sf):
    data, bw, points = table(spark, sf, "lineitem"), con("l_discount", 0.02, GAUSS), numbers(0, 0.1, 11, "l_discount")
    d = plans.permuted(data, bw, points).select("at", F.round(F.col("n") * 0.02 / 50 / 1000, 5).alias("n"), F.round(F.col("l_discount_n") / 1e6, 5).alias("derivative"))
    return d.join(plans.permuted(data, bw, points, operator="score").select("at", F.round(F.col("l_discount_n") / 1e6, 5).alias("score")), "at")


@query(f"""
    SELECT CAST(a.p_partkey AS BIGINT) AS p_partkey, round(sum(CASE WHEN a.p_partkey <> b.p_partkey THEN {epan("(a.p_retailprice - b.p_retailprice) / 20")} ELSE 0 END), 5) AS loo FROM part a, part b GROUP BY a.p_partkey""")
def ksum_leave_one_out(spark, sf):
    got = plans.ksum(table(spark, sf, "part"), con("p_retailprice", 20.0), pd.DataFrame(), {"loo": F.lit(1.0), "key": F.col("p_partkey")}, divide=False, leave_one_out=True)
    return got.select(F.col("own_key").cast("long").alias("p_partkey"), F.round("loo", 5).alias("loo"))


@query(f"""
    WITH g AS {series(5.0, 45.0, 9, "x")}
    SELECT CAST(g.at AS BIGINT) AS at, round(sum({epan_cdf("(g.x - l_quantity) / 4")} * (CASE WHEN abs(0.05 - l_discount) * abs(0.05 - l_discount) < 5 * 0.0004 THEN -0.4 * 0.33541019662496845446 * (0.05 - l_discount) / 0.02 ELSE 0 END)) / 1000, 6) AS n FROM g, lineitem GROUP BY g.at""")
def ksum_operator_by_column(spark, sf):
    """The integral of one variable's kernel times the derivative of another's."""
    bw = Bandwidth((Variable("l_quantity"), Variable("l_discount")), (4.0, 0.02), EPAN)
    points = numbers(5, 45, 9, "l_quantity").assign(l_discount=0.05)
    got = plans.ksum(table(spark, sf, "lineitem"), bw, points, operators={"l_quantity": "integral", "l_discount": "derivative"}, divide=False)
    return got.select("at", F.round(F.col("n") / 1000, 6).alias("n"))


@query(f"""
    WITH g AS {series(-500.0, 9500.0, 8, "x")}, l AS (SELECT CAST(count(DISTINCT c_mktsegment) AS DOUBLE) AS c, min(c_mktsegment) AS ref FROM customer)
    SELECT CAST(g.at AS BIGINT) AS at, round(sum({gauss("(g.x - c_acctbal) / 700")} * CASE WHEN c_mktsegment = ref THEN 0.8 ELSE 0.2 / (c - 1) END), 6) AS n FROM g, customer, l GROUP BY g.at""")
def ksum_at_reference(spark, sf):
    """Sums with the category's evaluation level set to a reference."""
    data = table(spark, sf, "customer")
    bw = Bandwidth(tuple(variables(data, ["c_acctbal", "c_mktsegment"])), (700.0, 0.2), GAUSS)
    levels = bw.variables[1].levels
    got = plans.at_reference(data, bw, numbers(-500, 9500, 8, "c_acctbal").assign(c_mktsegment=levels[-1]), "c_mktsegment", levels[0], divide=False)
    return got.select("at", F.round("n", 6).alias("n"))


LOO_SQL = """
    WITH t AS (SELECT {column} AS x, count(*) AS n FROM {table} GROUP BY 1), s AS (SELECT a.x, sum(b.n * {kernel}) AS s FROM t a JOIN t b ON b.x BETWEEN a.x - {h} * 2.2360679775 AND a.x + {h} * 2.2360679775 GROUP BY a.x)
    SELECT CAST({key} AS BIGINT) AS key, round(s - 0.33541019662496845446, 5) AS loo FROM {table} JOIN s ON {column} = x"""


@query(LOO_SQL.format(column="o_totalprice", table="orders", key="o_orderkey", h=200.0, kernel=epan("(a.x - b.x) / 200.0")))
def ksum_leave_one_out_orders(spark, sf):
    """Every row against all others, by buckets, so for tables of any size."""
    got = plans.ksum(table(spark, sf, "orders"), con("o_totalprice", 200.0), pd.DataFrame(), {"loo": F.lit(1.0), "key": F.col("o_orderkey")}, divide=False, leave_one_out=True, engine="buckets")
    return got.select(F.col("own_key").cast("long").alias("key"), F.round("loo", 5).alias("loo"))


@query(LOO_SQL.format(column="l_extendedprice", table="lineitem", key="l_orderkey * 10 + l_linenumber", h=20.0, kernel=epan("(a.x - b.x) / 20.0")))
def ksum_leave_one_out_lineitem(spark, sf):
    got = plans.ksum(table(spark, sf, "lineitem"), con("l_extendedprice", 20.0), pd.DataFrame(), {"loo": F.lit(1.0), "key": F.col("l_orderkey") * 10 + F.col("l_linenumber")}, divide=False, leave_one_out=True, engine="buckets")
    return got.select(F.col("own_key").cast("long").alias("key"), F.round("loo", 5).alias("loo"))


TRIWEIGHT = kernels.UserKernel(lambda z: np.where(np.abs(z) < 1, 35 / 32 * (1 - z * z) ** 3, 0.0), 1.0, column=lambda z: F.when(F.abs(z) < 1, 35 / 32 * F.pow(1 - z * z, F.lit(3.0))).otherwise(0.0))


def triweight(z: str) -> str:
    return f"(CASE WHEN abs({z}) < 1 THEN 1.09375 * power(1 - ({z})*({z}), 3) ELSE 0 END)"


def triweight_cdf(z: str) -> str:
    t = f"greatest(-1.0, least(1.0, {z}))"
    return f"(0.5 + 1.09375 * ({t} - power({t}, 3) + 0.6 * power({t}, 5) - power({t}, 7) / 7))"


@query(f"""
    WITH g AS {series(0.0, 52.0, 14, "x")}
    SELECT CAST(g.at AS BIGINT) AS at, round(sum({triweight("(g.x - l_quantity) / 6.0")}), 4) AS n, round(sum({triweight("(g.x - l_quantity) / 6.0")}), 4) AS native, round(avg({triweight_cdf("(g.x - l_quantity) / 6.0")}), 5) AS dist FROM g, lineitem GROUP BY g.at""")
def ksum_user_kernel(spark, sf):
    """A kernel of the user's own, in Python tasks and in the JVM; its distribution function is numerical."""
    data, bw, points = table(spark, sf, "lineitem"), con("l_quantity", 6.0, Kernel(TRIWEIGHT)), numbers(0, 52, 14, "l_quantity")
    blocks, native = (plans.ksum(data, bw, points, divide=False, engine=e) for e in ("blocks", "native"))
    both = blocks.select("at", F.round("n", 4).alias("n")).join(native.select("at", F.round("n", 4).alias("native")), "at")
    return both.join(density.npudist(data, bw, points).select("at", F.round("dist", 5).alias("dist")), "at")


@query(f"""
    WITH g AS {series(900.0, 2100.0, 25, "x")}, k AS (SELECT g.at, p_size AS y, {gauss("(g.x - p_retailprice) / 60")} AS k FROM g, part)
    SELECT CAST(at AS BIGINT) AS at, round(sum(k), 5) AS n, round(sum(k * y), 4) AS y, round(sum(k * k), 5) AS n_p2, round(sum(k * k * y), 4) AS y_p2, round(sum(k * k * k), 5) AS n_p3, round(sum(k * k * k * y), 4) AS y_p3 FROM k GROUP BY at""")
def ksum_powers_in_one_pass(spark, sf):
    got = plans.ksum(table(spark, sf, "part"), con("p_retailprice", 60.0, GAUSS), numbers(900, 2100, 25, "p_retailprice"), {"n": F.lit(1.0), "y": F.col("p_size")}, divide=False, power=(1, 2, 3))
    return got.select("at", *(F.round(c, 5 if c[0] == "n" else 4).alias(c) for c in ("n", "y", "n_p2", "y_p2", "n_p3", "y_p3")))


@query(f"""
    WITH g AS {series(1.0, 50.0, 8, "x")}, k AS (SELECT g.at, l_discount AS a, l_tax AS b, l_extendedprice / 1000 AS y, {gauss("(g.x - l_quantity) / 4")} AS k FROM g, lineitem)
    SELECT CAST(at AS BIGINT) AS at, round(sum(k * a), 4) AS a_one, round(sum(k * a * y), 3) AS a_y, round(sum(k * b), 4) AS b_one, round(sum(k * b * y), 3) AS b_y FROM k GROUP BY at""")
def ksum_weights_by_responses(spark, sf):
    got = plans.ksum(table(spark, sf, "lineitem"), con("l_quantity", 4.0, GAUSS), numbers(1, 50, 8, "l_quantity"), {"one": F.lit(1.0), "y": F.col("l_extendedprice") / 1000}, divide=False, weights={"a": F.col("l_discount"), "b": F.col("l_tax")})
    return got.select("at", *(F.round(c, 4 if c.endswith("one") else 3).alias(c) for c in ("a_one", "a_y", "b_one", "b_y")))


@query(f"""
    WITH g AS {series(0.0, 9000.0, 10, "x")}
    SELECT CAST(at AS BIGINT) AS at, CAST(s_suppkey AS BIGINT) AS "row", round(weight, 8) AS weight FROM (SELECT g.at, s_suppkey, {epan("(g.x - s_acctbal) / 500")} AS weight FROM g, supplier) WHERE weight <> 0""")
def ksum_kernel_weights(spark, sf):
    return rounded(plans.kernel_weights(table(spark, sf, "supplier"), con("s_acctbal", 500.0), numbers(0, 9000, 10, "s_acctbal"), "s_suppkey", divide=False), "weight", digits=8)


@query("""
    WITH l AS (SELECT DISTINCT c_mktsegment AS x FROM customer), c AS (SELECT CAST(count(*) AS DOUBLE) AS c FROM l)
    SELECT l.x AS c_mktsegment, round(sum(CASE WHEN m.x = c_mktsegment THEN 0.7 ELSE 0.3 / (c - 1) END), 6) AS n FROM l JOIN l m ON m.x <= l.x, customer, c GROUP BY l.x""")
def ksum_unordered_cdf(spark, sf):
    data = table(spark, sf, "customer")
    v = variables(data, ["c_mktsegment"])[0]
    got = plans.ksum(data, Bandwidth((v,), (0.3,)), pd.DataFrame({"c_mktsegment": list(v.levels)}), operators={"c_mktsegment": "integral"})
    names = F.array(*(F.lit(x) for x in v.levels))
    return got.select(F.element_at(names, F.col("c_mktsegment").cast("int")).alias("c_mktsegment"), F.round("n", 6).alias("n"))


@query(f"""
    WITH g AS {series(0.0, 500000.0, 11, "x")}
    SELECT CAST(g.at AS BIGINT) AS at, round(avg({gauss("(g.x - t.v) / 25000")} / 25000 / m) * 1e6, 6) AS dens FROM g, (SELECT o_totalprice AS v FROM orders) t, (SELECT 1.0 AS m) GROUP BY g.at""")
def dens_bounded_infinite(spark, sf):
    kernel = Kernel(bounds={"o_totalprice": (-float("inf"), float("inf"))})
    got = density.npudens(table(spark, sf, "orders"), con("o_totalprice", 25000.0, kernel), numbers(0, 500000, 11, "o_totalprice"))
    return got.select("at", F.round(F.col("dens") * 1e6, 6).alias("dens"))


@query(f"""
    WITH b AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), g AS (SELECT i AS at, lo + i * (hi - lo) / 10 AS x FROM b, range(11) r(i))
    SELECT CAST(g.at AS BIGINT) AS at, round(avg({epan("(g.x - t.p_retailprice) / 50")} / 50 / ({epan_cdf("(b.hi - g.x) / 50")} - {epan_cdf("(b.lo - g.x) / 50")})) * 1000, 6) AS dens FROM g, part t, b GROUP BY g.at""")
def dens_bounded_range(spark, sf):
    data = table(spark, sf, "part")
    low, high = data.agg(F.min("p_retailprice"), F.max("p_retailprice")).first()
    got = density.npudens(data, con("p_retailprice", 50.0, Kernel("epanechnikov", bounds={"p_retailprice": (low, high)})), numbers(low, high, 11, "p_retailprice"))
    return got.select("at", F.round(F.col("dens") * 1000, 6).alias("dens"))


# conditional estimates


@query(f"""
    WITH g AS (SELECT q, p FROM (SELECT unnest([10.0, 25.0, 40.0]) AS q), (SELECT CAST(10000 AS DOUBLE) * (i + 1) AS p FROM range(8) t(i)))
    SELECT q AS l_quantity, p AS l_extendedprice, round(1e6 * sum(kx * {epan("(p - l_extendedprice) / 8000")} / 8000) / sum(kx), 6) AS condens, round(sum(kx * {epan_cdf("(p - l_extendedprice) / 8000")}) / sum(kx), 6) AS condist
    FROM (SELECT g.*, t.l_extendedprice, {epan("(g.q - t.l_quantity) / 2")} AS kx FROM g, lineitem t) GROUP BY ALL""")
def cond_density_and_distribution(spark, sf):
    data = table(spark, sf, "lineitem")
    bw = Bandwidth((Variable("l_extendedprice"), Variable("l_quantity")), (8000.0, 2.0), EPAN_D)
    points = pd.MultiIndex.from_product([[10.0, 25.0, 40.0], 10000.0 * np.arange(1, 9)], names=["l_quantity", "l_extendedprice"]).to_frame(index=False)
    dens = conditional.npcdens(data, bw, ["l_extendedprice"], points)
    dist = conditional.npcdist(data, bw, ["l_extendedprice"], points).select("at", "condist")
    return dens.join(dist, "at").select("l_quantity", "l_extendedprice", F.round(F.col("condens") * 1e6, 6).alias("condens"), F.round("condist", 6).alias("condist"))


@query(f"""
    WITH q AS (SELECT unnest([10.0, 25.0, 40.0]) AS q), g AS (SELECT CAST(500 AS DOUBLE) * i AS p FROM range(1, 240) t(i)),
    d AS (SELECT q, p, sum(kx * {epan_cdf("(p - y) / 8000")}) / sum(kx) AS f FROM (SELECT q.q, g.p, t.l_extendedprice AS y, {epan("(q.q - t.l_quantity) / 2")} AS kx FROM q, lineitem t, g) GROUP BY ALL)
    SELECT q AS l_quantity, min(p) AS quantile FROM d WHERE f >= 0.5 GROUP BY q""")
def cond_quantile_on_grid(spark, sf):
    bw = Bandwidth((Variable("l_extendedprice"), Variable("l_quantity")), (8000.0, 2.0), EPAN_D)
    points = pd.MultiIndex.from_product([[10.0, 25.0, 40.0], 500.0 * np.arange(1, 240)], names=["l_quantity", "l_extendedprice"]).to_frame(index=False)
    return conditional.quantile_on_grid(table(spark, sf, "lineitem"), bw, "l_extendedprice", 0.5, points, "blocks").select("l_quantity", "quantile")


@query()
def cond_quantile_bisection(spark, sf):
    data = table(spark, sf, "part")
    bw = Bandwidth((Variable("p_retailprice"), Variable("p_size")), (30.0, 3.0), GAUSS)
    points = spark.createDataFrame(pd.DataFrame({"p_size": np.arange(5.0, 50, 5), "at": range(9)}))
    return conditional.npqreg(data, bw, "p_retailprice", [0.25, 0.5, 0.75], points)


MODE_SQL = f"""
    WITH s AS (SELECT DISTINCT c_mktsegment AS v FROM customer), m AS (SELECT count(*) AS m FROM s),
    f AS (SELECT a.c_custkey, a.c_mktsegment AS actual, s.v, sum({gauss("(a.c_acctbal - b.c_acctbal) / 300")} * (CASE WHEN s.v = b.c_mktsegment THEN 0.9 ELSE 0.1 / (m.m - 1) END)) AS f FROM customer a, customer b, s, m GROUP BY ALL),
    r AS (SELECT actual, v AS predicted, row_number() OVER (PARTITION BY c_custkey ORDER BY f DESC, v) AS i FROM f)"""


def _modes(spark, sf):
    data = table(spark, sf, "customer")
    vs = variables(data, ["c_mktsegment", "c_acctbal"])
    return conditional.npconmode(data, Bandwidth(tuple(vs), (0.1, 300.0), density.DENSITY_KERNEL), "c_mktsegment")


@query(f"{MODE_SQL} SELECT actual, predicted, CAST(count(*) AS BIGINT) AS n FROM r WHERE i = 1 GROUP BY ALL")
def conmode_confusion(spark, sf):
    return conditional.confusion(_modes(spark, sf))


@query(f"""{MODE_SQL}, c AS (SELECT actual, predicted, count(*) AS n FROM r WHERE i = 1 GROUP BY ALL), t AS (SELECT sum(n) AS t FROM c)
    SELECT round(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / max(t), 6) AS ccr, round(sum(CASE WHEN actual = predicted THEN n ELSE 0 END) / max(t) - (SELECT sum(power(p / t.t, 2)) FROM (SELECT sum(n) AS p FROM c GROUP BY predicted), t), 6) AS mcfadden FROM c, t""")
def conmode_classification(spark, sf):
    return rounded(conditional.classification(_modes(spark, sf)), "ccr", "mcfadden")


@query()
def copula_prices(spark, sf):
    data = table(spark, sf, "part").select(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"))
    return conditional.npcopula(data, ["p_retailprice", "p_size"], [0.1, 0.25, 0.5, 0.75, 0.9])


def quantile_sql(name: str, column: str, source: str, h: float) -> str:
    """Smooth quantiles: the least point, of a thousand on three ranges and the sample quantiles, where the distribution reaches u."""
    return f"""{name}r AS (SELECT min({column}) AS lo, max({column}) AS hi FROM {source}), {name}g AS (SELECT lo - (hi - lo) + i * 3 * (hi - lo) / 999 AS x FROM {name}r, range(1000) t(i) UNION SELECT unnest([quantile_cont({column}, 0.25), quantile_cont({column}, 0.5), quantile_cont({column}, 0.75)]) FROM {source}),
    {name}f AS (SELECT x, avg({epan_cdf(f"(x - {column}) / {h}")}) AS f FROM {name}g, {source} GROUP BY x), {name} AS (SELECT u, min(x) AS x FROM u, {name}f WHERE f >= u GROUP BY u)"""


@query(f"""
    WITH u AS (SELECT unnest([0.25, 0.5, 0.75]) AS u), p AS (SELECT CAST(p_retailprice AS DOUBLE) AS price, CAST(p_size AS DOUBLE) AS size FROM part), {quantile_sql("a", "price", "p", 30.0)}, {quantile_sql("b", "size", "p", 3.0)}
    SELECT a.u AS u1, b.u AS u2, round(avg({epan_cdf("(a.x - price) / 30")} * {epan_cdf("(b.x - size) / 3")}), 6) AS copula FROM a, b, p GROUP BY ALL""")
def copula_compact(spark, sf):
    data = table(spark, sf, "part").select(F.col("p_retailprice").cast("double"), F.col("p_size").cast("double"))
    bw = Bandwidth((Variable("p_retailprice"), Variable("p_size")), (30.0, 3.0), EPAN)
    return conditional.npcopula(data, bw.names, [0.25, 0.5, 0.75], bw).select("u1", "u2", F.round("copula", 6).alias("copula"))


@query()
def cond_density_proper(spark, sf):
    data = table(spark, sf, "part")
    bw = Bandwidth((Variable("p_retailprice"), Variable("p_size")), (30.0, 5.0), GAUSS)
    points = pd.MultiIndex.from_product([[10.0, 25.0, 40.0], np.linspace(800, 2200, 57)], names=["p_size", "p_retailprice"]).to_frame(index=False)
    got = conditional.local_polynomial_density(data, bw, "p_retailprice", spark.createDataFrame(points.assign(at=range(len(points)))), (1,))
    return conditional.proper(got, ["p_size"], "p_retailprice", "value")


@query()
def cond_distribution_proper(spark, sf):
    data = table(spark, sf, "part")
    bw = Bandwidth((Variable("p_retailprice"), Variable("p_size")), (30.0, 5.0), GAUSS)
    points = pd.MultiIndex.from_product([[10.0, 25.0, 40.0], np.linspace(800, 2200, 57)], names=["p_size", "p_retailprice"]).to_frame(index=False)
    got = conditional.local_polynomial_density(data, bw, "p_retailprice", spark.createDataFrame(points.assign(at=range(len(points)))), (1,), distribution=True)
    return conditional.proper(got, ["p_size"], "p_retailprice", "value", True)


@query(f"""
    WITH s AS (SELECT DISTINCT l_returnflag AS v FROM lineitem), f AS (SELECT s.v, sum(k * y) / sum(k) AS m FROM (SELECT s.v, l_extendedprice AS y, {gauss("(25.0 - l_quantity) / 3")} * (CASE WHEN s.v = l_returnflag THEN 0.8 ELSE 0.1 END) AS k FROM s, lineitem) s GROUP BY s.v)
    SELECT v AS l_returnflag, round(m - (SELECT m FROM f ORDER BY v LIMIT 1), 4) AS difference FROM f""")
def reg_category_effects(spark, sf):
    data = table(spark, sf, "lineitem")
    vs = variables(data, ["l_quantity", "l_returnflag"])
    bw = Bandwidth(tuple(vs), (3.0, 0.2), GAUSS)
    points = pd.DataFrame({"l_quantity": 25.0, "l_returnflag": list(vs[1].levels)})
    got = conditional.first_differences(lambda p: regression.npreg(data, bw, "l_extendedprice", p), data, bw, "l_returnflag", points, "mean")
    return spark.createDataFrame(points.assign(at=range(len(points)))).join(got, "at").select("l_returnflag", F.round("difference", 4).alias("difference"))


# regression


@query(f"""
    WITH g AS {series(1.0, 50.0, 25, "x")}, s AS (SELECT at, x, sum(k) AS s0, sum(k*d) AS s1, sum(k*d*d) AS s2, sum(k*y) AS t0, sum(k*d*y) AS t1 FROM (SELECT g.at, g.x, t.l_extendedprice AS y, t.l_quantity - g.x AS d, {gauss("(g.x - t.l_quantity) / 4")} AS k FROM g, lineitem t) GROUP BY ALL)
    SELECT CAST(at AS BIGINT) AS at, round((s2*t0 - s1*t1) / (s0*s2 - s1*s1), 4) AS mean, round((s0*t1 - s1*t0) / (s0*s2 - s1*s1), 4) AS grad FROM s""")
def reg_ll_price_on_quantity(spark, sf):
    got = regression.npreg(table(spark, sf, "lineitem"), con("l_quantity", 4.0, GAUSS), "l_extendedprice", numbers(1, 50, 25, "l_quantity"), "ll")
    return got.select("at", F.round("mean", 4).alias("mean"), F.round("grad_l_quantity", 4).alias("grad"))


def projected(source: str, columns: list[str], last: str) -> str:
    """Steps that make the last column orthogonal to the others under the weight w, by at: each takes its part out of those after it."""
    steps, now = [], source
    for i, c in enumerate(columns):
        rest = [*columns[i + 1 :], last]
        kept = ", ".join(f"{x} - {c} * sum(w * {x} * {c}) OVER (PARTITION BY at) / sum(w * {c} * {c}) OVER (PARTITION BY at) AS {x}" for x in rest)
        steps.append(f"o{i} AS (SELECT at, w, wy, {kept} FROM {now})")
        now = f"o{i}"
    return ", ".join(steps)


def lp_sql(columns: dict[str, str]) -> str:
    """The local polynomial of price on quantity and discount at 40 points: the response times what the other columns leave of the first."""
    return f"""
    WITH t AS (SELECT l_quantity AS q, l_discount AS d, count(*) AS n, sum(l_extendedprice) AS y FROM lineitem GROUP BY ALL),
    g AS (SELECT a.at * 5 + b.at AS at, a.x AS q, b.x AS d FROM {series(2.0, 49.0, 8, "x")} a, {series(0.01, 0.09, 5, "x")} b),
    k AS (SELECT g.at, t.q - g.q AS x, (t.d - g.d) * 100 AS z, n, y, {gauss("(t.q - g.q) / 5")} * {gauss("(t.d - g.d) / 0.03")} AS k FROM g, t),
    m AS (SELECT at, k * n AS w, k * y AS wy, {", ".join(f"{v} AS {c}" for c, v in columns.items())}, 1.0 AS b0 FROM k), {projected("m", list(columns), "b0")}
    SELECT CAST(at AS BIGINT) AS at, round(sum(wy * b0) / sum(w * b0), 2) AS mean FROM o{len(columns) - 1} GROUP BY at"""


LP = {"b1": "x", "b2": "z", "b3": "x * z", "b4": "x * x"}


@query(lp_sql(LP))
def reg_lp_two_variables(spark, sf):
    return _lp_two(spark, sf, "glp")


def _lp_two(spark, sf, basis):
    bw = Bandwidth((Variable("l_quantity"), Variable("l_discount")), (5.0, 0.03), GAUSS)
    points = pd.MultiIndex.from_product([np.linspace(2, 49, 8), np.linspace(0.01, 0.09, 5)], names=["l_quantity", "l_discount"]).to_frame(index=False)
    return regression.npreg(table(spark, sf, "lineitem"), bw, "l_extendedprice", points, "lp", (2, 1), basis).select("at", F.round("mean", 2).alias("mean"))


@query(lp_sql(LP))
def reg_lp_legendre(spark, sf):
    """Another family of polynomials, of the same span."""
    return _lp_two(spark, sf, "glp:legendre")


@query(lp_sql(LP | {"b5": "x * x * z"}))
def reg_lp_bernstein(spark, sf):
    """The tensor basis of Bernstein polynomials: all products of degrees 2 and 1."""
    return _lp_two(spark, sf, "tensor:bernstein")


@query(f"""
    WITH g AS {series(1.0, 50.0, 25, "x")}, s AS (SELECT at, sum(k) AS s0, sum(k*y) AS s1, sum(-z*k/4) AS d0, sum(-z*k*y/4) AS d1 FROM (SELECT g.at, t.l_extendedprice AS y, (g.x - t.l_quantity) / 4 AS z, {gauss("(g.x - t.l_quantity) / 4")} AS k FROM g, lineitem t) GROUP BY ALL)
    SELECT CAST(at AS BIGINT) AS at, round(s1 / s0, 4) AS mean, round((d1*s0 - s1*d0) / (s0*s0), 4) AS grad FROM s""")
def reg_lc_gradient(spark, sf):
    got = regression.lc_gradients(table(spark, sf, "lineitem"), con("l_quantity", 4.0, GAUSS), "l_extendedprice", numbers(1, 50, 25, "l_quantity"))
    return got.select("at", F.round("mean", 4).alias("mean"), F.round("grad_l_quantity", 4).alias("grad"))


FIT_SQL = f"""f AS (SELECT a.p_partkey AS i, max(a.p_retailprice) AS y, sum(k * b_y) / sum(k) AS m, max(CASE WHEN i2 = a.p_partkey THEN k END) / sum(k) AS h, (sum(k * b_y) - max(CASE WHEN i2 = a.p_partkey THEN k * b_y END)) / (sum(k) - max(CASE WHEN i2 = a.p_partkey THEN k END)) AS l
    FROM (SELECT a.p_partkey, a.p_retailprice, b.p_partkey AS i2, b.p_retailprice AS b_y, {gauss("(a.p_size - b.p_size) / 3.0")} AS k FROM part a, part b) a GROUP BY a.p_partkey)"""


@query(f"""WITH {FIT_SQL} SELECT round(power(corr(y, m), 2), 6) AS r2, round(avg((y - m)*(y - m)), 4) AS mse, round(avg(abs(y - m)), 4) AS mae, round(avg(abs((y - m) / y)), 6) AS mape, round(abs(corr(y, m)), 6) AS corr, round(avg(CASE WHEN sign(y) = sign(m) THEN 1.0 ELSE 0 END), 6) AS sign FROM f""")
def reg_goodness_of_fit(spark, sf):
    got = metrics.goodness_of_fit(regression.fitted(table(spark, sf, "part"), con("p_size", 3.0, GAUSS), "p_retailprice"), "y", "mean")
    return got.select(F.round("r2", 6).alias("r2"), F.round("mse", 4).alias("mse"), F.round("mae", 4).alias("mae"), F.round("mape", 6).alias("mape"), F.round("corr", 6).alias("corr"), F.round("sign", 6).alias("sign"))


@query(f"""WITH {FIT_SQL} SELECT round(avg((y - l)*(y - l)), 4) AS cv_ls, round(ln(avg((y - m)*(y - m))) + (1 + sum(h) / count(*)) / (1 - (sum(h) + 2) / count(*)), 6) AS cv_aic FROM f""")
def reg_cv_objectives(spark, sf):
    data, bw, y = table(spark, sf, "part"), con("p_size", 3.0, GAUSS), {"y": F.col("p_retailprice")}
    ls = search.evaluate(data, [bw], search.regression("ls"), y, lambda s, n: s[0] / n)[0]
    aic = search.evaluate(data, [bw], search.regression("aic"), y, search.aic_corrected)[0]
    return rounded(spark.createDataFrame([(round(ls, 4), aic)], "cv_ls double, cv_aic double"), "cv_aic")


@query(f"""
    WITH k AS (SELECT a.s_suppkey AS i, b.s_suppkey AS j, {gauss("(a.s_nationkey - b.s_nationkey) / 4.0")} AS k FROM supplier a, supplier b)
    SELECT CAST(i AS BIGINT) AS at, CAST(j AS BIGINT) AS "row", round(k / sum(k) OVER (PARTITION BY i), 8) AS weight FROM k""")
def reg_hat_matrix(spark, sf):
    data = table(spark, sf, "supplier").withColumn("row", F.col("s_suppkey")).withColumn("at", F.col("s_suppkey"))
    return rounded(regression.npreghat(data, con("s_nationkey", 4.0, GAUSS), data), "weight", digits=8)


@query(f"""
    SELECT CAST(a.s_suppkey AS BIGINT) AS at, round(sum({gauss("(a.s_acctbal - b.s_acctbal) / 900")} / 900 / 100.0 * 100.0 / (SELECT count(*) FROM supplier)) * 1000, 6) AS dens FROM supplier a, supplier b GROUP BY a.s_suppkey""")
def dens_hat_applied_to_ones(spark, sf):
    data = table(spark, sf, "supplier").withColumn("row", F.col("s_suppkey")).withColumn("at", F.col("s_suppkey"))
    return density.hat(data, con("s_acctbal", 900.0, GAUSS), data).groupBy("at").agg(F.round(F.sum("weight") * 1000, 6).alias("dens"))


@query()
def reg_bandwidth_cv(spark, sf):
    """The search over whole tables."""
    bw = regression.npregbw(table(spark, sf, "supplier"), "s_acctbal", ["s_nationkey"])
    return spark.createDataFrame([(bw.h[0], bw.value, bw.evaluations)], "h double, value double, evaluations int")


@query()
def reg_location_scale_quantile(spark, sf):
    data = table(spark, sf, "supplier").select("s_acctbal", F.col("s_nationkey").cast("double").alias("nation"))
    model = regression.LocationScale(con("nation", 4.0, GAUSS), 0.8, 0.75)
    return regression.nplsqreg(data, model, "s_acctbal", numbers(0, 24, 13, "nation"))


# bandwidths


@query("""
    WITH q AS (SELECT count(*) AS n, stddev_samp(o_totalprice) AS sd, (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 1.349 AS iqr, 1.4826 * mad(o_totalprice) AS mad FROM orders), s AS (SELECT n, least(sd, iqr, mad) AS s FROM q)
    SELECT round(s, 4) AS spread, round(1.06 * s * power(n, -0.2), 4) AS h_density, round(1.587 * s * power(n, -1.0 / 3), 4) AS h_distribution FROM s""")
def bandwidth_normal_reference(spark, sf):
    data = table(spark, sf, "orders")
    values = (metrics.spread(data, "o_totalprice"), search.normal_reference(data, ["o_totalprice"]).h[0], search.normal_reference(data, ["o_totalprice"], distribution=True).h[0])
    return rounded(spark.createDataFrame([values], "spread double, h_density double, h_distribution double"), "spread", "h_density", "h_distribution", digits=4)


@query("""
    WITH d AS (SELECT g.x, abs(g.x - s_acctbal) AS d FROM (SELECT unnest([0.0, 2500.0, 5000.0, 7500.0]) AS x) g, supplier)
    SELECT x, round(d, 6) AS radius FROM (SELECT x, d, row_number() OVER (PARTITION BY x ORDER BY d) AS i FROM d) WHERE i = 7""")
def nn_distance_generalized(spark, sf):
    values = np.sort(plans.collect(table(spark, sf, "supplier"), con("s_acctbal", 1.0)).columns[0])
    x = np.array([0.0, 2500.0, 5000.0, 7500.0])
    return rounded(spark.createDataFrame(pd.DataFrame({"x": x, "radius": plans.nn_distance(values, x, 7, False)})), "radius")


@query("""
    WITH d AS (SELECT a.s_suppkey AS i, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey)
    SELECT CAST(i AS BIGINT) AS s_suppkey, round(d, 6) AS radius FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d) WHERE r = 5""")
def nn_distance_adaptive(spark, sf):
    got = plans.collect(table(spark, sf, "supplier"), con("s_acctbal", 1.0), key=F.col("s_suppkey"))
    radius = plans.nn_distance(np.sort(got.columns[0]), got.columns[0], 5, True)
    return rounded(spark.createDataFrame(pd.DataFrame({"s_suppkey": got.extra["key"].astype(int), "radius": radius})), "radius")


@query("""
    SELECT x, round(max(abs(x - s_acctbal)) * 3.0, 6) AS radius FROM (SELECT unnest([0.0, 2500.0, 5000.0]) AS x), supplier GROUP BY x""")
def nn_distance_extended(spark, sf):
    """Three times as many neighbours as there are values: the farthest distance, three times."""
    values = np.sort(plans.collect(table(spark, sf, "supplier"), con("s_acctbal", 1.0)).columns[0])
    x = np.array([0.0, 2500.0, 5000.0])
    return rounded(spark.createDataFrame(pd.DataFrame({"x": x, "radius": plans.nn_distance(values, x, 3 * len(values), False)})), "radius")


@query("""
    WITH q AS (SELECT count(*) AS n, least(stddev_samp(o_totalprice), (quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)) / 1.349, 1.4826 * mad(o_totalprice)) AS s FROM orders)
    SELECT round(5000 / (s * power(n, -0.2)), 6) AS second, round(5000 / (s * power(n, -1.0 / 9)), 6) AS fourth FROM q""")
def bandwidth_scale_factors(spark, sf):
    data = table(spark, sf, "orders")
    spread, n = {"o_totalprice": metrics.spread(data, "o_totalprice")}, data.count()
    values = tuple(con("o_totalprice", 5000.0, Kernel(order=k)).scale_factors(spread, n)["o_totalprice"] for k in (2, 4))
    return rounded(spark.createDataFrame([values], "second double, fourth double"), "second", "fourth")


NN_SQL = """WITH d AS (SELECT a.s_suppkey AS i, abs(a.s_acctbal - b.s_acctbal) AS d FROM supplier a, supplier b WHERE a.s_suppkey <> b.s_suppkey), h AS (SELECT i, d AS h FROM (SELECT i, d, row_number() OVER (PARTITION BY i ORDER BY d) AS r FROM d) WHERE r = 9)"""


@query(f"""{NN_SQL}, g AS {series(-500.0, 9500.0, 21, "x")} SELECT CAST(g.at AS BIGINT) AS at, round(1000 * avg({gauss("(g.x - s.s_acctbal) / h.h")} / h.h), 6) AS dens FROM g, supplier s JOIN h ON h.i = s.s_suppkey GROUP BY g.at""")
def dens_adaptive_nn(spark, sf):
    bw = Bandwidth((Variable("s_acctbal"),), (9.0,), GAUSS, "adaptive_nn")
    return density.npudens(table(spark, sf, "supplier"), bw, numbers(-500, 9500, 21, "s_acctbal")).select("at", F.round(F.col("dens") * 1000, 6).alias("dens"))


@query(f"""
    WITH g AS {series(-500.0, 9500.0, 21, "x")}, h AS (SELECT at, d AS h FROM (SELECT at, abs(x - s_acctbal) AS d, row_number() OVER (PARTITION BY at ORDER BY abs(x - s_acctbal)) AS r FROM g, supplier) WHERE r = 9)
    SELECT CAST(g.at AS BIGINT) AS at, round(1000 * avg({gauss("(g.x - s_acctbal) / h.h")} / h.h), 6) AS dens FROM g JOIN h ON h.at = g.at, supplier GROUP BY g.at""")
def dens_generalized_nn(spark, sf):
    bw = Bandwidth((Variable("s_acctbal"),), (9.0,), GAUSS, "generalized_nn")
    return density.npudens(table(spark, sf, "supplier"), bw, numbers(-500, 9500, 21, "s_acctbal")).select("at", F.round(F.col("dens") * 1000, 6).alias("dens"))


@query(f"""
    WITH k AS (SELECT a.c_custkey AS i, sum(CASE WHEN a.c_custkey <> b.c_custkey THEN {gauss("(a.c_acctbal - b.c_acctbal) / 400")} / 400 ELSE 0 END) AS f, sum(exp(-0.25 * power((a.c_acctbal - b.c_acctbal) / 400, 2)) * 0.28209479177387814347 / 400) AS c FROM customer a, customer b GROUP BY a.c_custkey), n AS (SELECT count(*) AS n FROM customer)
    SELECT round(sum(-ln(f / (n - 1))), 5) AS cv_ml, round(1e6 * (sum(c) / max(n * n) - 2 * sum(f) / max(n * (n - 1))), 6) AS cv_ls FROM k, n""")
def dens_cv_objectives(spark, sf):
    data, bw = table(spark, sf, "customer"), con("c_acctbal", 400.0, GAUSS)
    values = (search.evaluate(data, [bw], search.density_ml)[0], search.evaluate(data, [bw], search.density_ls)[0] * 1e6)
    return spark.createDataFrame([values], "cv_ml double, cv_ls double").select(F.round("cv_ml", 5).alias("cv_ml"), F.round("cv_ls", 6).alias("cv_ls"))


@query(f"""
    WITH g AS (SELECT e.s_suppkey AS e, i.s_suppkey AS i, CASE WHEN i.s_acctbal <= e.s_acctbal THEN 1.0 ELSE 0 END AS b, {epan_cdf("(e.s_acctbal - i.s_acctbal) / 700")} AS g FROM supplier e, supplier i), s AS (SELECT *, sum(g) OVER (PARTITION BY e) AS s FROM g), n AS (SELECT count(*) AS n FROM supplier)
    SELECT round(1000 * sum(power(b - (s - g) / (n - 1), 2)) / max(n * (n - 1)), 6) AS cv_cdf FROM s, n WHERE e <> i""")
def dist_cv_objective(spark, sf):
    value = search.evaluate(table(spark, sf, "supplier"), [con("s_acctbal", 700.0)], search.distribution_cdf)[0]
    return rounded(spark.createDataFrame([(value * 1000,)], "cv_cdf double"), "cv_cdf")


COND_SQL = f"""WITH k AS (SELECT i.s_suppkey AS i, j.s_suppkey AS j, CASE WHEN i.s_suppkey = j.s_suppkey THEN 0 ELSE {gauss("(i.s_nationkey - j.s_nationkey) / 5.0")} END AS kx, {gauss("(i.s_acctbal - j.s_acctbal) / 1500")} / 1500 AS ky, {epan_cdf("(j.s_acctbal - i.s_acctbal) / 1500")} AS gy, exp(-0.25 * power((i.s_acctbal - j.s_acctbal) / 1500, 2)) * 0.28209479177387814347 / 1500 AS c, i.s_acctbal AS yi, j.s_acctbal AS yj FROM supplier i, supplier j), w AS (SELECT *, kx / sum(kx) OVER (PARTITION BY i) AS w FROM k)"""


@query(f"""{COND_SQL}, a AS (SELECT i, sum(w * ky) AS f FROM w GROUP BY i), q AS (SELECT x.i, sum(x.w * y.w * z.c) AS s FROM w x JOIN w y ON x.i = y.i JOIN w z ON z.i = x.j AND z.j = y.j GROUP BY x.i)
    SELECT round(sum(-ln(f)), 5) AS cv_ml, round(1e3 * sum(s - 2 * f), 6) AS cv_ls FROM a JOIN q ON a.i = q.i""")
def cond_density_cv_objectives(spark, sf):
    data = table(spark, sf, "supplier")
    bw = Bandwidth((Variable("s_acctbal"), Variable("s_nationkey")), (1500.0, 5.0), GAUSS)
    values = (search.evaluate(data, [bw], search.conditional_ml(["s_acctbal"]))[0], search.evaluate(data, [bw], search.conditional_ls(["s_acctbal"]))[0] * 1e3)
    return spark.createDataFrame([values], "cv_ml double, cv_ls double").select(F.round("cv_ml", 5).alias("cv_ml"), F.round("cv_ls", 6).alias("cv_ls"))


@query(f"""
    WITH k AS (SELECT i.s_suppkey AS i, j.s_suppkey AS j, CASE WHEN i.s_suppkey = j.s_suppkey THEN 0 ELSE {epan("(i.s_nationkey - j.s_nationkey) / 7.0")} END AS kx, {epan_cdf("(j.s_acctbal - i.s_acctbal) / 1500")} AS gy FROM supplier i, supplier j), w AS (SELECT *, kx / sum(kx) OVER (PARTITION BY i) AS w FROM k),
    f AS (SELECT x.i, z.j, sum(x.w * z.gy) AS f FROM w x JOIN w z ON z.i = x.j GROUP BY ALL), n AS (SELECT count(*) AS n FROM supplier)
    SELECT round(1000 * sum(power((CASE WHEN a.s_acctbal <= b.s_acctbal THEN 1.0 ELSE 0 END) - f, 2)) / max(n * (n - 1)), 6) AS cv_ls FROM f JOIN supplier a ON a.s_suppkey = i JOIN supplier b ON b.s_suppkey = j, n WHERE i <> j""")
def cond_distribution_cv_objective(spark, sf):
    bw = Bandwidth((Variable("s_acctbal"), Variable("s_nationkey")), (1500.0, 7.0), EPAN)
    value = search.evaluate(table(spark, sf, "supplier"), [bw], search.conditional_cdf(["s_acctbal"]))[0]
    return rounded(spark.createDataFrame([(value * 1000,)], "cv_ls double"), "cv_ls")


@query("""
    SELECT CAST(0.1 AS DOUBLE) AS prob, round(quantile_cont(o_totalprice, 0.1), 4) AS continuous, (SELECT o_orderpriority FROM (SELECT o_orderpriority, sum(count(*)) OVER (ORDER BY o_orderpriority) AS c FROM orders GROUP BY 1) WHERE c >= 0.1 * (SELECT count(*) FROM orders) - 1e-9 ORDER BY 1 LIMIT 1) AS "ordered", (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS "unordered" FROM orders UNION ALL
    SELECT 0.5, round(quantile_cont(o_totalprice, 0.5), 4), (SELECT o_orderpriority FROM (SELECT o_orderpriority, sum(count(*)) OVER (ORDER BY o_orderpriority) AS c FROM orders GROUP BY 1) WHERE c >= 0.5 * (SELECT count(*) FROM orders) - 1e-9 ORDER BY 1 LIMIT 1), (SELECT o_orderstatus FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) FROM orders""")
def quantiles_by_kind(spark, sf):
    data = table(spark, sf, "orders")
    c, o, u = (metrics.quantiles(data, v, [0.1, 0.5]).withColumnRenamed("value", n) for v, n in zip(variables(data, ["o_totalprice", ordered("o_orderpriority"), "o_orderstatus"]), ("continuous", "ordered", "unordered"), strict=True))
    return rounded(c.join(o, "prob").join(u, "prob"), "continuous", digits=4)


@query(f"""
    WITH r AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part), g AS (SELECT lo - (hi - lo) + i * 3 * (hi - lo) / 999 AS x FROM r, range(1000) t(i) UNION SELECT unnest([quantile_cont(p_retailprice, 0.25), quantile_cont(p_retailprice, 0.5), quantile_cont(p_retailprice, 0.9)]) FROM part),
    f AS (SELECT x, avg({epan_cdf("(x - p_retailprice) / 25")}) AS f FROM g, part GROUP BY x)
    SELECT t AS tau, round(min(x), 5) AS quantile FROM (SELECT unnest([0.25, 0.5, 0.9]) AS t), f WHERE f >= least(greatest(t, (SELECT min(f) FROM f)), (SELECT max(f) FROM f)) GROUP BY t""")
def quantile_smooth(spark, sf):
    return rounded(density.npquantile(table(spark, sf, "part"), "p_retailprice", [0.25, 0.5, 0.9], con("p_retailprice", 25.0), 1000), "quantile", digits=5)


# semiparametric and instrumental models


@query(f"""
    WITH k AS (SELECT a.p_partkey AS i, sum(k * b_y) / sum(k) AS my, sum(k * b_x) / sum(k) AS mx FROM (SELECT a.p_partkey, b.p_retailprice AS b_y, b.p_partkey / 1000.0 AS b_x, {gauss("(a.p_size - b.p_size) / 4.0")} AS k FROM part a, part b) a GROUP BY 1)
    SELECT round(sum((p_retailprice - my) * (p_partkey / 1000.0 - mx)) / sum(power(p_partkey / 1000.0 - mx, 2)), 5) AS coef FROM part JOIN k ON i = p_partkey""")
def partially_linear(spark, sf):
    data = table(spark, sf, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size"), (F.col("p_partkey") / 1000.0).alias("x"))
    model, _ = semiparametric.npplreg(data, "p_retailprice", ["x"], {c: con("p_size", 4.0, GAUSS) for c in ("p_retailprice", "x")})
    return rounded(spark.createDataFrame([(float(model.coef[0]),)], "coef double"), "coef", digits=5)


@query(f"""
    WITH g AS {series(1.0, 50.0, 10, "z")}, s AS (SELECT at, sum(k) AS a, sum(k*x) AS b, sum(k*x*x) AS c, sum(k*y) AS d, sum(k*x*y) AS e FROM (SELECT g.at, l_discount AS x, l_extendedprice AS y, {gauss("(g.z - l_quantity) / 5")} AS k FROM g, lineitem) GROUP BY at)
    SELECT CAST(at AS BIGINT) AS at, round((c*d - b*e) / (a*c - b*b), 3) AS b0, round((a*e - b*d) / (a*c - b*b), 3) AS b1 FROM s""")
def smooth_coefficient(spark, sf):
    got = semiparametric.npscoef(table(spark, sf, "lineitem"), con("l_quantity", 5.0, GAUSS), "l_extendedprice", ["l_discount"], numbers(1, 50, 10, "l_quantity"))
    return got.select("at", F.round("b0", 3).alias("b0"), F.round("b1", 3).alias("b1"))


@query(f"""
    WITH t AS (SELECT l_quantity + 40 * l_discount AS v, l_extendedprice AS y FROM lineitem), g AS {series(5.0, 50.0, 10, "v")}
    SELECT CAST(g.at AS BIGINT) AS at, round(sum({gauss("(g.v - t.v) / 3")} * y) / sum({gauss("(g.v - t.v) / 3")}), 4) AS mean FROM g, t GROUP BY g.at""")
def single_index(spark, sf):
    model = semiparametric.SingleIndex(("l_quantity", "l_discount"), (1.0, 40.0), 3.0, "l_extendedprice", GAUSS)
    points = pd.DataFrame({"l_quantity": np.linspace(5, 50, 10), "l_discount": 0.0})
    return semiparametric.npindex(table(spark, sf, "lineitem"), model, points).select("at", F.round("mean", 4).alias("mean"))


@query()
def single_index_search(spark, sf):
    data = table(spark, sf, "supplier").select("s_acctbal", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_suppkey") % 7).cast("double").alias("b"))
    m = semiparametric.npindexbw(data, "s_acctbal", ["a", "b"])
    return spark.createDataFrame([(m.beta[1], m.h, m.value)], "beta double, h double, value double")


@query()
def single_index_nelder_mead(spark, sf):
    data = table(spark, sf, "supplier").select("s_acctbal", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_suppkey") % 7).cast("double").alias("b"))
    m = semiparametric.npindexbw(data, "s_acctbal", ["a", "b"], optimizer="nelder-mead")
    return spark.createDataFrame([(m.beta[1], m.h, m.value)], "beta double, h double, value double")


@query("""
    WITH m AS (SELECT avg(l_quantity) AS a, stddev_pop(l_quantity) AS s, avg(l_discount) AS b, stddev_pop(l_discount) AS t FROM lineitem), c AS (SELECT corr(l_quantity, l_discount) AS r FROM lineitem)
    SELECT round(sqrt((1 + abs(r)) / (1 - abs(r))), 6) AS condition FROM c""")
def reg_design_condition(spark, sf):
    """Of the linear basis, whose standardised moments have one correlation in them."""
    return rounded(spark.createDataFrame([(polynomials.design(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], (1, 1)),)], "condition double"), "condition")


@query()
def instrumental_landweber(spark, sf):
    data = table(spark, sf, "supplier").select((F.col("s_acctbal") / 1000).alias("y"), F.col("s_nationkey").cast("double").alias("z"), (F.col("s_nationkey") + F.col("s_suppkey") % 5).cast("double").alias("w"))
    m = instrumental.npregiv(data, "y", ["z"], ["w"])
    return spark.createDataFrame(pd.DataFrame({"z": m.z[:, 0], "phi": m.phi, "iterations": m.iterations}))


@query()
def instrumental_landweber_cv(spark, sf):
    """Each step's smooths with bandwidths by cross-validation of their own, on the nations' means."""
    data = table(spark, sf, "supplier").groupBy("s_nationkey").agg((F.avg("s_acctbal") / 1000).alias("y"), F.avg(F.col("s_suppkey") % 5).alias("w")).withColumn("z", F.col("s_nationkey").cast("double"))
    m = api.npregiv("y ~ z | w", data, smooth="cv")
    return spark.createDataFrame(pd.DataFrame({"z": m.z[:, 0], "phi": m.phi, "iterations": m.iterations}))


@query()
def instrumental_tikhonov(spark, sf):
    data = table(spark, sf, "supplier").select((F.col("s_acctbal") / 1000).alias("y"), F.col("s_nationkey").cast("double").alias("z"), (F.col("s_nationkey") + F.col("s_suppkey") % 5).cast("double").alias("w"))
    m = instrumental.npregiv(data, "y", ["z"], ["w"], "Tikhonov")
    return spark.createDataFrame(pd.DataFrame({"z": m.z[:, 0], "phi": m.phi, "alpha": m.alpha}))


@query()
def instrumental_derivative(spark, sf):
    data = table(spark, sf, "supplier").select((F.col("s_acctbal") / 1000).alias("y"), (F.col("s_nationkey") + F.col("s_suppkey") / 1000).alias("z"), (F.col("s_nationkey") + F.col("s_suppkey") % 5).cast("double").alias("w"))
    m = instrumental.npregivderiv(data, "y", "z", ["w"])
    return spark.createDataFrame(pd.DataFrame({"z": m.z[:, 0], "phi": m.phi, "derivative": m.derivative}))


# tests


@query(f"""
    WITH x AS (SELECT s_suppkey AS i, s_acctbal AS v FROM supplier), y AS (SELECT c_custkey AS i, c_acctbal AS v FROM customer), n AS (SELECT (SELECT CAST(count(*) AS DOUBLE) FROM x) AS a, (SELECT CAST(count(*) AS DOUBLE) FROM y) AS b),
    p AS (SELECT sum(k) AS s, sum(k*k) AS q FROM (SELECT {gauss("(l.v - r.v) / 800")} / 800 AS k FROM x l, x r WHERE l.i <> r.i)), q AS (SELECT sum(k) AS s, sum(k*k) AS q FROM (SELECT {gauss("(l.v - r.v) / 500")} / 500 AS k FROM y l, y r WHERE l.i <> r.i)), z AS (SELECT sum(k) AS s, sum(k*k) AS q FROM (SELECT {gauss("(l.v - r.v) / 800")} / 800 AS k FROM y l, x r))
    SELECT round((p.s/(a*(a-1)) + q.s/(b*(b-1)) - 2*z.s/(a*b)) / sqrt(2*(p.q/(a*a*(a-1)*(a-1)) + q.q/(b*b*(b-1)*(b-1)) + 2*z.q/(a*a*b*b))), 5) AS tn FROM p, q, z, n""")
def test_density_equality(spark, sf):
    x, y = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("v")), table(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    t = inference.npdeneqtest(x, y, con("v", 800.0, GAUSS), con("v", 500.0, GAUSS), 0)
    return rounded(spark.createDataFrame([(float(t.statistic[0]),)], "tn double"), "tn", digits=5)


@query()
def test_density_equality_bootstrap(spark, sf):
    x, y = table(spark, sf, "supplier").select(F.col("s_acctbal").alias("v")), table(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    return inference.table(x, inference.npdeneqtest(x, y, con("v", 800.0, GAUSS), con("v", 500.0, GAUSS)))


@query(f"""
    WITH b AS (SELECT regr_slope(s_acctbal, s_nationkey) AS b, regr_intercept(s_acctbal, s_nationkey) AS a FROM supplier), e AS (SELECT s_suppkey AS i, s_nationkey AS x, s_acctbal - a - b * s_nationkey AS e FROM supplier, b),
    k AS (SELECT l.e AS u, r.e AS v, {gauss("(l.x - r.x) / 4.0")} / 4.0 AS k FROM e l, e r WHERE l.i <> r.i), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM e)
    SELECT round(max(n) * sqrt(4.0) * (sum(u*k*v) / max(n*n)) / sqrt(2 * 4.0 * sum(u*u*k*k*v*v) / max(n*n)), 5) AS jn FROM k, n""")
def test_specification(spark, sf):
    t = inference.npcmstest(table(spark, sf, "supplier"), "s_acctbal", con("s_nationkey", 4.0, GAUSS), 0)
    return rounded(spark.createDataFrame([(float(t.statistic[0]),)], "jn double"), "jn", digits=5)


@query()
def test_specification_bootstrap(spark, sf):
    data = table(spark, sf, "supplier")
    return inference.table(data, inference.npcmstest(data, "s_acctbal", con("s_nationkey", 4.0, GAUSS), boot_method="wild"))


@query()
def test_quantile_specification(spark, sf):
    data = table(spark, sf, "supplier")
    return inference.table(data, inference.npqcmstest(data, "s_acctbal", con("s_nationkey", 4.0, GAUSS), 0.5))


@query()
def test_significance(spark, sf):
    data = table(spark, sf, "supplier").select("s_acctbal", F.col("s_nationkey").cast("double").alias("a"), (F.col("s_suppkey") % 3).cast("string").alias("b"))
    vs = variables(data, ["a", "b"])
    return inference.table(data, inference.npsigtest(data, "s_acctbal", Bandwidth(tuple(vs), (4.0, 0.3), GAUSS)))


def _rho(a: str, b: str, h: float) -> str:
    """The integrated statistic on the grid of the density tests, in SQL."""
    return f"""WITH r AS (SELECT least((SELECT min(v) FROM {a}), (SELECT min(v) FROM {b})) - 8 * {h} AS lo, greatest((SELECT max(v) FROM {a}), (SELECT max(v) FROM {b})) + 8 * {h} AS hi), m AS (SELECT lo, hi, CAST(ceil((hi - lo) * 4 / {h}) AS BIGINT) AS m FROM r),
      g AS (SELECT i, m, (hi - lo) / m AS d, lo + i * (hi - lo) / m AS x FROM m, LATERAL (SELECT unnest(range(m + 1)) AS i)),
      w AS (SELECT x, d * (CASE WHEN i = 0 OR i = m THEN 0.5 - 1.0/12 WHEN i = 1 OR i = m - 1 THEN 1 + 1.0/12 ELSE 1 END) AS w FROM g),
      f AS (SELECT x, avg({gauss(f"(x - v) / {h}")}) / {h} AS f FROM w, {a} GROUP BY x), k AS (SELECT x, avg({gauss(f"(x - v) / {h}")}) / {h} AS k FROM w, {b} GROUP BY x)
      SELECT round(0.5 * sum(w * power(sqrt(f) - sqrt(k), 2)), 6) AS srho FROM w JOIN f USING (x) JOIN k USING (x)"""


@query(_rho("(SELECT s_acctbal AS v FROM supplier)", "(SELECT c_acctbal AS v FROM customer)", 600.0))
def test_univariate_entropy(spark, sf):
    t = inference.npunitest(table(spark, sf, "supplier"), table(spark, sf, "customer"), "s_acctbal", "c_acctbal", bw_x=600.0, bw_y=600.0, boot_num=0)
    return rounded(spark.createDataFrame([(float(t.statistic[0]),)], "srho double"), "srho")


@query(_rho("(SELECT s_acctbal AS v FROM supplier)", "(SELECT 2 * (SELECT avg(s_acctbal) FROM supplier) - s_acctbal AS v FROM supplier)", 700.0))
def test_symmetry(spark, sf):
    t = inference.npsymtest(table(spark, sf, "supplier"), "s_acctbal", bw=700.0, boot_num=0)
    return rounded(spark.createDataFrame([(float(t.statistic[0]),)], "srho double"), "srho")


@query()
def test_symmetry_bootstrap(spark, sf):
    data = table(spark, sf, "supplier")
    return inference.table(data, inference.npsymtest(data, "s_acctbal", boot_method="geom", block=4, order="s_suppkey"))


@query()
def test_dependence(spark, sf):
    data = table(spark, sf, "supplier")
    return inference.table(data, inference.npdeptest(data, "s_acctbal", "s_nationkey"))


@query()
def test_serial_dependence(spark, sf):
    data = table(spark, sf, "supplier")
    return inference.table(data, inference.npsdeptest(data, "s_acctbal", "s_suppkey", 2))


@query("""SELECT value, lagged FROM (SELECT s_acctbal AS value, lag(s_acctbal, 2) OVER (ORDER BY s_suppkey) AS lagged FROM supplier) WHERE lagged IS NOT NULL""")
def lagged_pairs(spark, sf):
    return inference.lagged(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey", 2)


@query("""
    WITH s AS (SELECT s_acctbal - avg(s_acctbal) OVER () AS x, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier)
    SELECT CAST(k AS BIGINT) AS lag, round(sum(a.x * b.x) / (SELECT sum(x*x) FROM s), 6) AS rho FROM range(6) t(k), s a, s b WHERE b.i = a.i + k GROUP BY k""")
def autocorrelation(spark, sf):
    rho = metrics.autocorrelations(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey", 5)
    return rounded(spark.createDataFrame(list(enumerate(rho)), "lag long, rho double"), "rho")


@query("""
    WITH x AS (SELECT s_acctbal - avg(s_acctbal) OVER () AS x, row_number() OVER (ORDER BY s_suppkey) AS i FROM supplier), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM x),
    p AS (SELECT n, greatest(5, ceil(log10(n))) AS kn, ceil(sqrt(n)) + greatest(5, ceil(log10(n))) AS mmax, ceil(least(3 * sqrt(n), n / 3)) AS bmax, 1.959963984540054 * sqrt(log10(n) / n) AS c FROM n),
    k AS (SELECT CAST(i AS BIGINT) AS k FROM p, range(200) t(i) WHERE i <= mmax), v AS (SELECT k, sum(a.x * b.x) / max(n) AS v FROM k, n, x a JOIN x b ON true WHERE b.i = a.i - k GROUP BY k),
    s AS (SELECT k, abs(v / (SELECT v FROM v WHERE k = 0)) < c AS small FROM v, p WHERE k > 0),
    r AS (SELECT a.k FROM s a, s b, p WHERE b.k >= a.k AND b.k < a.k + kn AND a.k <= mmax - kn + 1 GROUP BY a.k, kn HAVING count(*) = kn AND bool_and(b.small)),
    m AS (SELECT least(2 * coalesce((SELECT min(k) FROM r), (SELECT max(k) FROM s WHERE NOT small), 1), mmax) AS m FROM p),
    w AS (SELECT k, v * CASE WHEN k / CAST(m AS DOUBLE) <= 0.5 THEN 1.0 WHEN k <= m THEN 2 * (1 - k / CAST(m AS DOUBLE)) ELSE 0 END AS w FROM v, m WHERE k <= m),
    t AS (SELECT 2 * sum(k * w) AS g, 2 * sum(w) - max(CASE WHEN k = 0 THEN w END) AS s FROM w)
    SELECT round(least(power(2 * g * g / (2.0 * s * s), 1.0 / 3) * power(n, 1.0 / 3), bmax), 5) AS stationary, round(least(power(2 * g * g / (4.0 / 3 * s * s), 1.0 / 3) * power(n, 1.0 / 3), bmax), 5) AS circular FROM t, p""")
def block_length(spark, sf):
    return rounded(spark.createDataFrame([metrics.block_length(table(spark, sf, "supplier"), "s_acctbal", "s_suppkey")], "stationary double, circular double"), "stationary", "circular", digits=5)


# bounded univariate densities


@query(f"""
    WITH t AS (SELECT l_discount AS v FROM lineitem), g AS {series(0.0, 0.1, 21, "x")}, m AS (SELECT v FROM t UNION ALL SELECT -v FROM t UNION ALL SELECT 0.2 - v FROM t)
    SELECT round(g.x, 6) AS x, round(3 * avg({gauss("(g.x - m.v) / 0.01")} / 0.01), 5) AS f FROM g, m GROUP BY g.x""")
def density_reflected(spark, sf):
    got = boundary.npuniden_reflect(table(spark, sf, "lineitem"), "l_discount", np.linspace(0, 0.1, 21), 0.01, 0.0, 0.1)
    return got.select(F.round("x", 6).alias("x"), F.round("f", 5).alias("f"))


@query(f"""
    WITH t AS (SELECT p_size / 51.0 AS v FROM part), g AS {series(0.02, 0.98, 25, "x")}
    SELECT round(g.x, 6) AS x, round(avg(CASE WHEN x < 0.2 THEN CASE WHEN v <= 0.4 THEN 0.75 * (1 - x/0.2 - 1.25 * (1 - 2*x/0.2) * power(v/0.2, 2)) * power(v/0.2 - 2, 2) / 0.2 ELSE 0 END WHEN x > 0.8 THEN CASE WHEN v >= 0.6 THEN 0.75 * (1 - (1-x)/0.2 - 1.25 * (1 - 2*(1-x)/0.2) * power((1-v)/0.2, 2)) * power((1-v)/0.2 - 2, 2) / 0.2 ELSE 0 END ELSE CASE WHEN abs(x - v) < 0.2 THEN 0.9375 * power(1 - power((v - x)/0.2, 2), 2) / 0.2 ELSE 0 END END), 6) AS f FROM g, t GROUP BY g.x""")
def density_floating_boundary(spark, sf):
    data = table(spark, sf, "part").select((F.col("p_size") / 51.0).alias("v"))
    got, _ = boundary.npuniden_boundary(data, "v", np.linspace(0.02, 0.98, 25), 0.2, 0.0, 1.0, "fb")
    return got.select(F.round("x", 6).alias("x"), F.round("f", 6).alias("f"))


@query(f"""
    WITH t AS (SELECT p_size / 51.0 AS v FROM part), g AS {series(0.05, 0.95, 19, "x")}
    SELECT round(g.x, 6) AS x, round(avg(exp((x/0.05)*ln(v) + ((1-x)/0.05)*ln(1-v) - (lgamma(x/0.05+1) + lgamma((1-x)/0.05+1) - lgamma(1/0.05+2)))), 5) AS f FROM g, t GROUP BY g.x""")
def density_beta_boundary(spark, sf):
    data = table(spark, sf, "part").select((F.col("p_size") / 51.0).alias("v"))
    got, _ = boundary.npuniden_boundary(data, "v", np.linspace(0.05, 0.95, 19), 0.05, 0.0, 1.0, "beta1")
    return got.select(F.round("x", 6).alias("x"), F.round("f", 5).alias("f"))


@query(f"""
    WITH t AS (SELECT p_size / 51.0 AS v FROM part), g AS {series(0.05, 2.0, 14, "x")}
    SELECT round(g.x, 6) AS x, round(avg(exp((x/0.1)*ln(v/0.1) - v/0.1 - lgamma(x/0.1+1)) / 0.1), 6) AS f FROM g, t GROUP BY g.x""")
def density_gamma_boundary(spark, sf):
    data = table(spark, sf, "part").select((F.col("p_size") / 51.0).alias("v"))
    got, _ = boundary.npuniden_boundary(data, "v", np.linspace(0.05, 2.0, 14), 0.1, 0.0, float("inf"), "gamma")
    return got.select(F.round("x", 6).alias("x"), F.round("f", 6).alias("f"))


@query()
def density_boundary_kinds(spark, sf):
    data = table(spark, sf, "part").select((F.col("p_size") / 51.0).alias("v"))
    out = None
    for k in boundary.TYPES:
        got = boundary.npuniden_boundary(data, "v", np.linspace(0.02, 0.98, 13), 0.1, 0.0, 1.0, k)[0].withColumn("kind", F.lit(k))
        out = got if out is None else out.unionAll(got)
    return out


@query()
def density_shape_constrained(spark, sf):
    data = table(spark, sf, "part").select((F.col("p_size") / 51.0).alias("v"))
    return boundary.npuniden_sc(data, "v", 0.1, shape="log-concave", points=40)


def chen(x: str, v: str, h: float, s: int) -> str:
    p, q = f"(1 + ({x}) / {h * h * s!r})", f"(1 + (1 - ({x})) / {h * h * s!r})"
    return f"exp(({p} - 1) * ln({v}) + ({q} - 1) * ln(1 - ({v})) + lgamma({p} + {q}) - lgamma({p}) - lgamma({q}))"


@query(f"""
    WITH g AS {series(0.02, 0.98, 25, "x")}, t AS (SELECT p_size / 51.0 AS v FROM part)
    SELECT CAST(g.at AS BIGINT) AS at, round(avg(2 * {chen("g.x", "v", 0.2, 1)} - {chen("g.x", "v", 0.2, 2)}), 6) AS dens FROM g, t GROUP BY g.at""")
def density_beta_kernel(spark, sf):
    data = table(spark, sf, "part").select((F.col("p_size") / 51.0).alias("v"))
    return density.npudens(data, con("v", 0.2, Kernel("beta", 4, bounds={"v": (0.0, 1.0)})), numbers(0.02, 0.98, 25, "v")).select("at", F.round("dens", 6).alias("dens"))


# data behind plots, pairs and streams


@query(f"""
    WITH c AS (SELECT quantile_cont(l_discount, 0.5) AS d, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), g AS (SELECT i AS at, lo + i * (hi - lo) / 19 AS q, d FROM c, range(20) t(i)), t AS (SELECT l_quantity, l_discount, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY ALL)
    SELECT CAST(g.at AS BIGINT) AS at, round(sum(k * s) / sum(k * n), 4) AS mean FROM (SELECT g.at, n, s, {gauss("(g.q - t.l_quantity) / 4")} * {gauss("(g.d - t.l_discount) / 0.03")} AS k FROM g, t) g GROUP BY g.at""")
def plot_slice(spark, sf):
    data = table(spark, sf, "lineitem")
    bw = Bandwidth((Variable("l_quantity"), Variable("l_discount")), (4.0, 0.03), GAUSS)
    points = plotdata.slice_points(data, bw, "l_quantity", plotdata.GridControl(20))
    return regression.npreg(data, bw, "l_extendedprice", points).select("at", F.round("mean", 4).alias("mean"))


@query()
def plot_regression_band(spark, sf):
    data = table(spark, sf, "part").select("p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    bw = con("p_size", 4.0, GAUSS)
    return plotdata.regression_band(data, bw, "p_retailprice", plotdata.slice_points(data, bw, "p_size", plotdata.GridControl(20)), control=plotdata.BootControl(number=199), kind="simultaneous")


@query()
def plot_density_band(spark, sf):
    data = table(spark, sf, "supplier")
    bw = con("s_acctbal", 900.0, GAUSS)
    return plotdata.density_band(data, bw, density.grid(data, bw, 20), control=plotdata.BootControl("geom", 199, block=3), kind="bonferroni")


@query()
def plot_pairs(spark, sf):
    return plotdata.pairs(table(spark, sf, "part").select(F.col("p_size").cast("double"), "p_retailprice"), ["p_size", "p_retailprice"], 10)


@query(f"""
    WITH g AS {series(0.0, 100.0, 11, "x")}
    SELECT CAST(g.at AS BIGINT) AS at, round(sum({gauss("(g.x - e.value) / 10")} / 10), 5) AS n FROM g, events e GROUP BY g.at""")
def stream_ksum_grid(spark, sf):
    got = streaming.streaming_ksum(table(spark, sf, "events"), con("value", 10.0, GAUSS), numbers(0, 100, 11, "value"), {"n": F.lit(1.0)})
    return got.select(F.col("at").cast("long").alias("at"), F.round("n", 5).alias("n"))
