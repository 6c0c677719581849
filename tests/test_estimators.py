"""Plans against each other and estimators against loops over pairs, on small samples."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from smoothlake import api
from smoothlake.functions import kernels
from smoothlake.operators import boundary, conditional, density, inference, instrumental, metrics, plotdata, polynomials, regression, search, semiparametric
from smoothlake.plans import ksum as plans
from smoothlake.plans.spec import Bandwidth, Kernel, Variable, formula, ordered, unordered, variables

N = 80
GAUSS, EPAN = Kernel(), Kernel("epanechnikov")


@pytest.fixture(scope="module")
def frame():
    r = np.random.default_rng(1)
    f = pd.DataFrame({"x": r.random(N), "w": r.standard_normal(N), "z": r.choice(["a", "b", "c"], N), "o": r.integers(0, 4, N), "row": np.arange(N)})
    f["y"] = np.cos(6 * f.x) + (f.z == "b") + 0.25 * r.standard_normal(N)
    return f


@pytest.fixture(scope="module")
def data(spark, frame):
    return spark.createDataFrame(frame).repartition(3).cache()


def one(name="x", h=0.1, kernel=GAUSS, kind="fixed"):
    return Bandwidth((Variable(name),), (h,), kernel, kind)


GRID = pd.DataFrame({"x": [0.1, 0.45, 0.9]})


@pytest.mark.parametrize("kernel", [GAUSS, EPAN, Kernel("uniform"), Kernel("gaussian", 6)])
def test_engines_agree(data, frame, kernel):
    bw = one(kernel=kernel)
    r = {"n": F.lit(1.0), "s": F.col("y")}
    a = plans.ksum(data, bw, GRID, r).toPandas().sort_values("at")
    b = plans.ksum(data, bw, GRID, r, engine="native").toPandas().sort_values("at")
    K = kernels.pdf((GRID.x.to_numpy()[:, None] - frame.x.to_numpy()) / 0.1, kernel.continuous, kernel.order) / 0.1
    assert np.allclose(a[["n", "s"]], b[["n", "s"]]) and np.allclose(a.n, K.sum(1)) and np.allclose(a.s, K @ frame.y)
    if kernel.continuous != "gaussian":
        c = plans.bucket_ksum(data, bw, data.sparkSession.createDataFrame(GRID.assign(at=range(3))), r).toPandas().sort_values("at")
        assert np.allclose(a[["n", "s"]], c[["n", "s"]])


def test_adding_up_equal_rows_is_exact(spark):
    r = np.random.default_rng(2)
    d = spark.createDataFrame(pd.DataFrame({"x": r.integers(0, 5, 400) / 5, "y": r.random(400)}))
    a, b = (plans.ksum(d, one(), GRID, {"s": F.col("y")}, compress=c).toPandas() for c in (True, False))
    assert np.allclose(a.sort_values("at").s, b.sort_values("at").s)


def test_mixed_product_and_operators(data, frame):
    vs = variables(data, ["x", "z", ordered("o")])
    bw = Bandwidth(tuple(vs), (0.1, 0.2, 0.3), Kernel(ordered="wangvanryzin"))
    points = pd.DataFrame({"x": [0.2, 0.7], "z": ["a", "c"], "o": [0, 3]})
    for ops in ({}, {"x": "integral"}, {"x": "derivative"}, {"x": "convolution", "z": "convolution", "o": "convolution"}, {"o": "integral"}):
        got = plans.ksum(data, bw, points, operators=ops).toPandas().sort_values("at").n.to_numpy()
        want = []
        for p in points.itertuples():
            total = 0.0
            for q in frame.itertuples():
                f = kernels.CONTINUOUS[ops.get("x", "normal")](np.array([(p.x - q.x) / 0.1]))[0]
                f /= {"integral": 1, "derivative": 0.01}.get(ops.get("x"), 0.1)
                f *= (kernels.unordered_convolution if ops.get("z") else kernels.unordered)(np.array([p.z == q.z]), 0.2, "aitchisonaitken", 3)[0]
                s = np.arange(0.0, 4)
                a, b = np.array([float(p.o)]), np.array([float(q.o)])
                f *= {None: lambda: kernels.ordered(a, b, 0.3), "integral": lambda: kernels.ordered_cdf(a, b, 0.3, "wangvanryzin", s), "convolution": lambda: kernels.ordered_convolution(a, b, 0.3, "wangvanryzin", s)}[ops.get("o")]()[0]
                total += f
            want.append(total)
        assert np.allclose(got, want), ops


def test_nearest_neighbours():
    r = np.random.default_rng(3)
    v = np.sort(np.round(r.random(40), 2))
    for k in (1, 5, 39, 60):
        for skip in (False, True):
            at = v if skip else np.array([-1.0, 0.0, 0.33, 0.5, 2.0])
            got = plans.nn_distance(v, at, k, skip)
            n = len(v) - skip
            for a, g in zip(at, got, strict=True):
                d = np.sort(np.abs(v - a))[int(skip) :]
                assert g == pytest.approx(d[min(k, n) - 1] * max(1, k / n))


def test_permutations_and_scores(data):
    bw = lambda h: Bandwidth((Variable("x"), Variable("w")), (h, 0.4))
    points = pd.DataFrame({"x": [0.2, 0.7], "w": [0.0, 0.5]})
    total = lambda b, p=points: plans.ksum(data, b, p).toPandas().sort_values("at").n.to_numpy()
    got = plans.permuted(data, bw(0.1), points).toPandas().sort_values("at")
    assert np.allclose(got.n, total(bw(0.1)))
    assert np.allclose(got.x_n, (total(bw(0.1), points.assign(x=points.x + 1e-5)) - total(bw(0.1), points.assign(x=points.x - 1e-5))) / 2e-5, rtol=1e-4)
    score = plans.permuted(data, bw(0.1), points, operator="score").toPandas().sort_values("at")
    assert np.allclose(score.x_n, (total(bw(0.1 + 1e-6)) - total(bw(0.1 - 1e-6))) / 2e-6, rtol=1e-4)
    vs = variables(data, ["x", "z"])
    b = Bandwidth(tuple(vs), (0.1, 0.2))
    mixed = pd.DataFrame({"x": [0.2, 0.7], "z": ["b", "c"]})
    assert np.allclose(plans.at_reference(data, b, mixed, "z", "a").toPandas().sort_values("at").n, total(b, mixed.assign(z="a")))


def test_range_bounds(data, frame):
    k = density.range_bounds(data, ["x"], Kernel("beta", bounds={}))
    u = np.sort(frame.x.unique())
    assert k.bounds["x"] == pytest.approx((u[0] - (u[1] - u[0]) / 2, u[-1] + (u[-1] - u[-2]) / 2))
    assert np.isfinite(density.npudens(data, one(kernel=k, h=0.2), GRID).toPandas().dens).all()
    with pytest.raises(ValueError):
        density.npudens(data, one(kernel=density.range_bounds(data, ["x"], GAUSS)), pd.DataFrame({"x": [7.0]})).count()


def test_leave_one_out(data, frame):
    got = plans.ksum(data, one(), GRID, {"n": F.lit(1.0), "key": F.col("row")}, leave_one_out=True).toPandas().sort_values("own_key")
    K = kernels.pdf((frame.x.to_numpy()[:, None] - frame.x.to_numpy()) / 0.1) / 0.1
    np.fill_diagonal(K, 0)
    assert np.allclose(got.n, K.sum(1))


def test_fixed_density_objective_values():
    """Least squares with adaptive neighbours on fixed points, against the definition."""
    x = np.array([-2.8, -1.5, -0.7, -0.1, 0.4, 1.2, 2.7, 4.1])
    h = plans.nn_distance(np.sort(x), x, 3, True)
    train = plans.Points([x], {}, 8)
    bw = one(h=3, kind="adaptive_nn")
    got = search.density_ls(bw, train, [np.sort(x)], np.arange(8)).sum()
    phi = lambda d, s: math.exp(-0.5 * (d / s) ** 2) / (s * math.sqrt(2 * math.pi))
    square = sum(phi(x[i] - x[j], math.hypot(h[i], h[j])) for i in range(8) for j in range(8)) / 64
    cross = sum(phi(x[i] - x[j], h[j]) for i in range(8) for j in range(8) if i != j) / 56
    assert got == pytest.approx(square - 2 * cross)


def test_regression_kinds_agree(data, frame):
    ll = regression.npreg(data, one(), "y", GRID, "ll").toPandas().sort_values("at")
    lp = regression.npreg(data, one(), "y", GRID, "lp", (1,)).toPandas().sort_values("at")
    assert np.allclose(ll[["mean", "grad_x"]], lp[["mean", "grad_x"]])
    for p, got in zip(GRID.x, ll.itertuples(), strict=True):
        k = np.sqrt(kernels.pdf((p - frame.x.to_numpy()) / 0.1))
        b = np.linalg.lstsq(np.column_stack([np.ones(N), frame.x - p]) * k[:, None], frame.y * k, rcond=None)[0]
        assert (got.mean, got.grad_x) == (pytest.approx(b[0]), pytest.approx(b[1]))
    lc = regression.lc_gradients(data, one(), "y", GRID).toPandas().sort_values("at")
    up, down = (regression.npreg(data, one(), "y", GRID + e).toPandas().sort_values("at")["mean"].to_numpy() for e in (1e-5, -1e-5))
    assert np.allclose(lc.grad_x, (up - down) / 2e-5, atol=1e-4)


def test_hat_operators(spark, data, frame):
    points = spark.createDataFrame(GRID.assign(at=range(3)))
    for t in ("lc", "ll"):
        h = regression.hat_apply(regression.npreghat(data, one(), points, regtype=t), data).toPandas().sort_values("at")
        assert np.allclose(h.hy, regression.npreg(data, one(), "y", GRID, t).toPandas().sort_values("at")["mean"])
    ones = density.hat(data, one(), points).groupBy("at").agg(F.sum("weight").alias("d")).toPandas().sort_values("at")
    assert np.allclose(ones.d, density.npudens(data, one(), GRID).toPandas().sort_values("at").dens)
    c = Bandwidth((Variable("y"), Variable("x")), (0.3, 0.1), density.DENSITY_KERNEL)
    both = GRID.assign(y=0.2, at=range(3))
    for hat, f, v in ((api.npcdenshat, conditional.npcdens, "condens"), (api.npcdisthat, conditional.npcdist, "condist")):
        got = hat(data, c, "y", spark.createDataFrame(both)).groupBy("at").agg(F.sum("weight").alias("s")).toPandas().sort_values("at")
        assert np.allclose(got.s, f(data, c, ["y"], both).toPandas().sort_values("at")[v])
    s = api.npscoefhat(data, one(), ["w"], spark.createDataFrame(GRID.assign(w=0.7, at=range(3))))
    got = regression.hat_apply(s, data).toPandas().sort_values("at").hy.to_numpy()
    b = semiparametric.npscoef(data, one(), "y", ["w"], GRID).toPandas().sort_values("at")
    assert np.allclose(got, b.b0 + 0.7 * b.b1)


def test_searches_lower_the_objective(data):
    bw = regression.npregbw(data, "y", ["x"], rounds=6)
    at = lambda h: search.evaluate(data, [one(h=h)], search.regression("ls"), {"y": F.col("y")}, lambda s, n: s[0] / n)[0]
    assert bw.value <= min(at(0.5 * bw.h[0]), at(2 * bw.h[0]), at(0.3))
    assert regression.npregbw(data, "y", ["x"], "cv.aic", "ll", rounds=4).h[0] > 0
    assert density.npudensbw(data, ["x"], "cv.ls", rounds=4).h[0] > 0
    assert density.npudistbw(data, ["x"], rounds=4).h[0] > 0
    nn = density.npudensbw(data, ["x"], kind="generalized_nn", rounds=4)
    assert nn.h[0] == int(nn.h[0])
    assert regression.degree_search(data, "y", ["x"], 2, rounds=2)[0] in {(0,), (1,), (2,)}


def test_minimise_finds_the_least():
    f = lambda ps: [(math.log(a) - 1) ** 2 + (b - 0.3) ** 2 for a, b in ps]
    x, v, _ = search.minimise(f, [(1.0, 0.5)], (0.01, 0.0), (100.0, 1.0), (True, False), rounds=40, tolerance=1e-5)
    assert v < 1e-6 and x[0] == pytest.approx(math.e, rel=1e-2)


def test_conditional_estimates(spark, data, frame):
    bw = Bandwidth((Variable("y"), Variable("x")), (0.3, 0.1), density.DENSITY_KERNEL)
    points = spark.createDataFrame(pd.DataFrame({"x": [0.2, 0.6], "at": [0, 1]}))
    q = conditional.npqreg(data, bw, "y", [0.25, 0.75], points).toPandas()
    for r in q.itertuples():
        f = conditional.npcdist(data, bw, ["y"], pd.DataFrame({"y": [r.quantile], "x": [r.x]})).first()["condist"]
        assert f == pytest.approx(r.tau, abs=1e-6)
    m = Bandwidth(tuple(variables(data, ["z", "x"])), (0.1, 0.2), density.DENSITY_KERNEL)
    modes = conditional.npconmode(data, m, "z")
    cells = conditional.confusion(modes).toPandas()
    assert cells.n.sum() == N
    assert 0 <= conditional.classification(modes).first()["ccr"] <= 1


def test_repairs():
    r = np.random.default_rng(4)
    f, w = r.normal(0.5, 1, 30), r.random(30) + 0.1
    g = conditional.project_density(f, w)
    assert (g >= 0).all() and g @ w == pytest.approx(1)
    i = conditional.isotonic(r.random(50) * 1.4 - 0.2)
    assert (np.diff(i) >= 0).all() and i.min() >= 0 and i.max() <= 1
    assert conditional.isotonic(np.array([0.1, 0.5, 0.3, 0.9])).tolist() == pytest.approx([0.1, 0.4, 0.4, 0.9])


def test_copula(data):
    got = conditional.npcopula(data, ["x", "y"], [0.25, 0.75]).toPandas().sort_values(["u1", "u2"])
    assert (got.copula.between(0, 1)).all() and (got.copula <= got[["u1", "u2"]].min(axis=1) + 0.05).all()


def test_semiparametric_models(spark):
    r = np.random.default_rng(5)
    f = pd.DataFrame({"a": r.standard_normal(150), "b": r.standard_normal(150), "z": r.uniform(-2, 2, 150)})
    f["y"] = 1 + 2 * f.a - f.b + np.sin(f.z) + 0.1 * r.standard_normal(150)
    f["s"] = np.tanh(f.a - 0.5 * f.b) + 0.02 * r.standard_normal(150)
    d = spark.createDataFrame(f)
    model, _ = semiparametric.npplreg(d, "y", ["a", "b"], {c: one("z", 0.3) for c in ("y", "a", "b")})
    assert np.allclose(model.coef, [2, -1], atol=0.1)
    index = semiparametric.npindexbw(d, "s", ["a", "b"], rounds=8)
    assert index.beta[1] == pytest.approx(-0.5, abs=0.15)
    assert semiparametric.npindex_vcov(d, index).shape == (1, 1)
    with pytest.raises(ValueError):
        semiparametric.npindexbw(d, "s", ["a", "b"], "kleinspady")


def test_instrumental_regression(spark):
    r = np.random.default_rng(6)
    v, w = r.normal(0, 0.27, 400), r.standard_normal(400)
    z = 0.2 * w + v
    d = spark.createDataFrame(pd.DataFrame({"z": z, "w": w, "y": z * z - 0.5 * v + r.normal(0, 0.05, 400)}))
    for m in ("Landweber-Fridman", "Tikhonov"):
        assert np.isfinite(instrumental.npregiv(d, "y", ["z"], ["w"], m).phi).all()
    got = instrumental.npregivderiv(d, "y", "z", ["w"])
    assert np.isfinite(got.phi).all() and np.isfinite(got.derivative).all()
    assert instrumental.stop_index(np.array([1.0, 3.0, 2.0, 0.5, 4.0])) == 3


@pytest.mark.parametrize("kind", ["gaussian1", "gaussian2", "beta1", "fb"])
def test_boundary_kernels_integrate_to_one_over_observations(kind):
    grid = np.linspace(0, 1, 4001)
    for x in (0.02, 0.3, 0.5, 0.97):
        k = boundary.kernel(np.array([[x]]), grid[None], 0.15, 0, 1, kind)[0]
        assert ((k[1:] + k[:-1]) / 2).sum() / 4000 == pytest.approx(1, abs=0.01)


def test_boundary_estimates(data):
    f, h = boundary.npuniden_boundary(data, "x", np.linspace(0, 1, 11), 0.1, 0.0, 1.0)
    assert f.count() == 11 and h == 0.1
    s = boundary.npuniden_sc(data, "x", 0.1, shape="mono.decr", points=30).toPandas()
    assert (np.diff(s.f_sc) <= 1e-6).all()
    c = boundary.npuniden_reflect(data, "x", np.array([0.0, 1.0]), 0.1).toPandas().sort_values("x")
    assert c.dist.tolist() == pytest.approx([0, 1], abs=1e-9)
    with pytest.raises(ValueError):
        boundary.npuniden_boundary(data, "x", np.array([0.5]), 0.1, 0.5, 1.0)


def test_entropy_tests_take_whole_tables(spark):
    r = np.random.default_rng(3)
    a, b = r.normal(size=6000), r.normal(0.2, 1.1, size=7000)
    x, y = (spark.createDataFrame(pd.DataFrame({"v": v, "w": np.roll(v, 1), "i": np.arange(len(v))})) for v in (a, b))
    t = inference.npunitest(x, y, "v", "v", bw_x=0.3, bw_y=0.25, boot_num=9)
    assert np.isclose(t.statistic[0], inference.hellinger(a, b, 0.3, 0.25)) and t.replicates.shape == (9, 1) and t.p[0] == 0
    assert np.isclose(inference.npsymtest(x, "v", bw=0.3, boot_num=0).statistic[0], inference.hellinger(a, 2 * a.mean() - a, 0.3, 0.3))
    assert inference.npdeptest(x, "v", "w", 0).statistic[0] < 0.01
    assert inference.npsdeptest(x, "v", "i", 1, 0).statistic.max() < 0.01


def test_searches_descend_from_every_start():
    """The better start lies in the worse of two valleys."""
    f = lambda xs: [min((x[0] - 1) ** 2 + 0.5, 0.1 * (x[0] - 8) ** 2) for x in xs]
    x, v, _ = search.minimise(f, [(1.0,), (4.5,)], (0.0,), (10.0,), (False,), rounds=1)
    start = search.minimise(f, [(1.0,)], (0.0,), (10.0,), (False,), rounds=1)
    other = search.minimise(f, [(4.5,)], (0.0,), (10.0,), (False,), rounds=1)
    assert v == min(start[1], other[1]) == other[1] < start[1] and x == other[0]


def test_unknown_methods_are_refused(data):
    bw = Bandwidth(tuple(variables(data, ["x", "z"])), (0.1, 0.1))
    for call in (
        lambda: inference.npsigtest(data, "y", bw, boot_num=9, boot_method="pairwise"),
        lambda: inference.npcmstest(data, "y", one(), 9, "pairwise"),
        lambda: inference.npsymtest(data, "x", boot_method="pairwise", boot_num=9),
        lambda: plotdata.bands(np.zeros(2), np.zeros((9, 2)), kind="all"),
        lambda: plotdata.block_counts(np.random.default_rng(0), 5, plotdata.BootControl("wild")),
    ):
        with pytest.raises(ValueError, match="there are"):
            call()


def test_tests_have_power_and_size(spark, data, frame):
    same = inference.npdeneqtest(data, data, one(), one(), 19)
    assert same.p[0] > 0.5
    assert inference.npcmstest(data, "y", one(), 29).p[0] < 0.1
    assert inference.npunitest(data, data, "x", "w", boot_num=19).p[0] < 0.1
    assert inference.npdeptest(data, "x", "y", 19).p[0] < 0.2
    assert inference.npsigtest(data, "y", Bandwidth(tuple(variables(data, ["x", "z"])), (0.1, 0.1)), boot_num=19).p.max() < 0.2
    assert inference.npqcmstest(data, "y", one(), 0.5, 19).replicates.shape == (19, 1)
    again = inference.npdeneqtest(data, data, one(), one(), 19)
    assert (again.replicates == same.replicates).all()
    with pytest.raises(ValueError):
        inference.npdeneqtest(data, data, one(), one(), 5)


def test_quantile_regression_is_a_least_check_loss():
    r = np.random.default_rng(7)
    X = np.column_stack([np.ones(101), r.standard_normal(101)])
    y = X @ [1.0, 2.0] + r.standard_normal(101)
    loss = lambda f: float(np.sum((y - f) * (0.3 - (y - f < 0))))
    best = min(loss(X @ np.linalg.solve(X[[i, j]], y[[i, j]])) for i in range(101) for j in range(i))
    assert loss(inference.quantile_regression(X, y, 0.3)) == pytest.approx(best, rel=1e-3)


def test_bands(data):
    bw = one()
    points = plotdata.slice_points(data, bw, "x", plotdata.GridControl(5))
    for kind in ("pointwise", "bonferroni", "simultaneous", "pmzsd"):
        b = plotdata.regression_band(data, bw, "y", points, control=plotdata.BootControl(number=99), kind=kind).toPandas()
        assert (b.lower <= b.upper).all()
    assert plotdata.block_counts(np.random.default_rng(0), 50, plotdata.BootControl("geom", block=4)).sum() == 50


def test_metrics(data, frame):
    assert metrics.spread(data, "x") == pytest.approx(min(frame.x.std(), (frame.x.quantile(0.75) - frame.x.quantile(0.25)) / 1.349, 1.4826 * (frame.x - frame.x.median()).abs().median()))
    q = metrics.quantiles(data, Variable("x"), [0.1, 0.5]).toPandas().sort_values("prob")
    assert np.allclose(q.value, frame.x.quantile([0.1, 0.5]))
    assert len(metrics.block_length(data, "w", "row")) == 2


def test_formulas_and_validation(data):
    f = formula("y1 + y2 ~ factor(a) + ordered(b) | z")
    assert f.left == ("y1", "y2") and f.right == (unordered("a"), ordered("b")) and f.smooth == ("z",)
    for bad in ("y", "y ~ ", "y ~ x ~ z"):
        with pytest.raises(ValueError):
            formula(bad)
    with pytest.raises(ValueError):
        one(h=-1)
    with pytest.raises(ValueError):
        Bandwidth((Variable("z", "unordered", ("a", "b")),), (0.6,))
    with pytest.raises(TypeError):
        variables(data.withColumn("d", F.current_date()), ["d"])
    with pytest.raises(ValueError):
        density.npudist(data, Bandwidth(tuple(variables(data, ["z"])), (0.1,)), pd.DataFrame({"z": ["a"]}))
    with pytest.raises(plans.TooManyPairs):
        plans.collect(data, one(), 10)
    assert polynomials.terms((1, 2)) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert polynomials.dimension((2, 2), "additive") == 5 and polynomials.dimension((2, 2), "tensor") == 9


def test_missing_rows_and_predictions(spark, frame):
    f = frame[["x", "y"]].copy()
    f.loc[3, "x"] = None
    d = spark.createDataFrame(f.astype(object).where(f.notna(), None), "x double, y double")
    fit = api.npreg("y ~ x", d, one())
    got = fit.predict(pd.DataFrame({"x": [0.5, float("nan")]})).toPandas().sort_values("at")
    assert np.isfinite(got["mean"].iloc[0]) and np.isnan(got["mean"].iloc[1])
    assert fit.fitted().count() == N - 1 and "r2" in fit.summary() and "regression" in repr(fit)
    assert fit.gradients(GRID).count() == fit.se(GRID).count() == 3
    assert api.npudens("~ x", d, one()).summary()["rows"] == N - 1
    assert api.npksum("y ~ x", d, one(), GRID).columns == ["at", "x", "y"]


def test_leave_one_out_beyond_the_limit(spark, monkeypatch):
    """Large tables are summed at distinct values, part by part, or by buckets, with the own term taken off."""
    from smoothlake.plans import ksum as plans

    r = np.random.default_rng(4)
    frame = pd.DataFrame({"a": r.integers(0, 60, 300) / 7.0, "c": r.choice(["u", "v", "w"], 300), "y": r.normal(size=300)})
    data = spark.createDataFrame(frame).repartition(3)
    mixed = Bandwidth(tuple(variables(data, ["a", "c"])), (0.7, 0.2), Kernel("gaussian"))
    for bw, operators, power in ((mixed, {}, 1), (mixed, {}, 2), (mixed, {"a": "integral"}, 1), (mixed.of(["a"]), {}, 1), (Bandwidth((Variable("a"),), (0.7,), Kernel("epanechnikov")), {}, 1)):
        got = []
        for most in (200_000, 40):
            monkeypatch.setattr(plans, "MOST_POINTS", most)
            out = plans.ksum(data, bw, pd.DataFrame(), {"n": F.lit(1.0), "s": F.col("y")}, operators=operators, power=power, leave_one_out=True)
            assert out.count() == 300
            got.append(sorted(zip(*(np.round(out.toPandas()[c], 7) + 0.0 for c in ("own_s", "n", "s")), strict=True)))
        assert np.allclose(got[0], got[1], atol=1e-6)


def test_user_kernels_are_integrated():
    from smoothlake.functions import kernels

    z = np.linspace(-2.4, 2.4, 41)
    k = kernels.UserKernel(lambda z: np.where(np.abs(z) < 1, 0.75 * (1 - z * z), 0.0), 1.0)
    t = np.clip(z, -1, 1)
    assert np.allclose(kernels.cdf(z, k), 0.5 + 0.75 * (t - t**3 / 3), atol=1e-6)
    u = np.abs(z)
    assert np.allclose(kernels.convolution(z, k), np.where(u < 2, 3 / 160 * (2 - u) ** 3 * (u * u + 6 * u + 4), 0), atol=1e-5)
    inner = np.abs(np.abs(z) - 1) > 0.05
    assert np.allclose(kernels.derivative(z, k)[inner], np.where(np.abs(z) < 1, -1.5 * z, 0)[inner], atol=1e-3)
    with pytest.raises(ValueError):
        kernels.pdf_column(F.lit(0.0), k)


def test_families_of_polynomials_span_the_same():
    from smoothlake.operators import polynomials

    r = np.random.default_rng(1)
    x = [r.normal(size=50), r.normal(size=50)]
    y = r.normal(size=50)
    for basis in ("tensor", "additive"):
        fits = []
        for kind in ("raw", "legendre", "bernstein"):
            B = polynomials.powers(x, (3, 2), f"{basis}:{kind}")
            D = polynomials.powers(x, (3, 2), f"{basis}:{kind}", (1, 0))
            c = np.linalg.lstsq(B, y, rcond=None)[0]
            fits.append(np.concatenate([B @ c, D @ c]))
        assert np.allclose(fits[0], fits[1]) and np.allclose(fits[0], fits[2])
    with pytest.raises(ValueError):
        polynomials.powers(x, (1, 1), "glp:chebyshev")


def test_singular_systems_go_to_the_local_constant_mean():
    """Points of one value only: every slope fits, and the ridge leaves the mean."""
    B = np.stack([np.ones(6), np.full(6, 2.0)], 1)
    y = np.arange(6.0)
    got = polynomials.solve((B.T @ B)[None], (B.T @ y)[None, :, None])[0, :, 0]
    assert got @ [1.0, 2.0] == pytest.approx(y.mean(), rel=1e-3)
    dead = polynomials.solve(np.zeros((1, 2, 2)), np.zeros((1, 2, 1)))
    assert np.isnan(dead).all()
    bw = Bandwidth((Variable("x"),), (1.0,))
    train = plans.Points([np.r_[np.zeros(4), 5.0]], {}, 5)
    K = np.array([[1.0, 1, 1, 1, 0], [1, 1, 1, 1, 1]])
    H = polynomials.hat_rows(K, train, bw, [np.array([0.0, 0.0])], (1,))
    assert np.allclose(H[0], [0.25, 0.25, 0.25, 0.25, 0], atol=1e-6) and np.allclose(H.sum(1), 1)


def test_nelder_mead_finds_minima():
    f = lambda p: (p[0] - 1.5) ** 2 + 3 * (p[1] + 0.5) ** 2 + 0.5 * (p[0] - 1.5) * (p[1] + 0.5)
    at, value, tried = search.nelder_mead(lambda points: [f(p) for p in points], (0.0, 0.0), (0.5, 0.5), (-5.0, -5.0), (5.0, 5.0))
    assert np.allclose(at, (1.5, -0.5), atol=1e-2) and value < 1e-4 and tried > 10
    at, _, _ = search.nelder_mead(lambda points: [f(p) for p in points], (0.0, 0.0), (0.5, 0.5), (-5.0, -5.0), (1.0, 5.0))
    assert at[0] == pytest.approx(1.0, abs=1e-3)  # the bound


def test_design_condition(spark, data):
    B = polynomials.powers([np.array(c) for c in data.select("x", "w").toPandas().T.to_numpy()], (2, 1), "tensor")
    assert polynomials.design(data, ["x", "w"], (1, 1)) < polynomials.design(data, ["x", "w"], (3, 2)) and B.shape == (N, 6)
    with pytest.raises(ValueError):
        polynomials.design(data.withColumn("v", F.col("x") * 2 + 1), ["x", "v"], (1, 1))


def test_instrumental_regression_with_cross_validation(spark):
    r = np.random.default_rng(5)
    n = 250
    v, w = r.normal(0, 0.27, n), r.normal(size=n)
    z = 0.4 * w + v
    frame = pd.DataFrame({"z": z, "w": w, "y": z**2 - 0.5 * v + r.normal(0, 0.05, n)})
    data = spark.createDataFrame(frame)
    m = api.npregiv("y ~ z | w", data, smooth="cv")
    inner = np.abs(m.z[:, 0]) < 0.8
    error = np.sqrt(np.mean((m.phi - m.phi.mean() - m.z[:, 0] ** 2 + (m.z[:, 0] ** 2).mean())[inner] ** 2))
    spread = np.std(m.z[inner, 0] ** 2)
    assert error < 0.8 * spread and 1 <= m.iterations <= len(m.stop)
    columns = instrumental._columns(data, ["y", "w"])
    h = instrumental.cross_validated(columns[1:], columns[0], 1, [instrumental.reference(columns[1])])
    losses = []
    for f in (h[0], 0.2 * h[0], 6 * h[0]):
        H = instrumental.smoother(columns[1:], [f], 1)
        losses.append(np.mean(((columns[0] - H @ columns[0]) / (1 - np.diag(H))) ** 2))
    assert losses[0] <= min(losses[1:])
    with pytest.raises(ValueError):
        api.npregiv("y ~ z", data)
    with pytest.raises(ValueError):
        api.npregiv("y ~ z | w", data, smooth="guess")


def test_lags_of_long_series_are_cut_in_blocks(spark):
    r = np.random.default_rng(3)
    frame = pd.DataFrame({"t": r.permutation(400) * 3, "v": r.normal(size=400).round(3)})
    data = spark.createDataFrame(frame).repartition(5)
    v = frame.sort_values("t")["v"].tolist()
    want = sorted((v[i], v[i - 1] if i >= 1 else None, v[i - 9] if i >= 9 else None) for i in range(400))
    for rows in (10_000, 60, 7):
        got = metrics.lags(data, F.col("v"), "t", [1, 9], rows)
        assert sorted((tuple(x) for x in got.collect()), key=str) == sorted(want, key=str)
    assert "SinglePartition" not in metrics.lags(data, F.col("v"), "t", [1], 60)._jdf.queryExecution().executedPlan().toString()
    assert metrics.lags(data.limit(0), F.col("v"), "t", [1], 60).count() == 0


def test_pairs_equal_matrices():
    """By interpolation on a line, by tiles and by distinct rows, against a matrix of all pairs."""
    from smoothlake.functions import kernels
    from smoothlake.plans.line import Pairs

    r = np.random.default_rng(11)
    v = np.r_[r.uniform(-9, 99, 2500), 5000 + r.normal(0, 3, 300), -200.0]
    w = r.normal(size=len(v))
    for order in (2, 6):
        p = Pairs(Bandwidth((Variable("v"),), (4.0,), Kernel("gaussian", order)), [v])
        assert p.line is not None
        for operator, power in (("normal", 1), ("normal", 2), ("integral", 1), ("convolution", 1), ("derivative", 1)):
            K = (kernels.CONTINUOUS[operator]((v[:, None] - v) / 4.0, "gaussian", order)) ** power
            got = p.dot(p.totals(w), operator, False, power)[p.which]
            assert np.allclose(got, K @ w, rtol=0, atol=1e-12 * (abs(K) @ abs(w)).max())
    K = kernels.pdf((v[:, None] - v) / 4.0) / 4
    p = Pairs(one("v", 4.0), [v])
    assert np.isclose(p.forms([(p.totals(w), p.totals(w))], (1,))[0][0], w @ K @ w, rtol=1e-10)
    u = np.round(v)
    for columns, names in (([u, np.round(w)], ("u", "w")), ([v, w], ("v", "w"))):
        p = Pairs(Bandwidth(tuple(map(Variable, names)), (4.0, 1.0)), columns)
        K = kernels.pdf((columns[0][:, None] - columns[0]) / 4.0) / 4 * kernels.pdf(columns[1][:, None] - columns[1])
        assert p.line is None and np.allclose(p.dot(p.totals(w))[p.which], K @ w)
        assert np.allclose(p.own()[p.which], np.diag(K))


def test_density_equality_takes_whole_tables(spark):
    r = np.random.default_rng(12)
    a, b = r.normal(size=300), r.normal(0.3, 1.0, size=400)
    make = lambda v: spark.createDataFrame(pd.DataFrame({"x": v}))
    t = inference.npdeneqtest(make(np.repeat(a, 80)), make(np.repeat(b, 60)), one("x", 0.3), one("x", 0.25), 0)
    n, m = 24_000, 24_000

    def pair(u, v, h, k, own):
        K = np.exp(-0.5 * ((u[:, None] - v) / h) ** 2) / (h * np.sqrt(2 * np.pi))
        return k * k * np.array([K.sum(), (K * K).sum()]) - (own * np.array([K[0, 0], K[0, 0] ** 2]) if own else 0)

    (s1, q1), (s2, q2) = pair(a, a, 0.3, 80, n), pair(b, b, 0.25, 60, m)
    s3, q3 = pair(b, a, 0.3, 1, 0) * 80 * 60
    i_n = s1 / (n * (n - 1)) + s2 / (m * (m - 1)) - 2 * s3 / (n * m)
    assert t.statistic[1] == pytest.approx(i_n, rel=1e-8)
    assert t.statistic[0] == pytest.approx(i_n / np.sqrt(2 * (q1 / (n * (n - 1)) ** 2 + q2 / (m * (m - 1)) ** 2 + 2 * q3 / (n * m) ** 2)), rel=1e-8)


def test_density_equality_replicates_take_whole_tables(spark):
    r = np.random.default_rng(13)
    x, y = (spark.createDataFrame(pd.DataFrame({"x": r.normal(size=n)})) for n in (20_500, 500))
    t = inference.npdeneqtest(x, y, one("x", 0.3), one("x", 0.25), 9)
    assert t.replicates.shape == (9, 2) and np.isfinite(t.replicates).all()


@pytest.fixture(scope="module")
def many(spark):
    """More rows than fit a matrix of all pairs, few of them distinct."""
    r = np.random.default_rng(14)
    f = pd.DataFrame({"x": r.integers(0, 25, 5200) / 1.0, "z": r.choice(["a", "b", "c"], 5200)})
    f["y"] = np.cos(f.x / 6) + (f.z == "b") + 0.25 * r.standard_normal(len(f))
    return f


def test_specification_takes_whole_tables(spark, many):
    x, y = many.x.to_numpy(), many.y.to_numpy()
    K = kernels.pdf((x[:, None] - x) / 3.0) / 3
    np.fill_diagonal(K, 0)
    e = y - np.polyval(np.polyfit(x, y, 1), x)
    want = len(x) * np.sqrt(3) * (e @ K @ e / len(x) ** 2) / np.sqrt(2 * 3 * ((e * e) @ (K * K) @ (e * e)) / len(x) ** 2)
    assert inference.npcmstest(spark.createDataFrame(many), "y", one("x", 3.0), 0).statistic[0] == pytest.approx(want, rel=1e-9)


def test_specification_replicates_take_whole_tables(spark, many):
    t = inference.npcmstest(spark.createDataFrame(many), "y", one("x", 3.0), 9, "wild")
    assert t.replicates.shape == (9, 1) and t.p[0] == 0


def test_quantile_specification_takes_whole_tables(spark, many):
    t = inference.npqcmstest(spark.createDataFrame(many), "y", one("x", 3.0), 0.5, 9)
    assert t.replicates.shape == (9, 1) and t.p[0] == 0


def test_significance_takes_whole_tables(spark, many):
    data = spark.createDataFrame(many.head(3100))
    bw = Bandwidth(tuple(variables(data, ["x", "z"])), (3.0, 0.2))
    t = inference.npsigtest(data, "y", bw, boot_num=9)
    train = plans.collect(data, bw, y=F.col("y"))
    y, n = train.extra["y"], train.n
    hat = lambda x, by=(): polynomials.hat_rows(plans.product(bw, x, train.columns, list(bw.h), {}, False), train, bw, x, (1,), by=by)
    e2 = (y - hat(train.columns) @ y) ** 2
    size = lambda h: np.mean((h @ y) ** 2 / ((h * h) @ e2))
    levels = [hat([train.columns[0], np.full(n, k)]) for k in np.unique(train.columns[1])]
    want = [size(hat(train.columns, (1,))), np.mean([size(h - levels[0]) for h in levels[1:]])]
    assert np.allclose(t.statistic, want, rtol=1e-7) and t.replicates.shape == (9, 2) and t.p[1] == 0
    joint = inference.npsigtest(data, "y", bw, boot_num=0, joint=True)
    assert joint.statistic[0] == pytest.approx(sum(want))


@pytest.fixture(scope="module")
def instruments():
    """More rows than fit matrices of all pairs; z has many distinct values and w few, rounded has few of both."""
    r = np.random.default_rng(15)
    v, w = r.normal(0, 0.27, 4100), np.round(r.standard_normal(4100) * 8) / 8
    z = 0.2 * w + v
    return pd.DataFrame({"z": z, "rounded": np.round(z * 20) / 20, "w": w, "y": z * z - 0.5 * v + r.normal(0, 0.05, 4100)})


def _matrices(f: pd.DataFrame, z: str):
    Z, W = f[z].to_numpy(), f.w.to_numpy()
    return instrumental.smoother([Z], [instrumental.reference(Z)], 1), instrumental.smoother([W], [instrumental.reference(W)], 1)


def test_landweber_takes_whole_tables(spark, instruments):
    for z in ("rounded", "z"):
        got = instrumental.npregiv(spark.createDataFrame(instruments), "y", [z], ["w"], iterate_max=6)
        Kz, Kw = _matrices(instruments, z)
        E = Kw @ instruments.y.to_numpy()
        phi = Kz @ E
        for k in range(1, got.iterations):
            phi = phi + 0.5 * (Kz @ (E - Kw @ phi))
        assert len(got.stop) == 6 and np.allclose(got.z[:, 0], instruments[z]) and np.allclose(got.phi, phi, atol=1e-9)


def test_tikhonov_takes_whole_tables(spark, instruments):
    for z in ("rounded", "z"):
        got = instrumental.npregiv(spark.createDataFrame(instruments), "y", [z], ["w"], "Tikhonov", alpha=0.01)
        Kz, Kw = _matrices(instruments, z)
        r = Kz @ (Kw @ instruments.y.to_numpy())
        assert np.allclose(0.01 * got.phi + Kz @ (Kw @ got.phi), r, atol=1e-8)


def test_instrumental_derivative_takes_whole_tables(spark, instruments):
    """The second half of the rows has the z and w of the first: the same derivative as of the first alone, with their bandwidths."""
    half = instruments.head(2050)
    hz, hw = instrumental.reference(half.z.to_numpy()), [instrumental.reference(half.w.to_numpy())]
    got, want = (instrumental.npregivderiv(spark.createDataFrame(f), "y", "z", ["w"], hz, hw, iterate_max=20) for f in (pd.concat([half, half]), half))
    assert len(got.phi) == 4100 and got.iterations == want.iterations
    # the mean by rows and the centred integral are the same for doubled rows
    assert np.allclose(got.derivative[::2], want.derivative, rtol=1e-5, atol=1e-6) and np.allclose(got.phi[::2], want.phi, rtol=1e-6, atol=1e-7)


def test_smoothers_agree(spark, instruments):
    """By matrix, on a line and by tiles, their fits and own weights."""
    z, y = instruments.z.to_numpy(), instruments.y.to_numpy()
    for degree in (0, 1):
        H = instrumental.smoother([z], [0.1], degree)
        S = instrumental.Smoother([z], [0.1], degree)
        assert S.pairs.line is not None
        tiles = instrumental.Smoother([z, z], [0.1 * np.sqrt(2)] * 2, 0)
        assert np.allclose(S(y), H @ y, atol=1e-10) and np.allclose(S.own()[S.which], np.diag(H), atol=1e-10)
        if not degree:
            assert np.allclose(tiles(y), H @ y, atol=1e-10) and np.allclose(tiles.own()[tiles.which], np.diag(H), atol=1e-10)


def test_regression_bands_take_whole_tables(spark, frame):
    """A row drawn many times is many rows: the fit is that of the few distinct ones, by every method."""
    many = pd.concat([frame[["x", "y"]]] * 260)
    points = pd.DataFrame({"x": [0.2, 0.5, 0.8]})
    few, data = spark.createDataFrame(frame[["x", "y"]]), spark.createDataFrame(many)
    for regtype, method in (("lc", "inid"), ("ll", "geom"), ("ll", "wild")):
        b = plotdata.regression_band(data, one(), "y", points, regtype, control=plotdata.BootControl(method, 19, block=3)).toPandas()
        want = regression.npreg(few, one(), "y", points, regtype).toPandas().sort_values("at")["mean"]
        assert np.allclose(b["mean"], want) and (b.lower < b.upper).all() and (b.upper - b.lower).max() < 0.1
        assert method == "wild" or ((b.lower < b["mean"]) & (b["mean"] < b.upper)).all()  # wild draws smooth the fit again


def test_regression_band_replicates_equal_weighted_fits(spark, frame):
    data = spark.createDataFrame(frame[["x", "y"]])
    points = pd.DataFrame({"x": [0.2, 0.5, 0.8]})
    control = plotdata.BootControl(number=19)
    train = plans.collect(data, one(), y=F.col("y"))
    for regtype, degree in (("lc", ()), ("ll", (1,))):
        K = kernels.pdf((points.x.to_numpy()[:, None] - train.columns[0]) / 0.1)
        boot = np.stack([polynomials.fit_rows(K * plotdata.block_counts(np.random.default_rng([42, i]), train.n, control), train, one(), train.extra["y"], [points.x.to_numpy()], degree)[0] for i in range(19)])
        b = plotdata.regression_band(data, one(), "y", points, regtype, control=control).toPandas()
        assert np.allclose(b.lower, np.quantile(boot, 0.025, 0)) and np.allclose(b.upper, np.quantile(boot, 0.975, 0))


def test_density_bands_take_whole_tables(spark):
    v = np.random.default_rng(16).normal(size=20_300)
    data, points = spark.createDataFrame(pd.DataFrame({"x": v})), pd.DataFrame({"x": [-1.0, 0.0, 1.0]})
    for distribution in (False, True):
        b = plotdata.density_band(data, one("x", 0.3), points, distribution, plotdata.BootControl("geom", 19, block=3)).toPandas()
        z = (points.x.to_numpy()[:, None] - v) / 0.3
        want = (kernels.cdf(z) if distribution else kernels.pdf(z) / 0.3).mean(1)
        assert np.allclose(b.fit, want) and (b.lower < b.fit).all() and (b.fit < b.upper).all()


def test_plug_in_bandwidths_take_whole_tables(spark):
    v = np.random.default_rng(17).normal(size=2500)
    x = np.tile(v, 9)
    n, h = len(x), inference.plug_in(x)
    z = v[:, None] - v

    def psi(power, g):
        u = (z / g) ** 2
        poly = u * u - 6 * u + 3 if power == 4 else u**3 - 15 * u * u + 45 * u - 15
        return 81 * (poly * kernels.pdf(np.sqrt(u))).sum() / (n * (n - 1) * g ** (power + 1))

    scale = min(x.std(ddof=1), (np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.349)
    c = 1.357 * abs(psi(4, 1.24 * scale * n ** (-1 / 7)) / psi(6, 1.23 * scale * n ** (-1 / 9))) ** (1 / 7)
    assert h == pytest.approx((1 / (2 * np.sqrt(np.pi) * n * psi(4, c * h ** (5 / 7)))) ** 0.2, rel=1e-6)
    t = inference.npsymtest(spark.createDataFrame(pd.DataFrame({"x": x})), "x", boot_num=9)
    assert t.detail["h"] == pytest.approx(h) and t.replicates.shape == (9, 1)


def _both(monkeypatch, call, most=400):
    """What a call gives with tables that may go to all tasks, and with those beyond."""
    out = []
    for n in (200_000, most):
        monkeypatch.setattr(plans, "MOST_POINTS", n)
        out.append(call())
    return out


@pytest.fixture(scope="module")
def long(spark):
    """Enough values on a line to be interpolated, one of them alone far off."""
    r = np.random.default_rng(18)
    f = pd.DataFrame({"a": np.r_[np.round(r.uniform(0, 4, 598), 3), 30.0, 45.0], "g": r.integers(0, 9, 600) / 2.0, "c": r.choice(["u", "v", "w"], 600)})
    f["y"] = np.sin(f.g) + 0.3 * f.a + r.normal(size=600)
    return spark.createDataFrame(f).repartition(3).cache()


def test_density_objectives_of_large_tables(long, monkeypatch):
    mixed = Bandwidth(tuple(variables(long, ["a", "c"])), (0.7, 0.2))
    for loss in (search.density_ml, search.density_ls):
        for bw in (one("a", 1.0), one("g", 0.5), mixed):
            few, whole = _both(monkeypatch, lambda: search.evaluate(long, [bw], loss)[0])
            assert whole == pytest.approx(few, rel=1e-9), bw


def test_regression_objectives_of_large_tables(long, monkeypatch):
    y = {"y": F.col("y")}
    for bw in (one("a", 1.0), one("g", 0.5)):
        for method, finish in (("ls", lambda s, n: s[0] / n), ("aic", search.aic_corrected)):
            few, whole = _both(monkeypatch, lambda: search.evaluate(long, [bw], search.regression(method), y, finish)[0])
            assert whole == pytest.approx(few, rel=1e-8)


def test_regression_objectives_of_more_rows_than_go_to_all_tasks(spark):
    """Whole, with no limit moved, against sums by distinct x."""
    n, h = 200_100, 3.0
    i = np.arange(n)
    x, y = i % 23, i % 7 + 0.5 * (i % 23)
    K = kernels.pdf((np.arange(23)[:, None] - np.arange(23)) / h)
    near, total, own = (K @ np.bincount(x))[x], (K @ np.bincount(x, y))[x], K[0, 0]
    left_out, fit = (total - own * y) / (near - own), total / near
    data = spark.range(n).select((F.col("id") % 23).cast("double").alias("x"), (F.col("id") % 7 + 0.5 * (F.col("id") % 23)).alias("y"))
    objective = lambda method, finish: search.evaluate(data, [one("x", h)], search.regression(method), {"y": F.col("y")}, finish)[0]
    assert objective("ls", lambda s, m: s[0] / m) == pytest.approx(np.mean((y - left_out) ** 2), rel=1e-9)
    assert objective("aic", search.aic_corrected) == pytest.approx(search.aic_corrected([((y - fit) ** 2).sum(), (own / near).sum()], n), rel=1e-9)


def test_fits_of_large_tables(long, monkeypatch):
    for bw in (one("a", 1.0), one("g", 0.5)):
        few, whole = _both(monkeypatch, lambda: regression.fitted(long, bw, "y", carry={"k": F.col("a")}).toPandas().sort_values(["k", "y"]))
        assert list(few) == list(whole) and np.allclose(few.to_numpy(float), whole[list(few)].to_numpy(float), atol=1e-9)


def test_partially_linear_models_of_large_tables(long, monkeypatch):
    for bws in ({c: one("g", 0.5) for c in ("y", "a")}, {"y": one("g", 0.5), "a": one("g", 0.7)}):
        few, whole = _both(monkeypatch, lambda: semiparametric.npplreg(long, "y", ["a"], bws))
        assert np.allclose(few[0].coef, whole[0].coef) and np.allclose(few[0].vcov, whole[0].vcov)
        assert sorted(few[1].columns) == sorted(whole[1].columns)


def test_conditional_modes_of_large_tables(long, monkeypatch):
    bw = Bandwidth(tuple(variables(long, ["c", "a"])), (0.1, 1.0), density.DENSITY_KERNEL)
    few, whole = _both(monkeypatch, lambda: conditional.npconmode(long, bw, "c").toPandas().sort_values(["a", "actual"], ignore_index=True))
    assert list(few) == list(whole) and (few.conmode == whole.conmode).all() and np.allclose(few.condens, whole.condens)
    few, whole = _both(monkeypatch, lambda: sorted(map(tuple, conditional.confusion(conditional.npconmode(long, bw, "c")).collect())))
    assert few == whole


def test_conditional_classification_of_large_tables(long, monkeypatch):
    bw = Bandwidth(tuple(variables(long, ["c", "g"])), (0.1, 1.0), density.DENSITY_KERNEL)
    few, whole = _both(monkeypatch, lambda: conditional.classification(conditional.npconmode(long, bw, "c")).first())
    assert np.allclose(tuple(few), tuple(whole))


def test_conditional_quantiles_of_large_tables(spark, long, monkeypatch):
    points = spark.createDataFrame(pd.DataFrame({"g": [0.5, 2.0, 3.5], "at": [0, 1, 2]}))
    bw = Bandwidth((Variable("y"), Variable("g")), (0.3, 0.5))
    few, whole = _both(monkeypatch, lambda: conditional.npqreg(long, bw, "y", [0.0, 0.25, 0.9, 1.0], points).toPandas().sort_values(["at", "tau"]), 300)
    assert list(few) == list(whole) and np.allclose(few, whole)


def test_local_polynomial_densities_of_large_tables(spark, long, monkeypatch):
    points = spark.createDataFrame(pd.DataFrame({"g": [0.5, 0.5, 3.5], "y": [0.0, 1.0, 0.5], "at": [0, 1, 2]}))
    bw = Bandwidth((Variable("y"), Variable("g")), (0.3, 0.5))
    for degree in ((0,), (1,)):
        few, whole = _both(monkeypatch, lambda: conditional.local_polynomial_density(long, bw, "y", points, degree).toPandas().sort_values("at"))
        assert list(few) == list(whole) and np.allclose(few, whole)


def test_local_polynomial_distributions_of_large_tables(spark, long, monkeypatch):
    points = spark.createDataFrame(pd.DataFrame({"g": [0.5, 0.5, 3.5], "y": [0.0, 1.0, 0.5], "at": [0, 1, 2]}))
    bw = Bandwidth((Variable("y"), Variable("g")), (0.3, 0.5))
    few, whole = _both(monkeypatch, lambda: conditional.local_polynomial_density(long, bw, "y", points, (1,), distribution=True).toPandas().sort_values("at"))
    assert list(few) == list(whole) and np.allclose(few, whole)


def test_buckets_take_no_pairs(spark):
    """60,000 rows in one kernel's reach, 3,600,000,000 pairs, against the moments of all."""
    v = np.linspace(0, 1, 60_000)
    got = plans.ksum(spark.createDataFrame(pd.DataFrame({"a": v})), one("a", 1.0, EPAN), pd.DataFrame(), {"n": F.lit(1.0), "a0": F.col("a")}, leave_one_out=True, engine="buckets").toPandas().sort_values("own_a0")
    top = kernels.pdf(np.zeros(1), "epanechnikov")[0]
    want = top * (len(v) - (len(v) * v * v - 2 * v * v.sum() + (v * v).sum()) / 5) - top
    assert len(got) == len(v) and np.allclose(got["n"], want, rtol=1e-9)
