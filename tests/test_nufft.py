"""Fast transforms against direct sums."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel, choose_grid
from kernelspark.operators import fourier, gp, nufft
from kernelspark.sources import tables as S

CASES = {1: ((150,), (0.83,)), 2: ((15, 9), (0.7, 1.3)), 3: ((5, 3, 4), (0.7, 0.6, 1.2))}


def table(spark, d, n=400, seed=0):
    r = np.random.default_rng(seed)
    x, y = r.uniform(-1, 1, (n, d)), r.normal(size=n)
    rows = [(i, *map(float, p), float(v)) for i, (p, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"x{k + 1} double" for k in range(d)) + ", y double"), x, y


def phases(x, m, h, sign=-1):
    return [np.exp(sign * 2j * np.pi * h[k] * np.outer(x[:, k], np.arange(-m[k], m[k] + 1))) for k in range(x.shape[1])]


def direct1(x, y, m, h):
    return np.einsum({1: "n,na->a", 2: "n,na,nb->ab", 3: "n,na,nb,nc->abc"}[x.shape[1]], y, *phases(x, m, h))


def direct2(x, f, m, h):
    return np.einsum({1: "na,a->n", 2: "na,nb,ab->n", 3: "na,nb,nc,abc->n"}[x.shape[1]], *phases(x, m, h, 1), f).real


def as_array(df, m):
    t = df.toPandas()
    out = np.full([2 * k + 1 for k in m], np.nan, complex)
    out[tuple(t[f"j{k + 1}"].to_numpy() + v for k, v in enumerate(m))] = t["re"] + 1j * t["im"]
    return out


@pytest.fixture(params=["one tile", "many tiles"])
def tiling(request, monkeypatch):
    if request.param == "many tiles":
        monkeypatch.setattr(nufft, "ONE_TILE", 50)
        monkeypatch.setattr(nufft, "SIDE", {1: 40, 2: 17, 3: 15})
        monkeypatch.setattr(nufft, "DEALT", 30)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_errors_lie_below_the_tolerance(spark, tiling, d):
    m, h = CASES[d]
    df, x, y = table(spark, d)
    want = direct1(x, y, m, h)
    f = np.random.default_rng(3).normal(size=want.shape) + 1j
    at = direct2(x, f, m, h)
    for eps in (1e-4, 1e-9):
        assert abs(as_array(nufft.type1(df, m, h, "y", eps), m) - want).max() < eps * abs(y).sum()
        got = nufft.type2(df, f, h, eps).orderBy("id").toPandas()
        assert list(got.columns) == [*df.columns, "value"]
        assert abs(got["value"].to_numpy() - at).max() < eps * abs(f).sum()


def test_rows_that_take_no_part(spark, tiling):
    df, x, y = table(spark, 2, 50)
    odd = spark.createDataFrame([(90, None, 0.1, 1.0), (91, float("nan"), 0.1, 1.0), (92, 0.2, float("inf"), 1.0), (93, 0.1, 0.1, None)], df.schema)
    m, h = (4, 3), (0.5, 0.5)
    both = df.unionByName(odd).withColumn("block", F.lit("x")).withColumn("cell", F.lit(1)).withColumn("value", F.lit("old"))
    assert np.allclose(as_array(nufft.type1(both, m, h, "y"), m), direct1(x, y, m, h), atol=1e-7)
    f = np.ones((9, 7), complex)
    got = {r.id: r.value for r in nufft.type2(both, f, h).collect()}
    assert got[90] is None and got[91] is None and got[92] is None and got[93] is not None
    assert np.allclose([got[i] for i in range(50)], direct2(x, f, m, h), atol=1e-6)
    assert nufft.type1(df.limit(0), m, h, "y").count() == 0
    assert nufft.type2(df.limit(0), f, h).count() == 0


def test_repeated_rows_and_whole_periods(spark, tiling):
    rows = [(i, 0.25 * (i % 5) - 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x1 double")
    x = np.array([[r[1]] for r in rows])
    assert np.allclose(as_array(nufft.type1(df, 30, 1.0), (30,)), direct1(x, np.ones(40), (30,), (1.0,)), atol=1e-6)


@pytest.mark.parametrize("d", [1, 2])
def test_statistics_agree_in_all_forms_on_odd_rows(spark, d):
    df, _, _ = table(spark, d, 60)
    null = df.limit(3).withColumn("y", F.lit(None).cast("double")).unionByName(df.limit(2).withColumn("x1", F.lit(float("nan"))))
    g = Grid(d, 0.7, 2)
    want = fourier.statistics(df, g, "arrow")
    for form in ("sql", "arrow", "fast"):
        lags, rhs, n = fourier.statistics(df.unionByName(null), g, form)
        assert n == want[2] and np.allclose(lags, want[0], atol=1e-9) and np.allclose(rhs, want[1], atol=1e-9)


def test_a_fit_on_a_large_grid_takes_the_fast_path(spark):
    k = Kernel("matern", 1, 0.1, 1.0, 0.5)
    df = S.random_points(spark, 500, 1, 2, 0.1).cache()
    g = Grid(1, choose_grid(k, 1e-3).h, 400)
    fast, slow = gp.fit(df, k, gp.Config(reg=0.1, tol=1e-10), g), gp.fit(df, k, gp.Config(reg=0.1, tol=1e-10), g, form="arrow")
    assert np.allclose(fast.system.lags, slow.system.lags, atol=1e-7)
    a, b = (np.array([r["mean"] for r in m.predict(df).orderBy("id").collect()]) for m in (fast, slow))
    exact = fourier.type2_arrow(fast._scaled(df), fast._coefficients(), g.h).orderBy("id").toPandas()["value"].to_numpy()
    assert np.allclose(a, b, atol=1e-6) and np.allclose(a, exact, atol=1e-8)


def test_settings(spark):
    with pytest.raises(ValueError, match="dimensions"):
        nufft.Plan.of(4, 2, 1.0, 1e-6)
    with pytest.raises(ValueError, match="values for"):
        nufft.Plan.of(2, (1, 2, 3), 1.0, 1e-6)
    with pytest.raises(ValueError, match="tolerance"):
        nufft.Plan.of(1, 2, 1.0, 0.0)
    assert nufft._smooth(7) == 8 and nufft._smooth(121) == 128


@pytest.mark.parametrize("m", [(2, 2, 1), (6, 3), (20, 20)])
def test_crowded_parts_equal_scattered_cells(m, monkeypatch):
    plan = nufft.Plan.of(len(m), m, 0.8, 1e-10)
    r = np.random.default_rng(0)
    x, c = [r.uniform(-0.7, 0.7, 3000) for _ in m], r.normal(size=(2, 3000))
    side = [n + plan.width - 1 for n in plan.cells]
    block, (at, vals) = r.normal(size=side), plan.first(x)
    made = {}
    for way in (True, False):
        monkeypatch.setattr(nufft, "_crowded", lambda *_, way=way: way)
        cells: dict[int, np.ndarray] = {}
        nufft._spread_into(plan, cells, x, c)
        made[way] = cells[0], nufft._interpolate(plan, block, side, at, vals)
    assert all(np.allclose(a, b, rtol=1e-12, atol=1e-12) for a, b in zip(made[True], made[False], strict=True))


def test_few_modes_in_three_dimensions_take_products():
    plan = nufft.Plan.of(3, (2, 2, 1), 1.0, 1e-12)
    assert nufft._crowded(10_000, [n + plan.width - 1 for n in plan.cells], plan.width)
