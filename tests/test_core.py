"""Kernels, Fourier sums, solvers, models and analytics against dense numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel, bessel_k, choose_grid
from kernelspark.operators import analytics, fourier, gp, interpolation, machine, solvers
from kernelspark.sources import tables as S


def points(spark, n=300, dim=1, seed=1, noise=0.1):
    return S.random_points(spark, n, dim, seed, noise).cache()


def arrays(df, dim):
    t = df.orderBy("id").toPandas()
    return t[[f"x{k + 1}" for k in range(dim)]].to_numpy(), t["y"].to_numpy()


@pytest.mark.parametrize(("family", "nu"), [("se", 0.5), ("matern", 0.5), ("matern", 1.5), ("matern", 2.5), ("matern", 0.9)])
@pytest.mark.parametrize("dim", [1, 2, 3])
def test_fourier_series_gives_the_kernel_back(family, nu, dim):
    k = Kernel(family, dim, 0.2, 1.3, nu)
    g = choose_grid(k, 1e-3) if dim < 3 else choose_grid(k, 1e-2)
    if g.size > 3_000_000:
        g = Grid(dim, g.h, 60)
    x = np.array([0.31, 0.12, 0.2])[:dim]
    j = g.modes()
    got = float((g.weights(k) ** 2 * np.cos(2 * math.pi * g.h * (j @ x))).sum())
    assert got == pytest.approx(float(k.k(np.linalg.norm(x))), abs=3e-2)


def test_bessel_equals_closed_forms():
    z = np.array([0.05, 0.7, 4.0])
    assert np.allclose(bessel_k(0.5, z), np.sqrt(math.pi / (2 * z)) * np.exp(-z), rtol=1e-8)
    for nu in (0.5, 1.5, 2.5):
        a, b = Kernel("matern", 1, 0.3, 1.0, nu), Kernel("matern", 1, 0.3, 1.0, nu + 1e-9)
        assert np.allclose(a.k(np.array([0.1, 0.5])), b.k(np.array([0.1, 0.5])), rtol=1e-6)
    k = Kernel("se", 1, 0.1)
    assert k.k(k.radius(1e-4)) == pytest.approx(1e-4, rel=1e-6)
    with pytest.raises(ValueError, match="no such kernel"):
        Kernel("other", 1, 1.0)


def test_integral_cut_off_is_no_worse_than_asked():
    k = Kernel("matern", 1, 0.2, 1.0, 1.5)
    g = choose_grid(k, 1e-4, integral=True)
    far = g.h * np.arange(g.m + 1, g.m + 200_000)
    assert 2 * g.h * k.khat(far).sum() <= 2e-4


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_both_forms_of_the_sums_equal_the_direct_sum(spark, dim):
    df = points(spark, 120, dim)
    x, y = arrays(df, dim)
    g = Grid(dim, 0.7, 2)
    for form in ("sql", "arrow"):
        lags, rhs, n = fourier.statistics(df, g, form)
        assert n == 120
        assert np.allclose(rhs.ravel(), np.exp(-2j * math.pi * g.h * g.modes() @ x.T) @ y)
        assert np.allclose(lags.ravel(), np.exp(-2j * math.pi * g.h * Grid(dim, 0.7, 4).modes() @ x.T).sum(1))
    f = np.random.default_rng(0).standard_normal([5] * dim) + 0j
    got = fourier.type2_arrow(df.select("id", *[f"x{k + 1}" for k in range(dim)]), f, g.h).orderBy("id").toPandas()["value"]
    assert np.allclose(got, (np.exp(2j * math.pi * g.h * x @ g.modes().T) @ f.ravel()).real)


def test_toeplitz_operator_equals_its_matrix():
    rng = np.random.default_rng(3)
    for dim in (1, 2):
        g = Grid(dim, 0.8, 3)
        x = rng.random((50, dim))
        lags = np.exp(-2j * math.pi * g.h * Grid(dim, 0.8, 6).modes() @ x.T).sum(1).reshape([13] * dim)
        s = fourier.System(g, rng.random(g.size), lags, 0.3)
        v = rng.standard_normal((g.size, 3)) + 1j
        assert np.allclose(s(v), s.dense() @ v) and np.allclose(s(v[:, 0]), s.dense() @ v[:, 0])
        phi = np.exp(2j * math.pi * g.h * x @ g.modes().T) * s.w
        assert np.allclose(s.dense(), phi.conj().T @ phi + 0.3 * np.eye(g.size))


def spd(n=60, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))[0]
    t = 10.0 ** np.linspace(4, 0, n)
    return (q * t) @ q.T, q, t


def test_solvers_agree_and_deflation_saves_iterations():
    a, q, t = spd()
    b = np.random.default_rng(1).standard_normal(60)
    want = np.linalg.solve(a, b)
    plain = solvers.pcg(lambda v: a @ v, b, 1e-10)
    p = solvers.Deflation(q[:, :20], t[:21])
    better = solvers.pcg(lambda v: a @ v, b, 1e-10, precond=p)
    assert np.allclose(plain.x, want) and np.allclose(better.x, want) and better.iterations < plain.iterations and better.converged
    assert np.allclose(solvers.direct(a, b).x, want)
    eta = solvers.tune_step(lambda v: a @ v, b, [0.1 / t[20], 1.5 / t[20], 5 / t[20]], 30, p)
    assert eta == 1.5 / t[20]
    assert np.allclose(solvers.richardson(lambda v: a @ v, b, eta, 1e-8, 20_000, p).x, want, atol=1e-5)
    assert solvers.richardson(lambda v: a @ v, b, 1.0, 1e-8, 500).converged is False
    flat = np.sort(np.linalg.eigvals(np.array([p.root(a @ p.root(e)) for e in np.eye(60)])).real)[::-1]
    assert flat[0] == pytest.approx(t[20], rel=1e-6)
    for bad in ({"mu": -1.0}, {"mu": 1e9}):
        with pytest.raises(ValueError):
            solvers.Deflation(q[:, :5], t[:5], **bad)
    with pytest.raises(ArithmeticError):
        solvers.pcg(lambda v: -v, b)


@pytest.mark.parametrize("method", sorted(solvers.METHODS))
def test_eigen_methods_find_the_top(method):
    a, q, t = spd(80, 2)
    got, v = solvers.top_eigen(lambda x: a @ x, 80, 6, method, 1e-6, complex_=False)
    assert len(got) == 7 and v.shape == (80, 6)
    assert np.allclose(got[:6], t[:6], rtol=1e-3)
    assert solvers.subspace_error(np.linalg.qr(v)[0], q[:, :6])["sin_max"] < 0.05


def test_quadrature_keeps_moments():
    a, _, t = spd(50, 5)
    nodes, w = solvers.lanczos_quadrature(lambda v: a @ v, 50, 0, 50, complex_=False)
    assert w.sum() == pytest.approx(1) and nodes.max() == pytest.approx(t[0], rel=1e-6)


@pytest.mark.parametrize("dim", [1, 2])
@pytest.mark.parametrize("config", [{}, {"preconditioner": "deflation"}, {"preconditioner": "nystrom"}, {"solver": "direct"}, {"solver": "richardson", "preconditioner": "deflation", "rank": 40}])
def test_fourier_model_equals_the_exact_posterior(spark, dim, config):
    df = points(spark, 250, dim)
    k = Kernel("se", dim, 0.25)
    grid = choose_grid(k, 1e-8)
    m = gp.fit(df, k, gp.Config(reg=0.05, tol=1e-10, **config), grid)
    want = gp.naive(df, df.drop("y"), k, 0.05, variance=True).orderBy("id").toPandas()
    got = m.predict(df).orderBy("id").toPandas()
    assert np.abs(got["mean"] - want["mean"]).max() < 2e-5
    assert list(got["x1"]) == list(df.orderBy("id").toPandas()["x1"])
    if not config:
        var = m.variance(df.drop("y")).orderBy("id").toPandas()
        assert np.abs(var["var"] - want["var"]).max() < 1e-4 and m.score(df) < 0.3
        assert m.summary(spark).first()["n"] == 250 and m.history(spark).count() > 1
        with pytest.raises(Exception, match="outside the box"):
            m.predict(spark.createDataFrame([(0, *[9.0] * dim)], "id long, " + ", ".join(f"x{i + 1} double" for i in range(dim)))).collect()


def test_model_round_trip(spark, tmp_path):
    df = points(spark, 100)
    m = gp.fit(df, Kernel("matern", 1, 0.3, nu=1.5), gp.Config(reg=0.1, eps=1e-3))
    m.save(spark, str(tmp_path / "model"))
    again = gp.Model.load(spark, str(tmp_path / "model"))
    a, b = (x.predict(df).orderBy("id").toPandas()["mean"] for x in (m, again))
    assert np.allclose(a, b, atol=1e-12)


def test_sums_of_parts_add_up(spark):
    df = points(spark, 200)
    g = Grid(1, 0.6, 5)
    whole = fourier.statistics(df, g)
    parts = [fourier.statistics(df.where(F.col("id") % 2 == k), g) for k in (0, 1)]
    assert np.allclose(whole[0], parts[0][0] + parts[1][0]) and np.allclose(whole[1], parts[0][1] + parts[1][1])
    k = Kernel("se", 1, 0.3)
    both = tuple(a + b for a, b in zip(*parts, strict=True))
    assert np.allclose(gp.fit(df, k, grid=g, box=([0.5], 1.0)).beta.shape, gp.fit(df, k, grid=g, box=([0.5], 1.0), stats=both).beta.shape)


def test_low_rank_and_function_space_baselines(spark):
    df = points(spark, 200)
    k = Kernel("se", 1, 0.3)
    exact = gp.naive(df, df.drop("y"), k, 0.1).orderBy("id").toPandas()["mean"]
    low = gp.nystrom(df, df.where("id % 5 = 0").drop("y"), df.drop("y"), k, 0.1).orderBy("id").toPandas()["mean"]
    assert np.abs(exact - low).max() < 1e-2
    alpha, r = gp.kernel_cg(df, k, 0.1, 1e-10)
    x, y = arrays(df, 1)
    assert r.converged and np.allclose(alpha.orderBy("id").toPandas()["alpha"], np.linalg.solve(k.k(gp.distances(x, x)) + 0.1 * np.eye(200), y), atol=1e-5)
    nodes = interpolation.fit(df, k, 0.1, 128, -0.001, 1.001)
    got = interpolation.predict(df, nodes, 128, -0.001, 1.001).orderBy("id").toPandas()["mean"]
    assert np.abs(exact - got).max() < 1e-2
    with pytest.raises(ValueError, match="dense"):
        gp.naive(df, df, k, 0.1, most=10)


def test_kernel_machine_learns_and_spectrum_is_right(spark):
    rng = np.random.default_rng(0)
    c = rng.standard_normal((4, 8)) * 2
    rows = [(i, (c[i % 4] + 0.5 * rng.standard_normal(8)).tolist(), i % 4) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, x array<double>, label int")
    z = df.where("id < 100")
    kernel = machine.laplacian(4.0)
    m = machine.train(df, z, z, kernel, 4, rank=10, epochs=6)
    got = machine.accuracy(m.predict(df)).first()
    assert got.accuracy > 0.97 and m.history[-1] < m.history[0]
    _, x, _ = machine.arrays(z)
    s = machine.Spectrum.of(kernel, x, 5)
    assert np.allclose(s.values, np.sort(np.linalg.eigvalsh(kernel(x, x) / 100))[::-1][:6]) and s.critical_batch >= 1
    assert machine.choose_rank(s.values, 10**9) == 6 and machine.choose_rank(s.values, 1) == 5
    sums = machine.batch_sums(df, machine.Machine(kernel, x, np.zeros((100, 4))), x, 4, 3, 0, [0, 1, 2])
    assert sum(v["n"][0] for v in sums.values()) == 400
    f = machine.random_features(df, 8, 4000, 2.0).where("id < 2").orderBy("id").toPandas()["features"]
    d2 = ((np.array(rows[0][1]) - np.array(rows[1][1])) ** 2).sum()
    assert float(np.dot(f[0], f[1])) == pytest.approx(math.exp(-d2 / 8), abs=0.08)


def test_generators_and_scans(spark, tmp_path):
    df = S.random_points(spark, 500, 2, 3)
    assert df.agg(F.min("x1"), F.max("x2")).first()[1] <= 1 and sorted(df.collect()) == sorted(S.random_points(spark, 500, 2, 3).repartition(7).collect())
    assert S.clustered_points(spark, 200).where("x1 between 0 and 1 and x2 between 0 and 1").count() == 200
    assert S.holed_points(spark, 300).where("abs(x1) <= 0.3 and abs(x2) <= 0.3").count() == 0
    g = S.grid_points(spark, 3, 2).orderBy("id").toPandas()
    assert g[["x1", "x2"]].to_numpy().tolist() == [[a, b] for a in (0, 0.5, 1) for b in (0, 0.5, 1)]
    assert S.grid_points(spark, 4, 1, ends=False).agg(F.max("x1")).first()[0] == 0.75
    assert S.strided(df, 10).count() == 50 and S.id_range(df, 5, 9).count() == 4
    b = S.mini_batches(df, 4, 1).groupBy("batch").count().count()
    assert b == 4
    np.arange(6, dtype="<f8").tofile(tmp_path / "v.bin")
    assert [tuple(r)[1:] for r in S.binary_doubles(spark, str(tmp_path / "v.bin"), 2).orderBy("id").collect()] == [(0, 0, 3), (1, 1, 4), (2, 2, 5)]
    train, test = S.split_by_missing(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "y double"))
    assert (train.count(), test.count()) == (1, 2)
    box, centre, length = S.into_box(df, ["x1", "x2"])
    r = box.agg(F.min("x1"), F.max("x2")).first()
    assert -0.5001 <= r[0] and r[1] <= 0.5001 and len(centre) == 2 and length > 0
    assert S.lonlat(spark.createDataFrame([(10.0, 60.0)], "lon double, lat double")).first().x1 == pytest.approx(5)
    S.append_csv(df, str(tmp_path / "c"))
    S.append_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 1000


def test_analytics_on_edges(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 4.0), ("a", 1, 0.0), ("a", 1, 3.0)], "mode string, n int, t double")
    s = {(r.mode): r for r in analytics.summarise(df, ["mode"], ["t"]).collect()}
    assert s[None].t_median == 3 and s["a"].t_p90 == pytest.approx(2.7)
    assert {r.mode: r.slope for r in analytics.local_slope(df, ["mode"], "n", "t").where("n = 2").collect()} == {None: pytest.approx(1)}
    assert [r.t_share for r in analytics.share(df.where("t = 0"), ["t"], "t").collect()] == [None]
    assert analytics.regression_metrics(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "y double, p double"), "y", "p").first().r2 is None
    assert analytics.stacked([df, df.select("mode")], ["mode"]).count() == 8
    one = analytics.error_of(df.where("n = 1").select(F.col("t").alias("k"), "t"), df.select(F.col("t").alias("k"), (F.col("t") + 1).alias("t")), "k", "t").first()
    assert one.rms == 1 and one.worst == 1


def test_streamed_sums_equal_batch_sums(spark, tmp_path):
    from kernelspark.streaming import statistics as stream

    df = S.random_points(spark, 400, 1, 9).withColumn("ts", F.timestamp_seconds(F.col("id") * 600)).select("id", (F.col("x1") - 0.6).alias("x1"), "y", "ts")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.running_sums(src, 2, 1.0).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got, want = (sorted(map(tuple, d.collect())) for d in (spark.table("sums"), stream.running_sums(df, 2, 1.0)))
    assert np.allclose(np.array(got, float), np.array(want, float)) and got[0][2] == df.where("x1 < -0.5").count() > 0
    stream.run_once(stream.windowed_sums(src, 1, 1.0, late="30 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).schema.fieldNames() == ["start", "j1", "n", "yre", "yim"]


def test_neighbours_equal_all_pairs_and_table_functions(spark):
    from kernelspark.functions import table_functions
    from kernelspark.operators.neighbours import within

    df = S.random_points(spark, 200, 2, 8).cache()
    x, _ = arrays(df, 2)
    d = gp.distances(x, x)
    got = within(df, df, 0.1).toPandas()
    assert set(zip(got.target, got.id, strict=True)) == {(a, b) for a in range(200) for b in range(200) if ((x[a] - x[b]) ** 2).sum() ** 0.5 <= 0.1} and d.shape == (200, 200)
    table_functions.register(spark)
    assert [r.j for r in spark.sql("SELECT * FROM multi_index(1, 2)").collect()] == Grid(2, 1.0, 1).modes().tolist()


def test_registered_queries_have_matching_columns():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "gp1d_mean" in e.queries()
