"""Eigenvalue methods, preconditioned quadrature, interpolation on odd rows, small sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel
from kernelspark.operators import diagnostics, fourier, interpolation, solvers
from kernelspark.sources import tables as S


def matrix(values, seed=0):
    r = np.random.default_rng(seed)
    u = np.linalg.qr(r.normal(size=(len(values), len(values))))[0]
    return (u * values) @ u.T


class Counted:
    def __init__(self, a):
        self.a, self.columns = a, 0

    def __call__(self, v):
        self.columns += v.shape[1] if v.ndim == 2 else 1
        return self.a @ v


SLOW = np.exp(-np.arange(300) / 30)
CASES = {"fast decay": 1 / np.arange(1, 201) ** 1.5, "slow decay": SLOW, "repeated values": np.repeat([5.0, 3.0, 2.0, 1.0, 0.1], [3, 2, 4, 1, 70]), "low rank": np.concatenate((np.linspace(9, 4, 6), np.full(60, 0.01)))}


@pytest.mark.parametrize("method", sorted(solvers.METHODS))
@pytest.mark.parametrize("case", sorted(CASES))
def test_methods_agree_with_dense(method, case):
    values = CASES[case]
    a = matrix(values)
    t, v = solvers.top_eigen(lambda x: a @ x, len(values), 6, method, 1e-6, complex_=False)
    assert len(t) >= 6 and v.shape == (len(values), 6)
    assert np.allclose(t[:6], np.sort(values)[::-1][:6], rtol=1e-5)
    assert np.linalg.norm(a @ v - v * t[:6], axis=0).max() < 1e-4 * t[0]
    assert np.allclose(v.T @ v, np.eye(6), atol=1e-6)


def test_filters_restarts_and_preconditioners_save_products():
    a = matrix(SLOW)
    used = {}
    for method in ("subspace", "chebyshev", "block_krylov", "lobpcg"):
        op = Counted(a)
        solvers.top_eigen(op, 300, 8, method, 1e-6, complex_=False)
        used[method] = op.columns
    assert all(used[m] < 0.6 * used["subspace"] for m in ("chebyshev", "block_krylov", "lobpcg"))
    # an operator whose diagonal hides the spectrum's order: the inverse distance to it is a preconditioner
    d = np.concatenate((np.linspace(100, 90, 6), np.linspace(50, 1, 194)))
    b = np.diag(d) + 0.3 * matrix(np.linspace(1, 0, 200), 5)
    plain, helped = Counted(b), Counted(b)
    t, _ = solvers.top_eigen(plain, 200, 4, "lobpcg", 1e-8, complex_=False)
    s, _ = solvers.top_eigen(helped, 200, 4, "lobpcg", 1e-8, complex_=False, precond=lambda r: r / (105 - d)[:, None])
    assert np.allclose(t[:4], s[:4]) and helped.columns < plain.columns


def test_lobpcg_falls_back():
    a = matrix(SLOW)
    t, _ = solvers.top_eigen(lambda x: a @ x, 300, 5, "lobpcg", 1e-6, complex_=False, precond=lambda r: np.full_like(r, np.nan))
    assert np.allclose(t[:5], SLOW[:5], rtol=1e-5)


def system(spark, reg=0.05):
    df = S.random_points(spark, 300, 1, 2, 0.1)
    k, g = Kernel("se", 1, 0.2), Grid(1, 0.5, 12)
    return fourier.System(g, g.weights(k), fourier.statistics(df, g)[0], reg)


def test_single_precision_is_single(spark):
    s = system(spark)
    v = np.random.default_rng(0).normal(size=(s.size, 3)).astype(np.complex64)
    out = s.single()(v)
    assert out.dtype == np.complex64 and np.allclose(out, s(v.astype(complex)), rtol=1e-3, atol=1e-2)
    t, _ = solvers.top_eigen(s, s.size, 5, "mixed", 1e-10)
    assert np.allclose(t[:5], np.linalg.eigvalsh(s.dense())[::-1][:5], rtol=1e-9)


def test_preconditioned_spectrum(spark):
    s = system(spark)
    t, u = np.linalg.eigh(s.dense())
    p = solvers.Deflation(u[:, ::-1][:, :4], t[::-1][:5])
    atoms = diagnostics.spectral_atoms(spark, s, s.size, s.size, p, basis=True).toPandas()
    want = np.concatenate((t[:-4], np.full(4, t[-5])))
    for k in (1, 2, 3):
        assert (atoms["weight"] * atoms["node"] ** k).sum() == pytest.approx((want**k).sum(), rel=1e-6)
    assert atoms["node"].max() == pytest.approx(t[-5], rel=1e-6)
    r = diagnostics.spectrum_report(spark.createDataFrame(atoms), s.reg).first()
    assert r.label in ("flat", "ridge", "spread") and r.p99 <= r.top and r.tail_lower is None or r.tail_lower >= 0.99


def test_interpolation_on_odd_rows(spark):
    k = Kernel("se", 2, 0.3)
    df = S.random_points(spark, 200, 2, 3, 0.05).withColumns({c: F.col(c) - 0.5 for c in ("x1", "x2")}).cache()
    odd = spark.createDataFrame([(500, None, 0.1, 1.0), (501, 0.1, float("nan"), 1.0), (502, 0.1, 0.1, None)], "id long, x1 double, x2 double, y double")
    a, b = interpolation.fit(df, k, 0.1, 8), interpolation.fit(df.unionByName(odd), k, 0.1, 8)
    assert np.allclose(a, b, atol=1e-6)
    # every row counts, whatever its id; twice the rows are half the noise
    same = df.withColumn("id", F.lit(7))
    assert np.allclose(interpolation.fit(same, k, 0.1, 8), a, atol=1e-6)
    assert np.allclose(interpolation.fit(df.unionAll(df), k, 0.2, 8), a, atol=1e-5)
    got = interpolation.predict(same.unionByName(odd).drop("y"), a, 8).collect()
    assert len(got) == 203 and sum(r.mean is None for r in got) == 2 and {r.id for r in got} == {7, 500, 501, 502}
    grid = a.reshape(9, 9)
    p = df.limit(1).first()
    f, g = (p.x1 + 0.5) * 8, (p.x2 + 0.5) * 8
    i, j = int(f), int(g)
    want = sum(w1 * w2 * grid[i + u, j + v] for u, w1 in ((0, 1 - f + i), (1, f - i)) for v, w2 in ((0, 1 - g + j), (1, g - j)))
    assert interpolation.predict(df.limit(1), a, 8).first().mean == pytest.approx(want)


def test_small_sources(spark, tmp_path):
    df = spark.range(10).withColumn("y", F.col("id") * 1.0).withColumn("x1", F.col("id") - 5.0)
    less, m = S.demean(df)
    assert m == 4.5 and S.add_mean(less, m, "y").agg(F.sum("y")).first()[0] == 45.0
    assert S.demean(df.limit(0))[1] == 0.0
    assert [r.shard for r in S.contiguous_shards(df, 3).orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    assert {r.x1 for r in S.clipped(df, ["x1"], -1.0, 2.0).collect()} == {-1.0, 0.0, 1.0, 2.0}
    S.append_csv(df, f"{tmp_path}/c")
    S.append_csv(df, f"{tmp_path}/c")
    assert S.read_csv(spark, f"{tmp_path}/c", "id long, y double, x1 double").count() == 20
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_csv(spark, f"{tmp_path}/c", "id long, y int, x1 double").collect()
