"""Grids with their own spacing and count in each dimension, and users' kernels."""

import numpy as np
import pytest

from kernelspark.functions.kernels import Grid, Kernel, PairKernel, choose_pair_grid
from kernelspark.operators import fourier, gp
from kernelspark.sources import tables as S


def gauss(r):
    return np.exp(-(r**2) / 0.08)


def gauss_hat(xi):
    return 2 * np.pi * 0.04 * np.exp(-2 * (np.pi * 0.2 * xi) ** 2)


def test_a_wide_grid_equals_the_dense_system(spark):
    df = S.random_points(spark, 200, 2, 7, 0.1).cache()
    k = Kernel("se", 2, 0.3)
    g = Grid(2, (0.5, 0.8), (5, 3))
    t = df.orderBy("id").toPandas()
    x, y = t[["x1", "x2"]].to_numpy(), t["y"].to_numpy()
    phi = np.exp(2j * np.pi * (x * np.array(g.hs)) @ g.modes().T) * g.weights(k)
    for form in ("sql", "arrow", "fast"):
        lags, rhs, n = fourier.statistics(df, g, form)
        s = fourier.System(g, g.weights(k), lags, 0.2)
        assert n == 200 and lags.shape == (21, 13)
        assert np.allclose(s.dense(), phi.conj().T @ phi + 0.2 * np.eye(g.size), atol=1e-8)
        assert np.allclose(s.w * rhs.ravel(), phi.conj().T @ y, atol=1e-8)
        v = np.random.default_rng(0).normal(size=(g.size, 2))
        assert np.allclose(s(v), s.dense() @ v)


def test_a_model_on_a_wide_grid_is_saved_and_read(spark, tmp_path):
    df = S.random_points(spark, 150, 2, 8, 0.1).cache()
    m = gp.fit(df, Kernel("matern", 2, 0.3, nu=1.5), gp.Config(reg=0.1), Grid(2, (0.5, 0.7), (6, 4)))
    m.save(spark, f"{tmp_path}/m")
    n = gp.Model.load(spark, f"{tmp_path}/m")
    assert n.grid == m.grid
    a, b = (np.array([[r["mean"], r["var"]] for r in q.variance(df).orderBy("id").collect()]) for q in (m, n))
    assert np.allclose(a, b)


@pytest.mark.parametrize("eps", [1e-3, 1e-6])
def test_a_users_kernel_chooses_its_grid(spark, eps):
    k = PairKernel(2, gauss, gauss_hat)
    g = choose_pair_grid(k, eps)
    r = np.random.default_rng(0).uniform(-0.7, 0.7, (50, 2))
    series = np.cos(2 * np.pi * (r * np.array(g.hs)) @ g.modes().T) @ g.weights(k) ** 2
    assert np.abs(series - gauss(np.linalg.norm(r, axis=1))).max() < 20 * eps
    wide = choose_pair_grid(k, eps, (1.0, 3.0))
    assert wide.hs[0] > wide.hs[1] and wide.ms[0] < wide.ms[1]


def test_a_users_kernel_fits_as_the_built_in_one(spark, tmp_path):
    df = S.random_points(spark, 200, 2, 9, 0.05).cache()
    a = gp.fit(df, PairKernel(2, gauss, gauss_hat), gp.Config(reg=0.1, eps=1e-7, tol=1e-11))
    b = gp.fit(df, Kernel("se", 2, 0.2), gp.Config(reg=0.1, eps=1e-7, tol=1e-11))
    got, want = (np.array([r["mean"] for r in m.predict(df).orderBy("id").collect()]) for m in (a, b))
    assert np.allclose(got, want, atol=1e-5)
    with pytest.raises(TypeError, match="saved"):
        a.save(spark, f"{tmp_path}/x")
