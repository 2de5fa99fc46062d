import math

import numpy as np
import pytest

from kernelspark.functions.kernels import Grid, Kernel
from kernelspark.functions.quadrature import bessel_zeros, gauss_legendre, tensor_rule
from kernelspark.operators import diagnostics, gp
from kernelspark.sources import tables as S


@pytest.mark.parametrize("n", [1, 2, 7, 40, 150])
def test_nodes_equal_the_known_ones(n):
    x, w = gauss_legendre(n)
    a, b = np.polynomial.legendre.leggauss(n)
    assert np.allclose(x, a, atol=1e-13) and np.allclose(w, b, atol=1e-13)
    x, w = gauss_legendre(n, 2.0, 5.0)
    assert w.sum() == pytest.approx(3.0) and (w * x).sum() == pytest.approx(10.5)


def test_bessel_zeros():
    assert np.allclose(bessel_zeros(0, 3), [2.404825557695773, 5.520078110286311, 8.653727912911013], atol=1e-12)
    assert np.allclose(bessel_zeros(1, 2), [3.8317059702075125, 7.015586669815619], atol=1e-12)
    assert np.allclose(bessel_zeros(0.5, 50), math.pi * np.arange(1, 51), rtol=1e-12)


def test_tensor_rule_integrates_products():
    x, w = tensor_rule(6, 3, 0.0, 1.0)
    assert (w * x[:, 0] ** 3 * x[:, 1] ** 2 * x[:, 2]).sum() == pytest.approx(1 / 24)


@pytest.mark.parametrize("dim", [1, 2, 3])
def test_truncation_error_by_quadrature(spark, dim):
    k = Kernel("se", dim, 0.35)
    coarse, fine = Grid(dim, 0.5, 2), Grid(dim, 0.4, 6)
    a, b = (diagnostics.truncation_quadrature(spark, k, g, 12).first() for g in (coarse, fine))
    assert b.rms < 1e-3 < a.rms <= a.worst
    x, w = tensor_rule(12, dim, 0.0, 1.0)
    series = np.cos(2 * np.pi * 0.5 * x @ coarse.modes().T) @ coarse.weights(k) ** 2
    error = series - k.k(np.linalg.norm(x, axis=1))
    assert a.rms == pytest.approx(math.sqrt((w * np.prod(2 * (1 - x), axis=1) * error**2).sum()), rel=1e-9)


def test_self_convergence(spark):
    df = S.random_points(spark, 200, 1, 3, 0.1).cache()
    got = diagnostics.self_convergence(df, df.select("id", "x1"), Kernel("matern", 1, 0.2, nu=1.5), [Grid(1, 0.5, m) for m in (4, 8, 16, 64)], gp.Config(reg=0.1)).collect()
    assert [r.modes for r in got] == [9, 17, 33] and got[0].rate is None
    assert got[0].rms > got[1].rms > got[2].rms and all(r.rate > 1 for r in got[1:])
