import numpy as np
import pytest

from kernelspark.functions.kernels import Grid, Kernel, choose_grid
from kernelspark.operators import diagnostics, fourier, solvers
from kernelspark.sources import tables as S


def system(spark, n=400, reg=0.05):
    df = S.random_points(spark, n, 1, 2, 0.1).cache()
    k, g = Kernel("se", 1, 0.2), Grid(1, 0.5, 12)
    lags, _, _ = fourier.statistics(df, g)
    return df, k, fourier.System(g, g.weights(k), lags, reg)


def test_surrogate_eigenspace_equals_the_full_one(spark):
    df, k, s = system(spark)
    t, u = diagnostics.surrogate_eigenspace(df, k, s, 4, refine=6)
    w = np.linalg.eigvalsh(s.dense())[::-1]
    assert np.allclose(t[:4], w[:4], rtol=1e-6)
    p = solvers.Deflation(u, t)
    b = np.random.default_rng(0).standard_normal(s.size) + 0j
    assert solvers.pcg(s, b, 1e-8, precond=p).converged


def test_condition_truncation_and_report(spark):
    _, k, s = system(spark)
    c = diagnostics.condition(s, 400)
    assert 1 < c["condition"] <= c["bound"] * 1.01
    assert diagnostics.truncation_error(k, choose_grid(k, 1e-6)) < 1e-5 < diagnostics.truncation_error(k, Grid(1, 0.5, 2))
    atoms = diagnostics.spectral_atoms(spark, s, 6, 25)
    r = diagnostics.spectrum_report(atoms, s.reg).first()
    assert r.top == pytest.approx(c["top"], rel=1e-3) and 0 < r.near_ridge < 1 and r.effective_condition > 1


def test_samples(spark):
    df = spark.range(1000).selectExpr("id", "case when id < 10 then 1000.0 else 1.0 end as w")
    got = [r.id for r in diagnostics.weighted_sample(df, 50, "w").collect()]
    assert len(set(got)) == 50 and sum(i < 10 for i in got) == 10
    assert diagnostics.uniform_sample(df, 7).count() == 7


def test_grid_of_runs(spark, tmp_path):
    df = S.random_points(spark, 200, 1, 4, 0.1).cache()
    got = diagnostics.run_grid(df, df, Kernel("se", 1, 0.2), [0, 4], [{"eps": 1e-5, "reg": 0.1}, {"eps": 1e-5, "reg": -1.0}], sink=str(tmp_path / "runs"))
    rows = got.collect()
    assert [r.status for r in rows] == ["ok", "ok", "failed", "failed"] and rows[0].rmse_test < 0.3 and rows[2].error
    assert spark.read.csv(str(tmp_path / "runs"), header=True).count() == 4
