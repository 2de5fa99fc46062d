"""The pyspark.ml estimator, variances by solves, and block conjugate gradients."""

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel
from kernelspark.operators import gp, solvers
from kernelspark.operators.estimator import FourierModel, FourierRegressor
from kernelspark.sources import tables as S


@pytest.fixture(scope="module")
def line(spark):
    return S.random_points(spark, 300, 1, 4, 0.05).withColumnRenamed("y", "label").cache()


def test_fit_and_transform_equal_the_functions(spark, line):
    est = FourierRegressor(inputCols=["x1"], length=0.2, reg=0.05, tol=1e-12, margin=0.0, varianceCol="v")
    got = est.fit(line).transform(line).orderBy("id").toPandas()
    m = gp.fit(line.withColumnRenamed("label", "y"), Kernel("se", 1, 0.2), gp.Config(reg=0.05, tol=1e-12))
    want = m.variance(line.select("id", "x1")).orderBy("id").toPandas()
    assert list(got.columns) == [*line.columns, "prediction", "v"]
    assert np.allclose(got["prediction"], want["mean"], atol=1e-8) and np.allclose(got["v"], want["var"], atol=1e-8)


def test_in_a_pipeline_saved_and_read(spark, line, tmp_path):
    df = line.withColumn("x", F.lit("text")).withColumn("mean", F.lit(1)).withColumn("__x1", F.lit(2))
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x1"], outputCol="features"), FourierRegressor(kernel="matern", nu=1.5, length=0.3, reg=0.1, centred=True)])
    model = pipe.fit(df)
    before = model.transform(df).orderBy("id").select("prediction").toPandas()
    model.write().save(f"{tmp_path}/m")
    after = PipelineModel.load(f"{tmp_path}/m").transform(df)
    assert {*df.columns, "features", "prediction"} == set(after.columns)
    assert np.array_equal(after.orderBy("id").select("prediction").toPandas(), before)
    est = FourierRegressor(length=0.7, inputCols=["x1"])
    est.save(f"{tmp_path}/e")
    assert FourierRegressor.load(f"{tmp_path}/e").getOrDefault("length") == 0.7
    own = model.stages[-1]
    own.save(f"{tmp_path}/own")
    assert FourierModel.load(f"{tmp_path}/own").shift == own.shift != 0


def test_cross_validation_chooses_the_length(spark, line, tmp_path):
    est = FourierRegressor(inputCols=["x1"], reg=0.05)
    grid = ParamGridBuilder().addGrid(est.length, [0.15, 40.0]).build()
    cv = CrossValidator(estimator=est, estimatorParamMaps=grid, evaluator=RegressionEvaluator(), numFolds=2, seed=3).fit(line)
    assert cv.bestModel.getOrDefault("length") == 0.15 and cv.avgMetrics[0] < cv.avgMetrics[1]
    cv.write().save(f"{tmp_path}/cv")
    assert CrossValidatorModel.load(f"{tmp_path}/cv").bestModel.score(line) == pytest.approx(cv.bestModel.score(line))


def test_rows_that_take_no_part(spark, line):
    odd = spark.createDataFrame([(1000, None, 1.0), (1001, float("nan"), 1.0), (1002, 0.1, None), (1003, 0.2, float("inf"))], "id long, x1 double, label double")
    est = FourierRegressor(inputCols=["x1"], length=0.2, reg=0.05, tol=1e-12)
    both = line.select("id", "x1", "label").unionByName(odd)
    a, b = est.fit(line).transform(line).orderBy("id").toPandas(), est.fit(both).transform(both).orderBy("id").toPandas()
    assert np.allclose(a["prediction"], b["prediction"][: len(a)], atol=1e-9)
    assert b["prediction"].isna().tolist()[-4:] == [True, True, False, False]
    with pytest.raises(ValueError, match="no row"):
        est.fit(line.limit(0))


def test_fit_predict_holds_targets_beyond_the_points(spark, line):
    far = spark.createDataFrame([(0, 3.0), (1, -2.0)], "id long, x1 double")
    got = FourierRegressor(inputCols=["x1"], length=0.2, margin=0.0).fit_predict(line, far).collect()
    assert len(got) == 2 and all(abs(r.prediction) < 1e-2 for r in got)


@pytest.mark.parametrize("preconditioner", ["none", "deflation"])
def test_variance_by_solves_equals_the_factor(spark, preconditioner):
    p = S.random_points(spark, 200, 2, 5, 0.05).cache()
    m = gp.fit(p, Kernel("matern", 2, 0.3, nu=1.5), gp.Config(reg=0.1, preconditioner=preconditioner, rank=12), Grid(2, 0.6, 5))
    t = p.select("id", "x1", "x2").unionByName(spark.createDataFrame([(900, None, 0.1), (901, 0.1, float("nan"))], "id long, x1 double, x2 double"))
    a, b = m.variance(t).orderBy("id").toPandas(), m.variance_by_solves(t, 1e-11, block=17).orderBy("id").toPandas()
    assert np.allclose(a[["mean", "var"]][:200], b[["mean", "var"]][:200], atol=1e-8)
    assert a["var"].isna().tolist()[-2:] == b["var"].isna().tolist()[-2:] == [True, True]


def test_variance_beyond_the_factor_equals_the_exact_one(spark):
    k = Kernel("matern", 1, 0.2, nu=1.5)
    p = S.random_points(spark, 150, 1, 6, 0.05).cache()
    m = gp.fit(p, k, gp.Config(reg=0.1, preconditioner="deflation", rank=30), Grid(1, 0.4, 2_100))
    assert m.system.size > m.config.variance_modes
    t = p.select("id", "x1").where("id < 20")
    got = m.variance(t).orderBy("id").toPandas()["var"]
    want = gp.naive(p, t, k, 0.1, variance=True).orderBy("id").toPandas()["var"]
    assert np.allclose(got, want, atol=1e-4)


def test_block_conjugate_gradients_stop_column_by_column():
    r = np.random.default_rng(0)
    a = r.normal(size=(30, 30))
    a = a @ a.T + 0.1 * np.eye(30)
    b = np.concatenate((r.normal(size=(30, 3)), np.linalg.eigh(a)[1][:, :1], np.zeros((30, 1))), 1)
    got = solvers.block_pcg(lambda v: a @ v, b, 1e-10, 500)
    assert np.allclose(a @ got.x, b, atol=1e-7) and got.iterations[3] <= 2 and got.iterations[4] == 0
    with pytest.raises(ArithmeticError):
        solvers.block_pcg(lambda v: -v, b)


def test_richardson_with_a_residual_made_anew():
    a = np.diag([1.0, 2.0, 4.0])
    b = np.ones(3)
    one, two, three = solvers.richardson(lambda v: a @ v, b, 0.3), solvers.richardson(lambda v: a @ v, b, 0.3, recompute=True), solvers.richardson(lambda v: a @ v, b, 0.3, every=10)
    assert np.allclose(one.x, [1, 0.5, 0.25]) and np.allclose(two.x, one.x) and np.allclose(three.x, one.x, atol=1e-7)
    assert len(three.history) < len(one.history) and three.iterations % 10 == 0
