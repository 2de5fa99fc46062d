"""The Fourier regression as an Estimator and Model of pyspark.ml: in pipelines and cross validation, saved and read."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel
from kernelspark.operators import gp
from kernelspark.operators.fourier import dims_of, finite
from kernelspark.sources.tables import into_box


class _Settings(HasFeaturesCol, HasInputCols, HasLabelCol, HasPredictionCol):
    """What the estimator and its model share. Coordinates are the columns inputCols, or, where these are not set, the vector or array featuresCol."""

    kernel = Param(Params._dummy(), "kernel", "family: se or matern", TypeConverters.toString)
    length = Param(Params._dummy(), "length", "length scale", TypeConverters.toFloat)
    amplitude = Param(Params._dummy(), "amplitude", "variance of the kernel", TypeConverters.toFloat)
    nu = Param(Params._dummy(), "nu", "smoothness of matern", TypeConverters.toFloat)
    reg = Param(Params._dummy(), "reg", "noise variance", TypeConverters.toFloat)
    eps = Param(Params._dummy(), "eps", "error of the kernel's series", TypeConverters.toFloat)
    solver = Param(Params._dummy(), "solver", "pcg, richardson or direct", TypeConverters.toString)
    preconditioner = Param(Params._dummy(), "preconditioner", "none, deflation, nystrom or dominant", TypeConverters.toString)
    rank = Param(Params._dummy(), "rank", "eigenpairs of the preconditioner", TypeConverters.toInt)
    eigen = Param(Params._dummy(), "eigen", "method for these", TypeConverters.toString)
    tol = Param(Params._dummy(), "tol", "relative residual to stop at", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "steps at most", TypeConverters.toInt)
    margin = Param(Params._dummy(), "margin", "share of the box's length added for targets beyond the points", TypeConverters.toFloat)
    varianceCol = Param(Params._dummy(), "varianceCol", "column for the posterior variance; none if not set", TypeConverters.toString)
    spacing = Param(Params._dummy(), "spacing", "spacing of the frequency grid; with modes in place of eps", TypeConverters.toFloat)
    modes = Param(Params._dummy(), "modes", "greatest mode of the frequency grid in each dimension", TypeConverters.toInt)
    centred = Param(Params._dummy(), "centred", "whether the labels' mean is taken off before the fit and added to predictions", TypeConverters.toBoolean)

    def __init__(self):
        super().__init__()
        self._setDefault(kernel="se", length=0.1, amplitude=1.0, nu=0.5, reg=0.01, eps=1e-6, solver="pcg", preconditioner="none", rank=20, eigen="subspace", tol=1e-8, maxIter=2_000, margin=0.5, centred=False, labelCol="label", featuresCol="features", predictionCol="prediction")

    def config(self) -> gp.Config:
        g = self.getOrDefault
        return gp.Config(eps=g("eps"), reg=g("reg"), solver=g("solver"), preconditioner=g("preconditioner"), rank=g("rank"), eigen=g("eigen"), tol=g("tol"), most=g("maxIter"))

    def _coordinates(self, df: DataFrame, dim: int | None = None) -> list[Column]:
        if self.isSet("inputCols"):
            return [F.col(c).cast("double") for c in self.getInputCols()]
        v = F.col(self.getFeaturesCol())
        if df.schema[self.getFeaturesCol()].dataType.typeName() == "vectorudt" or "Vector" in type(df.schema[self.getFeaturesCol()].dataType).__name__:
            from pyspark.ml.functions import vector_to_array

            v = vector_to_array(v)
        if dim is None:
            seen = df.select(F.size(v).alias("n")).where("n > 0").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).first()
            dim = seen.n if seen else 0
        return [F.get(v, F.lit(k)).cast("double") for k in range(dim)]


class FourierRegressor(Estimator, _Settings, DefaultParamsReadable, DefaultParamsWritable):
    """fit: one aggregation over the rows; those with a null or non-finite coordinate or label take no part."""

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._set(**self._input_kwargs["settings"] if "settings" in self._input_kwargs else self._input_kwargs)

    @keyword_only
    def setParams(self, **settings):
        return self._set(**self._input_kwargs["settings"] if "settings" in self._input_kwargs else self._input_kwargs)

    def _points(self, df: DataFrame) -> DataFrame:
        at = self._coordinates(df)
        if not 1 <= len(at) <= 3:
            raise ValueError("one to three coordinates are needed")
        points = df.select(*[c.alias(f"x{k + 1}") for k, c in enumerate(at)], F.col(self.getLabelCol()).cast("double").alias("y"))
        return finite(points, [*dims_of(points), "y"])

    def _fit(self, df: DataFrame, targets: DataFrame | None = None) -> FourierModel:
        points, g = self._points(df), self.getOrDefault
        dims = dims_of(points)
        around = None
        if targets is not None:
            at = self._coordinates(targets, len(dims))
            around = finite(targets.select(*[c.alias(d) for c, d in zip(at, dims, strict=True)]), dims)
        if not points.limit(1).count():
            raise ValueError("no row has finite coordinates and a label")
        _, centre, length = into_box(points.select(dims), dims, around)
        shift = float(points.agg(F.avg("y")).first()[0]) if g("centred") else 0.0
        kernel = Kernel(g("kernel"), len(dims), g("length"), g("amplitude"), g("nu"))
        grid = Grid(len(dims), g("spacing"), g("modes")) if self.isSet("spacing") and self.isSet("modes") else None
        fitted = gp.fit(points.withColumn("y", F.col("y") - F.lit(shift)), kernel, self.config(), grid, box=(centre, length * (1 + g("margin"))))
        return self._copyValues(FourierModel(fitted, shift))

    def fit_predict(self, df: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """Predictions at targets, or at df itself, from a fit whose box holds both."""
        return self._fit(df, targets).transform(df if targets is None else targets)


class FourierModel(Model, _Settings, MLReadable, MLWritable):
    """transform: predictions, and variances if varianceCol is set; null where a coordinate is null or not finite. Targets beyond the fit's box raise an error."""

    def __init__(self, fitted: gp.Model | None = None, shift: float = 0.0):
        super().__init__()
        self.fitted, self.shift = fitted, shift

    def _transform(self, df: DataFrame) -> DataFrame:
        dims = [f"x{k + 1}" for k in range(self.fitted.grid.dim)]
        at = self._coordinates(df, len(dims))
        # the rows themselves go along as one column, so no name of theirs can clash
        held = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[c.alias(d) for c, d in zip(at, dims, strict=True)])
        wide = self.isSet("varianceCol")
        out = self.fitted.variance(held) if wide else self.fitted.predict(held)
        mean = F.when(~F.isnan("mean"), F.col("mean") + F.lit(self.shift))
        more = {self.getPredictionCol(): mean} | ({self.getOrDefault("varianceCol"): F.col("var")} if wide else {})
        kept = [F.col(f"__row.`{c}`").alias(c) for c in df.columns if c not in more]
        return out.select(*kept, *[v.alias(n) for n, v in more.items()])

    def summary(self, spark) -> DataFrame:
        return self.fitted.summary(spark)

    def score(self, df: DataFrame, metric: str = "rmse") -> float:
        from kernelspark.operators.analytics import regression_metrics

        return regression_metrics(self.transform(df), self.getLabelCol(), self.getPredictionCol()).first()[metric]

    def copy(self, extra=None) -> FourierModel:
        return self._copyValues(FourierModel(self.fitted, self.shift), extra)

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    def __init__(self, model: FourierModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sc if hasattr(self, "sc") else self.sparkSession, extraMetadata={"shift": self.model.shift})
        self.model.fitted.save(self.sparkSession, f"{path}/fitted")


class _Reader(MLReader):
    def load(self, path: str) -> FourierModel:
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        out = FourierModel(gp.Model.load(self.sparkSession, f"{path}/fitted"), meta["shift"])
        out._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(out, meta)
        return out
