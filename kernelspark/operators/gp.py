"""Gaussian-process regression: the Fourier estimator, exact and low-rank baselines, posterior variance."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel, PairKernel, choose_grid, choose_pair_grid
from kernelspark.operators import nufft, solvers
from kernelspark.operators.fourier import FAST_MODES, System, _powers, dims_of, extended, finite, statistics, type2_arrow


@dataclass(frozen=True)
class Config:
    eps: float = 1e-6
    reg: float = 0.01
    solver: str = "pcg"
    preconditioner: str = "none"
    rank: int = 20
    eigen: str = "subspace"
    tol: float = 1e-8
    most: int = 2_000
    eta: float | None = None
    variance_modes: int = 4_000
    #: Tolerance of fast transforms, where the grid is large enough for them.
    transform_eps: float = 1e-12

    def __post_init__(self):
        if self.solver not in ("pcg", "richardson", "direct") or self.preconditioner not in ("none", "deflation", "nystrom", "dominant"):
            raise ValueError(f"no such solver or preconditioner: {self.solver}, {self.preconditioner}")
        if self.reg <= 0 or self.eps <= 0 or self.rank < 1:
            raise ValueError("reg, eps and rank must be positive")


@dataclass
class Model:
    """Fitted weights. Prediction is a map over rows; targets must lie in the box that the grid was made for."""

    kernel: Kernel | PairKernel
    config: Config
    grid: Grid
    centre: list[float]
    box: float
    beta: np.ndarray
    system: System
    report: dict = field(default_factory=dict)

    def _coefficients(self) -> np.ndarray:
        return (self.system.w * self.beta).reshape(self.grid.shape)

    def _scaled(self, targets: DataFrame) -> DataFrame:
        dims = dims_of(targets)
        out = None
        for c, m in zip(dims, self.centre, strict=True):
            far = (F.abs(F.col(c) - m) > self.box * 0.5000001) & ~F.isnan(F.col(c).cast("double"))
            out = far if out is None else out | far
        ok = F.when(out, F.raise_error(F.lit("a target lies outside the box of the fit"))).otherwise(F.lit(0.0))
        return targets.withColumns({c: F.col(c).cast("double") - F.lit(float(m)) + (ok if k == 0 else F.lit(0.0)) for k, (c, m) in enumerate(zip(dims, self.centre, strict=True))})

    def predict(self, targets: DataFrame) -> DataFrame:
        """targets with a column mean; coordinates are given back as they came."""
        dims = dims_of(targets)
        kept = targets.withColumns({f"__{c}": F.col(c) for c in dims})
        f = self._coefficients()
        fast = self.grid.dim <= 3 and f.size > FAST_MODES[self.grid.dim] // 2**self.grid.dim
        out = nufft.type2(self._scaled(kept), f, self.grid.hs, self.config.transform_eps) if fast else type2_arrow(self._scaled(kept), f, self.grid.hs)
        return out.withColumns({c: F.col(f"__{c}") for c in dims}).drop(*[f"__{c}" for c in dims]).withColumnRenamed("value", "mean")

    def variance(self, targets: DataFrame) -> DataFrame:
        """targets with mean and var, var = reg phi* A^-1 phi: from one factorisation for all targets, or beyond variance_modes by variance_by_solves."""
        if self.system.size > self.config.variance_modes:
            return self.variance_by_solves(targets)
        root = np.linalg.inv(np.linalg.cholesky(self.system.dense())) * self.system.w
        f, reg = self._coefficients().ravel(), self.config.reg
        shared = targets.sparkSession.sparkContext.broadcast((root, f))

        def each(phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            root, f = shared.value
            return (phi @ f).real, reg * (np.abs(phi.conj() @ root.T) ** 2).sum(1)

        return self._at_targets(targets, each, 512)

    def variance_by_solves(self, targets: DataFrame, tol: float = 1e-8, most: int | None = None, block: int = 64) -> DataFrame:
        """The same without a factor: a system of equations for each target, a block of targets at a time in the tasks, each with its own stop.

        What goes along is of the grid's size.  The fit's preconditioner serves the solves as well.
        """
        precond, _ = preconditioner(self.system, self.config)
        most = most or 3 * self.system.size
        f, reg = self._coefficients().ravel(), self.config.reg
        shared = targets.sparkSession.sparkContext.broadcast((self.system, precond, f))

        def each(phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            system, precond, f = shared.value
            rhs = (system.w * phi.conj()).T
            got = solvers.block_pcg(system, rhs, tol, most, precond)
            if not (got.residual <= 100 * tol).all():
                raise ArithmeticError("a variance did not settle")
            return (phi @ f).real, reg * np.einsum("ij,ij->j", rhs.conj(), got.x).real

        return self._at_targets(targets, each, block)

    def _at_targets(self, targets: DataFrame, function, block: int) -> DataFrame:
        """targets with mean and var of function(phi), phi the modes at a block of targets; a target without finite coordinates has null for both."""
        ms, hs, dims = self.grid.ms, self.grid.hs, dims_of(targets)
        kept = targets.withColumns({f"__{c}": F.col(c) for c in dims})
        schema = extended(kept, mean="double", var="double")

        def each(batches):
            for b in batches:
                x = np.array([b.column(c).to_numpy(zero_copy_only=False) for c in dims], float)
                mean, var = np.full(b.num_rows, np.nan), np.full(b.num_rows, np.nan)
                fine = np.flatnonzero(np.isfinite(x).all(0))
                for s in range(0, len(fine), block):
                    at = fine[s : s + block]
                    e = [_powers(v[at], h, m, 1.0) for v, h, m in zip(x, hs, ms, strict=True)]
                    phi = e[0]
                    for g in e[1:]:
                        phi = (phi[:, :, None] * g[:, None, :]).reshape(len(phi), -1)
                    mean[at], var[at] = function(phi)
                none = np.isnan(mean)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(mean, mask=none), pa.array(var, mask=none)], names=[*b.schema.names, "mean", "var"])

        out = self._scaled(kept).mapInArrow(each, schema)
        return out.withColumns({c: F.col(f"__{c}") for c in dims}).drop(*[f"__{c}" for c in dims])

    def score(self, points: DataFrame, metric: str = "rmse") -> float:
        from kernelspark.operators.analytics import regression_metrics

        return regression_metrics(self.predict(points), "y", "mean").first()[metric]

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame([{k: v for k, v in self.report.items() if not isinstance(v, list)}])

    def history(self, spark) -> DataFrame:
        return spark.createDataFrame([(k, float(v)) for k, v in enumerate(self.report["history"])], "iter int, relres double")

    def save(self, spark, path: str) -> None:
        """Parquet: one row of settings, and beta with its lags. A user's kernel has no text form and raises."""
        if not isinstance(self.kernel, Kernel):
            raise TypeError("a model with a user's kernel can't be saved as text")
        meta = {"kernel": asdict(self.kernel), "config": asdict(self.config), "grid": asdict(self.grid), "centre": self.centre, "box": self.box, "report": {k: v for k, v in self.report.items() if k != "history"}}
        spark.createDataFrame([(json.dumps(meta),)], "meta string").write.parquet(f"{path}/meta")
        for name, v in (("beta", self.beta), ("lags", self.system.lags.ravel())):
            spark.createDataFrame(pa.table({"k": np.arange(len(v)), "re": v.real, "im": v.imag}).to_pandas()).write.parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Model:
        meta = json.loads(spark.read.parquet(f"{path}/meta").first()[0])
        kernel, config = Kernel(**meta["kernel"]), Config(**meta["config"])
        grid = Grid(**{k: tuple(v) if isinstance(v, list) else v for k, v in meta["grid"].items()})
        arrays = []
        for name in ("beta", "lags"):
            t = spark.read.parquet(f"{path}/{name}").toArrow().sort_by("k")
            arrays.append(t["re"].to_numpy() + 1j * t["im"].to_numpy())
        system = System(grid, grid.weights(kernel), arrays[1].reshape(grid.lag_shape), config.reg)
        return cls(kernel, config, grid, meta["centre"], meta["box"], arrays[0], system, meta["report"] | {"history": []})


def preconditioner(system: System, config: Config):
    if config.preconditioner == "none":
        return None, None
    if config.preconditioner == "nystrom":
        theta, u = solvers.coordinate_nystrom(system, config.rank, 4 * config.rank)
    else:
        theta, u = solvers.top_eigen(system, system.size, min(config.rank, system.size - 3), config.eigen, 1e-2)
    if config.preconditioner == "dominant":
        return solvers.DominantSubspace(u, theta / theta[-1], 0.0), theta
    return solvers.Deflation(u, theta), theta


def solve(system: System, rhs: np.ndarray, config: Config) -> tuple[solvers.Result, dict]:
    started = time.time()
    precond, theta = preconditioner(system, config)
    ready = time.time()
    if config.solver == "direct":
        got = solvers.direct(system.dense(), rhs)
    elif config.solver == "pcg":
        got = solvers.pcg(system, rhs, config.tol, config.most, precond)
    else:
        top = float(theta[-1] if theta is not None else solvers.top_eigen(system, system.size, 1, "lanczos", 1e-3)[0][0])
        eta = config.eta or solvers.tune_step(system, rhs, [c / top for c in (0.5, 1.0, 1.5, 1.9)], 20, precond)
        got = solvers.richardson(system, rhs, eta, config.tol, config.most, precond)
    return got, {"iterations": got.iterations, "relres": got.residual, "converged": got.converged, "history": got.history, "precond_s": ready - started, "solve_s": time.time() - ready}


def fit(points: DataFrame, kernel: Kernel | PairKernel, config: Config = Config(), grid: Grid | None = None, box: tuple[list[float], float] | None = None, form: str = "auto", stats=None) -> Model:
    """points: x1 [, x2, x3], y. One aggregation over the data gives all that the solve needs.

    box: (centres, length) of the box that holds points and later targets; by
    default it is taken of the points.  stats: the sums of an earlier run, as
    fourier.statistics gives them, in place of the aggregation.
    """
    dims = dims_of(points)
    if len(dims) != kernel.dim:
        raise ValueError(f"the kernel has {kernel.dim} dimensions, the points {len(dims)}")
    if box is None:
        from kernelspark.sources.tables import into_box

        _, centre, length = into_box(finite(points, [*dims, "y"]), dims)
    else:
        centre, length = box
    grid = grid or (choose_grid if isinstance(kernel, Kernel) else choose_pair_grid)(kernel, config.eps, length)
    started = time.time()
    moved = points.select(*[(F.col(c).cast("double") - F.lit(float(m))).alias(c) for c, m in zip(dims, centre, strict=True)], F.col("y").cast("double").alias("y"))
    lags, rhs, n = stats or statistics(moved, grid, form, config.transform_eps)
    w = grid.weights(kernel)
    system = System(grid, w, lags, config.reg)
    summed = time.time()
    b = w * rhs.ravel()
    got, report = solve(system, b, config)
    if not np.isfinite(got.x).all():
        raise ArithmeticError("the solution is not finite")
    report = {"n": n, "modes": system.size, "h": grid.h, "m": grid.m, "sums_s": summed - started, **report}
    return Model(kernel, config, grid, list(map(float, centre)), float(length), got.x, system, report)


# exact and low-rank baselines -----------------------------------------------------------------------------------------


def _matrix(df: DataFrame, dims: list[str], most: int) -> tuple[np.ndarray, np.ndarray]:
    t = df.select(*[F.col(c).cast("double") for c in dims], *([F.col("y").cast("double")] if "y" in df.columns else [])).limit(most + 1).toArrow()
    if t.num_rows > most:
        raise ValueError(f"a dense method takes {most} rows at most")
    x = np.stack([t[c].to_numpy() for c in dims], 1)
    return x, (t["y"].to_numpy() if "y" in df.columns else np.zeros(len(x)))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = 2 * a @ b.T
    np.subtract((a * a).sum(1)[:, None], d, out=d)
    d += (b * b).sum(1)
    return np.sqrt(np.maximum(d, 0, out=d), out=d)


def _against(targets: DataFrame, x: np.ndarray, columns: dict[str, np.ndarray], kernel, extra=None) -> DataFrame:
    """targets with columns k(target, x) @ v: a map over rows, x and v broadcast."""
    shared = targets.sparkSession.sparkContext.broadcast((x, columns, extra))
    dims = dims_of(targets)
    schema = extended(targets, **dict.fromkeys([*columns, *(["var"] if extra is not None else [])], "double"))

    def each(batches):
        x, cols, half = shared.value
        step = max(1, 4_000_000 // max(1, len(x)))
        for b in batches:
            p = np.stack([b.column(c).cast(pa.float64()).to_numpy() for c in dims], 1)
            out = {c: np.empty(len(p)) for c in cols}
            var = np.empty(len(p))
            for s in range(0, len(p), step):
                k = kernel.k(distances(p[s : s + step], x))
                for c, v in cols.items():
                    out[c][s : s + step] = k @ v
                if half is not None:
                    var[s : s + step] = kernel.k(np.zeros(1))[0] - ((half @ k.T) ** 2).sum(0)
            more = [pa.array(var)] if half is not None else []
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, out.values()), *more], names=schema.fieldNames())

    return targets.mapInArrow(each, schema)


def naive(points: DataFrame, targets: DataFrame, kernel: Kernel, reg: float, variance: bool = False, most: int = 4_000) -> DataFrame:
    """Exact posterior mean (and variance) from the dense kernel matrix of at most ``most`` points."""
    x, y = _matrix(points, dims_of(points), most)
    chol = np.linalg.cholesky(kernel.k(distances(x, x)) + reg * np.eye(len(x)))
    half = np.linalg.inv(chol)
    return _against(targets, x, {"mean": half.T @ (half @ y)}, kernel, half if variance else None)


def nystrom(points: DataFrame, landmarks: DataFrame, targets: DataFrame, kernel: Kernel, reg: float, jitter: float = 1e-10, most: int = 3_000) -> DataFrame:
    """Kernel ridge regression on the span of the landmarks; the landmarks' normal equations are sums over the points' tasks."""
    z, _ = _matrix(landmarks.drop("y"), dims_of(landmarks), most)
    half = np.linalg.inv(np.linalg.cholesky(kernel.k(distances(z, z)) + jitter * np.eye(len(z))))
    shared = points.sparkSession.sparkContext.broadcast((z, half))
    dims = dims_of(points)

    def sums(batches):
        z, half = shared.value
        g, b = np.zeros((len(z), len(z))), np.zeros(len(z))
        for batch in batches:
            p = np.stack([batch.column(c).to_numpy() for c in dims], 1)
            for s in range(0, len(p), 4096):
                f = kernel.k(distances(p[s : s + 4096], z)) @ half.T
                g += f.T @ f
                b += f.T @ batch.column("y").to_numpy()[s : s + 4096]
        full = np.concatenate((g, b[:, None]), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(z))), pa.array(list(full), pa.list_(pa.float64()))], names=["i", "row"])

    rows = points.select(*[F.col(c).cast("double").alias(c) for c in [*dims, "y"]]).mapInArrow(sums, "i long, row array<double>")
    got = rows.select("i", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    full = np.zeros((len(z), len(z) + 1))
    full[got["i"].to_numpy(), got["j"].to_numpy()] = got["v"].to_numpy()
    alpha = np.linalg.solve(full[:, :-1] + reg * np.eye(len(z)), full[:, -1])
    return _against(targets, z, {"mean": half.T @ alpha}, kernel)


def kernel_cg(points: DataFrame, kernel: Kernel, reg: float, tol: float = 1e-8, most: int = 500, limit: int = 50_000) -> tuple[DataFrame, solvers.Result]:
    """Conjugate gradients on (K + reg I) alpha = y in function space, never forming K.

    Each product is one job over blocks of rows against all points, which are
    broadcast: this baseline takes at most ``limit`` points.
    """
    spark = points.sparkSession
    dims = dims_of(points)
    rows = points.select("id", *[F.col(c).cast("double").alias(c) for c in dims], F.col("y").cast("double").alias("y")).orderBy("id").limit(limit + 1).toArrow()
    if rows.num_rows > limit:
        raise ValueError(f"function-space conjugate gradients take {limit} points at most")
    x, y, ids = np.stack([rows[c].to_numpy() for c in dims], 1), rows["y"].to_numpy(), rows["id"].to_numpy()
    shared = spark.sparkContext.broadcast(x)
    blocks = spark.range(-(-len(x) // 1024))

    def product(v: np.ndarray) -> np.ndarray:
        vec = spark.sparkContext.broadcast(v)

        def each(batches):
            x = shared.value
            for b in batches:
                for k in b.column("id").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([kernel.k(distances(x[k * 1024 : (k + 1) * 1024], x)) @ vec.value], pa.list_(pa.float64()))], names=["id", "v"])

        got = blocks.mapInArrow(each, "id long, v array<double>").orderBy("id").collect()
        vec.destroy()
        return np.concatenate([r.v for r in got]) + reg * v

    result = solvers.pcg(product, y, tol, most)
    out = spark.createDataFrame(pa.table({"id": ids, "alpha": result.x}).to_pandas())
    return out, result
