"""Spectral diagnostics, surrogate eigenspaces, benchmark runs and weighted samples."""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Grid, Kernel
from kernelspark.functions.quadrature import gauss_legendre
from kernelspark.operators import solvers
from kernelspark.operators.fourier import System, statistics, type2_block


def weighted_sample(df: DataFrame, n: int, weight: str, key: str = "id", seed: int = 0) -> DataFrame:
    """n rows without replacement, drawn by weight: the n largest log(u) / w, u from the key. A top-n, not a sort."""
    u = (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1))
    return df.where(F.col(weight) > 0).withColumn("__k", F.log(u) / F.col(weight)).orderBy(F.desc("__k"), key).limit(n).drop("__k")


def uniform_sample(df: DataFrame, n: int, key: str = "id", seed: int = 0) -> DataFrame:
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def condition(system: System, n: int) -> dict[str, float]:
    """Condition number of a small system, and its bound n / reg + 1 for a kernel of unit variance."""
    t = np.linalg.eigvalsh(system.dense())
    return {"condition": float(t[-1] / t[0]), "bound": n / system.reg + 1, "top": float(t[-1]), "low": float(t[0])}


def truncation_error(kernel: Kernel, grid: Grid, at: int = 200) -> float:
    """Largest error of the grid's Fourier series as the kernel, over distances in the unit box along an axis."""
    j, w2 = grid.modes(), grid.weights(kernel) ** 2
    r = np.linspace(0, 1, at)
    series = np.cos(2 * math.pi * grid.hs[0] * np.outer(r, j[:, 0])) @ w2
    return float(np.abs(series - kernel.k(r)).max())


def truncation_quadrature(spark: SparkSession, kernel: Kernel, grid: Grid, nodes: int = 40) -> DataFrame:
    """One row: rms and largest error of the grid's Fourier series as the kernel over all differences of two points of the unit box, in every dimension.

    The mean square is an integral over [-1, 1]^d by a product Gauss rule, weighted by how often a difference occurs between uniform points; by
    symmetry over [0, 1]^d.  Nodes are rows, dealt over tasks, and the series is a type-2 sum in each.
    """
    x, w = gauss_legendre(nodes, 0.0, 1.0)
    dim, f, hs, ms = grid.dim, (grid.weights(kernel) ** 2).reshape(grid.shape).astype(complex), grid.hs, grid.ms
    shared = spark.sparkContext.broadcast(f)

    def each(batches):
        for b in batches:
            at = np.array(np.unravel_index(b.column("id").to_numpy(), (nodes,) * dim))
            error = np.concatenate([type2_block([x[a[s : s + 1024]] for a in at], shared.value, hs, ms) for s in range(0, b.num_rows, 1024)] or [np.zeros(0)])
            error = error - kernel.k(np.sqrt((x[at] ** 2).sum(0)))
            weight = np.prod(w[at] * 2 * (1 - x[at]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(weight * error**2), pa.array(np.abs(error))], names=["square", "worst"])

    parts = spark.range(nodes**dim).mapInArrow(each, "square double, worst double")
    return parts.agg(F.sqrt(F.sum("square")).alias("rms"), F.max("worst").alias("worst"))


def self_convergence(points: DataFrame, targets: DataFrame, kernel, grids: list[Grid], config, box=None) -> DataFrame:
    """(step, modes, rms, worst, rate): each grid's posterior mean at targets (id, x1 ..) against the last one's, and the rate at which rms falls with the modes.

    One fit a grid; the means are compared by a join on id, so nothing of the targets comes to the driver.  rate: minus the slope of log rms
    against log modes from the step before, null where there is none or an error is 0.
    """
    from kernelspark.operators import gp
    from kernelspark.operators.analytics import error_of

    spark = points.sparkSession
    means = [(g.size, gp.fit(points, kernel, config, g, box).predict(targets).select("id", "mean")) for g in grids]
    rows, last = [], means[-1][1]
    for k, (modes, mean) in enumerate(means[:-1]):
        e = error_of(mean, last, "id", "mean").first()
        rate = None
        if rows and e.rms and rows[-1][2] and modes != rows[-1][1]:
            rate = -math.log(e.rms / rows[-1][2]) / math.log(modes / rows[-1][1])
        rows.append((k, modes, e.rms, e.worst, rate))
    return spark.createDataFrame(rows, "step int, modes int, rms double, worst double, rate double")


def surrogate_eigenspace(points: DataFrame, kernel: Kernel, system: System, q: int, share: float = 0.3, coarse: float = 0.5, refine: int = 2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Top eigenpairs from a sample of the points on a coarser cut-off, put into the full grid and refined by a few products.

    The sample is by key, so it is one more additive job over a part of the
    rows; the coarse modes are the middle of the full grid's.
    """
    part = points.where(F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1000)) < int(1000 * share)) if "id" in points.columns else points.sample(share, seed)
    grid = Grid(system.grid.dim, system.grid.hs, tuple(max(1, int(m * coarse)) for m in system.grid.ms))
    lags, _, n = statistics(part, grid)
    small = System(grid, grid.weights(kernel), lags, system.reg * share)
    _, u = solvers.top_eigen(small, small.size, min(q, small.size - 1), tol=1e-2)
    full = np.zeros([*system.shape, u.shape[1]], complex)
    full[tuple(slice(m - k, m - k + s) for m, k, s in zip(system.grid.ms, grid.ms, small.shape, strict=True))] = u.reshape(*small.shape, -1)
    v = np.linalg.qr(full.reshape(system.size, -1))[0]
    extra = np.random.default_rng(seed).standard_normal((system.size, 4))
    v = np.linalg.qr(np.concatenate((v, extra), 1))[0]
    for _ in range(refine):
        v = np.linalg.qr(system(v))[0]
    t, w, _ = solvers._ritz(system, v)
    return t[: q + 1], w[:, :q]


def spectral_atoms(spark: SparkSession, system: System, probes: int, steps: int, precond: solvers.Deflation | None = None, basis: bool = False) -> DataFrame:
    """(probe, node, weight) of Lanczos quadrature; probes are independent tasks, the system goes along by broadcast.

    precond: the spectrum of the preconditioned operator, by its symmetric split.
    basis: probe p is the p-th unit vector; all of them together give exact traces.
    """
    shared = spark.sparkContext.broadcast((system.grid, system.w, system.lags, system.reg, precond))

    def each(batches):
        *parts, precond = shared.value
        s = System(*parts)
        apply = solvers.split(s, precond) if precond else s
        for b in batches:
            for p in b.column("id").to_pylist():
                start = (np.arange(s.size) == p).astype(complex) if basis else None
                nodes, w = solvers.lanczos_quadrature(apply, s.size, p, steps, start=start)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), p, np.int32)), pa.array(nodes), pa.array(w)], names=["probe", "node", "weight"])

    return spark.range(probes).repartition(min(probes, spark.sparkContext.defaultParallelism)).mapInArrow(each, "probe int, node double, weight double")


def spectrum_report(atoms: DataFrame, reg: float) -> DataFrame:
    """One row: quantiles of the spectrum, an effective condition number, the share near the ridge and in the top decade, tail ratios, and a label.

    tail_upper and tail_lower compare the outer tenths with the middle: (p99 - p50) / (p90 - p50) and (p50 - p01) / (p50 - p10); null where
    the middle has no width.  label: "flat" where p99 is below twice p01, "ridge" where half of the weight lies near the ridge, else "spread".
    """
    from kernelspark.operators.analytics import weighted_quantiles

    qs = [0.01, 0.1, 0.5, 0.9, 0.99]
    q = weighted_quantiles(atoms, [], qs).groupBy().pivot("q", qs).agg(F.first("value")).toDF("p01", "p10", "p50", "p90", "p99")
    # one row: the greatest node decides what the top decade is
    ends = atoms.agg(F.max("node").alias("top"), F.min("node").alias("low"), F.sum("weight").alias("total"))
    sums = atoms.groupBy("node").agg(F.sum("weight").alias("weight")).join(F.broadcast(ends), F.lit(True))
    mass = sums.agg(
        (F.sum(F.when(F.col("node") <= 2 * reg, F.col("weight")).otherwise(0.0)) / F.first("total")).alias("near_ridge"),
        (F.sum(F.when(F.col("node") >= F.col("top") / 10, F.col("weight")).otherwise(0.0)) / F.first("total")).alias("top_decade"),
        F.first("top").alias("top"),
        F.first("low").alias("low"),
    )
    out = mass.join(F.broadcast(q), F.lit(True)).withColumn("effective_condition", F.col("p99") / F.greatest(F.col("p01"), F.lit(reg)))
    part = lambda a, b, c: (F.col(a) - F.col(b)) / F.when(F.col(c) != F.col(b), F.col(c) - F.col(b))
    out = out.withColumn("tail_upper", part("p99", "p50", "p90")).withColumn("tail_lower", part("p01", "p50", "p10"))
    return out.withColumn("label", F.when(F.col("p99") < 2 * F.col("p01"), "flat").when(F.col("near_ridge") >= 0.5, "ridge").otherwise("spread"))


def run_case(points: DataFrame, test: DataFrame, kernel: Kernel, rank: int, config: dict, repeat: int = 0) -> dict:
    """One fit and prediction with timings and errors; a failure is a row as well."""
    from kernelspark.operators import gp

    began = time.time()
    row = {"mode": "plain" if rank == 0 else "deflated", "top_q": rank, "repeat_idx": repeat, "status": "ok", "error": None, "wall_s": None, "rmse_test": None, "iterations": None, "relres": None, "n": None}
    try:
        m = gp.fit(points, kernel, gp.Config(**config, **({"preconditioner": "deflation", "rank": rank} if rank else {})))
        row |= {"rmse_test": m.score(test), "iterations": m.report["iterations"], "relres": float(m.report["relres"]), "n": m.report["n"]}
    except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:
        row |= {"status": "failed", "error": str(e)}
    return row | {"wall_s": time.time() - began}


RUN_SCHEMA = "mode string, top_q int, repeat_idx int, status string, error string, wall_s double, rmse_test double, iterations int, relres double, n long"


def run_grid(points: DataFrame, test: DataFrame, kernel: Kernel, ranks: list[int], configs: list[dict], repeats: int = 1, sink: str | None = None) -> DataFrame:
    """All cases one after another, each a Spark job of its own; with a sink every row is kept as soon as it is there."""
    spark, rows = points.sparkSession, []
    names = [c.split()[0] for c in RUN_SCHEMA.split(", ")]
    for config in configs:
        for rank in ranks:
            for k in range(repeats):
                r = run_case(points, test, kernel, rank, config, k)
                rows.append(tuple(r[c] for c in names))
                if sink:
                    spark.createDataFrame(rows[-1:], RUN_SCHEMA).write.mode("append").option("header", True).csv(sink)
    return spark.createDataFrame(rows, RUN_SCHEMA)
