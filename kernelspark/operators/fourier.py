"""Nonuniform Fourier sums over DataFrames: type 1 (points to modes) and type 2 (modes to points).

Two physical forms of one operator.  The SQL form pairs every point with every
mode inside one stage (modes are an array literal, not a join) and sums them by
map-side partial aggregation; it is all generated code and what shuffles is one
row for each mode and task.  The Arrow form accumulates in each task by
separable matrix products.  Points times modes decide which is used.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from kernelspark.functions.kernels import Grid, per_dim

#: Lags up to which sums are made as SQL aggregations.
SQL_MODES = 64
#: Lags beyond which spreading points costs less than matrix products, by dimension.
FAST_MODES = {1: 600, 2: 6_000, 3: 60_000}
TAU = 2 * math.pi


def dims_of(df: DataFrame) -> list[str]:
    return sorted(c for c in df.columns if len(c) == 2 and c[0] == "x" and c[1].isdigit())


def extended(df: DataFrame, **more: str) -> StructType:
    """The schema of df with more columns of these types."""
    new = [StructField(c, ArrayType(DoubleType()) if t == "array<double>" else IntegerType() if t == "int" else DoubleType()) for c, t in more.items()]
    return StructType([*df.schema.fields, *new])


def is_finite(cols: list[str]) -> Column:
    """Whether all of these columns are there and finite."""
    out = F.lit(True)
    for c in cols:
        v = F.col(c).cast("double")
        out = out & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    return out


def finite(points: DataFrame, cols: list[str]) -> DataFrame:
    """The rows that take part in sums: those whose cols are all there and finite."""
    return points.where(is_finite(cols))


def phase(dims: list[str], scale, modes: list[str]) -> Column:
    """2 pi <h j, x>; a sum in order of the dimensions. scale: h, one for all or one a dimension."""
    out, hs = F.lit(0.0), per_dim(scale, len(dims))
    if len(set(hs)) > 1:
        for c, j, h in zip(dims, modes, hs, strict=True):
            out = out + F.lit(h) * F.col(c) * F.col(j)
        return F.lit(TAU) * out
    for c, j in zip(dims, modes, strict=True):
        out = out + F.col(c) * F.col(j)
    return F.lit(TAU * hs[0]) * out


def with_modes(df: DataFrame, m, dim: int, names: str = "j") -> DataFrame:
    """Every row with every mode index in -m .. m; generated inside the stage, nothing is joined or moved."""
    for k, n in enumerate(per_dim(m, dim)):
        df = df.withColumn(f"{names}{k + 1}", F.explode(F.sequence(F.lit(-n), F.lit(n))))
    return df


def half(m, dim: int, names: str = "l") -> Column:
    """One of each pair of opposite modes: the first index that is not 0 is positive, or all are 0."""
    out = F.lit(True)
    for k in range(dim, 0, -1):
        j = F.col(f"{names}{k}")
        out = (j > 0) | ((j == 0) & out)
    return out


def type1_sql(points: DataFrame, m, scale, weight: str | None = None, names: str = "j", half_only: bool = False) -> DataFrame:
    """sum_n c_n exp(-2 pi i h <j, x_n>) as (j.., re, im); c is 1 without a weight column."""
    dims = dims_of(points)
    js = [f"{names}{k + 1}" for k in range(len(dims))]
    rows = with_modes(points.select(*dims, (F.col(weight) if weight else F.lit(1.0)).alias("c")), m, len(dims), names)
    if half_only:
        rows = rows.where(half(m, len(dims), names))
    t = phase(dims, scale, js)
    return rows.groupBy(*js).agg(F.sum(F.col("c") * F.cos(t)).alias("re"), F.sum(-F.col("c") * F.sin(t)).alias("im"))


def _powers(x: np.ndarray, scale: float, m: int, sign: float) -> np.ndarray:
    """exp(sign 2 pi i h j x) for j in -m .. m, (rows, 2m + 1)."""
    return np.exp(sign * 1j * TAU * scale * np.outer(x, np.arange(-m, m + 1)))


def partial_sums(x: list[np.ndarray], c: np.ndarray, scale, m) -> np.ndarray:
    """Type-1 sums of one block of points for several weights (weights, rows), by products over one dimension at a time."""
    ms = per_dim(m, len(x))
    e = [_powers(v, h, k, -1.0) for v, h, k in zip(x, per_dim(scale, len(x)), ms, strict=True)]
    if len(e) == 1:
        return c @ e[0]
    out = []
    for w in c:
        left = e[0] * w[:, None]
        if len(e) == 2:
            out.append(left.T @ e[1])
        else:
            right = e[1]
            for f in e[2:]:
                right = (right[:, :, None] * f[:, None, :]).reshape(len(w), -1)
            out.append((left.T @ right).reshape([2 * k + 1 for k in ms]))
    return np.array(out)


def type1_arrow(points: DataFrame, m, scale, weights: tuple[str | None, ...] = (None,), block: int = 2048) -> DataFrame:
    """Type-1 sums by (weight, k, re, im), k the mode's place in row-major order. One complex array a task and weight is held."""
    dims = dims_of(points)
    cols = [w for w in weights if w]
    size = math.prod(2 * k + 1 for k in per_dim(m, len(dims)))

    def each(batches):
        total = None
        for b in batches:
            x = [b.column(c).to_numpy() for c in dims]
            c = np.array([b.column(w).to_numpy() if w else np.ones(b.num_rows) for w in weights])
            for s in range(0, b.num_rows, block):
                part = partial_sums([v[s : s + block] for v in x], c[:, s : s + block], scale, m)
                total = part if total is None else total + part
        if total is not None:
            flat = total.reshape(len(weights), -1)
            for w in range(len(weights)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, w, np.int32)), pa.array(np.arange(size)), pa.array(flat[w].real.copy()), pa.array(flat[w].imag.copy())], names=["weight", "k", "re", "im"])

    rows = points.select(*[F.col(c).cast("double").alias(c) for c in [*dims, *cols]]).mapInArrow(each, "weight int, k long, re double, im double")
    return rows.groupBy("weight", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def type2_sql(points: DataFrame, modes: DataFrame, scale: float, key: str = "id") -> DataFrame:
    """Re sum_j f_j exp(2 pi i h <j, x>) of every row: (key, value), repeated keys each on their own. A map: modes (j.., re, im) go along as one array and must be few."""
    dims = dims_of(points)
    js = [f"j{k + 1}" for k in range(len(dims))]
    if modes.count() > 100_000:
        raise ValueError("many modes: use type2_arrow, which takes them as an array")
    all_modes = modes.agg(F.array_sort(F.collect_list(F.struct(*js, "re", "im"))).alias("__modes"))

    def add(total, f):
        t = F.lit(TAU * scale) * sum((f[j] * F.col(c) for j, c in zip(js, dims, strict=True)), F.lit(0.0))
        return total + f["re"] * F.cos(t) - f["im"] * F.sin(t)

    return points.select(key, *dims).join(F.broadcast(all_modes)).select(key, F.aggregate("__modes", F.lit(0.0), add).alias("value"))


def type2_block(x: list[np.ndarray], f: np.ndarray, scale, m) -> np.ndarray:
    """Re of the type-2 sum at a block of points; f has one axis a dimension."""
    e = [_powers(v, h, k, 1.0) for v, h, k in zip(x, per_dim(scale, len(x)), per_dim(m, len(x)), strict=True)]
    if len(e) == 1:
        return (e[0] @ f).real
    out = np.tensordot(e[0], f, axes=(1, 0))
    for g in e[1:]:
        out = np.einsum("nj...,nj->n...", out, g)
    return out.real


def type2_arrow(points: DataFrame, f: np.ndarray, scale, block: int = 2048) -> DataFrame:
    """points with a column value, null where a coordinate is null or not finite; a map over rows, the modes go along as a broadcast array."""
    dims = dims_of(points)
    m = tuple((n - 1) // 2 for n in f.shape)
    shared = points.sparkSession.sparkContext.broadcast(f)
    schema = extended(points.drop("value"), value="double")

    def each(batches):
        for b in batches:
            x = [b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in dims]
            fine = np.isfinite(x).all(0)
            x = [np.where(fine, d, 0.0) for d in x]
            v = np.concatenate([type2_block([d[s : s + block] for d in x], shared.value, scale, m) for s in range(0, b.num_rows, block)] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(v, mask=~fine)], names=[*b.schema.names, "value"])

    return points.drop("value").mapInArrow(each, schema)


def _sums_sql(points: DataFrame, grid: Grid) -> DataFrame:
    """Half of the lags with the sums weighted by y beside them: (l.., re, im, yre, yim), one aggregation."""
    dims = dims_of(points)
    js = [f"l{k + 1}" for k in range(grid.dim)]
    twice = tuple(2 * m for m in grid.ms)
    rows = with_modes(points.select(*dims, "y"), twice, grid.dim, "l").where(half(twice, grid.dim, "l"))
    t = phase(dims, grid.hs, js)
    return rows.groupBy(*js).agg(F.sum(F.cos(t)).alias("re"), F.sum(-F.sin(t)).alias("im"), F.sum(F.col("y") * F.cos(t)).alias("yre"), F.sum(-F.col("y") * F.sin(t)).alias("yim"))


def _sums_arrow(points: DataFrame, grid: Grid, block: int = 2048) -> DataFrame:
    """All lags (part 0) and the sums weighted by y (part 1) as (part, k, re, im), from one map over the data."""
    dims, m = dims_of(points), grid.ms
    twice = tuple(2 * k for k in m)

    def each(batches):
        total = [0.0, 0.0]
        for b in batches:
            x, y = [b.column(c).to_numpy() for c in dims], b.column("y").to_numpy()
            for s in range(0, b.num_rows, block):
                part, w = [v[s : s + block] for v in x], y[s : s + block]
                total[0] = total[0] + partial_sums(part, np.ones((1, len(w))), grid.hs, twice)
                total[1] = total[1] + partial_sums(part, w[None, :], grid.hs, m)
        for k, sums in enumerate(total):
            if not isinstance(sums, float):
                v = sums.ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v))), pa.array(v.real.copy()), pa.array(v.imag.copy())], names=["part", "k", "re", "im"])

    rows = points.select(*[F.col(c).cast("double").alias(c) for c in [*dims, "y"]]).mapInArrow(each, "part int, k long, re double, im double")
    return rows.groupBy("part", "k").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def statistics(points: DataFrame, grid: Grid, form: str = "auto", eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray, int]:
    """(lags of shape (4m + 1)^d, right-hand side of shape (2m + 1)^d without weights, number of points): the only job over the data, one pass.

    Both are additive, so they can be summed over parts, days or micro-batches.
    They are collected: their size is the grid's, not the data's.  The number
    of points is the lag 0.  Rows with a null or non-finite coordinate or y take
    no part, in every form.  form: "sql" makes a row a point and mode and suits
    small grids, "arrow" matrix products in each task, "fast" spreads points on a
    grid with an error of about eps (one to three dimensions); "auto" goes by
    the grid.
    """
    d, m = grid.dim, grid.ms
    points = finite(points, [*dims_of(points), "y"])
    if form == "auto":
        size = math.prod(grid.lag_shape)
        form = "sql" if size <= SQL_MODES else "fast" if d <= 3 and size > FAST_MODES[d] else "arrow"
    if form == "fast":
        from kernelspark.operators import nufft

        return nufft.statistics(points, m, grid.hs, eps)
    lags, rhs = np.zeros(grid.lag_shape, complex), np.zeros(grid.shape, complex)
    if form == "sql":
        for r in _sums_sql(points, grid).collect():
            at = [r[f"l{k + 1}"] for k in range(d)]
            lags[tuple(2 * k + a for a, k in zip(at, m, strict=True))] = complex(r.re, r.im)
            lags[tuple(2 * k - a for a, k in zip(at, m, strict=True))] = complex(r.re, -r.im)
            if all(abs(a) <= k for a, k in zip(at, m, strict=True)) and r.yre is not None:
                rhs[tuple(k + a for a, k in zip(at, m, strict=True))] = complex(r.yre, r.yim)
                rhs[tuple(k - a for a, k in zip(at, m, strict=True))] = complex(r.yre, -r.yim)
    else:
        got = _sums_arrow(points, grid).toArrow()
        part, k, v = got["part"].to_numpy(), got["k"].to_numpy(), got["re"].to_numpy() + 1j * got["im"].to_numpy()
        lags.ravel()[k[part == 0]] = v[part == 0]
        rhs.ravel()[k[part == 1]] = v[part == 1]
    return lags, rhs, int(round(lags[tuple(2 * k for k in m)].real))


class System:
    """The weight-space system (D T D + lambda) beta = D b, T the Toeplitz operator of the lags, D the weights."""

    def __init__(self, grid: Grid, weights: np.ndarray, lags: np.ndarray, reg: float):
        self.grid, self.w, self.lags, self.reg = grid, weights, lags, reg
        self.shape = list(grid.shape)
        self.axes = tuple(range(grid.dim))
        self.spectrum = np.fft.fftn(lags, axes=self.axes)

    @property
    def size(self) -> int:
        return len(self.w)

    def toeplitz(self, v: np.ndarray) -> np.ndarray:
        """T v for a vector or a block (size, columns)."""
        cols = v.shape[1:]
        x = np.fft.fftn(v.reshape(*self.shape, *cols), list(self.lags.shape), axes=self.axes)
        y = np.fft.ifftn(x * self.spectrum.reshape(*self.spectrum.shape, *[1] * len(cols)), axes=self.axes)
        return y[tuple(slice(2 * m, 2 * m + s) for m, s in zip(self.grid.ms, self.shape, strict=True))].reshape(-1, *cols)

    def __call__(self, v: np.ndarray) -> np.ndarray:
        w = self.w.reshape(-1, *[1] * (v.ndim - 1))
        return w * self.toeplitz(w * v) + self.reg * v

    def single(self) -> System:
        """The same operator in single precision: half the memory, and its products are single as well."""
        out = System(self.grid, self.w.astype(np.float32), self.lags.astype(np.complex64), np.float32(self.reg))
        out.spectrum = self.spectrum.astype(np.complex64)
        return out

    def dense(self) -> np.ndarray:
        j = self.grid.modes()
        lag = (j[:, None] - j[None, :]) + 2 * np.array(self.grid.ms)
        return self.w[:, None] * self.lags[tuple(lag[..., k] for k in range(self.grid.dim))] * self.w + self.reg * np.eye(self.size)
