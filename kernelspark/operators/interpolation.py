"""Structured kernel interpolation: points spread on a regular grid by linear weights, a Toeplitz kernel there, conjugate gradients."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelspark.functions.kernels import Kernel
from kernelspark.operators import solvers
from kernelspark.operators.fourier import dims_of, finite, is_finite

#: Nodes that are broadcast for predictions.
MOST_NODES = 1 << 25


def corners(points: DataFrame, cells: int, low: float, high: float) -> Column:
    """An array of (node, w): the 2^d grid nodes around a point with their multilinear weights; nodes are numbered row by row. Points outside take the nearest cell's line on."""
    dims = dims_of(points)
    at = {c: (F.col(c) - low) * (cells / (high - low)) for c in dims}
    cell = {c: F.least(F.greatest(F.floor(at[c]), F.lit(0)), F.lit(cells - 1)).cast("long") for c in dims}
    out = []
    for corner in itertools.product((0, 1), repeat=len(dims)):
        node, w = F.lit(0).cast("long"), F.lit(1.0)
        for c, k in zip(dims, corner, strict=True):
            f = at[c] - cell[c]
            node = node * (cells + 1) + cell[c] + k
            w = w * (f if k else 1 - f)
        out.append(F.struct(node.alias("node"), w.alias("w")))
    return F.array(*out)


def fit(points: DataFrame, kernel: Kernel, reg: float, cells: int, low: float = -0.5, high: float = 0.5, tol: float = 1e-8) -> np.ndarray:
    """Values of the posterior mean at the grid nodes.

    The data enter by W'W (pairs of nodes that share a point) and W'y, sums by
    node of what each row gives from its own corners: one pass and one
    aggregation, whose partial sums are of the grid's size.  With K the grid's
    kernel the mean there is K (W'W K + reg I)^-1 W'y.  Rows with a null or
    non-finite coordinate or y take no part; repeated rows each count.
    """
    d = kernel.dim
    rows = finite(points, [*dims_of(points), "y"]).select(corners(points, cells, low, high).alias("c"), F.col("y").cast("double").alias("y"))
    every = F.transform("c", lambda a: F.concat(F.array(F.struct(a.node.alias("i"), F.lit(-1).cast("long").alias("j"), (a.w * F.col("y")).alias("v"))), F.transform("c", lambda b: F.struct(a.node.alias("i"), b.node.alias("j"), (a.w * b.w).alias("v")))))
    pairs = rows.select(F.explode(F.flatten(every)).alias("p")).groupBy("p.i", "p.j").agg(F.sum("p.v").alias("v")).toArrow()
    size = (cells + 1) ** d
    b = np.zeros(size)
    i, j, v = pairs["i"].to_numpy(), pairs["j"].to_numpy(), pairs["v"].to_numpy()
    b[i[j < 0]] = v[j < 0]
    i, j, v = i[j >= 0], j[j >= 0], v[j >= 0]
    axis = np.linspace(low, high, cells + 1)
    lag = np.arange(-cells, cells + 1) * (axis[1] - axis[0])
    r = np.sqrt(sum(g * g for g in np.meshgrid(*[lag] * d, indexing="ij")))
    spectrum = np.fft.fftn(np.fft.ifftshift(np.pad(kernel.k(r), [(1, 0)] * d)))

    def k(x: np.ndarray) -> np.ndarray:
        f = np.fft.fftn(x.reshape([cells + 1] * d), spectrum.shape)
        return np.fft.ifftn(f * spectrum).real[tuple(slice(0, cells + 1) for _ in range(d))].ravel()

    # symmetric form: (B + reg K^-1) u = W'y with u = K s  ->  (K B K + reg K) s = K W'y
    def apply(s: np.ndarray) -> np.ndarray:
        ks = k(s)
        return k(np.bincount(i, weights=v * ks[j], minlength=size) + reg * s)

    return k(solvers.pcg(apply, k(b), tol, 3_000).x)


def predict(targets: DataFrame, nodes: np.ndarray, cells: int, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """(id, mean) of every row, null where a coordinate is null or not finite; a map, the nodes go along as a broadcast of the grid's size."""
    if len(nodes) > MOST_NODES:
        raise ValueError(f"a grid has {MOST_NODES} nodes at most")
    shared = targets.sparkSession.sparkContext.broadcast(nodes)
    rows = targets.select("id", F.when(is_finite(dims_of(targets)), corners(targets, cells, low, high)).alias("c"))
    parts = rows.select("id", F.transform("c", lambda s: s.node).alias("node"), F.transform("c", lambda s: s.w).alias("w"))
    n = 2 ** len(dims_of(targets))

    def each(batches):
        for b in batches:
            fine = b.column("node").is_valid().to_numpy(zero_copy_only=False)
            mean = np.zeros(b.num_rows)
            if fine.any():
                at, w = (b.column(c).drop_null().flatten().to_numpy().reshape(-1, n) for c in ("node", "w"))
                mean[fine] = (shared.value[at] * w).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(mean, mask=~fine)], names=["id", "mean"])

    return parts.mapInArrow(each, f"id {targets.schema['id'].dataType.simpleString()}, mean double")
