"""Fast nonuniform Fourier transforms of types 1 and 2 with a tolerance, in one to three dimensions.

Type 1, points to modes: every point is spread by a kernel of ``width`` cells a
dimension onto a grid twice as fine as the modes need, the grid is transformed,
and the modes are divided by the kernel's own transform.  Type 2 goes the other
way: divide, transform, and interpolate the fine grid at each point.  A point
costs width^d operations whatever the number of modes; where a part of the grid
holds many points they are products of matrices.

How it is laid out.  The fine grid is cut into tiles, and a point belongs to the
tile of its first cell; what it spreads beyond the tile lies in a margin on the
far sides, the halo.  A small grid is one tile: each task spreads the rows it
has and only sums of cells are shuffled.  On a large grid points are first
dealt to tiles (tiles with many points to several tasks), so that no task holds
more than some tiles with their halos.  Cells of halos and of different tasks
are added up by cell.  The transform of the summed grid goes axis by axis: lines
of cells are gathered in blocks, transformed, cut to the wanted modes and
divided, so that the grid shrinks with each axis and never lies in one place.
Type 2 takes a small fine grid along as a broadcast of checked size, and beyond
that points meet tiles with halos by the tile's number.

More than three dimensions: fourier.type1_arrow and type2_arrow, exact sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernelspark.functions.kernels import per_dim
from kernelspark.operators.fourier import dims_of, extended, finite, is_finite

#: Cells up to which a grid is one tile (and is broadcast for type 2), cells a side of a tile beyond, and points of a task of one tile.
ONE_TILE = 1 << 21
SIDE = {1: 1 << 14, 2: 128, 3: 24}
DEALT = 200_000
#: Cells of a line, or of a grid gathered to the driver, at most.
MOST = 1 << 25


def _smooth(n: int) -> int:
    """The least even number from n on without prime factors above 5: fast to transform."""
    n += n % 2
    while True:
        k = n
        for p in (2, 3, 5):
            while k % p == 0:
                k //= p
        if k == 1:
            return n
        n += 2


@dataclass(frozen=True)
class Plan:
    """Sizes for modes -m .. m of each dimension at spacing h (positive powers: exp(2 pi i h j x)) with relative error of about eps."""

    m: tuple[int, ...]
    h: tuple[float, ...]
    eps: float
    #: Cells a side of a tile; the whole grid where it is small.
    tile: tuple[int, ...] = ()

    @classmethod
    def of(cls, dim: int, m, h, eps: float) -> Plan:
        if not 1 <= dim <= 3:
            raise ValueError("fast transforms have one to three dimensions")
        if not 1e-14 <= eps < 1:
            raise ValueError("the tolerance must lie in 1e-14 .. 1")
        plan = cls(tuple(int(k) for k in per_dim(m, dim)), tuple(float(k) for k in per_dim(h, dim)), eps)
        if min(plan.m) < 0 or not all(k > 0 for k in plan.h):
            raise ValueError("modes must not be negative, spacings positive")
        n = plan.cells
        return replace(plan, tile=n if math.prod(n) <= ONE_TILE else tuple(min(k, max(SIDE[dim], plan.width)) for k in n))

    @property
    def dim(self) -> int:
        return len(self.m)

    @property
    def width(self) -> int:
        return min(16, max(2, math.ceil(-math.log10(self.eps)) + 2))

    @property
    def beta(self) -> float:
        # the shape that suits a grid twice as fine (a fixed value of the kernel's published error bound)
        return 2.3 * self.width

    @property
    def cells(self) -> tuple[int, ...]:
        return tuple(_smooth(max(2 * (2 * k + 1), 2 * self.width)) for k in self.m)

    @property
    def tiles(self) -> tuple[int, ...]:
        return tuple(-(-n // t) for n, t in zip(self.cells, self.tile, strict=True))

    def values(self, z: np.ndarray) -> np.ndarray:
        """The spreading kernel on -1 .. 1."""
        return np.exp(self.beta * (np.sqrt(np.maximum(1 - z * z, 0)) - 1))

    def factor(self, axis: int) -> np.ndarray:
        """Cells times the kernel's transform at the modes -m .. m of an axis."""
        x, w = np.polynomial.legendre.leggauss(4 * self.width + 20)
        j = np.arange(-self.m[axis], self.m[axis] + 1)
        return self.width / 2 * (np.cos(np.pi * self.width / self.cells[axis] * np.outer(j, x)) @ (w * self.values(x)))

    def first(self, x: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each dimension the first cell of each point (folded into the period) and the kernel's values there, (points, width)."""
        at, vals = [], []
        for v, h, n in zip(x, self.h, self.cells, strict=True):
            u = v * h
            u = (u - np.floor(u)) * n
            low = np.ceil(u - self.width / 2)
            z = (low - u)[:, None] + np.arange(self.width)
            at.append(low.astype(np.int64) % n)
            vals.append(self.values(2 * z / self.width))
        return at, vals


def tile_of(plan: Plan, dims: list[str]) -> Column:
    """The number of the tile of a point's first cell, in generated code."""
    out = F.lit(0).cast("long")
    for c, h, n, t, k in zip(dims, plan.h, plan.cells, plan.tile, plan.tiles, strict=True):
        u = F.col(c).cast("double") * F.lit(h)
        first = F.pmod(F.ceil((u - F.floor(u)) * F.lit(float(n)) - F.lit(plan.width / 2)).cast("long"), F.lit(n).cast("long"))
        out = out * F.lit(k) + F.floor(first / F.lit(float(t))).cast("long")
    return out


def _split(plan: Plan, tiles: np.ndarray) -> list[np.ndarray]:
    """Tile numbers to their place in each dimension."""
    return list(np.unravel_index(tiles, plan.tiles))


def _spread_into(plan: Plan, blocks: dict[int, np.ndarray], x: list[np.ndarray], c: np.ndarray, step: int = 1 << 21) -> None:
    """Add the points with weights c (weights, points) to the blocks of their tiles, halo included; real sums."""
    w, d = plan.width, plan.dim
    side = [t + w - 1 for t in plan.tile]
    rows = max(1, step // (2 * w * d))
    for s in range(0, len(x[0]), rows):
        at, vals = plan.first([v[s : s + rows] for v in x])
        own = np.ravel_multi_index([a // t for a, t in zip(at, plan.tile, strict=True)], plan.tiles)
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], own[order][1:] != own[order][:-1], [True])))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            pick = order[a:b]
            k = int(own[pick[0]])
            held = blocks.setdefault(k, np.zeros((len(c), math.prod(side))))
            near = [at[axis][pick] % plan.tile[axis] for axis in range(d)]
            if not _crowded(len(pick), side, w):
                for t in range(0, len(pick), max(1, step // w**d)):
                    few = slice(t, t + max(1, step // w**d))
                    place, value = _scattered([v[few] for v in near], [v[pick[few]] for v in vals], side)
                    for i in range(len(c)):
                        held[i] += np.bincount(place.ravel(), (value * c[i, s : s + rows][pick[few]][:, None]).ravel(), held.shape[1])
                continue
            for corner, size, own_rows in _pieces(_bins(near, side, w)):
                mine = [vals[axis][pick[own_rows]] for axis in range(d)]
                first, rest = _dense(mine, [near[axis][own_rows] - corner[axis] for axis in range(d)], size)
                window = tuple(slice(o, o + n) for o, n in zip(corner, size, strict=True))
                for i in range(len(c)):
                    sums = (first * c[i, s : s + rows][pick[own_rows]][:, None]).T @ rest
                    held[i].reshape(side)[window] += sums.reshape(size)


def _scattered(at: list[np.ndarray], vals: list[np.ndarray], side: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(place, value) of each point's cells in a block, (points, width^d)."""
    w = vals[0].shape[1]
    place, value = np.zeros((len(at[0]), 1), np.int64), np.ones((len(at[0]), 1))
    for a, v, n in zip(at, vals, side, strict=True):
        place = (place[:, :, None] * n + (a[:, None] + np.arange(w))[:, None, :]).reshape(len(place), -1)
        value = (value[:, :, None] * v[:, None, :]).reshape(len(value), -1)
    return place, value


def _crowded(points: int, side: list[int], w: int) -> bool:
    """Whether the parts of a block hold so many points that matrix products over whole parts cost less than each point's cells."""
    return points >= 32 * math.prod(-(-n // _part(n, w)) for n in side)


def _part(n: int, w: int) -> int:
    return n if n <= 2 * w else w


def _pieces(bins: Iterator[tuple[list[int], list[int], np.ndarray]], entries: int = 1 << 18) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Bins whose points times cells of a part are bounded."""
    for corner, size, rows in bins:
        step = max(1, entries // (math.prod(size) // size[0]))
        for s in range(0, len(rows), step):
            yield corner, size, rows[s : s + step]


def _bins(near: list[np.ndarray], side: list[int], w: int) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """(corner, size, rows): points by parts of a block that hold all their cells. A block of a few kernel widths is one part."""
    part = [_part(n, w) for n in side]
    of = np.zeros(len(near[0]), np.int64)
    count = [-(-n // p) for n, p in zip(side, part, strict=True)]
    for v, p, k in zip(near, part, count, strict=True):
        of = of * k + v // p
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1], [True]))) if len(of) else np.zeros(0, np.int64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        place = np.unravel_index(int(of[order[a]]), count)
        corner = [int(k) * p for k, p in zip(place, part, strict=True)]
        yield corner, [min(p + w - 1, n - o) for p, n, o in zip(part, side, corner, strict=True)], order[a:b]


def _dense(vals: list[np.ndarray], at: list[np.ndarray], size: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The kernel's values over a whole part: (points, cells of the first axis) and (points, cells of the others)."""
    w = np.arange(vals[0].shape[1])
    full = []
    for v, k, n in zip(vals, at, size, strict=True):
        f = np.zeros((len(v), n))
        np.put_along_axis(f, k[:, None] + w, v, 1)
        full.append(f)
    rest = np.ones((len(vals[0]), 1))
    for f in full[1:]:
        rest = (rest[:, :, None] * f[:, None, :]).reshape(len(f), -1)
    return full[0], rest


def _cells_of(plan: Plan, tile: int) -> np.ndarray:
    """The cell numbers of a block, halo included, folded into the grid."""
    place = [int(k[0]) for k in _split(plan, np.array([tile]))]
    # the last tile of a dimension may reach beyond the grid: those cells are the first ones again, as the halo's are
    axes = [(p * t + np.arange(t + plan.width - 1)) % n for p, t, n in zip(place, plan.tile, plan.cells, strict=True)]
    return np.ravel_multi_index(np.meshgrid(*axes, indexing="ij"), plan.cells).ravel()


def _dealt(points: DataFrame, plan: Plan, dims: list[str]) -> DataFrame:
    """On a large grid, points by tile; tiles with many points go to several tasks, by a hash of the point."""
    if math.prod(plan.tiles) == 1:
        return points
    rows = points.withColumn("__tile", tile_of(plan, dims))
    held = rows.groupBy("__tile").agg(F.ceil(F.count("*") / F.lit(float(DEALT))).cast("long").alias("__parts")).where("__parts > 1")
    part = F.pmod(F.xxhash64(*dims), F.coalesce(F.col("__parts"), F.lit(1)))
    return rows.join(held, "__tile", "left").withColumn("__part", part).repartition("__tile", "__part").drop("__tile", "__parts", "__part")


def spread(points: DataFrame, plan: Plan, weights: tuple[str | None, ...]) -> DataFrame:
    """(cell, s0, s1, ..): the fine grid's cells that hold anything, one sum a weight (None: 1 a row). Rows with a null or non-finite coordinate or weight take no part."""
    dims = dims_of(points)
    cols = list(dict.fromkeys(w for w in weights if w))
    rows = finite(points.select(*[F.col(c).cast("double").alias(c) for c in [*dims, *cols]]), [*dims, *cols])
    names = [f"s{k}" for k in range(len(weights))]
    most = max(4, (1 << 22) // math.prod(t + plan.width for t in plan.tile))

    def give(blocks: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for tile, held in blocks.items():
            cell = _cells_of(plan, tile)
            used = np.flatnonzero((held != 0).any(0))
            for s in range(0, len(used), 1 << 16):
                at = used[s : s + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(cell[at]), *(pa.array(held[i][at]) for i in range(len(held)))], names=["cell", *names])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            _spread_into(plan, blocks, [b.column(c).to_numpy() for c in dims], np.array([b.column(w).to_numpy() if w else np.ones(b.num_rows) for w in weights]))
            if len(blocks) > most:
                yield from give(blocks)
                blocks.clear()
        yield from give(blocks)

    made = _dealt(rows, plan, dims).mapInArrow(each, "cell long, " + ", ".join(f"{n} double" for n in names))
    return made.groupBy("cell").agg(*[F.sum(n).alias(n) for n in names])


def _axis(grid: DataFrame, plan: Plan, axis: int, width: int) -> DataFrame:
    """One axis of the transform: (c1 .., re, im) with a cell number in column c{axis + 1} to the same with a mode there. width: lines of a block."""
    names = [f"c{k + 1}" for k in range(plan.dim)]
    own, rest = names[axis], [n for n in names if n != names[axis]]
    n, m = plan.cells[axis], plan.m[axis]
    divide = 1 / plan.factor(axis)
    keep = np.arange(-m, m + 1) % n

    def lines(rows: pd.DataFrame) -> pd.DataFrame:
        found = rows[rest].drop_duplicates().reset_index(drop=True) if rest else pd.DataFrame(index=[0])
        line = rows[rest].merge(found.reset_index(), on=rest, how="left")["index"].to_numpy() if rest else np.zeros(len(rows), np.int64)
        held = np.zeros((len(found), n), complex)
        held[line, rows[own].to_numpy()] = rows["re"].to_numpy() + 1j * rows["im"].to_numpy()
        out = (np.fft.fft(held, axis=1)[:, keep] * divide).ravel()
        made = {c: np.repeat(found[c].to_numpy(), 2 * m + 1) for c in rest}
        made[own] = np.tile(np.arange(-m, m + 1), len(found))
        return pd.DataFrame({**{c: made[c] for c in names}, "re": out.real, "im": out.imag})

    block = F.lit(0).cast("long")
    for c in rest:
        block = block * F.lit(1 << 20) + F.floor(F.col(c) / F.lit(float(width))).cast("long")
    schema = ", ".join(f"{c} long" for c in names) + ", re double, im double"
    return grid.withColumn("block", block).groupBy("block").applyInPandas(lines, schema)


def type1(points: DataFrame, m, scale, weight: str | None = None, eps: float = 1e-9) -> DataFrame:
    """sum_n c_n exp(-2 pi i <h j, x_n>) as (j1 .., re, im) for |j_k| <= m_k, with an error of about eps times sum |c_n|; c is 1 without a weight column.

    m and scale: one number, or one a dimension.  A row with a null or non-finite
    coordinate or weight takes no part; no rows at all give no modes.
    """
    dims = dims_of(points)
    plan = Plan.of(len(dims), m, scale, eps)
    if max(plan.cells) > MOST:
        raise ValueError("too many modes in one dimension")
    cells = spread(points, plan, (weight,))
    place, left = {}, F.col("cell")
    for k in range(plan.dim - 1, -1, -1):
        place[k] = F.pmod(left, F.lit(plan.cells[k]).cast("long"))
        left = F.floor(left / F.lit(plan.cells[k])).cast("long")
    grid = cells.select(*[place[k].alias(f"c{k + 1}") for k in range(plan.dim)], F.col("s0").alias("re"), F.lit(0.0).alias("im"))
    for axis in range(plan.dim - 1, -1, -1):
        # blocks of lines of about a million cells
        lines = max(1, (1 << 20) // plan.cells[axis])
        grid = _axis(grid, plan, axis, max(1, int(lines ** (1 / max(1, plan.dim - 1)))))
    # a line without any point is missing: its modes are 0 in the axes after it, and complete in the first one
    return grid.select(*[F.col(f"c{k + 1}").cast("int").alias(f"j{k + 1}") for k in range(plan.dim)], "re", "im")


def gather(cells: DataFrame, plan: Plan, k: int) -> list[np.ndarray]:
    """The fine grids of k weights as arrays on the driver; their size is the grid's, and checked."""
    if math.prod(plan.cells) * k > MOST:
        raise ValueError("the grid is too large for one place: use type1")
    got = cells.toArrow()
    at = got["cell"].to_numpy()
    out = []
    for i in range(k):
        flat = np.zeros(math.prod(plan.cells))
        flat[at] = got[f"s{i}"].to_numpy()
        out.append(flat.reshape(plan.cells))
    return out


def transform(plan: Plan, grid: np.ndarray, m: tuple[int, ...] | None = None) -> np.ndarray:
    """Modes -m .. m (the plan's, or fewer) of a fine grid, (2 m1 + 1, ..)."""
    m = m or plan.m
    out = np.fft.fftn(grid)
    for axis in range(plan.dim):
        keep = np.arange(-m[axis], m[axis] + 1)
        divide = 1 / plan.factor(axis)[keep + plan.m[axis]]
        out = np.take(out, keep % plan.cells[axis], axis) * divide.reshape([-1 if k == axis else 1 for k in range(plan.dim)])
    return out


def statistics(points: DataFrame, m, scale, eps: float = 1e-12) -> tuple[np.ndarray, np.ndarray, int]:
    """(lags -2m .. 2m, right-hand side -m .. m weighted by y, rows) by one spreading of both weights: what fourier.statistics gives, to within eps."""
    dims = dims_of(points)
    few = tuple(int(k) for k in per_dim(m, len(dims)))
    plan = Plan.of(len(dims), tuple(2 * k for k in few), scale, eps)
    one, y = gather(spread(points, plan, (None, "y")), plan, 2)
    lags = transform(plan, one)
    # what rounding and eps leave of the symmetry of real weights goes
    lags = (lags + np.conj(lags[(slice(None, None, -1),) * plan.dim])) / 2
    return lags, transform(plan, y, few), int(round(float(lags[tuple(2 * k for k in few)].real)))


def fine_grid(plan: Plan, f: np.ndarray) -> np.ndarray:
    """The real part of the fine grid that interpolation takes for modes f, one axis a dimension."""
    out = np.zeros(plan.cells, complex)
    g = f.astype(complex)
    for axis in range(plan.dim):
        # the transform's own division by the cells is taken back by factor, which is per cell
        g = g / plan.factor(axis).reshape([-1 if k == axis else 1 for k in range(plan.dim)])
    out[np.ix_(*[np.arange(-k, k + 1) % n for k, n in zip(plan.m, plan.cells, strict=True)])] = g
    return (np.fft.ifftn(out) * out.size).real


def _interpolate(plan: Plan, block: np.ndarray, side: list[int], at: list[np.ndarray], vals: list[np.ndarray]) -> np.ndarray:
    """Sums over the kernel's cells of a block whose places at are given for the first cells."""
    out = np.empty(len(at[0]))
    if not _crowded(len(out), side, plan.width):
        step = max(1, (1 << 20) // plan.width**plan.dim)
        for s in range(0, len(out), step):
            place, value = _scattered([v[s : s + step] for v in at], [v[s : s + step] for v in vals], side)
            out[s : s + step] = (block.ravel()[place] * value).sum(1)
        return out
    block = block.reshape(side)
    for corner, size, rows in _pieces(_bins(at, side, plan.width)):
        part = np.ascontiguousarray(block[tuple(slice(o, o + n) for o, n in zip(corner, size, strict=True))]).reshape(size[0], -1)
        first, rest = _dense([v[rows] for v in vals], [a - o for a, o in zip([a[rows] for a in at], corner, strict=True)], size)
        out[rows] = np.einsum("pi,pi->p", first @ part, rest)
    return out


def type2(points: DataFrame, f: np.ndarray, scale, eps: float = 1e-9) -> DataFrame:
    """points with a column value, Re sum_j f_j exp(2 pi i <h j, x>), with an error of about eps times sum |f_j|.

    f has one axis of odd length a dimension; lengths may differ.  value is null
    where a coordinate is null or not finite.  A column value of points is replaced.
    """
    points = points.drop("value")
    dims = dims_of(points)
    plan = Plan.of(len(dims), tuple((n - 1) // 2 for n in f.shape), scale, eps)
    fine = fine_grid(plan, f)
    w = plan.width
    if math.prod(plan.tiles) > 1:
        return _by_tile(points, plan, fine, dims)
    shared = points.sparkSession.sparkContext.broadcast(np.pad(fine, [(0, w - 1)] * plan.dim, mode="wrap"))
    side = [n + w - 1 for n in plan.cells]
    schema = extended(points, value="double")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, _values(plan, shared.value, side, b, dims)], names=[*b.schema.names, "value"])

    return points.mapInArrow(each, schema)


def _values(plan: Plan, block: np.ndarray, side: list[int], b: pa.RecordBatch, dims: list[str], within: bool = False) -> pa.Array:
    x = [b.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in dims]
    fine = np.isfinite(x).all(0) if b.num_rows else np.zeros(0, bool)
    out = np.full(b.num_rows, np.nan)
    rows = np.flatnonzero(fine)
    step = max(1, (1 << 20) // (2 * plan.width * plan.dim))
    for s in range(0, len(rows), step):
        pick = rows[s : s + step]
        at, vals = plan.first([v[pick] for v in x])
        at = [a % t for a, t in zip(at, plan.tile, strict=True)] if within else at
        out[pick] = _interpolate(plan, block, side, at, vals)
    return pa.array(out, mask=~fine)


def _by_tile(points: DataFrame, plan: Plan, fine: np.ndarray, dims: list[str]) -> DataFrame:
    """Points and tiles with halos meet by the tile's number; tiles with many points are several groups. Rows without a tile get null."""
    spark, w = points.sparkSession, plan.width
    flat, side = fine.ravel(), [t + w - 1 for t in plan.tile]
    tiles = spark.createDataFrame(pd.DataFrame({"__tile": np.arange(math.prod(plan.tiles)), "__cells": [flat[_cells_of(plan, k)].tobytes() for k in range(math.prod(plan.tiles))]}), "__tile long, __cells binary")
    rows = points.withColumn("__tile", F.when(is_finite(dims), tile_of(plan, dims)).otherwise(F.pmod(F.xxhash64(*dims), F.lit(math.prod(plan.tiles)).cast("long"))))
    parts = rows.groupBy("__tile").agg(F.ceil(F.count("*") / F.lit(float(DEALT))).cast("long").alias("__parts"))
    split = rows.join(parts, "__tile").withColumn("__part", F.pmod(F.xxhash64(*dims), F.col("__parts"))).drop("__parts")
    blocks = tiles.join(parts, "__tile").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1))).drop("__parts")
    schema, names = extended(points, value="double"), points.columns

    def each(key, left: pa.Table, right: pa.Table) -> pa.Table:
        block = np.frombuffer(right["__cells"][0].as_py()) if right.num_rows else np.zeros(math.prod(side))
        own = left.select(names)
        values = [_values(plan, block, side, b, dims, True) for b in own.to_batches()]
        return own.append_column("value", pa.chunked_array(values, pa.float64()))

    return split.groupBy("__tile", "__part").cogroup(blocks.groupBy("__tile", "__part")).applyInArrow(each, schema)
