"""Neighbours within a radius as an equality join on grid cells: no pair of far points is ever made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernelspark.operators.fourier import dims_of


def within(points: DataFrame, targets: DataFrame, radius: float) -> DataFrame:
    """(target, id, d): all points within the radius of each target, from cells of that width.

    A target looks into the 3^d cells around its own; points are in one cell.
    Cells that hold very many points are split by AQE's skew join.
    """
    dims = dims_of(points)
    cell = [F.floor(F.col(c) / F.lit(radius)).cast("long").alias(f"c{c}") for c in dims]
    p = points.select("id", *dims, *cell)
    t = targets.select(F.col("id").alias("target"), *[F.col(c).alias(f"t{c}") for c in dims], *cell)
    for c in dims:
        t = t.withColumn(f"c{c}", F.explode(F.array(*[F.col(f"c{c}") + k for k in (-1, 0, 1)])))
    d2 = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in dims[1:]), (F.col(dims[0]) - F.col(f"t{dims[0]}")) * (F.col(dims[0]) - F.col(f"t{dims[0]}")))
    return t.join(p, [f"c{c}" for c in dims]).withColumn("d", F.sqrt(d2)).where(F.col("d") <= radius).select("target", "id", "d")
