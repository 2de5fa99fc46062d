"""Functions for spark.sql: register(spark) makes them known."""

from __future__ import annotations

import itertools

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from kernelspark.functions.kernels import Kernel


@udtf(returnType="j array<int>")
class MultiIndex:
    """multi_index(m, d): every index in -m .. m in d dimensions, the last fastest."""

    def eval(self, m: int, d: int):
        for j in itertools.product(range(-m, m + 1), repeat=d):
            yield (list(j),)


@udtf(returnType="k int, xi double, weight double")
class GridWeights:
    """grid_weights(family, length, nu, h, m): the frequencies of a one-dimensional grid and their weights."""

    def eval(self, family: str, length: float, nu: float, h: float, m: int):
        kernel = Kernel(family, 1, float(length), 1.0, float(nu))
        for k in range(-m, m + 1):
            xi = float(h) * k
            yield k, xi, float((float(h) * kernel.khat(abs(xi))) ** 0.5)


def register(spark: SparkSession) -> None:
    spark.udtf.register("multi_index", MultiIndex)
    spark.udtf.register("grid_weights", GridWeights)
