"""Named queries with their DuckDB SQL. Every query reads its whole tables.

Values are rounded to six decimals on both sides.  Where an iteration has no
SQL of its own, the oracle takes another road to the same number: a solve is
checked by Gauss-Jordan elimination unrolled into one statement.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelspark.functions import kernels as K
from kernelspark.functions import table_functions
from kernelspark.functions.quadrature import gauss_legendre
from kernelspark.operators import analytics as A
from kernelspark.operators import diagnostics as D
from kernelspark.operators import gp, machine, sharded, solvers
from kernelspark.operators import neighbours as N
from kernelspark.operators.estimator import FourierRegressor
from kernelspark.operators import fourier as T
from kernelspark.operators import interpolation, nufft
from kernelspark.sources import mat
from kernelspark.sources import tables as S
from kernelspark.sources.staging import work_dir
from kernelspark.streaming import statistics as stream

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def r6(c: Column | str) -> Column:
    """Six decimals, without negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in cols})


# kernels on vectors: every embedding against the mean vector of each label ---------------------------------------------


def class_means(v: DataFrame) -> DataFrame:
    """(class, z): the mean of each label's vectors; classes times dimensions, so small by nature."""
    one = v.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return one.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s.v).alias("z")).withColumnRenamed("label", "class")


def against_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.table(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).crossJoin(F.broadcast(class_means(v)))


MEANS = """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings),
c AS (SELECT label, generate_subscripts(x, 1) AS k, unnest(x) AS v FROM e), a AS (SELECT label, k, avg(v) AS v FROM c GROUP BY ALL),
z AS (SELECT label AS class, list(v ORDER BY k) AS z FROM a GROUP BY label),
p AS (SELECT vec_id, class, x, z, list_distance(x, z) AS d FROM e, z)
"""

for _name, _column, _text in (
    ("gaussian", lambda d2: K.gaussian(d2, 0.8), "exp(-d * d / (2 * 0.8 * 0.8))"),
    ("laplacian", lambda d2: K.laplacian(d2, 1.5), "exp(-d / 1.5)"),
    ("dispersal", lambda d2: K.dispersal(d2, 1.2, 1.4), "exp(-pow(d * d, 0.7) / 1.2)"),
    ("cauchy", lambda d2: K.cauchy(d2, 0.9), "1 / (1 + d * d / 0.81)"),
    ("exp_cauchy", lambda d2: K.exp_cauchy(d2, 0.9), "exp(-(1 + d * d / 0.81))"),
    ("se", lambda d2: K.Kernel("se", 64, 0.7).column(F.sqrt(d2)), "exp(-d * d / (2 * 0.49))"),
    ("matern12", lambda d2: K.matern(F.sqrt(d2), 0.5, 0.7), "exp(-d / 0.7)"),
    ("matern32", lambda d2: K.matern(F.sqrt(d2), 1.5, 0.7), "(1 + sqrt(3) * d / 0.7) * exp(-sqrt(3) * d / 0.7)"),
    ("matern52", lambda d2: K.matern(F.sqrt(d2), 2.5, 0.7), "(1 + sqrt(5) * d / 0.7 + 5 * d * d / (3 * 0.49)) * exp(-sqrt(5) * d / 0.7)"),
):

    @query(f"kernel_{_name}", MEANS + f"SELECT vec_id, class, round({_text}, 6) AS k FROM p")
    def _kernel(spark, sf_dir, column=_column):
        return against_means(spark, sf_dir).select("vec_id", "class", r6(column(K.sq_distance(F.col("x"), F.col("z")))).alias("k"))


@query(
    "kernel_ntk",
    MEANS
    + """, b AS (SELECT vec_id, class, sqrt(list_inner_product(x, x)) * sqrt(list_inner_product(z, z)) AS n, list_inner_product(x, z) AS s FROM p),
l0 AS (SELECT *, s AS o, s / n AS c FROM b),
l1 AS (SELECT vec_id, class, n, n * (sqrt(1 - c * c) + (pi() - acos(c)) * c) / pi() AS s, o * (pi() - acos(c)) / pi() AS o FROM l0),
l2 AS (SELECT vec_id, class, n, s, o + s AS o, s / n AS c FROM l1)
SELECT vec_id, class, round(o * (pi() - acos(c)) / pi() + n * (sqrt(1 - c * c) + (pi() - acos(c)) * c) / pi(), 6) AS k FROM l2""",
)
def kernel_ntk(spark, sf_dir):
    x, z = F.col("x"), F.col("z")
    n = K.norm(x) * K.norm(z)
    return against_means(spark, sf_dir).select("vec_id", "class", r6(K.ntk_relu(K.dot(x, z) / n, n, 2)).alias("k"))


# projections ----------------------------------------------------------------------------------------------------------


def head(v: str) -> list[Column]:
    return [r6(F.col(v)[0]).alias("v0"), r6(F.col(v)[63]).alias("v63"), r6(F.aggregate(v, F.lit(0.0), lambda s, x: s + x)).alias("total")]


@query("l2_normalize", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), n AS (SELECT vec_id, list_transform(x, lambda v: v / sqrt(list_inner_product(x, x))) AS u FROM e) SELECT vec_id, round(u[1], 6) AS v0, round(u[64], 6) AS v63, round(list_sum(u), 6) AS total FROM n")
def l2_normalize(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").withColumn("u", A.unit_norm("embedding")).select("vec_id", *head("u"))


RANGES = "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT vec_id, generate_subscripts(x, 1) AS k, unnest(x) AS v FROM e), b AS (SELECT k, min(v) AS lo, max(v) AS hi FROM c GROUP BY k), "


@query("unit_range", RANGES + "u AS (SELECT vec_id, k, CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END AS u FROM c JOIN b USING (k)) SELECT vec_id, round(max(u) FILTER (k = 1), 6) AS v0, round(max(u) FILTER (k = 64), 6) AS v63, round(sum(u), 6) AS total FROM u GROUP BY vec_id")
def unit_range(spark, sf_dir):
    return A.unit_range(S.table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", *head("embedding"))


@query("row_max_range", RANGES + "m AS (SELECT vec_id, k, v - lo AS u FROM c JOIN b USING (k)), t AS (SELECT vec_id, max(u) AS t FROM m GROUP BY vec_id) SELECT vec_id, round(max(u / t) FILTER (k = 1), 6) AS v0, round(max(u / t) FILTER (k = 64), 6) AS v63, round(sum(u / t), 6) AS total FROM m JOIN t USING (vec_id) GROUP BY vec_id")
def row_max_range(spark, sf_dir):
    return A.row_max_range(S.table(spark, sf_dir, "embeddings"), "embedding", 64).select("vec_id", *head("embedding"))


@query("one_hot", "SELECT vec_id, c::INT AS class, CASE WHEN label = c THEN 1.0 ELSE 0.0 END::DOUBLE AS hot FROM embeddings, range(0, 10) t(c)")
def one_hot(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(A.one_hot("label", 10)).alias("class", "hot"))


PLANE = """WITH pts AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_quantity::DOUBLE / 50.0 - 0.5 AS x1, l_extendedprice::DOUBLE / 105000.0 - 0.5 AS x2,
  date_diff('day', DATE '1995-01-01', l_shipdate::DATE) / 2500.0 - 0.5 AS x3, l_discount::DOUBLE * 10.0 - 0.5 AS y FROM lineitem)"""
LINE = "WITH pts AS (SELECT event_id AS id, (epoch_us(ts) / 1e6 - 1704067200.0) / 2592000.0 - 0.5 AS x1, value / 100.0 - 2.5 AS y, ts FROM events)"


@query("scale_box", PLANE + ", b AS (SELECT (min(x1) + max(x1)) / 2 AS c1, (min(x2) + max(x2)) / 2 AS c2, greatest(max(x1) - min(x1), max(x2) - min(x2)) AS n FROM pts) SELECT id, round((x1 - c1) / n, 6) AS x1, round((x2 - c2) / n, 6) AS x2 FROM pts, b")
def scale_box(spark, sf_dir):
    return rounded(S.into_box(S.lineitem_plane(spark, sf_dir).select("id", "x1", "x2"), ["x1", "x2"])[0], "x1", "x2")


@query("demean", "SELECT o_orderkey AS id, round((o_totalprice::DOUBLE - avg(o_totalprice::DOUBLE) OVER ()) / 1e5, 6) AS y FROM orders")
def demean(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("v"))
    return o.crossJoin(F.broadcast(o.agg(F.avg("v").alias("m")))).select("id", r6((F.col("v") - F.col("m")) / 1e5).alias("y"))


# pairs ----------------------------------------------------------------------------------------------------------------


@query("kernel_matvec", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label / 10.0 AS v FROM embeddings) SELECT a.vec_id AS id, round(sum(exp(-list_distance(a.x, b.x) / 2.0) * b.v), 4) AS value FROM e a, e b GROUP BY a.vec_id")
def kernel_matvec(spark, sf_dir):
    """K v with K the Laplacian kernel of all vectors: blocks of rows against blocks of rows, neither of which is ever in one place."""
    v = _labelled(spark, sf_dir)
    return sharded.Product(v, machine.laplacian(2.0))(v.select("id", (F.col("label") / 10.0).alias("v"))).select("id", F.round("v", 4).alias("value"))


@query("kernel_matrix_sums", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings) SELECT a.label AS label_a, b.label AS label_b, count(*) AS pairs, round(sum(exp(-pow(list_distance(a.x, b.x), 2) / 2)), 4) AS total FROM e a, e b GROUP BY ALL")
def kernel_matrix_sums(spark, sf_dir):
    """The Gaussian kernel matrix of all vectors, summed by label: blocks of rows against shards of rows, a pair in a task at a time; no pair of rows is ever a row."""
    v = _labelled(spark, sf_dir)
    m = sharded.Sharded.zeros(v.limit(0), machine.gaussian(1.0), 10)
    m.append(v.withColumn("w", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: (c == F.col("label")).cast("double"))))
    count = v.groupBy("label").agg(F.count("*").alias("n"))
    rows = m.predict(v).join(v.select("id", F.col("label").alias("label_a")), "id").select("label_a", F.posexplode("scores").alias("label_b", "s"))
    total = rows.groupBy("label_a", "label_b").agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("total"))
    return total.join(F.broadcast(count.select(F.col("label").alias("label_b"), F.col("n").alias("n_b"))), "label_b").select("label_a", "label_b", (F.col("n") * F.col("n_b")).alias("pairs"), "total")


@query("nearest_to_origin", PLANE + " SELECT id, round(x1, 6) AS x1, round(x2, 6) AS x2, round(x1 * x1 + x2 * x2, 6) AS d2 FROM pts ORDER BY x1 * x1 + x2 * x2, id LIMIT 1")
def nearest_to_origin(spark, sf_dir):
    return rounded(A.nearest_to_origin(S.lineitem_plane(spark, sf_dir), ["x1", "x2"]), "x1", "x2", "d2")


@query("top_classes", MEANS + ", k AS (SELECT vec_id AS id, class, round(exp(-d), 9) AS score FROM p) SELECT id, class, round(score, 6) AS score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, class) AS rank FROM k) WHERE rank <= 5")
def top_classes(spark, sf_dir):
    s = against_means(spark, sf_dir).select(F.col("vec_id").alias("id"), "class", F.round(K.laplacian(K.sq_distance(F.col("x"), F.col("z")), 1.0), 9).alias("score"))
    return A.top_classes(s, 5).select("id", "class", r6("score").alias("score"), F.col("rank").cast("int").alias("rank"))


@query("class_accuracy", MEANS + ", k AS (SELECT vec_id, class, row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 9), class) AS r FROM p) SELECT count(*) AS n, round(avg(CASE WHEN class = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM k JOIN e USING (vec_id) WHERE r = 1")
def class_accuracy(spark, sf_dir):
    best = against_means(spark, sf_dir).groupBy("vec_id").agg(F.min(F.struct(F.round(F.sqrt(K.sq_distance(F.col("x"), F.col("z"))), 9).alias("d"), "class")).alias("b"))
    j = best.join(S.table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")
    return j.agg(F.count("*").alias("n"), r6(F.avg((F.col("b.class") == F.col("label")).cast("double"))).alias("accuracy"))


@query("neighbour_counts", "WITH p AS (SELECT s_suppkey AS id, s_acctbal::DOUBLE / 10000.0 AS x1, s_nationkey / 25.0 AS x2 FROM supplier) SELECT a.id, count(*) AS n, round(sum(sqrt(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2))), 6) AS total FROM p a JOIN p b ON sqrt(pow(a.x1 - b.x1, 2) + pow(a.x2 - b.x2, 2)) <= 0.15 GROUP BY a.id")
def neighbour_counts(spark, sf_dir):
    """Suppliers within a radius of each supplier, by cells."""
    p = S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_acctbal").cast("double") / 10000.0).alias("x1"), (F.col("s_nationkey") / 25.0).alias("x2"))
    return N.within(p, p, 0.15).groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n"), r6(F.sum("d")).alias("total"))


@query("grid_weights", "SELECT j::INT AS k, round(0.6 * j, 6) AS xi, round(sqrt(0.6 * sqrt(2 * pi() * 0.01) * exp(-2 * pow(pi() * 0.1 * 0.6 * j, 2))), 6) AS weight FROM range(-6, 7) r(j)")
def grid_weights(spark, sf_dir):
    """The grid's weights by a table function in SQL."""
    table_functions.register(spark)
    return rounded(spark.sql("SELECT * FROM grid_weights('se', 0.1D, 0.5D, 0.6D, 6)"), "xi", "weight")


# Fourier sums ---------------------------------------------------------------------------------------------------------


def type1_text(pts: str, m: int, dim: int, c: str, h: float = 1.0, digits: int = 4) -> str:
    js = ", ".join(f"j{k + 1}::INT AS j{k + 1}" for k in range(dim))
    ranges = ", ".join(f"range({-m}, {m + 1}) r{k + 1}(j{k + 1})" for k in range(dim))
    t = f"(2 * pi() * {h!r} * (" + " + ".join(f"j{k + 1} * x{k + 1}" for k in range(dim)) + "))"
    return f"{pts} SELECT {js}, round(sum({c} * cos({t})), {digits}) AS re, round(sum(-({c}) * sin({t})), {digits}) AS im FROM pts, {ranges} GROUP BY ALL"


def tidy(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) + 0.0 for c in ("re", "im")})


@query("type1_1d", type1_text(LINE, 6, 1, "y"))
def type1_1d(spark, sf_dir):
    return tidy(T.type1_sql(S.events_line(spark, sf_dir), 6, 1.0, "y"))


@query("type1_2d", type1_text(PLANE, 2, 2, "y"))
def type1_2d(spark, sf_dir):
    return tidy(T.type1_sql(S.lineitem_plane(spark, sf_dir).drop("x3"), 2, 1.0, "y"))


@query("type1_3d", type1_text(PLANE, 1, 3, "y"))
def type1_3d(spark, sf_dir):
    """By the Arrow form: separable matrix products in each task."""
    got = T.type1_arrow(S.lineitem_plane(spark, sf_dir), 1, 1.0, ("y",))
    k = F.col("k")
    js = [(F.floor(k / 3 ** (2 - d)) % 3 - 1).cast("int").alias(f"j{d + 1}") for d in range(3)]
    return tidy(got.select(*js, "re", "im"))


def nufft1_text(pts: str, ms: tuple[int, ...], hs: tuple[float, ...], c: str) -> str:
    """The direct sums divided by the number of points."""
    js = [f"j{k + 1}" for k in range(len(ms))]
    ranges = ", ".join(f"range({-m}, {m + 1}) r{k + 1}(j{k + 1})" for k, m in enumerate(ms))
    t = "(2 * pi() * (" + " + ".join(f"{h!r} * j{k + 1} * x{k + 1}" for k, h in enumerate(hs)) + "))"
    return f"{pts} SELECT {', '.join(f'{j}::INT AS {j}' for j in js)}, round(avg({c} * cos({t})), 7) + 0.0 AS re, round(avg(-({c}) * sin({t})), 7) + 0.0 AS im FROM pts, {ranges} GROUP BY ALL"


def _mean_modes(points: DataFrame, ms, hs, eps: float) -> DataFrame:
    n = points.count()
    got = nufft.type1(points, ms, hs, "y", eps)
    return got.withColumns({c: F.round(F.col(c) / F.lit(float(n)), 7) + 0.0 for c in ("re", "im")})


@query("nufft1_1d", nufft1_text(LINE, (60,), (0.9,), "y"))
def nufft1_1d(spark, sf_dir):
    """Type 1 by spreading and a fast transform."""
    return _mean_modes(S.events_line(spark, sf_dir), 60, 0.9, 1e-12)


@query("nufft1_2d", nufft1_text(PLANE, (6, 3), (0.8, 0.5), "y"))
def nufft1_2d(spark, sf_dir):
    """Modes and spacings of their own for each dimension."""
    return _mean_modes(S.lineitem_plane(spark, sf_dir).drop("x3"), (6, 3), (0.8, 0.5), 1e-12)


@query("nufft1_3d", nufft1_text(PLANE, (2, 2, 1), (1.0, 0.7, 0.9), "y"))
def nufft1_3d(spark, sf_dir):
    return _mean_modes(S.lineitem_plane(spark, sf_dir), (2, 2, 1), (1.0, 0.7, 0.9), 1e-12)


def nufft2_text(pts: str, ms: tuple[int, ...], hs: tuple[float, ...]) -> str:
    """Sums over modes with coefficients 1 / (1 + |j|^2), rows kept apart."""
    js = [f"j{k + 1}" for k in range(len(ms))]
    ranges = ", ".join(f"range({-m}, {m + 1}) r{k + 1}(j{k + 1})" for k, m in enumerate(ms))
    t = "(2 * pi() * (" + " + ".join(f"{h!r} * j{k + 1} * x{k + 1}" for k, h in enumerate(hs)) + "))"
    return f"{pts}, u AS (SELECT row_number() OVER () AS rid, * FROM pts) SELECT id, round(sum(cos({t}) / (1 + {' + '.join(f'{j} * {j}' for j in js)})), 5) + 0.0 AS value FROM u, {ranges} GROUP BY rid, id"


def _coefficients(ms: tuple[int, ...]) -> np.ndarray:
    j = np.meshgrid(*[np.arange(-m, m + 1) for m in ms], indexing="ij")
    return (1 / (1 + sum(k * k for k in j))).astype(complex)


def _at_points(points: DataFrame, ms, hs, eps: float) -> DataFrame:
    return nufft.type2(points, _coefficients(ms), hs, eps).select("id", (F.round("value", 5) + 0.0).alias("value"))


@query("nufft2_1d", nufft2_text(LINE, (60,), (0.9,)))
def nufft2_1d(spark, sf_dir):
    """Type 2 by a fast transform and interpolation at every point."""
    return _at_points(S.events_line(spark, sf_dir).select("id", "x1"), (60,), (0.9,), 1e-10)


@query("nufft2_2d", nufft2_text(PLANE, (6, 3), (0.8, 0.5)))
def nufft2_2d(spark, sf_dir):
    return _at_points(S.lineitem_plane(spark, sf_dir).select("id", "x1", "x2"), (6, 3), (0.8, 0.5), 1e-10)


@query("nufft2_3d", nufft2_text(PLANE, (2, 2, 1), (1.0, 0.7, 0.9)))
def nufft2_3d(spark, sf_dir):
    return _at_points(S.lineitem_plane(spark, sf_dir).select("id", "x1", "x2", "x3"), (2, 2, 1), (1.0, 0.7, 0.9), 1e-10)


@query("toeplitz_lags", type1_text(LINE, 8, 1, "1.0").replace("j1::INT AS j1", "j1::INT AS l1"))
def toeplitz_lags(spark, sf_dir):
    return tidy(T.type1_sql(S.events_line(spark, sf_dir), 8, 1.0, names="l"))


@query("type2_1d", LINE + " SELECT id, round(sum(cos(2 * pi() * j * x1) / (1 + j * j) - sin(2 * pi() * j * x1) * j / 10.0), 6) AS value FROM pts, range(-4, 5) r(j) GROUP BY id")
def type2_1d(spark, sf_dir):
    modes = spark.range(-4, 5).select(F.col("id").cast("int").alias("j1"), (1 / (1 + F.col("id") * F.col("id"))).alias("re"), (F.col("id") / 10.0).alias("im"))
    return rounded(T.type2_sql(S.events_line(spark, sf_dir), modes, 1.0), "value")


@query("type2_2d", PLANE + ", u AS (SELECT row_number() OVER () AS rid, * FROM pts) SELECT id, round(sum(cos(2 * pi() * (j * x1 + k * x2)) / (1 + j * j + k * k)), 6) AS value FROM u, range(-2, 3) r(j), range(-2, 3) s(k) GROUP BY rid, id")
def type2_2d(spark, sf_dir):
    j = np.arange(-2, 3)
    f = 1 / (1 + j[:, None] ** 2 + j[None, :] ** 2)
    return rounded(T.type2_arrow(S.lineitem_plane(spark, sf_dir).select("id", "x1", "x2"), f.astype(complex), 1.0).select("id", "value"), "value")


@query("dense_system", LINE + " SELECT a::INT AS a, b::INT AS b, round(sum(cos(2 * pi() * (a - b) * x1)) / ((1 + a * a) * (1 + b * b)), 4) AS re, round(sum(-sin(2 * pi() * (a - b) * x1)) / ((1 + a * a) * (1 + b * b)), 4) AS im FROM pts, range(-3, 4) r(a), range(-3, 4) s(b) GROUP BY a, b")
def dense_system(spark, sf_dir):
    """The matrix of the weighted modes from the lags: an equality join of mode differences with the table of lags."""
    lags = T.type1_sql(S.events_line(spark, sf_dir), 6, 1.0, names="l")
    pairs = T.with_modes(T.with_modes(spark.range(1), 3, 1, "a"), 3, 1, "b").select(F.col("a1").alias("a"), F.col("b1").alias("b"), (F.col("a1") - F.col("b1")).alias("l1"))
    w = (1 + F.col("a") * F.col("a")) * (1 + F.col("b") * F.col("b"))
    return tidy(pairs.join(lags, "l1").select("a", "b", (F.col("re") / w).alias("re"), (F.col("im") / w).alias("im")))


@query("toeplitz_apply", LINE + ", l AS (SELECT l, sum(cos(2 * pi() * l * x1)) AS re, sum(-sin(2 * pi() * l * x1)) AS im FROM pts, range(-6, 7) r(l) GROUP BY l) SELECT a::INT AS a, round(sum(l.re / (1 + b * b)), 4) AS re, round(sum(l.im / (1 + b * b)), 4) AS im FROM range(-3, 4) r(a), range(-3, 4) s(b), l WHERE l.l = a - b GROUP BY a")
def toeplitz_apply(spark, sf_dir):
    """The operator on the vector 1 / (1 + b^2), by fast transforms, against the sum over lags."""
    lags, _, _ = T.statistics(S.events_line(spark, sf_dir), K.Grid(1, 1.0, 3))
    s = T.System(K.Grid(1, 1.0, 3), np.ones(7), lags, 0.0)
    b = np.arange(-3, 4)
    out = s((1 / (1 + b * b)).astype(complex))
    return tidy(spark.createDataFrame([(int(a), float(v.real), float(v.imag)) for a, v in zip(b, out, strict=True)], "a int, re double, im double"))


@query("grid_points", "SELECT (a * 21 + b)::BIGINT AS id, round(a / 20.0, 6) AS x1, round(b / 20.0, 6) AS x2 FROM range(0, 21) r(a), range(0, 21) s(b)")
def grid_points(spark, sf_dir):
    return rounded(S.grid_points(spark, 21, 2), "x1", "x2")


# regression -----------------------------------------------------------------------------------------------------------

KERNEL, REG = K.Kernel("se", 1, 0.1), 1.0
GRID = K.Grid(1, 0.6, 6)
BOX = ([0.0], 1.0)


def _features_text(pts: str = "pts", m: int = GRID.m) -> str:
    """The real features of the grid: w0, and sqrt(2) w_j times cos and sin; they span what the complex modes span."""
    w = f"sqrt(0.6 * sqrt(2 * pi() * 0.01) * exp(-2 * pow(pi() * 0.1 * 0.6 * (CASE WHEN i > {m} THEN i - {m} ELSE i END), 2)))"
    return f"(SELECT *, {w} * CASE WHEN i = 0 THEN 1 WHEN i <= {m} THEN sqrt(2) * cos(2 * pi() * 0.6 * i * x1) ELSE sqrt(2) * sin(2 * pi() * 0.6 * (i - {m}) * x1) END AS v FROM {pts}, range(0, {2 * m + 1}) r(i))"


def gauss_jordan(first: str, size: int, last: str = "sol") -> str:
    """CTEs that solve the augmented system in ``first`` (i, j, v): the columns from ``size`` on become the solution."""
    out, at = [], first
    for k in range(size):
        new = last if k == size - 1 else f"{first}_{k}"
        out.append(
            f"{new} AS MATERIALIZED (SELECT r.i, r.j, CASE WHEN r.i = {k} THEN r.v / p.v ELSE r.v - c.v * q.v / p.v END AS v FROM {at} r, (SELECT v FROM {at} WHERE i = {k} AND j = {k}) p, "
            f"(SELECT j, v FROM {at} WHERE i = {k}) q, (SELECT i, v FROM {at} WHERE j = {k}) c WHERE q.j = r.j AND c.i = r.i)"
        )
        at = new
    return ",\n".join(out)


M = GRID.size
SOLVED = (
    LINE
    + f", f AS MATERIALIZED {_features_text()}, g AS MATERIALIZED (SELECT a.i::INT AS i, b.i::INT AS j, sum(a.v * b.v) + max(CASE WHEN a.i = b.i THEN {REG} ELSE 0 END) AS v FROM f a JOIN f b ON a.id = b.id GROUP BY ALL UNION ALL SELECT i::INT, {M}, sum(v * y) FROM f GROUP BY i"
)
TARGETS = "t AS (SELECT range::BIGINT AS id, range / 199.0 - 0.5 AS x1 FROM range(0, 200))"


def line_model(spark: SparkSession, sf_dir: str, **config) -> gp.Model:
    c = {"reg": REG, "tol": 1e-12} | config
    return gp.fit(S.events_line(spark, sf_dir), KERNEL, gp.Config(**c), GRID, BOX)


def line_targets(spark: SparkSession) -> DataFrame:
    return spark.range(200).select("id", (F.col("id") / 199.0 - 0.5).alias("x1"))


MEAN_SQL = SOLVED + "),\n" + gauss_jordan("g", M) + f", {TARGETS}, p AS {_features_text('t')} SELECT p.id, round(p.x1, 6) AS x1, round(sum(p.v * s.v), 6) AS mean FROM p JOIN sol s ON s.i = p.i AND s.j = {M} GROUP BY ALL"


@query("gp1d_mean", MEAN_SQL)
def gp1d_mean(spark, sf_dir):
    """Posterior mean of the events' values on 200 moments of the month."""
    return rounded(line_model(spark, sf_dir).predict(line_targets(spark)), "x1", "mean")


@query("gp1d_fast", MEAN_SQL)
def gp1d_fast(spark, sf_dir):
    """The same with sums and predictions by fast transforms."""
    m = gp.fit(S.events_line(spark, sf_dir), KERNEL, gp.Config(reg=REG, tol=1e-12), GRID, BOX, "fast")
    return rounded(nufft.type2(line_targets(spark), m._coefficients(), GRID.h, 1e-12).withColumnRenamed("value", "mean"), "x1", "mean")


@query("gp1d_on_grid", MEAN_SQL)
def gp1d_on_grid(spark, sf_dir):
    """The posterior mean on an equispaced grid with both ends."""
    return rounded(line_model(spark, sf_dir).predict(S.grid_points(spark, 200, 1, -0.5, 0.5)), "x1", "mean")


@query("series_at_points", LINE + " SELECT id, round(sum(0.6 * sqrt(2 * pi() * 0.01) * exp(-2 * pow(pi() * 0.1 * 0.6 * j, 2)) * cos(2 * pi() * 0.6 * j * x1)), 6) + 0.0 AS k FROM pts, range(-6, 7) r(j) GROUP BY id")
def series_at_points(spark, sf_dir):
    """The kernel's Fourier series between every event and the middle of the month, with the grid of the SQL table function."""
    table_functions.register(spark)
    grid = spark.sql("SELECT xi, weight FROM grid_weights('se', 0.1D, 0.5D, 0.6D, 6)").agg(F.collect_list(F.struct("xi", "weight")).alias("g"))
    term = F.aggregate("g", F.lit(0.0), lambda t, m: t + m.weight * m.weight * F.cos(F.lit(2 * math.pi) * m.xi * F.col("x1")))
    return S.events_line(spark, sf_dir).select("id", "x1").join(F.broadcast(grid)).select("id", r6(term).alias("k"))


@query("runs_by_setting", "WITH runs AS (SELECT l_extendedprice::DOUBLE AS wall_s FROM lineitem)" + " SELECT n::INT AS least, share::DOUBLE AS share, count(*) FILTER (wall_s > share * n) AS runs FROM runs, (SELECT unnest([1000, 30000]) AS n), (SELECT unnest([0.5, 1.0, 1.5]) AS share) GROUP BY ALL")
def runs_by_setting(spark, sf_dir):
    """Every setting of a parameter grid with the line items it holds for."""
    grid = A.parameter_grid(spark, {"least": [1000, 30000], "share": [0.5, 1.0, 1.5]})
    price = S.table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("wall_s"))
    return price.join(F.broadcast(grid)).groupBy("least", "share").agg(F.count_if(F.col("wall_s") > F.col("share") * F.col("least")).alias("runs"))


@query("gp1d_deflated", MEAN_SQL)
def gp1d_deflated(spark, sf_dir):
    """The same with a spectral preconditioner."""
    return rounded(line_model(spark, sf_dir, preconditioner="deflation", rank=5).predict(line_targets(spark)), "x1", "mean")


@query("gp1d_nystrom_preconditioned", MEAN_SQL)
def gp1d_nystrom_preconditioned(spark, sf_dir):
    return rounded(line_model(spark, sf_dir, preconditioner="nystrom", rank=3).predict(line_targets(spark)), "x1", "mean")


@query("gp1d_richardson", MEAN_SQL)
def gp1d_richardson(spark, sf_dir):
    return rounded(line_model(spark, sf_dir, solver="richardson", preconditioner="deflation", rank=10, most=20000).predict(line_targets(spark)), "x1", "mean")


@query("gp1d_direct", MEAN_SQL)
def gp1d_direct(spark, sf_dir):
    return rounded(line_model(spark, sf_dir, solver="direct").predict(line_targets(spark)), "x1", "mean")


@query(
    "gp1d_variance",
    SOLVED
    + f" UNION ALL SELECT a.i::INT, ({M + 1} + b.i)::INT, CASE WHEN a.i = b.i THEN 1.0 ELSE 0.0 END FROM range(0, {M}) a(i), range(0, {M}) b(i)),\n"
    + gauss_jordan("g", M)
    + f", {TARGETS}, p AS {_features_text('t')} SELECT a.id, round({REG} * sum(a.v * s.v * b.v), 6) AS var FROM p a JOIN p b ON a.id = b.id JOIN sol s ON s.i = a.i AND s.j = {M + 1} + b.i GROUP BY a.id",
)
def gp1d_variance(spark, sf_dir):
    return line_model(spark, sf_dir).variance(line_targets(spark)).select("id", r6("var").alias("var"))


@query("gp1d_variance_solves", _sql["gp1d_variance"])
def gp1d_variance_solves(spark, sf_dir):
    """The same variances by a system of equations for each target, in the tasks."""
    return line_model(spark, sf_dir).variance_by_solves(line_targets(spark), 1e-12).select("id", r6("var").alias("var"))


@query("gp1d_estimator", MEAN_SQL)
def gp1d_estimator(spark, sf_dir):
    """The posterior mean by the pyspark.ml estimator on the same grid."""
    e = S.events_line(spark, sf_dir).select("x1", F.col("y").alias("label"))
    est = FourierRegressor(inputCols=["x1"], length=0.1, reg=REG, tol=1e-12, spacing=GRID.h, modes=GRID.m, predictionCol="mean")
    return rounded(est.fit_predict(e, line_targets(spark)), "x1", "mean").select("id", "x1", "mean")


@query("eig_moments", LINE + f", f AS MATERIALIZED {_features_text()}, g AS (SELECT a.i, b.i AS j, sum(a.v * b.v) + max(CASE WHEN a.i = b.i THEN {REG} ELSE 0 END) AS v FROM f a JOIN f b ON a.id = b.id GROUP BY ALL) SELECT round(sum(v) FILTER (i = j) / 1e3, 6) AS total, round(sum(v * v) / 1e6, 4) AS squares FROM g")
def eig_moments(spark, sf_dir):
    """Sums of the eigenvalues and their squares against the matrix's trace and norm."""
    t = np.linalg.eigvalsh(line_model(spark, sf_dir).system.dense())
    return spark.createDataFrame([(round(float(t.sum()) / 1e3, 6), round(float((t**2).sum()) / 1e6, 4))], "total double, squares double")


SHIFTS = (0.05, 0.08, 0.11, 0.15, 0.2, 0.23)


def _counts_text() -> str:
    """How many eigenvalues lie above shares of the trace: by the signs of the pivots of A - s I (Sylvester)."""
    shifts = ", ".join(f"({k}, {v!r})" for k, v in enumerate(SHIFTS))
    out = [f"e0 AS MATERIALIZED (SELECT s.k AS s, g.i, g.j, g.v - CASE WHEN g.i = g.j THEN s.share * (SELECT sum(v) FROM g WHERE i = j) ELSE 0 END AS v FROM g, (VALUES {shifts}) s(k, share) WHERE g.j < {M})"]
    for k in range(M - 1):
        out.append(f"e{k + 1} AS MATERIALIZED (SELECT r.s, r.i, r.j, r.v - c.v * q.v / p.v AS v FROM e{k} r JOIN (SELECT s, v FROM e{k} WHERE i = {k} AND j = {k}) p USING (s) JOIN (SELECT s, i, v FROM e{k} WHERE j = {k}) c USING (s, i) JOIN (SELECT s, j, v FROM e{k} WHERE i = {k}) q USING (s, j) WHERE r.i > {k} AND r.j > {k})")
    pivots = " UNION ALL ".join(f"SELECT s, v FROM e{k} WHERE i = {k} AND j = {k}" for k in range(M))
    methods = ", ".join(f"('{m}')" for m in sorted(solvers.METHODS))
    return ",\n".join(out) + f" SELECT method, s::INT AS shift, count(*) FILTER (v > 0)::INT AS above FROM ({pivots}), (VALUES {methods}) m(method) GROUP BY ALL"


@query("eig_counts", SOLVED + "),\n" + _counts_text())
def eig_counts(spark, sf_dir):
    """Of the six largest eigenvalues by each method, how many lie above shares of the trace."""
    s = line_model(spark, sf_dir).system
    trace = float(np.diag(s.dense()).real.sum())
    rows = []
    for method in sorted(solvers.METHODS):
        t, _ = solvers.top_eigen(s, s.size, 5, method, 1e-8)
        rows += [(method, k, int((t > share * trace).sum())) for k, share in enumerate(SHIFTS)]
    return spark.createDataFrame(rows, "method string, shift int, above int")


def _moments_text(weight: str) -> str:
    """Mean over all unit probes of the first three moments of D^(1/2) A D^(1/2), D diagonal."""
    return (
        f", a AS MATERIALIZED (SELECT i, j, v * sqrt({weight.format('i')} * {weight.format('j')}) / 1e3 AS v FROM g WHERE j < {M}), b AS MATERIALIZED (SELECT x.i, y.j, sum(x.v * y.v) AS v FROM a x JOIN a y ON x.j = y.i GROUP BY ALL)"
        f" SELECT 1 AS k, round(sum(v) / {M}, 6) AS moment FROM a WHERE i = j UNION ALL SELECT 2, round(sum(v) / {M}, 6) FROM b WHERE i = j UNION ALL SELECT 3, round(sum(a.v * b.v) / {M}, 6) FROM a JOIN b ON a.i = b.j AND a.j = b.i"
    )


def _moments(atoms: DataFrame) -> DataFrame:
    n = F.col("node") / F.lit(1e3)
    sums = atoms.agg(*[(F.sum(F.col("weight") * F.pow(n, F.lit(k))) / F.lit(float(M))).alias(f"m{k}") for k in (1, 2, 3)])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), r6(f"m{k}").alias("moment")) for k in (1, 2, 3)])).alias("m")).select("m.k", "m.moment")


@query("slq_moments", SOLVED + ")" + _moments_text("1"))
def slq_moments(spark, sf_dir):
    """Moments of the spectrum by Lanczos quadrature of all unit probes, run in tasks."""
    return _moments(D.spectral_atoms(spark, line_model(spark, sf_dir).system, M, 4, basis=True))


@query("slq_preconditioned", SOLVED + ")" + _moments_text("(CASE WHEN {} = 0 THEN 0.25 ELSE 1 END)"))
def slq_preconditioned(spark, sf_dir):
    """The same of the preconditioned operator: a deflation of the constant mode to a quarter."""
    s = line_model(spark, sf_dir).system
    constant = (np.arange(s.size) == GRID.m).astype(complex)[:, None]
    return _moments(D.spectral_atoms(spark, s, M, 4, solvers.Deflation(constant, np.array([1.0]), 0.25), basis=True))


@query("gp1d_saved", MEAN_SQL)
def gp1d_saved(spark, sf_dir):
    """The posterior mean of a model that was saved and read again."""
    at = work_dir(spark)
    line_model(spark, sf_dir).save(spark, at)
    return rounded(gp.Model.load(spark, at).predict(line_targets(spark)), "x1", "mean")


CELLS = 16


@query(
    "ski_mean",
    LINE
    + f""", u AS (SELECT i::INT AS i, i / {CELLS}.0 - 0.5 AS x FROM range(0, {CELLS + 1}) r(i)), k AS MATERIALIZED (SELECT a.i, b.i AS j, exp(-pow(a.x - b.x, 2) / 0.02) AS v FROM u a, u b),
c AS MATERIALIZED (SELECT row_number() OVER () AS rid, y, least(greatest(floor((x1 + 0.5) * {CELLS}), 0), {CELLS - 1})::INT AS cell, (x1 + 0.5) * {CELLS} AS pos FROM pts),
w AS MATERIALIZED (SELECT rid, y, cell + d AS i, CASE WHEN d = 1 THEN pos - cell ELSE 1 - (pos - cell) END AS v FROM c, range(0, 2) r(d)),
n AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM w a JOIN w b USING (rid) GROUP BY ALL), g AS MATERIALIZED (SELECT a.i::INT AS i, b.j, coalesce(sum(n.v * b.v), 0) + max(CASE WHEN a.i = b.j THEN {REG} ELSE 0 END) AS v FROM u a CROSS JOIN k b LEFT JOIN n ON n.i = a.i AND n.j = b.i GROUP BY ALL
UNION ALL SELECT u.i, {CELLS + 1}, coalesce(sum(v * y), 0) FROM u LEFT JOIN w USING (i) GROUP BY u.i),
"""
    + gauss_jordan("g", CELLS + 1)
    + f""", m AS MATERIALIZED (SELECT k.i, sum(k.v * s.v) AS v FROM k JOIN sol s ON s.i = k.j AND s.j = {CELLS + 1} GROUP BY k.i), {TARGETS},
q AS (SELECT id, least(greatest(floor((x1 + 0.5) * {CELLS}), 0), {CELLS - 1})::INT AS cell, (x1 + 0.5) * {CELLS} AS pos FROM t) SELECT q.id, round((1 - (pos - cell)) * a.v + (pos - cell) * b.v, 4) + 0.0 AS mean FROM q JOIN m a ON a.i = cell JOIN m b ON b.i = cell + 1""",
)
def ski_mean(spark, sf_dir):
    """Structured kernel interpolation on 17 nodes: sums from each row's own corners, a solve of the grid's size, a map over targets."""
    nodes = interpolation.fit(S.events_line(spark, sf_dir), KERNEL, REG, CELLS, tol=1e-12)
    return interpolation.predict(line_targets(spark), nodes, CELLS).select("id", (F.round("mean", 4) + 0.0).alias("mean"))


# sources and sinks ----------------------------------------------------------------------------------------------------


@query("truth_values", PLANE + " SELECT id, round(sin(2 * pi() * x1) + 0.3 * cos(6 * pi() * x1), 6) + 0.0 AS one, round(sin(2 * pi() * x1) + 0.5 * cos(2 * pi() * x2) + 0.2 * sin(2 * pi() * (x1 + x2)) + CASE WHEN x1 + x2 > 1 THEN 1 ELSE 0 END, 6) + 0.0 AS two, round(sin(2 * pi() * x1) + 0.5 * cos(2 * pi() * x2) + 0.25 * sin(2 * pi() * x3), 6) + 0.0 AS three FROM pts")
def truth_values(spark, sf_dir):
    """The test functions of one to three coordinates at all line items."""
    p = S.lineitem_plane(spark, sf_dir)
    return p.select("id", r6(S.truth(1)).alias("one"), r6(S.truth(2, rough=True)).alias("two"), r6(S.truth(3)).alias("three"))


@query("strided_rows", LINE + " SELECT id, round(x1, 6) AS x1 FROM pts WHERE id % 7 = 3")
def strided_rows(spark, sf_dir):
    return S.strided(S.events_line(spark, sf_dir), 7, 3).select("id", r6("x1").alias("x1"))


@query("contiguous_loaders", "WITH n AS (SELECT count(*) AS n FROM embeddings) SELECT least(vec_id // (n // 3), 2)::INT AS shard, count(*) AS rows, min(vec_id) AS first, max(vec_id) AS last FROM embeddings, n GROUP BY ALL")
def contiguous_loaders(spark, sf_dir):
    """Every row's loader, of three that read runs of neighbouring ids."""
    v = S.contiguous_shards(_labelled(spark, sf_dir), 3)
    return v.groupBy("shard").agg(F.count("*").alias("rows"), F.min("id").alias("first"), F.max("id").alias("last"))


@query("csv_round_trip", "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_nationkey::INT AS s_nationkey, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    """Suppliers written as CSV and read again by a schema."""
    at = work_dir(spark)
    S.append_csv(S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_nationkey").cast("int").alias("s_nationkey"), F.col("s_acctbal").cast("double").alias("s_acctbal")), at)
    return S.read_csv(spark, at, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


@query("mat_round_trip", "SELECT s_suppkey::DOUBLE AS s_suppkey, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def mat_round_trip(spark, sf_dir):
    """Suppliers written as MAT files by the tasks; two of three variables read again."""
    at = work_dir(spark)
    mat.write_mat(S.table(spark, sf_dir, "supplier").select(*[F.col(c).cast("double").alias(c) for c in ("s_suppkey", "s_nationkey", "s_acctbal")]), at)
    mat.register(spark)
    return spark.read.format("mat").option("columns", "s_suppkey,s_acctbal").load(at).select("s_suppkey", "s_acctbal")


@query("json_round_trip", "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, s_acctbal::DOUBLE AS s_acctbal FROM supplier")
def json_round_trip(spark, sf_dir):
    at = work_dir(spark)
    S.write_json(S.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal")), at)
    return spark.read.schema("s_suppkey long, s_name string, s_acctbal double").json(at)


@query("demean_add_back", "SELECT o_orderkey AS id, round(o_totalprice::DOUBLE, 2) AS y, round((o_totalprice::DOUBLE - avg(o_totalprice::DOUBLE) OVER ()) / 1e5, 6) AS less FROM orders")
def demean_add_back(spark, sf_dir):
    o = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("y"))
    less, m = S.demean(o)
    return S.add_mean(less.withColumn("less", F.col("y")), m, "y").select("id", F.round("y", 2).alias("y"), r6(F.col("less") / 1e5).alias("less"))


@query("clipped_box", PLANE + " SELECT id, round(least(greatest(x1, -0.3), 0.3), 6) + 0.0 AS x1, round(least(greatest(x2, -0.3), 0.3), 6) + 0.0 AS x2 FROM pts")
def clipped_box(spark, sf_dir):
    return rounded(S.clipped(S.lineitem_plane(spark, sf_dir).select("id", "x1", "x2"), ["x1", "x2"], -0.3, 0.3), "x1", "x2")


@query(
    "machine_evaluation",
    MEANS + ", s AS (SELECT p.vec_id, e.label, p.class, exp(-p.d / 1.5) AS k FROM p JOIN e USING (vec_id)), b AS (SELECT vec_id, label, arg_max(class, (k, -class)) AS best, sum(pow(k - (class = label)::INT, 2)) AS sq FROM s GROUP BY ALL) SELECT count(*) AS n, round(avg((best = label)::INT), 6) AS accuracy, round(avg(sq), 6) AS loss FROM b",
)
def machine_evaluation(spark, sf_dir):
    """Accuracy and squared loss of a machine with unit weights on the class means, over all rows in blocks."""
    _, z, label = machine.arrays(_mean_centres(spark, sf_dir))
    m = machine.Machine(machine.laplacian(1.5), z, machine.one_hot(label, 10))
    return rounded(machine.accuracy(m.predict(_labelled(spark, sf_dir))), "accuracy", "loss")


def _nation(spark, sf_dir):
    return S.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), (F.col("n_nationkey") / 24.0).alias("x1"), (F.length("n_name") / 10.0 - 0.8).alias("y"))


@query(
    "naive_gp",
    "WITH pts AS (SELECT n_nationkey::INT AS i, n_nationkey / 24.0 AS x, length(n_name) / 10.0 - 0.8 AS y FROM nation), k AS (SELECT a.i, b.i AS j, exp(-abs(a.x - b.x) / 0.2) AS v FROM pts a, pts b), g AS MATERIALIZED (SELECT i, j, v + CASE WHEN i = j THEN 0.1 ELSE 0 END AS v FROM k UNION ALL SELECT i, 25, y FROM pts),\n"
    + gauss_jordan("g", 25)
    + " SELECT k.i::BIGINT AS id, round(sum(k.v * s.v), 6) AS mean FROM k JOIN sol s ON s.i = k.j AND s.j = 25 GROUP BY k.i",
)
def naive_gp(spark, sf_dir):
    p = _nation(spark, sf_dir)
    return gp.naive(p, p.drop("y"), K.Kernel("matern", 1, 0.2), 0.1).select("id", r6("mean").alias("mean"))


@query("kernel_cg", _sql["naive_gp"])
def kernel_cg(spark, sf_dir):
    """The same posterior mean by conjugate gradients in function space."""
    p = _nation(spark, sf_dir)
    alpha, _ = gp.kernel_cg(p, K.Kernel("matern", 1, 0.2), 0.1, 1e-13)
    j = p.select("id", "x1").crossJoin(F.broadcast(p.join(alpha, "id").select(F.col("x1").alias("z"), "alpha")))
    return j.groupBy("id").agg(r6(F.sum(F.exp(-F.abs(F.col("x1") - F.col("z")) / 0.2) * F.col("alpha"))).alias("mean"))


@query("function_cg", _sql["naive_gp"])
def function_cg(spark, sf_dir):
    """The same posterior mean by conjugate gradients whose vectors are tables, K made block by block in the tasks."""
    p = _nation(spark, sf_dir).select("id", F.array("x1").alias("x"), "y")
    kernel = machine.laplacian(0.2)
    alpha, _ = sharded.function_cg(p, kernel, 0.1, 1e-9, block=10)
    return sharded.Product(p, kernel, 10)(alpha.select("id", F.col("alpha").alias("v"))).select("id", r6("v").alias("mean"))


@query(
    "nystrom_krr",
    LINE
    + ", z AS (SELECT range::INT AS i, range / 8.0 - 0.5 AS z FROM range(0, 9)), k AS MATERIALIZED (SELECT id, i, y, exp(-pow(x1 - z, 2) / 0.02) AS v FROM pts, z), g AS MATERIALIZED (SELECT a.i, b.i AS j, sum(a.v * b.v) + max(exp(-pow((a.i - b.i) / 8.0, 2) / 0.02)) AS v FROM k a JOIN k b ON a.id = b.id GROUP BY ALL UNION ALL SELECT i, 9, sum(v * y) FROM k GROUP BY i),\n"
    + gauss_jordan("g", 9)
    + f", {TARGETS} SELECT t.id, round(sum(exp(-pow(t.x1 - z.z, 2) / 0.02) * s.v), 6) AS mean FROM t, z JOIN sol s ON s.i = z.i AND s.j = 9 GROUP BY t.id",
)
def nystrom_krr(spark, sf_dir):
    z = spark.range(9).select("id", (F.col("id") / 8.0 - 0.5).alias("x1"))
    return gp.nystrom(S.events_line(spark, sf_dir), z, line_targets(spark), KERNEL, 1.0, 1e-12).select("id", r6("mean").alias("mean"))


def _cg_text(steps: int) -> str:
    """Conjugate gradients on g from 0, unrolled; the relative residual after each step."""
    out = [f"r0 AS MATERIALIZED (SELECT i, v FROM g WHERE j = {M}), p0 AS MATERIALIZED (SELECT * FROM r0)"]
    for k in range(steps):
        out.append(f"ap{k} AS MATERIALIZED (SELECT g.i, sum(g.v * p.v) AS v FROM g JOIN p{k} p ON g.j = p.i GROUP BY g.i)")
        out.append(f"r{k + 1} AS MATERIALIZED (SELECT r.i, r.v - a.v * (SELECT sum(v * v) FROM r{k}) / (SELECT sum(p.v * ap.v) FROM p{k} p JOIN ap{k} ap USING (i)) AS v FROM r{k} r JOIN ap{k} a USING (i))")
        out.append(f"p{k + 1} AS MATERIALIZED (SELECT r.i, r.v + p.v * (SELECT sum(v * v) FROM r{k + 1}) / (SELECT sum(v * v) FROM r{k}) AS v FROM r{k + 1} r JOIN p{k} p USING (i))")
    return ",\n".join(out) + " " + " UNION ALL ".join(f"SELECT {k}::INT AS iter, round(sqrt((SELECT sum(v * v) FROM r{k}) / (SELECT sum(v * v) FROM r0)), 6) AS relres" for k in range(steps + 1))


@query("cg_history", SOLVED + "),\n" + _cg_text(6))
def cg_history(spark, sf_dir):
    """Relative residuals of the first six conjugate-gradient steps."""
    return line_model(spark, sf_dir, most=6).history(spark).select("iter", r6("relres").alias("relres"))


@query("residual_history")
def residual_history(spark, sf_dir):
    return line_model(spark, sf_dir).history(spark)


KERNEL2, GRID2 = K.Kernel("matern", 2, 0.3, nu=1.5), K.Grid(2, 0.6, 2)


def _plane_text() -> str:
    """The real features of the plane's grid, one row of settings a feature: cosines of half of the modes, then sines."""
    modes = GRID2.modes()
    w = dict(zip(map(tuple, modes.tolist()), GRID2.weights(KERNEL2).tolist(), strict=True))
    upper = [m for m in w if m > (0, 0)]
    rows = [(0, 0, 0, 1, w[0, 0])] + [(k + 1, *m, 1, math.sqrt(2) * w[m]) for k, m in enumerate(upper)] + [(k + 1 + len(upper), *m, 0, math.sqrt(2) * w[m]) for k, m in enumerate(upper)]
    return "m(i, a, b, even, w) AS (VALUES " + ", ".join(f"({i}, {x}, {y}, {e}, {v!r}::DOUBLE)" for i, x, y, e, v in rows) + ")"


@query(
    "gp2d_mean",
    PLANE
    + f", u AS (SELECT row_number() OVER () AS rid, * FROM pts), {_plane_text()}, f AS MATERIALIZED (SELECT rid, id, y, i, w * CASE WHEN even = 1 THEN cos(2 * pi() * 0.6 * (a * x1 + b * x2)) ELSE sin(2 * pi() * 0.6 * (a * x1 + b * x2)) END AS v FROM u, m), "
    + f"g AS MATERIALIZED (SELECT p.i, q.i AS j, sum(p.v * q.v) + max(CASE WHEN p.i = q.i THEN 10.0 ELSE 0 END) AS v FROM f p JOIN f q ON p.rid = q.rid GROUP BY ALL UNION ALL SELECT i, {GRID2.size}, sum(v * y) FROM f GROUP BY i),\n"
    + gauss_jordan("g", GRID2.size)
    + f" SELECT f.id, round(sum(f.v * s.v), 5) + 0.0 AS mean FROM f JOIN sol s ON s.i = f.i AND s.j = {GRID2.size} GROUP BY f.rid, f.id",
)
def gp2d_mean(spark, sf_dir):
    """Posterior mean over quantity and price at all line items, by the Arrow form."""
    p = S.lineitem_plane(spark, sf_dir).drop("x3")
    m = gp.fit(p, KERNEL2, gp.Config(reg=10.0, tol=1e-12, preconditioner="deflation", rank=10), GRID2, ([0.0, 0.0], 1.01), "arrow")
    return m.predict(p.select("id", "x1", "x2")).select("id", (F.round("mean", 5) + 0.0).alias("mean"))


GRID3 = K.Grid(2, (0.6, 0.9), (3, 1))


def _cauchy_k(r: np.ndarray) -> np.ndarray:
    """exp(-2 pi 0.2 r): its transform is that of a Matern kernel of smoothness 1/2."""
    return np.exp(-2 * math.pi * 0.2 * r)


def _cauchy_khat(xi: np.ndarray) -> np.ndarray:
    return 0.2 / (2 * math.pi) * (0.04 + xi * xi) ** -1.5


PAIR = K.PairKernel(2, _cauchy_k, _cauchy_khat)


def _plane_features(kernel, grid: K.Grid) -> str:
    """The real features of a plane's grid with their own spacings, a row of settings each."""
    w = dict(zip(map(tuple, grid.modes().tolist()), grid.weights(kernel).tolist(), strict=True))
    upper = [m for m in w if m > (0, 0)]
    rows = [(0, 0, 0, 1, w[0, 0])] + [(k + 1, *m, 1, math.sqrt(2) * w[m]) for k, m in enumerate(upper)] + [(k + 1 + len(upper), *m, 0, math.sqrt(2) * w[m]) for k, m in enumerate(upper)]
    h1, h2 = grid.hs
    return "m(i, a, b, even, w) AS (VALUES " + ", ".join(f"({i}, {x * h1!r}::DOUBLE, {y * h2!r}::DOUBLE, {e}, {v!r}::DOUBLE)" for i, x, y, e, v in rows) + ")"


@query(
    "gp2d_user_kernel",
    PLANE
    + f", u AS (SELECT row_number() OVER () AS rid, * FROM pts), {_plane_features(PAIR, GRID3)}, f AS MATERIALIZED (SELECT rid, id, y, i, w * CASE WHEN even = 1 THEN cos(2 * pi() * (a * x1 + b * x2)) ELSE sin(2 * pi() * (a * x1 + b * x2)) END AS v FROM u, m), "
    + f"g AS MATERIALIZED (SELECT p.i, q.i AS j, sum(p.v * q.v) + max(CASE WHEN p.i = q.i THEN 10.0 ELSE 0 END) AS v FROM f p JOIN f q ON p.rid = q.rid GROUP BY ALL UNION ALL SELECT i, {GRID3.size}, sum(v * y) FROM f GROUP BY i),\n"
    + gauss_jordan("g", GRID3.size)
    + f" SELECT f.id, round(sum(f.v * s.v), 5) + 0.0 AS mean FROM f JOIN sol s ON s.i = f.i AND s.j = {GRID3.size} GROUP BY f.rid, f.id",
)
def gp2d_user_kernel(spark, sf_dir):
    """Posterior mean at all line items with a user's kernel and transform, on a grid with its own width and count in each dimension."""
    p = S.lineitem_plane(spark, sf_dir).drop("x3")
    m = gp.fit(p, PAIR, gp.Config(reg=10.0, tol=1e-12), GRID3, ([0.0, 0.0], 1.01))
    return m.predict(p.select("id", "x1", "x2")).select("id", (F.round("mean", 5) + 0.0).alias("mean"))


def _mean_text(m: int, name: str, targets: str) -> str:
    """CTEs that end in the posterior mean at targets on the grid of 2 m + 1 modes: name(id, mean)."""
    n = 2 * m + 1
    f = f"f{m} AS MATERIALIZED {_features_text('pts', m)}, g{m} AS MATERIALIZED (SELECT a.i::INT AS i, b.i::INT AS j, sum(a.v * b.v) + max(CASE WHEN a.i = b.i THEN {REG} ELSE 0 END) AS v FROM f{m} a JOIN f{m} b ON a.id = b.id GROUP BY ALL UNION ALL SELECT i::INT, {n}, sum(v * y) FROM f{m} GROUP BY i),\n"
    return f + gauss_jordan(f"g{m}", n, f"sol{m}") + f", {name} AS MATERIALIZED (SELECT p.id, sum(p.v * s.v) AS mean FROM {_features_text(targets, m)} p JOIN sol{m} s ON s.i = p.i AND s.j = {n} GROUP BY p.id)"


@query(
    "self_convergence",
    LINE + f", {TARGETS}, " + ", ".join(_mean_text(m, f"mean{m}", "t") for m in (2, 4, 6))
    + " SELECT step, modes, round(rms, 6) AS rms, round(worst, 6) AS worst FROM (SELECT 0 AS step, 5 AS modes, sqrt(avg(pow(a.mean - b.mean, 2))) AS rms, max(abs(a.mean - b.mean)) AS worst FROM mean2 a JOIN mean6 b USING (id) UNION ALL SELECT 1, 9, sqrt(avg(pow(a.mean - b.mean, 2))), max(abs(a.mean - b.mean)) FROM mean4 a JOIN mean6 b USING (id))",
)
def self_convergence(spark, sf_dir):
    """Posterior means on coarser grids against the finest."""
    grids = [K.Grid(1, 0.6, m) for m in (2, 4, 6)]
    got = D.self_convergence(S.events_line(spark, sf_dir), line_targets(spark), KERNEL, grids, gp.Config(reg=REG, tol=1e-12), BOX)
    return got.select("step", "modes", r6("rms").alias("rms"), r6("worst").alias("worst"))


_LEGENDRE = ", ".join(f"({k}, {x!r}::DOUBLE, {w!r}::DOUBLE)" for k, (x, w) in enumerate(zip(*(a.tolist() for a in np.polynomial.legendre.leggauss(24)), strict=True)))


@query("mean_integral", LINE + f", q(id, z, w) AS (VALUES {_LEGENDRE}), t AS (SELECT id, z / 2 AS x1 FROM q), {_mean_text(GRID.m, 'mean', 't')} SELECT round(sum(w / 2 * mean), 6) AS integral, round(sum(w / 2 * mean * mean), 6) AS square FROM mean JOIN q USING (id)")
def mean_integral(spark, sf_dir):
    """Integrals of the posterior mean and its square over the month, by Gauss-Legendre nodes of the library's own."""
    x, w = gauss_legendre(24, -0.5, 0.5)
    nodes = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(zip(x, w, strict=True))], "id long, x1 double, w double")
    got = line_model(spark, sf_dir).predict(nodes)
    return got.agg(r6(F.sum(F.col("w") * F.col("mean"))).alias("integral"), r6(F.sum(F.col("w") * F.col("mean") * F.col("mean"))).alias("square"))


@query("structured_interpolation")
def structured_interpolation(spark, sf_dir):
    p = S.events_line(spark, sf_dir)
    nodes = interpolation.fit(p, KERNEL, REG, 64, -0.5001, 0.5001)
    return interpolation.predict(line_targets(spark), nodes, 64, -0.5001, 0.5001).select("id", F.round("mean", 4).alias("mean"))


@query("slq_cdf")
def slq_cdf(spark, sf_dir):
    """Spectral distribution of the system from ten probes, as quantiles."""
    s = line_model(spark, sf_dir).system
    atoms = [(p, float(n), float(w)) for p in range(10) for n, w in zip(*solvers.lanczos_quadrature(s, s.size, p, 12), strict=True)]
    return A.weighted_quantiles(spark.createDataFrame(atoms, "probe int, node double, weight double"), [], [0.1, 0.5, 0.9])


@query("spectrum_report")
def spectrum_report(spark, sf_dir):
    s = line_model(spark, sf_dir).system
    return D.spectrum_report(D.spectral_atoms(spark, s, 8, 12), s.reg)


@query("surrogate_eigen")
def surrogate_eigen(spark, sf_dir):
    """Top eigenvalues by a sample of the rows on a coarser grid, refined on all of them."""
    m = line_model(spark, sf_dir)
    t, _ = D.surrogate_eigenspace(S.events_line(spark, sf_dir), KERNEL, m.system, 4, refine=4)
    return spark.createDataFrame([(k + 1, round(float(v), 4)) for k, v in enumerate(t)], "rank int, value double")


@query("benchmark_runs")
def benchmark_runs(spark, sf_dir):
    p = S.events_line(spark, sf_dir)
    return D.run_grid(p, p, KERNEL, [0, 4], [{"eps": 1e-4, "reg": 1.0}])


@query("fit_metrics", PLANE + " SELECT count(*) AS n, round(sqrt(avg(pow(x1 - y, 2))), 6) AS rmse, round(avg(abs(x1 - y)), 6) AS mae, round(1 - sum(pow(x1 - y, 2)) / (var_pop(y) * count(*)), 6) AS r2, round(max(abs(x1 - y)), 6) AS worst FROM pts")
def fit_metrics(spark, sf_dir):
    return rounded(A.regression_metrics(S.lineitem_plane(spark, sf_dir), "y", "x1"), "rmse", "mae", "r2", "worst")


# kernel machines ------------------------------------------------------------------------------------------------------


def _labelled(spark, sf_dir):
    return S.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("int").alias("label"))


def _mean_centres(spark, sf_dir):
    return class_means(S.table(spark, sf_dir, "embeddings")).select(F.col("class").cast("long").alias("id"), F.col("z").alias("x"), F.col("class").cast("int").alias("label"))


@query("km_gradient", MEANS + " SELECT p.class AS centre, e.label AS class, round(-sum(exp(-p.d / 1.5)), 6) AS value FROM p JOIN e USING (vec_id) GROUP BY ALL")
def km_gradient(spark, sf_dir):
    """The gradient of a zero machine at the class means, summed over all rows as one batch."""
    _, z, _ = machine.arrays(_mean_centres(spark, sf_dir))
    kernel = machine.laplacian(1.5)
    got = machine.batch_sums(_labelled(spark, sf_dir), machine.Machine(kernel, z, np.zeros((len(z), 10))), z, 10, 1, 0, [0])[0]["kz"]
    return rounded(spark.createDataFrame([(a, b, float(got[a, b])) for a in range(got.shape[0]) for b in range(10)], "centre int, class int, value double"), "value")


@query("km_train")
def km_train(spark, sf_dir):
    """A machine on the class means after two epochs; its scores on all rows."""
    m = machine.train(_labelled(spark, sf_dir), _mean_centres(spark, sf_dir), _mean_centres(spark, sf_dir), machine.laplacian(1.5), 10, rank=3, epochs=2)
    return machine.accuracy(m.predict(_labelled(spark, sf_dir)))


_LABELLED_SQL = "WITH e AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS x FROM embeddings), c AS (SELECT range::INT AS class FROM range(0, 10))"


def _weights(m: sharded.Sharded) -> DataFrame:
    return m.table.select("id", F.posexplode("w").alias("class", "w"))


@query(
    "km_coordinates",
    _LABELLED_SQL
    + """, p AS (SELECT a.id, b.label AS class, sum(exp(-list_distance(a.x, b.x) / 1.5)) * 0.002 AS p FROM e a JOIN e b ON a.id % 2 = 1 AND b.id % 2 = 0 GROUP BY ALL)
SELECT e.id, class, round(CASE WHEN e.id % 2 = 0 THEN 0.002 * 1.5 * (label = class)::INT ELSE -0.002 * (coalesce(p, 0) - (label = class)::INT) END, 6) + 0.0 AS w FROM e CROSS JOIN c LEFT JOIN p USING (id, class)""",
)
def km_coordinates(spark, sf_dir):
    """Weights of all rows after two coordinate steps with momentum, on even and on odd ids."""
    m = sharded.train_coordinates(_labelled(spark, sf_dir), machine.laplacian(1.5), 10, rank=0, batches=2, rate=0.002, momentum=0.5, batch_of=lambda n, epoch: F.pmod("id", F.lit(n)), tables=True)
    return rounded(_weights(m), "w")


@query(
    "km_delayed",
    MEANS
    + """, k AS MATERIALIZED (SELECT a.class::INT AS i, b.class::INT AS j, exp(-list_distance(a.z, b.z) / 1.5) AS v FROM z a, z b),
t AS (SELECT p.class::INT AS i, e.label::INT AS c, 0.002 * sum(exp(-p.d / 1.5)) AS v FROM p JOIN e USING (vec_id) GROUP BY ALL), g AS MATERIALIZED (SELECT i, j, v FROM k UNION ALL SELECT i, 10 + c, v FROM t),
"""
    + gauss_jordan("g", 10)
    + " SELECT i::BIGINT AS id, (j - 10)::INT AS class, round(v, 4) + 0.0 AS w FROM sol WHERE j >= 10",
)
def km_delayed(spark, sf_dir):
    """One step on all rows from a zero machine, projected on the class means by the inner solver."""
    inner = {"epochs": 20_000, "tol": 1e-24, "rank": 9, "batches": 1}
    m, _ = sharded.train_delayed(_labelled(spark, sf_dir), _mean_centres(spark, sf_dir), machine.laplacian(1.5), 10, rank=0, batches=4, delay=4, rate=0.002, inner=inner, batch_of=lambda n, epoch: F.lit(0), tables=True)
    return _weights(m).select("id", "class", (F.round("w", 4) + 0.0).alias("w"))


@query("sharded_matvec", "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x, label / 10.0 AS v FROM embeddings) SELECT a.vec_id AS id, round(sum(exp(-list_distance(a.x, b.x) / 2.0) * b.v), 4) AS value FROM e a, e b GROUP BY a.vec_id")
def sharded_matvec(spark, sf_dir):
    """K v with K the Laplacian kernel of all vectors: blocks of points against shards of centres, partial sums by point."""
    v = _labelled(spark, sf_dir)
    m = sharded.Sharded.zeros(v.limit(0), machine.laplacian(2.0), 1)
    m.append(v.withColumn("w", F.array(F.col("label") / 10.0)))
    return m.predict(v).select("id", F.round(F.col("scores")[0], 4).alias("value"))


@query("km_accuracy")
def km_accuracy(spark, sf_dir):
    """Accuracy on all rows after two epochs of coordinate steps whose rank and batches the sample's spectrum chooses."""
    v = _labelled(spark, sf_dir)
    m = sharded.train_coordinates(v, machine.laplacian(1.5), 10, epochs=2)
    return machine.accuracy(m.predict(v).join(v.select("id", "label"), "id"))


_W0 = "[" + ", ".join(repr(float(v)) for v in np.random.default_rng(0).standard_normal((64, 32))[:, 0]) + "]::DOUBLE[]"


@query("random_features", f"SELECT vec_id AS id, round(cos(list_inner_product(embedding::DOUBLE[], {_W0})) / sqrt(32), 6) + 0.0 AS v0 FROM embeddings")
def random_features(spark, sf_dir):
    return machine.random_features(_labelled(spark, sf_dir), 64, 32, 1.0).select("id", r6(F.col("features")[0]).alias("v0"))


# result analytics -----------------------------------------------------------------------------------------------------

RUNS = "WITH runs AS (SELECT l_returnflag AS mode, l_linestatus AS status, year(l_shipdate)::INT AS n, l_extendedprice::DOUBLE AS wall_s, l_tax::DOUBLE AS tax FROM lineitem)"


def runs(spark, sf_dir):
    return S.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("mode"), F.col("l_linestatus").alias("status"), F.year("l_shipdate").alias("n"), F.col("l_extendedprice").cast("double").alias("wall_s"), F.col("l_tax").cast("double").alias("tax"))


@query("bench_summary", RUNS + " SELECT mode, n, count(*) AS repeat_count, round(median(wall_s), 4) AS wall_s_median, round(avg(wall_s), 4) AS wall_s_mean, round(stddev_samp(wall_s), 4) AS wall_s_std, round(quantile_cont(wall_s, 0.1), 4) AS wall_s_p10, round(quantile_cont(wall_s, 0.9), 4) AS wall_s_p90 FROM runs GROUP BY mode, n")
def bench_summary(spark, sf_dir):
    got = A.summarise(runs(spark, sf_dir), ["mode", "n"], ["wall_s"])
    return got.withColumns({c: F.round(c, 4) for c in got.columns if c.startswith("wall_s")})


@query("exact_quantiles", RUNS + " SELECT mode, n, q::DOUBLE AS q, round(CASE q WHEN 0.1 THEN a WHEN 0.5 THEN b ELSE c END, 4) AS wall_s FROM (SELECT mode, n, quantile_cont(wall_s, 0.1) AS a, quantile_cont(wall_s, 0.5) AS b, quantile_cont(wall_s, 0.9) AS c FROM runs GROUP BY mode, n), (SELECT unnest([0.1, 0.5, 0.9]) AS q)")
def exact_quantiles(spark, sf_dir):
    """The percentiles of bench_summary by refined counts, in bounded memory."""
    got = A.exact_quantiles(runs(spark, sf_dir), ["mode", "n"], "wall_s", [0.1, 0.5, 0.9])
    return got.select("mode", "n", "q", F.round("wall_s", 4).alias("wall_s"))


@query("fail_count", RUNS + " SELECT mode, n, count(*) AS runs, count(*) FILTER (status <> 'F') AS fail_count FROM runs GROUP BY mode, n")
def fail_count(spark, sf_dir):
    return A.fail_count(runs(spark, sf_dir), ["mode", "n"], F.col("status") != "F")


@query("local_slope", RUNS + ", a AS (SELECT mode, n, sum(wall_s) AS t FROM runs GROUP BY mode, n), b AS (SELECT *, ln(n) - ln(lag(n) OVER w) AS dx, ln(t) - ln(lag(t) OVER w) AS dy FROM a WINDOW w AS (PARTITION BY mode ORDER BY n)) SELECT mode, n, round(t, 2) AS t, round(CASE WHEN dx <> 0 THEN dy / dx END, 4) AS slope FROM b")
def local_slope(spark, sf_dir):
    a = runs(spark, sf_dir).groupBy("mode", "n").agg(F.sum("wall_s").alias("t"))
    return A.local_slope(a, ["mode"], "n", "t").select("mode", "n", F.round("t", 2).alias("t"), F.round("slope", 4).alias("slope"))


@query("time_share", RUNS + " SELECT mode, n, round(sum(wall_s * tax) / sum(wall_s), 6) AS taxed_share FROM runs GROUP BY mode, n")
def time_share(spark, sf_dir):
    a = runs(spark, sf_dir).groupBy("mode", "n").agg(F.sum("wall_s").alias("t"), F.sum(F.col("wall_s") * F.col("tax")).alias("taxed"))
    return A.share(a, ["taxed"], "t").select("mode", "n", r6("taxed_share").alias("taxed_share"))


@query("speedup_join", RUNS + ", a AS (SELECT mode, n, avg(wall_s) AS t FROM runs GROUP BY mode, n) SELECT x.n, round(x.t, 4) AS base, round(y.t, 4) AS other, round(x.t / y.t, 6) AS speedup FROM a x JOIN a y ON x.n = y.n AND x.mode = 'N' AND y.mode = 'R'")
def speedup_join(spark, sf_dir):
    a = runs(spark, sf_dir).groupBy("mode", "n").agg(F.avg("wall_s").alias("t"))
    got = A.speedup(a, F.col("mode") == "N", F.col("mode") == "R", ["n"], "t")
    return got.select("n", F.round("base", 4).alias("base"), F.round("other", 4).alias("other"), r6("speedup").alias("speedup"))


@query("param_grid", "SELECT n::INT AS n, eps::DOUBLE AS eps, solver FROM (SELECT unnest([100, 1000]) AS n), (SELECT unnest([1e-3, 1e-6]) AS eps), (SELECT unnest(['pcg', 'richardson']) AS solver)")
def param_grid(spark, sf_dir):
    return A.parameter_grid(spark, {"n": [100, 1000], "eps": [1e-3, 1e-6], "solver": ["pcg", "richardson"]})


@query("stacked_results", RUNS + " SELECT mode, NULL::INT AS n, round(sum(tax), 4) AS t FROM runs GROUP BY mode UNION ALL SELECT NULL, n, round(sum(tax), 4) FROM runs GROUP BY n")
def stacked_results(spark, sf_dir):
    r = runs(spark, sf_dir)
    t = F.round(F.sum("tax"), 4).alias("t")
    return A.stacked([r.groupBy("mode").agg(t), r.groupBy("n").agg(t)], ["mode", "n"]).select("mode", "n", "t")


@query("metric_left_join", RUNS + ", m AS (SELECT mode, n, round(sum(tax), 4) AS t FROM runs WHERE mode <> 'A' GROUP BY ALL) SELECT c.mode, c.n, m.t AS t_method FROM (SELECT DISTINCT mode, n FROM runs) c LEFT JOIN m ON m.mode IS NOT DISTINCT FROM c.mode AND m.n IS NOT DISTINCT FROM c.n")
def metric_left_join(spark, sf_dir):
    r = runs(spark, sf_dir)
    m = r.where("mode <> 'A'").groupBy("mode", "n").agg(F.round(F.sum("tax"), 4).alias("t"))
    return A.left_metrics(A.distinct_values(r, ["mode", "n"]), m, ["mode", "n"], "_method").select("mode", "n", "t_method")


@query("distinct_modes", RUNS + " SELECT DISTINCT mode, n FROM runs")
def distinct_modes(spark, sf_dir):
    return A.distinct_values(runs(spark, sf_dir), ["mode", "n"])


@query("latitude_band", "SELECT s_suppkey, round(s_acctbal::DOUBLE / 200, 6) AS lat FROM supplier WHERE s_acctbal::DOUBLE / 200 BETWEEN -10 AND 30")
def latitude_band(spark, sf_dir):
    s = S.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal").cast("double") / 200).alias("lat"))
    return rounded(S.latitude_band(s, -10.0, 30.0), "lat")


@query("cosine_toy", "SELECT id, round(id / 500.0, 6) AS x1, round(cos(2 * pi() * 3 * (id / 500.0)), 6) + 0.0 AS y FROM range(500) r(id)")
def cosine_toy(spark, sf_dir):
    return rounded(S.cosine_toy(spark, 500, 3.0), "x1", "y")


ATOMS = "WITH atoms AS (SELECT l_returnflag AS probe, l_quantity::DOUBLE AS node, sum(l_tax::DOUBLE) AS weight FROM lineitem GROUP BY ALL)"


def atoms(spark, sf_dir):
    t = S.table(spark, sf_dir, "lineitem")
    return t.groupBy(F.col("l_returnflag").alias("probe"), F.col("l_quantity").cast("double").alias("node")).agg(F.sum(F.col("l_tax").cast("double")).alias("weight"))


@query("spectral_cdf", ATOMS + " SELECT probe, node, round(sum(weight) OVER (PARTITION BY probe ORDER BY node) / sum(weight) OVER (PARTITION BY probe), 6) AS cdf FROM atoms")
def spectral_cdf(spark, sf_dir):
    return A.with_cdf(atoms(spark, sf_dir), ["probe"]).select("probe", "node", r6("cdf").alias("cdf"))


@query("weighted_quantile", ATOMS + ", c AS (SELECT probe, node, sum(weight) OVER (PARTITION BY probe ORDER BY node) / sum(weight) OVER (PARTITION BY probe) AS cdf FROM atoms) SELECT probe, q::DOUBLE AS q, min(node) AS value FROM c, (SELECT unnest([0.1, 0.5, 0.9]) AS q) WHERE cdf >= q - 1e-12 GROUP BY ALL")
def weighted_quantile(spark, sf_dir):
    return A.weighted_quantiles(atoms(spark, sf_dir), ["probe"], [0.1, 0.5, 0.9])


@query("spectral_density", ATOMS + " SELECT probe, x::DOUBLE AS x, round(sum(weight * exp(-pow((x - node) / 4.0, 2) / 2)) / (4.0 * sqrt(2 * pi())), 5) AS density FROM atoms, (SELECT unnest([5.0, 25.0, 45.0]) AS x) GROUP BY ALL")
def spectral_density(spark, sf_dir):
    return A.density(atoms(spark, sf_dir), ["probe"], [5.0, 25.0, 45.0], 4.0).withColumn("density", F.round("density", 5))


@query("prefix_span", ATOMS + ", k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY node DESC) AS r FROM atoms) SELECT probe, round((max(weight) - min(weight)) / abs(avg(weight)), 6) AS span FROM k WHERE r <= 5 GROUP BY probe")
def prefix_span(spark, sf_dir):
    return rounded(A.relative_span(atoms(spark, sf_dir), ["probe"], "node", "weight"), "span")


# streams --------------------------------------------------------------------------------------------------------------

SUMS = LINE + " SELECT j1::INT AS j1, count(*) AS n, round(sum(cos(2 * pi() * j1 * x1)), 4) AS re, round(sum(-sin(2 * pi() * j1 * x1)), 4) AS im, round(sum(y * cos(2 * pi() * j1 * x1)), 4) AS yre, round(sum(-y * sin(2 * pi() * j1 * x1)), 4) AS yim FROM pts, range(-4, 5) r(j1) GROUP BY j1"


def _tidy_sums(df):
    return df.select("j1", "n", *[(F.round(c, 4) + 0.0).alias(c) for c in ("re", "im", "yre", "yim")])


@query("running_sums", SUMS)
def running_sums(spark, sf_dir):
    return _tidy_sums(stream.running_sums(S.events_line(spark, sf_dir), 4, 1.0))


@query("stream_sums", SUMS)
def stream_sums(spark, sf_dir):
    """The same from a stream of the events' files: each micro-batch leaves its sums under its number, and they are added up."""
    return _tidy_sums(stream.from_files(spark, f"{sf_dir}/events.parquet", 4, 1.0))


@query("windowed_sums", LINE + " SELECT date_trunc('day', ts)::DATE AS day, j1::INT AS j1, count(*) AS n, round(sum(y * cos(2 * pi() * j1 * x1)), 4) AS yre, round(sum(-y * sin(2 * pi() * j1 * x1)), 4) AS yim FROM pts, range(-2, 3) r(j1) GROUP BY ALL")
def windowed_sums(spark, sf_dir):
    e = S.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), ((S.seconds("ts") - F.lit(S.EVENTS_START)) / F.lit(S.EVENTS_SPAN) - 0.5).alias("x1"), (F.col("value") / 100.0 - 2.5).alias("y"))
    got = stream.windowed_sums(e, 2, 1.0)
    return got.select(F.to_date("start").alias("day"), "j1", "n", (F.round("yre", 4) + 0.0).alias("yre"), (F.round("yim", 4) + 0.0).alias("yim"))
