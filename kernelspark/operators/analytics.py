"""Metrics and the relational layer over result tables: groups with percentiles, slopes, shares, joins, cumulative weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def regression_metrics(df: DataFrame, y: str, mean: str) -> DataFrame:
    """One row: n, rmse, mae, r2 (null where y does not vary), worst; one pass, from additive moments about a shift."""
    e = F.col(mean) - F.col(y)
    agg = df.agg(F.count("*").alias("n"), F.sum(e * e).alias("se"), F.avg(F.abs(e)).alias("mae"), (F.var_pop(y) * F.count(y)).alias("st"), F.max(F.abs(e)).alias("worst"))
    return agg.select("n", F.sqrt(F.col("se") / F.col("n")).alias("rmse"), "mae", F.when(F.col("st") > 0, 1 - F.col("se") / F.col("st")).alias("r2"), "worst")


def error_of(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """rms and largest difference of two results joined on their key."""
    j = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key)
    d = F.col("a") - F.col("b")
    return j.agg(F.sqrt(F.avg(d * d)).alias("rms"), F.max(F.abs(d)).alias("worst"))


def summarise(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Per group: count, and median, mean, sample deviation and interpolated 10th and 90th percentile of each value. Null keys are a group; NaN counts as the greatest value.

    df is read some three times: the percentiles come from refined counts, as those of exact_quantiles, since percentile() keeps and shuffles every distinct value.
    """
    from kernelspark.sources.staging import written

    ks, qs = [f"__k{i}" for i in range(len(keys))], {"median": 0.5, "p10": 0.1, "p90": 0.9}
    named = df.select(*[F.col(c).alias(k) for c, k in zip(keys, ks, strict=True)], *[F.col(v).alias(f"__v{i}") for i, v in enumerate(values)])
    out = [F.count("*").alias("repeat_count")]
    for i, v in enumerate(values):
        out += [F.avg(f"__v{i}").alias(f"{v}_mean"), F.stddev_samp(f"__v{i}").alias(f"{v}_std"), F.struct(*_extremes(F.col(f"__v{i}").cast("double"))).alias(f"__e{i}")]
    groups = written(named.groupBy(*ks).agg(*out))
    got = groups
    for i, v in enumerate(values):
        found = _quantiles(named.select(*ks, F.col(f"__v{i}").cast("double").alias("v")).where("v is not null"), groups.select(*ks, f"__e{i}.*"), ks, list(qs.values()))
        wide = found.groupBy(*[F.col(k).alias(f"{k}_") for k in ks]).agg(*[F.max(F.when(F.col("q") == q, F.col("v"))).alias(f"{v}_{name}") for name, q in qs.items()])
        got = got.join(wide, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in ks], F.lit(True)), "left").drop(*[f"{k}_" for k in ks])
    return got.select(*[F.col(k).alias(c) for c, k in zip(keys, ks, strict=True)], "repeat_count", *[f"{v}_{name}" for v in values for name in ("median", "mean", "std", "p10", "p90")])


#: Parts that a range of values is cut in, and rows of a range that is no longer cut but sorted.
PARTS, FEW = 1_024, 10_000


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """(keys.., q, value): exact quantiles with linear interpolation, as percentile gives them, in bounded memory. Null keys are a group; null and NaN values take no part.

    A quantile lies between two rows of known ranks.  For each such rank the
    range that holds it is cut in equal parts, rows are counted by part (partial
    counts, so what is shuffled is at most the parts), and the part with the rank
    is the next range, shrunk to the least and greatest value in it, until it has
    one value or few rows; only those are sorted.  Every round is one pass; two do
    for most data.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(keys, ks, strict=True)], F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    found = _quantiles(rows, rows.groupBy(*ks).agg(*_extremes(F.col("v"))), ks, qs)
    return found.select(*[F.col(k).alias(c) for c, k in zip(keys, ks, strict=True)], "q", F.col("v").alias(value))


def _extremes(v: Column) -> list[Column]:
    """Of a group: how many values, -Infinity, Infinity and NaN it has, and its least and greatest finite value."""
    finite = F.when(F.abs(v) < float("inf"), v)
    return [F.count(v).alias("n"), F.count_if(v == float("-inf")).alias("least"), F.count_if(v == float("inf")).alias("most"), F.count_if(F.isnan(v)).alias("nans"), F.min(finite).alias("lo"), F.max(finite).alias("hi")]


def _quantiles(rows: DataFrame, groups: DataFrame, ks: list[str], qs: list[float]) -> DataFrame:
    """(ks.., q, v) of rows (ks.., v) without nulls, whose groups have _extremes."""
    from kernelspark.sources.staging import remove, written

    place = F.col("q") * (F.col("n") - 1)
    wanted = groups.where("n > 0").withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    wanted = wanted.withColumn("rank", F.when(F.col("side") == 0, F.floor(place)).otherwise(F.ceil(place)).cast("long"))
    # what is not finite lies at the ends
    finite = F.col("n") - F.col("least") - F.col("most") - F.col("nans")
    end = F.when(F.col("rank") < F.col("least"), float("-inf")).when(F.col("rank") >= F.col("n") - F.col("nans"), float("nan")).when(F.col("rank") >= F.col("least") + finite, float("inf"))
    wanted = written(wanted.select(*ks, "q", "side", "rank", F.col("least").alias("below"), finite.alias("held"), "n", F.coalesce(end, "lo").alias("lo"), F.coalesce(end, "hi").alias("hi")))
    same = lambda cols: reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols], F.lit(True))
    left = lambda *cols: [F.col(f"a.{c}").alias(c) for c in cols]
    open_ = (F.col("held") > FEW) & (F.col("lo") < F.col("hi"))

    def inside(ranges: DataFrame) -> DataFrame:
        """Rows with each distinct range of their group that holds them."""
        r = ranges.select(*ks, "lo", "hi").distinct()
        met = rows.alias("b").join(r.alias("a"), same(ks) & F.col("b.v").between(F.col("a.lo"), F.col("a.hi")))
        return met.select(*left(*ks, "lo", "hi"), F.col("b.v").alias("v"))

    while wanted.where(open_).limit(1).count():
        part = F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * PARTS), F.lit(PARTS - 1)).cast("int")
        counts = inside(wanted.where(open_)).withColumn("part", part).groupBy(*ks, "lo", "hi", "part").agg(F.count("*").alias("c"), F.min("v").alias("lo2"), F.max("v").alias("hi2"))
        counts = counts.withColumn("before", F.sum("c").over(Window.partitionBy(*ks, "lo", "hi").orderBy("part")) - F.col("c"))
        at = F.col("a.rank") - F.col("a.below")
        cut = wanted.where(open_).alias("a").join(counts.alias("b"), same([*ks, "lo", "hi"]) & (F.col("b.before") <= at) & (at < F.col("b.before") + F.col("b.c")))
        cut = cut.select(*left(*ks, "q", "side", "rank"), (F.col("a.below") + F.col("b.before")).alias("below"), F.col("b.c").alias("held"), *left("n"), F.col("b.lo2").alias("lo"), F.col("b.hi2").alias("hi"))
        old, wanted = wanted, written(wanted.where(~open_).unionByName(cut))
        remove(old)
    # few rows a range are left, or one value
    lists = inside(wanted.where("lo < hi")).groupBy(*ks, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    found = wanted.alias("a").join(lists.alias("b"), same([*ks, "lo", "hi"]), "left")
    v = F.when(F.col("a.lo") == F.col("a.hi"), F.col("a.lo")).otherwise(F.get("b.vs", (F.col("a.rank") - F.col("a.below")).cast("int")))
    found = found.select(*left(*ks, "q", "side", "n"), v.alias("v"))
    both = found.groupBy(*ks, "q").agg(F.max("n").alias("n"), F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    share = F.col("q") * (F.col("n") - 1) - F.floor(F.col("q") * (F.col("n") - 1))
    return both.select(*ks, "q", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - share) + F.col("b") * share).alias("v"))


def fail_count(df: DataFrame, keys: list[str], failed: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("runs"), F.count_if(failed).alias("fail_count"))


def local_slope(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """slope: d log y / d log x between neighbours by x within a group; null for the first, and where x does not change."""
    w = Window.partitionBy(*keys).orderBy(x)
    dx, dy = F.log(F.col(x)) - F.log(F.lag(x).over(w)), F.log(F.col(y)) - F.log(F.lag(y).over(w))
    return df.withColumn("slope", F.when(dx != 0, dy / dx))


def share(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Each part's share of the total; null where the total is 0."""
    return df.withColumns({f"{p}_share": F.col(p) / F.when(F.col(total) != 0, F.col(total)) for p in parts})


def speedup(df: DataFrame, base: Column, other: Column, on: list[str], value: str) -> DataFrame:
    a, b = df.where(base).select(*on, F.col(value).alias("base")), df.where(other).select(*on, F.col(value).alias("other"))
    return a.join(b, on).withColumn("speedup", F.col("base") / F.col("other"))


def left_metrics(cases: DataFrame, metrics: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Every case with its metrics, named with a suffix; cases without metrics stay, and null keys meet null keys."""
    own = metrics.select(*[F.col(c).alias(f"__{c}" if c in on else f"{c}{suffix}") for c in metrics.columns])
    meet = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in on])
    return cases.join(own, meet, "left").drop(*[f"__{c}" for c in on])


def distinct_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """The distinct combinations of these columns, in order."""
    return df.select(*cols).distinct().orderBy(*cols)


def stacked(tables: list[DataFrame], order: list[str]) -> DataFrame:
    """Tables one after another in this order, missing columns null."""
    parts = [t.withColumn("__section", F.lit(k)) for k, t in enumerate(tables)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("__section", *order).drop("__section")


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """All combinations of a few settings, from one row exploded."""
    df = spark.range(1).select()
    for name, values in grid.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def with_cdf(atoms: DataFrame, keys: list[str], node: str = "node", weight: str = "weight") -> DataFrame:
    """cdf: share of weight up to and with a node. Ties share a value."""
    run = Window.partitionBy(*keys).orderBy(node).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return atoms.withColumn("cdf", F.sum(weight).over(run) / F.sum(weight).over(Window.partitionBy(*keys)))


def weighted_quantiles(atoms: DataFrame, keys: list[str], q: list[float], node: str = "node", weight: str = "weight") -> DataFrame:
    """The first node at which the cumulative weight reaches q of the total."""
    cdf = with_cdf(atoms, keys, node, weight).withColumn("q", F.explode(F.array(*[F.lit(v) for v in q])))
    return cdf.where(F.col("cdf") >= F.col("q") - 1e-12).groupBy(*keys, "q").agg(F.min(node).alias("value"))


def density(atoms: DataFrame, keys: list[str], at: list[float], width: float, node: str = "node", weight: str = "weight") -> DataFrame:
    """Weights smoothed by a normal of this width, at given places."""
    x = atoms.withColumn("x", F.explode(F.array(*[F.lit(v) for v in at])))
    z = (F.col("x") - F.col(node)) / width
    return x.groupBy(*keys, "x").agg((F.sum(F.col(weight) * F.exp(-z * z / 2)) / (width * (2 * 3.141592653589793) ** 0.5)).alias("density"))


def relative_span(df: DataFrame, keys: list[str], step: str, value: str, last: int = 5) -> DataFrame:
    """(max - min) / |mean| over the last few steps of each group."""
    w = Window.partitionBy(*keys).orderBy(F.desc(step))
    tail = df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= last)
    return tail.groupBy(*keys).agg(((F.max(value) - F.min(value)) / F.abs(F.avg(value))).alias("span"))


def nearest_to_origin(df: DataFrame, dims: list[str], key: str = "id") -> DataFrame:
    d2 = sum((F.col(c) * F.col(c) for c in dims[1:]), F.col(dims[0]) * F.col(dims[0]))
    return df.select(key, *dims, d2.alias("d2")).orderBy("d2", key).limit(1)


def top_classes(scores: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best (class, score) of each row, class ascending in ties."""
    w = Window.partitionBy(key).orderBy(F.desc("score"), "class")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# vector columns -------------------------------------------------------------------------------------------------------


def unit_norm(v: str) -> Column:
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.transform(v, lambda x: x.cast("double") / n)


def one_hot(label: str, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda c: (c == F.col(label)).cast("double"))


def unit_range(df: DataFrame, v: str, dim: int) -> DataFrame:
    """Each feature mapped to [0, 1] by its own extremes; features that don't vary become 0."""
    lo = df.agg(*[F.min(F.col(v)[k]).alias(f"lo{k}") for k in range(dim)], *[F.max(F.col(v)[k]).alias(f"hi{k}") for k in range(dim)]).first()
    at = F.array(*[F.lit(float(lo[f"lo{k}"])) for k in range(dim)])
    span = F.array(*[F.lit(float(lo[f"hi{k}"] - lo[f"lo{k}"])) for k in range(dim)])
    return df.withColumn(v, F.transform(F.arrays_zip(F.col(v).alias("a"), at.alias("b"), span.alias("c")), lambda t: F.when(t.c > 0, (t.a.cast("double") - t.b) / t.c).otherwise(0.0)))


def row_max_range(df: DataFrame, v: str, dim: int) -> DataFrame:
    """Each feature less its minimum, divided by the row's maximum of what is left."""
    lo = df.agg(*[F.min(F.col(v)[k]).alias(f"lo{k}") for k in range(dim)]).first()
    at = F.array(*[F.lit(float(lo[f"lo{k}"])) for k in range(dim)])
    moved = F.zip_with(v, at, lambda a, b: a.cast("double") - b)
    return df.withColumn("__m", moved).withColumn(v, F.transform("__m", lambda x: x / F.array_max("__m"))).drop("__m")
