"""Point sets: views over the tables, generators, files, and the affine map into the unit box."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


#: The fixed box of the events of January 2024: its first second and its length, so that streams need no second pass.
EVENTS_START, EVENTS_SPAN = 1704067200.0, 2592000.0


def events_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x1 in [-1/2, 1/2], y): event values over time, y in hundreds about 2.5."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), ((seconds("ts") - F.lit(EVENTS_START)) / F.lit(EVENTS_SPAN) - 0.5).alias("x1"), (F.col("value") / 100.0 - 2.5).alias("y"))


def lineitem_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x1, x2, x3, y): quantity, price and day in boxes of length 1, discount about its middle."""
    t = table(spark, sf_dir, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return t.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        (F.col("l_quantity").cast("double") / 50.0 - 0.5).alias("x1"),
        (F.col("l_extendedprice").cast("double") / 105000.0 - 0.5).alias("x2"),
        (day / 2500.0 - 0.5).alias("x3"),
        (F.col("l_discount").cast("double") * 10.0 - 0.5).alias("y"),
    )


# generators -----------------------------------------------------------------------------------------------------------


def _uniform(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone, so any part of the data can be made again anywhere."""
    return F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _normal(key: Column, salt: int) -> Column:
    return F.sqrt(-2 * F.log(F.greatest(_uniform(key, salt), F.lit(1e-300)))) * F.cos(2 * F.pi() * _uniform(key, salt + 1))


def truth(dim: int, rough: bool = False) -> Column:
    """Smooth test functions of x1 .. x3; rough ones add a step."""
    x1, x2, x3 = F.col("x1"), F.col("x2"), F.col("x3")
    tau = 2 * F.pi()
    if dim == 1:
        y, step = F.sin(tau * x1) + 0.3 * F.cos(3 * tau * x1), x1 > 0.55
    elif dim == 2:
        y, step = F.sin(tau * x1) + 0.5 * F.cos(tau * x2) + 0.2 * F.sin(tau * (x1 + x2)), x1 + x2 > 1
    else:
        y, step = F.sin(tau * x1) + 0.5 * F.cos(tau * x2) + 0.25 * F.sin(tau * x3), x1 + x2 + x3 > 1.5
    return y + step.cast("double") if rough else y


def random_points(spark: SparkSession, n: int, dim: int, seed: int = 0, noise: float = 0.0, y: Column | None = None) -> DataFrame:
    """n points uniform in the unit box with y (by default truth(dim)) plus noise."""
    df = spark.range(n).select("id", *[_uniform(F.col("id"), seed * 100 + k).alias(f"x{k + 1}") for k in range(dim)])
    df = df.withColumn("y", truth(dim) if y is None else y)
    return df.withColumn("y", F.col("y") + noise * _normal(F.col("id"), seed * 100 + 50)) if noise else df


def clustered_points(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A 60/40 mixture of two normal clusters in the plane, cut to the unit box."""
    first = _uniform(F.col("id"), seed * 100 + 40) < 0.6
    near = lambda a, b, k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(first, a + 0.05 * _normal(F.col("id"), k)).otherwise(b + 0.08 * _normal(F.col("id"), k))))
    return spark.range(n).select("id", near(0.3, 0.75, seed * 100 + 41).alias("x1"), near(0.3, 0.65, seed * 100 + 44).alias("x2"))


def holed_points(spark: SparkSession, n: int, half: float = 0.3, seed: int = 0) -> DataFrame:
    """Of n points in the square [-1/2, 1/2]^2 those outside the central square."""
    df = random_points(spark, n, 2, seed, y=F.lit(0.0)).withColumns({c: F.col(c) - 0.5 for c in ("x1", "x2")})
    return df.where(F.greatest(F.abs("x1"), F.abs("x2")) > half)


def grid_points(spark: SparkSession, n: int, dim: int, low: float = 0.0, high: float = 1.0, ends: bool = True) -> DataFrame:
    """n^dim equispaced points, with or without the upper end, from one range: no join."""
    step = (high - low) / ((n - 1) if ends else n)
    df = spark.range(n**dim)
    return df.select("id", *[(F.lit(low) + (F.floor(F.col("id") / F.lit(n ** (dim - 1 - k))) % n) * F.lit(step)).alias(f"x{k + 1}") for k in range(dim)])


def strided(df: DataFrame, every: int, offset: int = 0) -> DataFrame:
    """Every k-th id: the same subset wherever and whenever it is made."""
    return df.where(F.pmod(F.col("id"), F.lit(every)) == offset)


def id_range(df: DataFrame, start: int, end: int) -> DataFrame:
    return df.where((F.col("id") >= start) & (F.col("id") < end))


def mini_batches(df: DataFrame, batches: int, epoch: int = 0) -> DataFrame:
    """A batch number for every id, shuffled anew each epoch, without moving a row."""
    return df.withColumn("batch", F.pmod(F.xxhash64(F.lit(epoch), "id"), F.lit(batches)).cast("int"))


def binary_doubles(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """Files of little-endian doubles, column by column, as rows (path, id, x1 ..)."""
    import numpy as np
    import pyarrow as pa

    def read(batches):
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                v = np.frombuffer(raw, "<f8").reshape(columns, -1)
                yield pa.RecordBatch.from_arrays([pa.array([p] * v.shape[1]), pa.array(np.arange(v.shape[1])), *map(pa.array, v)], names=["path", "id", *[f"x{k + 1}" for k in range(columns)]])

    schema = "path string, id long, " + ", ".join(f"x{k + 1} double" for k in range(columns))
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, schema)


def split_by_missing(df: DataFrame, y: str = "y") -> tuple[DataFrame, DataFrame]:
    """(rows with a value, rows whose value is NaN or null): training and test rows of files that mark these so."""
    missing = F.col(y).isNull() | F.isnan(F.col(y))
    return df.where(~missing), df.where(missing)


def latitude_band(df: DataFrame, low: float, high: float, lat: str = "lat") -> DataFrame:
    """The rows between two latitudes, both included."""
    return df.where(F.col(lat).between(low, high))


def cosine_toy(spark: SparkSession, n: int, waves: float = 1.0) -> DataFrame:
    """(id, x1, y): one period or more of a cosine at n equispaced points of [0, 1), without noise."""
    x = F.col("id") / F.lit(float(n))
    return spark.range(n).select("id", x.alias("x1"), F.cos(F.lit(2 * math.pi * waves) * x).alias("y"))


def lonlat(df: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """x1, x2 in degrees with the aspect of the mean latitude."""
    mean = df.agg(F.avg(lat)).first()[0]
    return df.withColumn("x1", F.col(lon) * F.cos(F.radians(F.lit(mean)))).withColumn("x2", F.col(lat))


def into_box(df: DataFrame, dims: list[str], targets: DataFrame | None = None) -> tuple[DataFrame, list[float], float]:
    """Map columns affinely so that the points (and targets) lie in [-1/2, 1/2]; (points, centres, common length)."""
    both = df.select(dims) if targets is None else df.select(dims).unionAll(targets.select(dims))
    r = both.agg(*[f(c).alias(f"{n}_{c}") for c in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    centre = [(r[f"lo_{c}"] + r[f"hi_{c}"]) / 2 for c in dims]
    box = max(r[f"hi_{c}"] - r[f"lo_{c}"] for c in dims) or 1.0
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(box) for c, m in zip(dims, centre, strict=True)}), centre, box


def demean(df: DataFrame, y: str = "y") -> tuple[DataFrame, float]:
    """(df with y less its mean, the mean): add_mean puts it back on predictions."""
    m = df.agg(F.avg(F.col(y).cast("double"))).first()[0] or 0.0
    return df.withColumn(y, F.col(y).cast("double") - F.lit(float(m))), float(m)


def add_mean(df: DataFrame, mean: float, column: str = "mean") -> DataFrame:
    return df.withColumn(column, F.col(column) + F.lit(mean))


def clipped(df: DataFrame, dims: list[str], low: float = -0.5, high: float = 0.5) -> DataFrame:
    """Coordinates put on the box's border where they lie beyond it."""
    return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(low)), F.lit(high)) for c in dims})


def contiguous_shards(df: DataFrame, shards: int, key: str = "id") -> DataFrame:
    """A shard number for every row: runs of neighbouring ids of equal length, the last shard takes what is left; not shuffled.

    Ids must be 0 .. n - 1, so that a row's shard follows from its id and the number of rows alone.
    """
    n = df.count()
    size = max(1, n // shards)
    return df.withColumn("shard", F.least(F.floor(F.col(key) / F.lit(size)), F.lit(shards - 1)).cast("int"))


def read_csv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    """CSV files with a header by a schema of their own; a field that does not fit fails the read."""
    return spark.read.schema(schema).options(header=True, mode="FAILFAST", **options).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line; null fields are kept."""
    df.write.option("ignoreNullFields", False).json(path)


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)
