"""Incremental Fourier statistics with Structured Streaming: the sums are additive, so a stream keeps them up to date.

The box is fixed before the first row; rows outside it are counted, not clipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelspark.operators.fourier import dims_of, phase, with_modes
from kernelspark.sources.staging import work_dir


def running_sums(points: DataFrame, m: int, scale: float, low: float = -0.5, high: float = 0.5) -> DataFrame:
    """Streaming or batch (j1.., n, outside, re, im, yre, yim) by mode; as a stream in complete or update mode."""
    dims = dims_of(points)
    js = [f"j{k + 1}" for k in range(len(dims))]
    inside = F.lit(True)
    for c in dims:
        inside = inside & F.col(c).between(low, high)
    rows = with_modes(points.select(*dims, "y", inside.alias("inside")), m, len(dims))
    t = phase(dims, scale, js)
    own = lambda c: F.sum(F.when(F.col("inside"), c).otherwise(0.0))
    return rows.groupBy(*js).agg(
        F.count_if("inside").alias("n"), F.count_if(~F.col("inside")).alias("outside"), own(F.cos(t)).alias("re"), own(-F.sin(t)).alias("im"), own(F.col("y") * F.cos(t)).alias("yre"), own(-F.col("y") * F.sin(t)).alias("yim")
    )


def windowed_sums(points: DataFrame, m: int, scale: float, every: str = "1 day", late: str = "1 day", time: str = "ts") -> DataFrame:
    """The same sums by event-time window; with a watermark, windows of a stream are given out once and their state is dropped."""
    dims = dims_of(points)
    js = [f"j{k + 1}" for k in range(len(dims))]
    source = points.withWatermark(time, late) if points.isStreaming else points
    rows = with_modes(source.select(time, *dims, "y"), m, len(dims))
    t = phase(dims, scale, js)
    out = rows.groupBy(F.window(time, every).alias("w"), *js).agg(F.count("*").alias("n"), F.sum(F.col("y") * F.cos(t)).alias("yre"), F.sum(-F.col("y") * F.sin(t)).alias("yim"))
    return out.select(F.col("w.start").alias("start"), *js, "n", "yre", "yim")


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> None:
    """Read all that is there, in micro-batches, and stop; a restart goes on where it ended."""
    stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def from_files(spark: SparkSession, path: str, m: int, scale: float) -> DataFrame:
    """running_sums of a stream of event files, all that are there: each micro-batch writes its sums to a folder of its number, so a repeated batch writes the same folder again."""
    from kernelspark.sources.tables import EVENTS_SPAN, EVENTS_START, seconds

    at = work_dir(spark)
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")  # as a pattern, a single file will do as well
    points = rows.select(((seconds("ts") - EVENTS_START) / EVENTS_SPAN - 0.5).alias("x1"), (F.col("value") / 100.0 - 2.5).alias("y"))

    def keep(batch: DataFrame, k: int) -> None:
        running_sums(batch, m, scale).write.mode("overwrite").parquet(f"{at}/sums/batch={k}")

    points.writeStream.foreachBatch(keep).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{at}/sums")
    return got.groupBy("j1").agg(*[F.sum(c).alias(c) for c in ("n", "outside", "re", "im", "yre", "yim")])

