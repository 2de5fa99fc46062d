"""What the operators share: the folder that all executors see, staged tables, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_mine: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; only where it is unset and all runs on one machine (as in tests), a temporary one is made and set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kernelspark-")
        spark.sparkContext.setCheckpointDir(at)
        _mine.append((spark, at))
    return at


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder below shared_dir(); removed when the program ends."""
    at = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _mine.append((spark, at))
    return at


def remove_dir(spark: SparkSession, at: str) -> None:
    """Delete a folder of new_dir() whose tables nobody reads any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, at in _mine:
        try:
            remove_dir(spark, at)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


#: Spark's own setting: the shuffle files of a query go when it has ended, not when the driver's memory is next collected.
FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Spark's own setting: bytes of a batch that a step over Arrow takes; by its default of 10,000 rows a batch of texts has 25 MB, twice that as it grows.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    The write's shuffle files are of no use once the table is there; they are removed at once.  Steps over Arrow get batches of 4 MB.
    """
    spark = df.sparkSession
    at = new_dir(spark, name)
    before = {k: spark.conf.get(k) for k in (FILE_CLEANUP, BATCH_BYTES)}
    spark.conf.set(FILE_CLEANUP, True)
    spark.conf.set(BATCH_BYTES, "4m")
    try:
        df.write.parquet(at)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(at)
    out._staged_at = at
    return out


def lean(function):
    """A function for mapInArrow that gives freed memory back to the system when its task ends: workers live on, and what their allocators keep adds up."""

    def each(batches):
        try:
            yield from function(batches)
        finally:
            trim()

    return each


def trim() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        pass


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b: long): rows (node, component), component the smallest node reachable.

    Alternates the large-star and small-star steps, each one shuffle on the
    vertex, until no edge changes; a hub with very many edges is reduced by
    map-side minimum before it is shuffled, and its edges are joined, which AQE
    can split.  Every round is written to the shared folder.  No edges: no rows.
    """
    e = staged(
        edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = staged(small.where("u <> v").distinct(), "edges")
        after = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        for old in (e, large):
            remove_dir(old.sparkSession, old._staged_at)
        e = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
