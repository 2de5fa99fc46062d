"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_mine: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, removed when the program ends; only where that is unset and all runs on one machine, below a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="kernelspark-")
    at = f"{at.rstrip('/')}/work-{uuid.uuid4().hex[:12]}"
    _mine.append((spark, at))
    return at


def written(df: DataFrame) -> DataFrame:
    """df written once and read again: lineage ends there, and lost executors lose nothing."""
    at = work_dir(df.sparkSession)
    df.write.parquet(at)
    out = df.sparkSession.read.schema(df.schema).parquet(at)
    out._written_at = at
    return out


def remove(df: DataFrame) -> None:
    """Delete what written() wrote, when nobody reads it any more."""
    if hasattr(df, "_written_at"):
        _delete(df.sparkSession, df._written_at)


def _delete(spark: SparkSession, at: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, at in _mine:
        try:
            _delete(spark, at)
        except Exception:  # noqa: BLE001  the session may be gone already
            return
