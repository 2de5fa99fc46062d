"""Rows of whole numbers that are shuffled in blocks.

Numbers are dealt out in numpy: a block holds a task's rows of one bucket, byte
by byte in columns, which compress well.  Spark moves and sorts blocks, and the
rows are put in order where they arrive, a bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows that a task collects before it deals them out, and blocks of a batch it gives.
HELD, BLOCKS = 1 << 18, 256
#: Buckets at least, and in each partition.
BUCKETS, EACH = 512, 4

SCHEMA = "bucket int, block binary"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession) -> int:
    """How many buckets rows are dealt to: the same number for each partition of a shuffle."""
    n = partitions(spark)
    return n * max(EACH, -(-BUCKETS // n))


def gathered(df: DataFrame, *order: str) -> DataFrame:
    """Blocks of one bucket in one partition, one after the other."""
    return df.repartitionById(partitions(df.sparkSession), "bucket").sortWithinPartitions("bucket", *order)


def blocks(cols: list[np.ndarray], bucket: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, block) of the rows in cols."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket, kind="stable")
    bucket = bucket[order]
    table = np.concatenate([c[order].view(np.uint8).reshape(len(c), c.itemsize) for c in cols], axis=1)
    edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True]))) if len(bucket) else np.zeros(0, np.int64)
    for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        yield int(bucket[s]), table[s:e].T.tobytes()


def collected(rows: Iterable[tuple[np.ndarray, ...]], n: int = HELD) -> Iterator[list[np.ndarray]]:
    """Columns of at least n rows, but at the end."""
    held, size = [], 0
    for cols in rows:
        held.append(cols)
        size += len(cols[0])
        if size >= n:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held, size = [], 0
    if size:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def dealt(rows: Iterable[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    """Blocks of rows (bucket, columns ..), as batches of SCHEMA."""
    for bucket, *cols in collected(rows):
        got = list(blocks(cols, bucket))
        for a in range(0, len(got), BLOCKS):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got[a : a + BLOCKS], strict=True), (pa.int32(), pa.binary()), strict=True)], names=["bucket", "block"])


def opened(found: list[bytes], types: tuple) -> list[np.ndarray]:
    """The columns of some blocks."""
    types = [np.dtype(t) for t in types]
    width = sum(t.itemsize for t in types)
    size = [len(b) // width for b in found]
    planes, at = np.empty((width, sum(size)), np.uint8), 0
    for b, n in zip(found, size, strict=True):
        planes[:, at : at + n] = np.frombuffer(b, np.uint8).reshape(width, n)
        at += n
    out, at = [], 0
    for t in types:
        out.append(np.ascontiguousarray(planes[at : at + t.itemsize].T).view(t).ravel())
        at += t.itemsize
    return out


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blocks of each bucket."""
    bucket, held = None, []
    for batch in batches:
        for b, block in zip(batch.column("bucket").to_pylist(), batch.column("block").to_pylist(), strict=True):
            if b != bucket and held:
                yield held
                held = []
            bucket = b
            held.append(block)
    if held:
        yield held
