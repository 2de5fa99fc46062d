"""Approximate nearest neighbours with adaptive dimension scans (operator 9).

An inverted file: centroids fitted on a bounded sample, every vector in the
list of its nearest centroid.  Vectors are rotated at random and stored by
column blocks of BLOCK dimensions.  A query probes its nearest lists; within a
list it adds up squared distances block by block and after each block drops the
candidates that a hypothesis test finds farther than its k-th best so far: with
d of D rotated dimensions seen, a partial distance p stands for p D / d up to a
relative error of EPSILON / sqrt(d).  What survives all blocks is measured
again on the original vectors in double precision.

Lists are split in parts of PART vectors on average, so a list that holds a
third of all rows is many tasks; queries go to every part of the lists they
probe, in turns.  Parts give k rows a query each, and the k best of all are kept.
How many lists a query probes is measured on the sample: few where vectors lie
in groups, most of them where they spread evenly in many dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that the centroids are fitted on at most; centroids are about the square root of the rows, and MOST_LISTS at most.
SAMPLE, MOST_LISTS = 20_000, 4_096
BLOCK, PART, EPSILON = 16, 4_096, 2.1


def rotation(dim: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def fit(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Centroids of x by Lloyd's rounds; empty lists are put on the farthest vectors."""
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        own, off = np.empty(len(x), np.int64), np.empty(len(x))
        for s in range(0, len(x), 1024):
            part = x[s : s + 1024]
            d = (part * part).sum(1)[:, None] - 2 * part @ c.T + (c * c).sum(1)
            own[s : s + 1024] = d.argmin(1)
            off[s : s + 1024] = d.min(1)
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        full = n > 0
        c[full] = total[full] / n[full, None]
        if not full.all():
            far = np.argsort(-off)[: (~full).sum()]
            c[~full] = x[far]
    return c


def scan_part(q: np.ndarray, x: np.ndarray, k: int, block: int = BLOCK, epsilon: float = EPSILON) -> list[np.ndarray]:
    """For each rotated query the rows of x (rotated, one list part) that survive the test; all of x's true k nearest with high probability."""
    dim = x.shape[1]
    columns = [np.ascontiguousarray(x[:, s : s + block].T) for s in range(0, dim, block)]
    out = []
    longest = (x * x).sum(1).max(initial=0.0)
    for v in q:
        slack = 1e-12 * (longest + v @ v)  # rounding of the rotation: copies of a query are not quite at distance 0
        left = np.arange(len(x))
        partial = np.zeros(len(x))
        # the bound: the k-th best of a first few candidates in full
        head = ((x[: 4 * k] - v) ** 2).sum(1)
        bound = np.partition(head, k - 1)[k - 1] if len(head) >= k else np.inf
        for b, col in enumerate(columns):
            s = b * block
            part = v[s : s + block, None]
            seen = min(s + block, dim)
            cols = col if len(left) == len(x) else col[:, left]
            partial = partial + ((cols - part) ** 2).sum(0)
            if seen < dim:
                stay = partial * dim / seen <= bound * (1 + epsilon / np.sqrt(seen)) ** 2 + slack
            else:
                stay = partial <= bound * (1 + 1e-5) + 1e-9 + slack
            if not stay.all():
                left, partial = left[stay], partial[stay]
            if seen < dim and len(left) > 8 * k:
                # the most promising candidates in full tighten the bound
                best = left[np.argpartition(partial, 2 * k)[: 2 * k]]
                full = ((x[best] - v) ** 2).sum(1)
                bound = min(bound, np.partition(full, k - 1)[k - 1])
        out.append(left)
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as array<double>) of the rows that take part: an id and finite, non-zero vectors without nulls, of the commonest length."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    fine = "vec_id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)"
    rows = rows.where(fine)
    dim = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).first()
    return rows.where(F.size("v") == dim["n"]) if dim else rows


def _near(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n nearest centroids of each row."""
    d = (c * c).sum(1) - 2 * x @ c.T
    if n >= len(c):
        return np.tile(np.arange(len(c)), (len(x), 1))
    return np.argpartition(d, n - 1, axis=1)[:, :n]


def share_of_lists(x: np.ndarray, centroids: np.ndarray, k: int, target: float, queries: int = 256) -> float:
    """The share of its nearest lists that a query must look into to meet ``target`` of its neighbours, measured on a sample x.

    Neighbours within a sample are farther off than those among all rows, and
    so lie in lists of later ranks: the share errs on the safe side.
    """
    if len(x) <= k + 1 or len(centroids) == 1:
        return 1.0
    q = x[np.linspace(0, len(x) - 1, min(queries, len(x))).astype(np.int64)]
    own = _near(x, centroids, 1)[:, 0]
    ranks = np.empty((len(q), len(centroids)), np.int64)
    to = (centroids * centroids).sum(1) - 2 * q @ centroids.T
    np.put_along_axis(ranks, np.argsort(to, axis=1, kind="stable"), np.arange(len(centroids))[None, :].repeat(len(q), 0), 1)
    d = (x * x).sum(1) - 2 * q @ x.T
    best = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : k + 1]  # with the query itself, whose rank is low
    found = np.take_along_axis(ranks, own[best], 1)
    at_self = np.take_along_axis(d, best, 1).argmin(1)
    rest = np.ones(found.shape, bool)
    rest[np.arange(len(q)), at_self] = False
    return float((np.quantile(found[rest], target) + 1) / len(centroids))


def search(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, probe: float | None = None, target: float = 0.965, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest found, by Euclidean distance, ties to the smaller id.

    is_query: SQL condition that picks the queries; probe: share of the lists a
    query looks into, by default measured on the sample so that ``target`` of the
    neighbours lie there, and never so few that they would hold fewer than 50 k
    rows on average.  Null, zero, null-holding and non-finite vectors and rows
    without id take no part, as queries or candidates.  A query's own row (every
    row with its id) is no candidate.  Of rows with one id the least vector
    counts, as query and as candidate.  Fewer than k candidates: all.  No
    queries or an empty table: no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors).groupBy("vec_id").agg(F.min("v").alias("v"))
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    # about ``sample`` rows by hash; the bound twice that is never met, but holds
    part = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, sample / total) * (1 << 40)))
    got = rows.where(part).limit(2 * sample).toPandas()
    got = (got if len(got) else rows.limit(1).toPandas()).sort_values("vec_id")
    x = np.stack(got["v"].to_numpy())
    turn = rotation(x.shape[1])
    lists = int(np.clip(np.sqrt(total), 1, min(MOST_LISTS, len(x))))
    centroids = fit(x @ turn, lists)
    lists = len(centroids)
    share = probe if probe is not None else share_of_lists(x @ turn, centroids, k, target)
    probes = min(lists, max(1, int(np.ceil(lists * max(share, min(1.0, 50 * k / total))))))
    shared = spark.sparkContext.broadcast((turn, centroids))

    def assign(n: int):
        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            turn, c = shared.value
            step = max(1, min(1024, 100_000 // n))  # rows at a time, so that what is given out stays small
            for whole in batches:
                for s in range(0, len(whole), step):
                    b = whole.iloc[s : s + step]
                    at = _near(np.stack(b["v"].to_numpy()) @ turn, c, n)
                    yield pd.DataFrame({"vec_id": np.repeat(b["vec_id"].to_numpy(), n), "list": at.ravel().astype(np.int32), "v": np.repeat(b["v"].to_numpy(), n)})

        return each

    listed = rows.mapInPandas(assign(1), "vec_id long, list int, v array<double>")
    # at most MOST_LISTS rows
    parts = listed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PART)).cast("int").alias("parts"))
    # named small: a join that goes by what its sides read would take the queries for the small side, before they are given out to their lists
    parts = F.broadcast(parts)
    listed = listed.join(parts, "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int")).drop("parts")
    asked = rows.where(is_query)
    # queries meet a part in turns of about PART, so that no task holds all of them
    turns = max(1, -(-asked.count() * probes // (lists * PART)))
    asked = asked.mapInPandas(assign(probes), "vec_id long, list int, v array<double>").withColumn("turn", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.lit(turns)).cast("int"))
    asked = asked.join(parts, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    if turns > 1:
        listed = listed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))))
    else:
        listed = listed.withColumn("turn", F.lit(0))

    def near(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "d2": []}
        if len(q) and len(c):
            turn, _ = shared.value
            c = c.sort_values("vec_id")
            x, ids = np.stack(c["v"].to_numpy()), c["vec_id"].to_numpy()
            rx = x @ turn
            for s in range(0, len(q), 256):
                part = q.iloc[s : s + 256]
                v = np.stack(part["v"].to_numpy())
                # one more than k: the query itself may be among them
                for own, vec, left in zip(part["vec_id"].to_numpy(), v, scan_part(v @ turn, rx, min(k + 1, len(x))), strict=True):
                    left = left[ids[left] != own]
                    diff = x[left] - vec
                    d = (diff * diff).sum(1)
                    best = np.lexsort((ids[left], d))[:k]
                    out["query_id"] += [own] * len(best)
                    out["vec_id"] += ids[left[best]].tolist()
                    out["d2"] += d[best].tolist()
        return pd.DataFrame(out)

    found = asked.groupBy("list", "part", "turn").cogroup(listed.groupBy("list", "part", "turn")).applyInPandas(near, "query_id long, vec_id long, d2 double")
    order = Window.partitionBy("query_id").orderBy("d2", "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.sqrt("d2").alias("score"))
