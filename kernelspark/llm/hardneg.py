"""Hard-negative mining with vantage-point trees over norm-augmented vectors (operator 12).

Inner products become distances: with M the greatest norm, a row x gets one more
coordinate sqrt(M^2 - |x|^2) and an anchor a gets 0, so that the squared
distance is |a|^2 + M^2 - 2 <a, x>.  Greater scores are nearer, and a window of
scores is an annulus around the anchor.

A tree over a bounded sample deals rows out to parts of about PART rows that
lie together; a part that gets more (many equal vectors) is split by id.  Each
part is one vantage-point tree: a node keeps its vantage row and, for each half
of its rows, the least and greatest distance to that, which bounds what an
anchor can meet there from both sides.  An anchor visits the leaves that meet
its annulus, nearest first, and stops at a leaf that lies farther than its k-th
row of the wanted label.  Anchors go in blocks: for all anchors of a block the
bounds of a level are one array operation, and so is their j-th visit each.

The first search finds each anchor's nearest rows of its own label, the second,
with one annulus for each of these, the nearest rows of other labels.  Both
start with a bound: the k-th found in the sample alone can't be beaten by fewer
than k rows.  A task holds one block of anchors and one tree; what moves is
blocks times trees, and each pair gives at most k rows an anchor and window.

All scores are integers and exact: distances only choose what is visited, with
a margin for rounding.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kernelspark.llm._util import staged

#: Rows of a part on average, rows of a leaf, anchors of a block on average, and rows of the sample, about (twice as many at most).
PART, LEAF, BLOCK, SAMPLE = 4_096, 64, 512, 8_192
#: The score of a place that nothing fills.
NEVER = -np.iinfo(np.int64).max
_FOUND = "anchor_id long, place int, vec_id long, score long"


def _pack(**arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _load(blob: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(blob)) as f:
        return {k: f[k] for k in f.files}


def exact(x: np.ndarray, norm2: float) -> np.ndarray:
    """x in the cheapest type in which inner products of vectors of squared norm up to norm2 are exact: no partial sum exceeds norm2."""
    return x.astype(np.float32 if norm2 < 2**24 else np.float64 if norm2 < 2**53 else np.int64)


@dataclass
class Tree:
    """A balanced vantage-point tree of 2^depth leaves; node i has the children 2i + 1 (near) and 2i + 2 (far)."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    start: np.ndarray  # first row of each leaf, and the end
    vantage: np.ndarray  # (inner nodes, dimensions)
    lift: np.ndarray  # their further coordinate
    low: np.ndarray  # (inner nodes, 2): least distance of each child's rows to the vantage row
    high: np.ndarray
    norm2: float

    @property
    def depth(self) -> int:
        return (len(self.start) - 1).bit_length() - 1

    @classmethod
    def build(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm2: float, leaves: int) -> Tree:
        """leaves: a power of two, at most the rows. The vantage row of a node is the one farthest from its first row."""
        first = np.argsort(ids, kind="stable")
        ids, labels, x = ids[first], labels[first], x[first]
        wide = x.astype(np.float64)
        lift = np.sqrt(np.maximum(norm2 - (wide * wide).sum(1), 0))
        inner = leaves - 1
        chosen, low, high = np.zeros(inner, np.int64), np.zeros((inner, 2)), np.zeros((inner, 2))

        def distance(rows: np.ndarray, to: int) -> np.ndarray:
            d = wide[rows] - wide[to]
            return np.sqrt((d * d).sum(1) + (lift[rows] - lift[to]) ** 2)

        groups = [np.arange(len(ids))]
        for node in range(inner):
            rows = groups[node]
            at = rows[int(distance(rows, rows[0]).argmax())]
            d = distance(rows, at)
            order = np.argsort(d, kind="stable")
            half = (len(rows) + 1) // 2
            chosen[node] = at
            for side, part in enumerate((order[:half], order[half:])):
                low[node, side], high[node, side] = d[part].min(), d[part].max()
                groups.append(rows[part])
        parts = groups[inner:]
        order = np.concatenate(parts)
        return cls(ids[order], labels[order], x[order], np.concatenate(([0], np.cumsum([len(p) for p in parts]))), x[chosen], lift[chosen], low, high, norm2)

    def pack(self) -> bytes:
        return _pack(ids=self.ids, labels=self.labels, x=self.x, start=self.start, vantage=self.vantage, lift=self.lift, low=self.low, high=self.high, norm2=np.array(self.norm2))

    @classmethod
    def load(cls, blob: bytes) -> Tree:
        f = _load(blob)
        return cls(**{**f, "norm2": float(f["norm2"])})

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row: from every node to the half whose distances it is nearer to."""
        wide = x.astype(np.float64)
        lift = np.sqrt(np.maximum(self.norm2 - (wide * wide).sum(1), 0))
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            d = wide - self.vantage[node]
            d = np.sqrt((d * d).sum(1) + (lift - self.lift[node]) ** 2)
            node = 2 * node + 1 + (d > (self.high[node, 0] + self.low[node, 1]) / 2)
        return node - (len(self.start) - 2)

    def bounds(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchors, leaves): the least and greatest distance that rows of a leaf can have."""
        low, high = np.zeros((len(a), 1)), np.full((len(a), 1), np.inf)
        wide = a.astype(np.float64)
        own = (wide * wide).sum(1)[:, None] + self.norm2
        for level in range(self.depth):
            nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
            d = np.sqrt(np.maximum(own - 2 * wide @ self.vantage[nodes].astype(np.float64).T, 0))[:, :, None]
            low = np.maximum(low[:, :, None], np.maximum(d - self.high[nodes], self.low[nodes] - d)).reshape(len(a), -1)
            high = np.minimum(high[:, :, None], d + self.high[nodes]).reshape(len(a), -1)
        return low, high

    def nearest(self, a: np.ndarray, own: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, bound: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (anchors, windows, k): for each window low .. high of scores the k highest of rows of the anchor's label, or of other labels.

        Ties go to the smaller id; the anchor's own id is passed over; places that nothing fills have
        id -1.  Scores below bound, (anchors, windows), may be left out.
        """
        n, w = low.shape
        ids, scores = np.full((n, w, k), -1, np.int64), np.full((n, w, k), NEVER, np.int64)
        wide = a.astype(np.float64)
        base = (wide * wide).sum(1)[:, None] + self.norm2
        margin = 1e-6 * (np.sqrt(base) + 1)
        radius = lambda s: np.sqrt(np.maximum(base - 2 * np.maximum(s, -base).astype(np.float64), 0))
        least, most = self.bounds(a)
        # windows that can hold nothing here; the others reach from inner to outer
        open_ = (low <= high) & (high >= bound)
        inner, outer = radius(high) - margin, radius(np.maximum(low, bound)) + margin
        outer = np.where(open_, outer, -1.0)
        meets = ((least[:, None, :] <= outer[:, :, None]) & (most[:, None, :] >= inner[:, :, None])).any(1)
        order = np.argsort(np.where(meets, least, np.inf), axis=1, kind="stable")
        visits = meets.sum(1)
        x, av = exact(self.x, self.norm2), exact(a, self.norm2)
        size = np.diff(self.start)
        step = np.arange(size.max())
        for j in range(int(visits.max(initial=0))):
            leaf = order[:, j]
            reach = outer.max(1)
            live = np.flatnonzero((j < visits) & (least[np.arange(n), leaf] <= reach))
            if not len(live):
                break
            for s in range(0, len(live), 256):
                rows = live[s : s + 256]
                at = self.start[leaf[rows]][:, None] + step
                real = step < size[leaf[rows]][:, None]
                at = np.where(real, at, 0)
                got = (x[at] @ av[rows][:, :, None])[:, :, 0].astype(np.int64)
                fits = real & ((self.labels[at] == label[rows][:, None]) == same) & (self.ids[at] != own[rows][:, None])
                fine = fits[:, None, :] & (got[:, None, :] >= np.maximum(np.maximum(low[rows], bound[rows]), scores[rows, :, -1])[:, :, None]) & (got[:, None, :] <= high[rows][:, :, None]) & open_[rows][:, :, None]
                r, v = np.nonzero(fine.any(2))
                if not len(r):
                    continue
                s_new = np.concatenate((scores[rows[r], v], np.where(fine[r, v], got[r], NEVER)), axis=1)
                i_new = np.concatenate((ids[rows[r], v], np.where(fine[r, v], self.ids[at][r], -1)), axis=1)
                best = np.lexsort((i_new, -s_new), axis=1)[:, :k]
                scores[rows[r], v], ids[rows[r], v] = np.take_along_axis(s_new, best, 1), np.take_along_axis(i_new, best, 1)
                full = scores[rows[r], v, -1] > NEVER
                if full.any():
                    kth = scores[rows[r[full]], v[full], -1].astype(np.float64)
                    reach_now = np.sqrt(np.maximum(base[rows[r[full]], 0] - 2 * kth, 0)) + margin[rows[r[full]], 0]
                    outer[rows[r[full]], v[full]] = np.minimum(outer[rows[r[full]], v[full]], reach_now)
        return ids, scores


def usable(vectors: DataFrame) -> tuple[DataFrame, int, float, int]:
    """(vec_id, label, v as array<long>) of the rows that take part, their dimension, greatest squared norm and greatest component."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null)")
    norm2 = F.aggregate("v", F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double"))
    most = F.array_max(F.transform("v", F.abs))
    seen = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("c"), F.max(norm2).alias("norm2"), F.max(most).alias("most")).orderBy(F.desc("c"), "dim").limit(1).first()
    if seen is None:
        return rows, 0, 0.0, 0
    # one row an id: the least by label, then by vector
    one = rows.where(F.size("v") == seen.dim).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return one.select("vec_id", "r.label", "r.v"), seen.dim, seen.norm2, seen.most


def _matrix(v: pd.Series) -> np.ndarray:
    return np.stack(v.to_numpy()).astype(np.int64) if len(v) else np.zeros((0, 0), np.int64)


def _trees(rows: DataFrame, total: int, norm2: float, narrow: np.dtype) -> tuple[DataFrame, int, bytes]:
    """(tree, blob) for the parts of rows, their number, and the tree of the sample."""
    spark = rows.sparkSession
    # about SAMPLE rows by hash; the bound twice that is never met, but holds
    share = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(int(min(1.0, SAMPLE / total) * (1 << 40)))
    got = rows.where(share).limit(2 * SAMPLE).toPandas()
    if not len(got):
        got = rows.limit(1).toPandas()
    power = lambda n: 1 << max(0, int(n - 1).bit_length())
    ids, labels, x = got["vec_id"].to_numpy(), got["label"].to_numpy(), _matrix(got["v"]).astype(narrow)
    sample = Tree.build(ids, labels, x, norm2, max(1, power(-(-len(ids) // LEAF)) if len(ids) > LEAF else 1))
    leaves = min(power(-(-total // PART)), power(max(1, len(ids) // 16)))
    top = spark.sparkContext.broadcast(Tree.build(ids, labels, x, norm2, leaves).pack())

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Tree.load(top.value)
        for b in batches:
            for s in range(0, len(b), 4096):
                part = b.iloc[s : s + 4096]
                x = _matrix(part["v"])
                yield pd.DataFrame({"leaf": tree.route(x).astype(np.int32), "vec_id": part["vec_id"].to_numpy(), "label": part["label"].to_numpy(), "v": [r.tobytes() for r in x.astype(narrow)]})

    dealt = rows.mapInPandas(deal, "leaf int, vec_id long, label long, v binary")
    # at most as many rows as the sample's tree has leaves
    parts = staged(dealt.groupBy("leaf").agg(F.ceil(F.count("*") / F.lit(float(PART))).cast("int").alias("parts")), "parts")
    base = parts.select("leaf", "parts", (F.sum("parts").over(Window.partitionBy(F.lit(0)).orderBy("leaf")) - F.col("parts")).cast("int").alias("base"))
    n = parts.agg(F.sum("parts")).first()[0]
    own = dealt.join(F.broadcast(base), "leaf").select((F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long"))).cast("int").alias("tree"), "vec_id", "label", "v")

    def build(key, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.frombuffer(b"".join(rows["v"]), narrow).reshape(len(rows), -1)
        leaves = 1 << max(0, (len(rows) // LEAF).bit_length() - 1) if len(rows) >= 2 * LEAF else 1
        return pd.DataFrame({"tree": [key[0]], "blob": [Tree.build(rows["vec_id"].to_numpy(), rows["label"].to_numpy(), x, norm2, leaves).pack()]})

    return staged(own.groupBy("tree").applyInPandas(build, "tree int, blob binary"), "trees"), int(n), sample.pack()


def _search(asked: DataFrame, trees: DataFrame, n_trees: int, sample: bytes, n_asked: int, k: int, same: bool, narrow: np.dtype) -> DataFrame:
    """_FOUND rows of every tree for asked (vec_id, label, v, lows, highs: a window a place); the k best of each anchor and place are left to choose."""
    spark = asked.sparkSession
    shared = spark.sparkContext.broadcast(sample)
    far = np.iinfo(np.int64).min // 4

    def block(key, rows: pd.DataFrame) -> pd.DataFrame:
        a, own, label = _matrix(rows["v"]), rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        most = max(map(len, rows["lows"]))
        low, high = np.ones((len(rows), most), np.int64), np.zeros((len(rows), most), np.int64)
        for i, (x, y) in enumerate(zip(rows["lows"], rows["highs"], strict=True)):
            low[i, : len(x)], high[i, : len(y)] = x, y
        _, scores = Tree.load(shared.value).nearest(a, own, label, low, high, np.full(low.shape, far), k, same)
        return pd.DataFrame({"block": [key[0]], "asked": [_pack(a=a.astype(narrow), own=own, label=label, low=low, high=high, bound=np.maximum(scores[:, :, -1], far))]})

    blocks = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(-(-n_asked // BLOCK))).cast("int")).groupBy("block").applyInPandas(block, "block int, asked binary")
    n = max(1, min(n_trees, 8 * spark.sparkContext.defaultParallelism))
    pairs = blocks.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(n_trees - 1)))).repartition(n, "tree").join(trees.repartition(n, "tree"), "tree")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tree = None, None
        for batch in batches:
            for number, blob, asked in batch[["tree", "blob", "asked"]].itertuples(index=False):
                if number != last:
                    last, tree = number, Tree.load(blob)
                q = _load(asked)
                ids, scores = tree.nearest(q["a"], q["own"], q["label"], q["low"], q["high"], q["bound"], k, same)
                anchor, place, rank = np.nonzero(scores > NEVER)
                yield pd.DataFrame({"anchor_id": q["own"][anchor], "place": place.astype(np.int32), "vec_id": ids[anchor, place, rank], "score": scores[anchor, place, rank]})

    return pairs.mapInPandas(visit, _FOUND)


def mine(vectors: DataFrame, is_anchor: str = "vec_id % 50 = 0", positives: int = 5, k: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, label, v: array of integers).

    An anchor's positives are the rows of its label with the highest inner
    products with it, its negatives for each positive the ``k`` highest rows of other
    labels between low and high hundredths of the positive's score; ties go to the
    smaller vec_id, fewer rows give fewer.  is_anchor: SQL condition on vec_id.

    Rows without id, label or vector, with an empty vector or a null component
    take no part, nor do rows whose length is not the commonest (the shorter
    of equally common ones).  Of rows with one id that with the least label,
    then vector, counts.  Inner products must fit in a long.  Anchors without
    positives, an empty table or no anchors: no rows.  Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows, dim, norm2, most = usable(vectors)
    if not dim:
        return spark.createDataFrame([], schema)
    narrow = np.dtype("<i2") if most < 2**15 else np.dtype("<i8")
    rows = staged(rows, "vectors")
    anchors = rows.where(is_anchor)
    counts = rows.agg(F.count("*").alias("total"), F.count_if(F.expr(is_anchor)).alias("anchors")).first()
    if not counts.anchors:
        return spark.createDataFrame([], schema)
    trees, n_trees, sample = _trees(rows, counts.total, norm2, narrow)
    every = np.iinfo(np.int64).max // 4
    first = _search(anchors.withColumn("lows", F.array(F.lit(-every))).withColumn("highs", F.array(F.lit(every))), trees, n_trees, sample, counts.anchors, positives, True, narrow)
    by = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
    best = first.withColumn("place", F.row_number().over(by("anchor_id")) - 1).where(F.col("place") < positives)
    best = staged(best.select("anchor_id", F.col("place").cast("int").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # windows in whole numbers: least n with 100 n >= low p, greatest with 100 n <= high p
    hundredths = F.col("positive_score").cast("decimal(20,0)")
    lows, highs = F.ceil(hundredths * low / 100).cast("long"), F.floor(hundredths * high / 100).cast("long")
    windows = best.withColumn("low", lows).withColumn("high", highs).groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))
    asked = anchors.join(windows, anchors["vec_id"] == windows["anchor_id"]).select("vec_id", "label", "v", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    found = _search(asked, trees, n_trees, sample, counts.anchors, k, False, narrow)
    found = found.withColumn("rank", F.row_number().over(by("anchor_id", "place"))).where(F.col("rank") <= k)
    out = found.join(best, ["anchor_id", "place"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def scaled(embeddings: DataFrame, by: int = 256) -> DataFrame:
    """(vec_id, label, v): v the components floor(by x); a vector with a null or non-finite component is null."""
    fine = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < float('Infinity'))")
    return embeddings.select("vec_id", "label", F.when(fine, F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * F.lit(float(by))))).alias("v"))


#: The same in DuckDB by all inner products with the anchors.
ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM {vectors} WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r AS a JOIN r AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
