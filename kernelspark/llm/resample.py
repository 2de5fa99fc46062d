"""Target-distribution importance resampling by bucket-partitioned inverted postings (operator 13).

The corpus is inverted: every document gives one posting (bucket, document,
count) for each bucket of its hashed n-grams.  Postings are shuffled by bucket,
where the target corpus' counts meet them (co-grouped by a union that is
aggregated map-side), so that a bucket's gain is known where its postings lie;
each posting then emits count times gain, and contributions are summed by
document.

A bucket of a common word holds a posting of nearly every document.  Buckets
are therefore split by document into parts of PART postings on average, and the
gain, one number, goes to each part.  Neither a bucket nor a part is ever
gathered: both sides are joined row by row.

Documents are drawn by the greatest perturbed weights (Gumbel noise from a hash
of the id, so reruns agree), which is sampling without replacement.  Ranks come
from a range partition by score, counts of the ranges and prefix sums of those.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelspark.llm import _text as T
from kernelspark.llm._util import lean, staged

#: Postings of one part of a bucket, on average.
PART = 1 << 14
#: Distinct n-grams whose bucket a worker remembers; then it starts anew.
CACHE = 1_000_000
#: Bytes that part words: ASCII but digits and letters.
_PARTS = np.ones(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _PARTS[_a:_b] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POSTING = "key long, bucket int, n long, doc_id long, words long"


class Inverter:
    """Texts to bucket counts; n-grams already met are looked up by 64-bit values."""

    def __init__(self, n: int, buckets: int):
        self.n, self.buckets = n, buckets
        self.known: dict[int, int] = {}

    def _buckets(self, values: np.ndarray, spans, raw: bytes) -> np.ndarray:
        """The bucket of each distinct value; spans(i) gives the byte spans of the words of one n-gram."""
        if len(self.known) > CACHE:
            self.known.clear()
        got = [self.known.get(v, -1) for v in values.tolist()]
        for i, b in enumerate(got):
            if b < 0:
                text = b" ".join(raw[s:e] for s, e in spans(i))
                got[i] = self.known[int(values[i])] = zlib.crc32(text) % self.buckets
        return np.array(got, np.int64)

    def block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, count) of the postings, and the words and features of each row."""
        words = T.Words(data, offsets, lower=True, space=_PARTS)
        raw = _LOWER[data].tobytes()
        n_words = np.diff(words.first)
        rows, found = [], []
        features = np.zeros(len(n_words), np.int64)
        for k in range(1, self.n + 1):
            row = np.repeat(np.arange(len(n_words)), n_words)
            value, first = (words.value, np.arange(len(row))) if k == 1 else (T.windows(words.value, k), np.arange(max(0, len(row) - k + 1)))
            inside = row[first] == row[first + k - 1] if k > 1 else slice(None)
            value, first = value[inside], first[inside]
            features += np.maximum(n_words - k + 1, 0)
            distinct, at, back = np.unique(value, return_index=True, return_inverse=True)
            place = first[at]
            bucket = self._buckets(distinct, lambda i, k=k, place=place: [(words.start[j], words.end[j]) for j in range(place[i], place[i] + k)], raw)
            rows.append(row[first])
            found.append(bucket[back])
        code, count = np.unique(np.concatenate(rows) * self.buckets + np.concatenate(found), return_counts=True)
        return code // self.buckets, code % self.buckets, count, n_words, features


def invert(docs: DataFrame, n: int, buckets: int, column: str = "text", name: str | None = "doc_id") -> DataFrame:
    """(key, bucket, n, doc_id, words): postings (doc_id and words null), and with bucket -1 one row a document, n its features.

    key numbers the rows of docs; it is settled once the result is written.
    Without name only postings are made.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        inverter, key = Inverter(n, buckets), TaskContext.get().partitionId() << 36
        for batch in batches:
            for a, b, data, offsets in T.blocks(batch.column("text")):
                row, bucket, count, words, features = inverter.block(data, offsets)
                none = pa.nulls(len(row), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key + row), pa.array(bucket.astype(np.int32)), pa.array(count.astype(np.int64)), none, none], names=["key", "bucket", "n", "doc_id", "words"])
                if name:
                    ids = batch.column("doc_id").slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([pa.array(key + np.arange(b - a)), pa.array(np.full(b - a, -1, np.int32)), pa.array(features), ids, pa.array(words.astype(np.int64))], names=["key", "bucket", "n", "doc_id", "words"])
                key += b - a

    own = F.col(name).cast("long") if name else F.lit(None).cast("long")
    return docs.select(own.alias("doc_id"), F.col(column).cast("string").alias("text")).mapInArrow(lean(each), _POSTING)


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain, parts) of every bucket of the corpus, from the postings of both; at most ``buckets`` rows.

    gain: floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))), s and
    t the bucket's features in corpus and target, S and T all features there.
    """
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"), F.lit(1).alias("one")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"), F.lit(0).alias("one")))
    met = both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"), F.sum("one").alias("postings"))
    # one row a bucket: a window over all of them is of a fixed size
    every = Window.partitionBy(F.lit(0))
    d = lambda c: (c + F.lit(0)).cast("double")
    more = met.withColumn("all_s", F.sum("s").over(every)).withColumn("all_t", F.sum("t").over(every))
    ratio = d(F.col("t") + 1) * d(F.col("all_s") + buckets) / (d(F.col("s") + 1) * d(F.col("all_t") + buckets))
    return more.where("postings > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"), F.ceil(F.col("postings") / F.lit(float(PART))).cast("int").alias("parts"))


def contributions(corpus: DataFrame, gain: DataFrame) -> DataFrame:
    """(key, weight) of the documents with features: postings and gains meet by bucket and part, then documents sum up."""
    # at most ``buckets`` rows of two ints are broadcast: how many parts the buckets have that have several
    several = F.broadcast(gain.where("parts > 1").select("bucket", "parts"))
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts").cast("long")), F.lit(0)).cast("int")
    dealt = corpus.join(several, "bucket", "left").select("key", "bucket", "n", part.alias("part"))
    spread = gain.select("bucket", "gain", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    met = dealt.join(spread.hint("shuffle_hash"), ["bucket", "part"])
    return met.groupBy("key").agg(F.sum(F.col("n") * F.col("gain")).alias("weight"))


def uniform(doc_id: Column, seed: int) -> Column:
    """The first 32 bits of SHA-256 of seed:doc_id, null as the word null."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")


def ranked(rows: DataFrame, by: list[Column], percent: int) -> DataFrame:
    """rows with their place in the order ``by`` as rank, null beyond the first floor(percent * rows / 100): ranges, their sizes, prefix sums."""
    kept = staged(rows.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    # one row a shuffle partition: sizes of ranges and their prefix sums
    sizes = kept.groupBy("range").agg(F.count("*").alias("held"))
    before = sizes.select("range", (F.sum("held").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("held")).alias("before"))
    most = kept.count() * percent // 100
    place = F.row_number().over(Window.partitionBy("range").orderBy(*by)) + F.col("before")
    out = kept.join(F.broadcast(before), "range").withColumn("rank", place.cast("long"))
    return out.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).drop("range", "before")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank), all long, of every row of docs: how like the target texts it is, and its place in the draw.

    Features: all runs of 1 to n consecutive words, words being runs of ASCII
    letters (lower-cased), digits and all other non-ASCII characters.  Null and
    empty texts have none and weight 0.  A row with a null id is hashed as the
    word null and sorts last among equal scores; repeated rows each count, in
    the statistics and in the draw, and equal rows take neighbouring ranks.
    Documents with fewer than ``least`` words are never drawn.  An empty target
    counts no features, an empty docs gives no rows.  Other columns are not read.
    """
    table = staged(invert(docs, n, buckets), "postings")
    corpus, rows = table.where("bucket >= 0").select("key", "bucket", "n"), table.where("bucket = -1").select("key", "doc_id", F.col("n").alias("n_features"), "words")
    wanted = invert(target, n, buckets, name=None)
    weights = contributions(corpus, staged(gains(corpus, wanted, buckets), "gains"))
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((uniform(F.col("doc_id"), seed) + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")
    scored = rows.join(weights, "key", "left").withColumn("weight", F.coalesce(F.col("weight"), F.lit(0)).cast("long")).withColumn("score", F.col("weight") + noise)
    scored = staged(scored, "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("key")]
    drawn = ranked(scored.where(F.col("words") >= least), order, percent)
    out = drawn.unionByName(scored.where(F.col("words") < least).withColumn("rank", F.lit(None).cast("long")))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


#: The same in DuckDB, for n = 1, 10,000 buckets, ten percent, 20 words and seed 2024. CRC-32 is its byte-wise definition over a table made from the polynomial.
ORACLE = r"""
WITH bits AS (
  SELECT list(list_reduce(list_prepend(i, range(0, 8)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(0, 256) AS r(i)
), words AS (
  SELECT d.row, d.side, unnest(regexp_extract_all(translate(coalesce(d.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT row_number() OVER () AS row, 0 AS side, text FROM {docs} UNION ALL SELECT 0, 1, text FROM benchmark) AS d
), counts AS (
  SELECT row, side, w, count(*) AS n FROM words GROUP BY ALL
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, octet_length(encode(w))), lambda k: ('0x' || substr(hex(encode(w)), 2 * k + 1, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM counts), bits
), sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0)::BIGINT AS t FROM counts JOIN hashed USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * ((SELECT sum(s) FROM sums) + 10000)::DOUBLE) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sums) + 10000)::DOUBLE)))::BIGINT AS gain FROM sums
), weights AS (
  SELECT row, sum(n * gain)::BIGINT AS weight, sum(n)::BIGINT AS n_features FROM counts JOIN hashed USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY row
), scored AS (
  SELECT d.row, d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM (SELECT row_number() OVER () AS row, doc_id FROM {docs}) AS d LEFT JOIN weights USING (row)
), placed AS (
  SELECT *, CASE WHEN n_features >= 20 THEN row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST) END AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM placed
"""
