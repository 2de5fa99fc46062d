"""Mixing sources to target weights by hash-threshold histograms (operator 10).

Every document gets a fixed hash.  A source with target r times its size takes
floor(r) whole copies of each document, and once more those documents whose
hash lies below a threshold.  The threshold is found without sorting: sum the
words by source and hash bucket, walk the (at most BUCKETS) sums to the bucket
where the budget ends, and refine that bucket alone by the next hash digits,
LEVELS times.  What shuffles is one row for each source, bucket and task.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kernelspark.llm._util import remove_dir, staged

WORD = r"[^\x20\x09-\x0D]+"
#: Hexadecimal digits of the hash that one level looks at, and the number of levels.
DIGITS, LEVELS = 3, 3
BUCKETS = 16**DIGITS
#: No document is taken more often than this.
MOST = 3


def size_of(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: Column) -> Column:
    """The first 36 bits of the MD5 of the id as text (null as the word null): the same in every run and engine."""
    text = F.coalesce(doc_id.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(text), 1, DIGITS * LEVELS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """From (source, source_size): each source's target words.

    Sources by code point, null last, take the weights in turn; shares of all
    words are cut at ``most`` times a source's size and what is cut goes to the
    others by weight, again until none is above.  In closed form: in order of
    cap / weight the sources at their cap come first, and the rest share what
    is left by weight.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int")
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    rest = by.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = sizes.select("source", "source_size", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), turn + 1).cast("long").alias("weight"))
    t = t.withColumn("cap", F.col("source_size") * most)
    t = t.withColumn("left", F.sum("source_size").over(every) - (F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")))
    t = t.withColumn("level", F.col("left").cast("double") / F.sum("weight").over(rest))
    t = t.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "level"))).over(every))
    level = F.col("level.level")
    return t.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(level * F.col("weight"), F.col("cap").cast("double"))).alias("target"))


def thresholds(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """From (source, size, h): (source, source_size, target, copies, below). A document is taken copies times, and once more where h < below."""
    first = sized.groupBy("source", (F.shiftright("h", 4 * DIGITS * (LEVELS - 1))).alias("b")).agg(F.sum("size").alias("n"))
    first = staged(first, "mix-level")
    plan = targets(first.groupBy("source").agg(F.sum("n").alias("source_size")), weights, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("copies", F.floor(ratio).cast("long"))
    plan = staged(plan.withColumn("budget", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("lo", F.lit(0).cast("long")), "mix-plan")
    counts = first
    for level in range(LEVELS):
        last = level == LEVELS - 1
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("b"))
        # null sources have their own row; eqNullSafe keeps it
        at = counts.withColumnRenamed("source", "s").join(plan.withColumnRenamed("budget", "left"), F.col("s").eqNullSafe(F.col("source"))).drop("s")
        at = at.withColumn("upto", upto)
        over = F.col("upto") > F.col("left")
        at = at.groupBy("source", "source_size", "target", "copies", "left", "lo").agg(
            F.min(F.when(over, F.struct("b", "n", "upto"))).alias("edge"), F.max("b").alias("top")
        )
        width = 16 ** (DIGITS * (LEVELS - 1 - level))
        inside = F.col("edge.upto") - F.col("edge.n")
        # with no bucket over the budget, all that was counted is taken
        new_lo = F.when(F.col("edge").isNull(), F.col("lo") + (F.col("top") + 1) * width).otherwise(F.col("lo") + F.col("edge.b") * width)
        if last:
            nearer = F.coalesce((F.col("left") - inside) * 2 > F.col("edge.n"), F.lit(False))
            new_lo = new_lo + F.when(nearer, F.lit(width)).otherwise(F.lit(0))
        plan = staged(
            at.select("source", "source_size", "target", "copies", F.when(F.col("edge").isNull(), F.lit(0.0)).otherwise(F.col("left") - inside).alias("budget"), new_lo.cast("long").alias("lo")),
            "mix-plan",
        )
        if not last:
            below = 16 ** (DIGITS * (LEVELS - 2 - level))
            edge = plan.where("budget > 0").select(F.col("source").alias("s"), F.col("lo").alias("from"))
            inner = (F.col("h") >= F.col("from")) & (F.col("h") < F.col("from") + F.lit(width))
            counts = sized.join(edge, F.col("source").eqNullSafe(F.col("s"))).where(inner).groupBy("source", F.floor((F.col("h") - F.col("from")) / F.lit(below)).cast("long").alias("b")).agg(F.sum("size").alias("n"))
            # a source that is settled keeps its threshold: an empty bucket stands for it
            settled = plan.where("budget <= 0").select("source", F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
            counts = staged(counts.unionAll(settled), "mix-level")
    return plan.select("source", "source_size", "target", "copies", F.col("lo").alias("below"))


def mixture(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each document.

    Null texts have size 0.  A null source is a source, last in order.  Rows
    with the same id share a hash and are taken alike, so repeated rows at the
    threshold come or stay together.  A source without words has target 0.  An
    empty table gives no rows.  Columns other than doc_id, text, source are not
    looked at.
    """
    sized = staged(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "mix-sized")
    plan = thresholds(sized, weights, most).withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("copies") + F.when(F.col("h") < F.col("below"), 1).otherwise(0))
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """The documents of the mix with all their columns, a document as many times as it is taken."""
    keep = docs.columns
    sized = staged(docs.select("source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id")).alias("h")), "mix-sized")
    plan = thresholds(sized, weights, most).select(F.struct("source", "copies", "below").alias("__plan"))
    every = docs.select(F.struct(*[docs[c] for c in keep]).alias("__doc"))
    out = every.join(plan, F.col("__doc.source").eqNullSafe(F.col("__plan.source")))
    copies = F.col("__plan.copies") + F.when(hash_of(F.col("__doc.doc_id")) < F.col("__plan.below"), 1).otherwise(0)
    out = out.withColumn("__n", copies.cast("int")).where("__n > 0")
    out = out.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n"))))
    remove_dir(docs.sparkSession, sized._staged_at)
    return out.select("__doc.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 9))::BIGINT AS h FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * 3 AS cap, ([1, 2, 3])[((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER ()) - (sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source) - cap))::DOUBLE
             / (sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
m AS (SELECT arg_min(level, cap / weight) AS level FROM l WHERE level * weight <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(m.level * weight, cap::DOUBLE)) AS target FROM l, m),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
b AS (SELECT *, target - copies * source_size AS budget FROM p),
e AS (SELECT d.source, h, sum(size) AS n FROM d GROUP BY ALL),
r AS (SELECT e.source, e.h, e.n, b.budget, sum(e.n) OVER (PARTITION BY e.source ORDER BY e.h) AS upto FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source),
k AS (SELECT source, h, CASE WHEN upto <= budget OR ((budget - (upto - n)) * 2 > n AND upto - n <= budget) THEN 1 ELSE 0 END AS more FROM r)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.copies + k.more))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
"""
