import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rng_words(seed, n, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def docs(spark, rows):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def odd_rows():
    """Null in every column, empty and very long texts, ties, repeated rows."""
    long = " ".join(rng_words(1, 30_000))
    return [(1, None), (2, ""), (3, " \n\t "), (None, "no id here at all, is there"), (5, "one"), (5, "one"), (6, "one", None), (7, long), (8, long), (9, "a b c d e f g", None)]


def with_extra(df):
    """Extra columns named like columns that operators make."""
    for c in ("h", "size", "n", "value", "node", "first", "line", "host", "component_id", "ids", "part", "queue", "taken", "kept", "key", "bad", "row"):
        df = df.withColumn(c, F.lit("x"))
    return df
