import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from kernelspark.llm import resample
from tests.llm.helpers import docs, odd_rows, rng_words, with_extra

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(rows, target, n=1, buckets=10_000, percent=10, least=20, seed=2024):
    """Row by row from the definition; rows are (doc_id, text)."""

    def features(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    all_s, all_t = s.total(), t.total()
    out, may = [], []
    for doc, text in rows:
        words, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None])
        if len(words) >= least:
            may.append(out[-1])
    may.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(may[: len(may) * percent // 100], 1):
        r[4] = place
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def target(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")


def rows(seed=0, n=60):
    return [(i, " ".join(rng_words(seed + i, 5 + 7 * (i % 9), 90))) for i in range(n)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_equals_brute_force(spark, n):
    have, like = rows(), [" ".join(rng_words(900 + i, 30, 40)) for i in range(5)]
    found = resample.resample(docs(spark, have).repartition(5), target(spark, like), n=n, buckets=500, percent=30)
    assert got(found) == brute(have, like, n, 500, 30)


def test_split_buckets_give_the_same(spark, monkeypatch):
    have, like = rows(7, 80), ["w1 w2 w3 w4 w5"]
    whole = got(resample.resample(docs(spark, have), target(spark, like), percent=50))
    monkeypatch.setattr(resample, "PART", 3)
    assert got(resample.resample(docs(spark, have).repartition(7), target(spark, like), percent=50)) == whole == brute(have, like, percent=50)


def test_odd_rows(spark):
    have = [(r[0], r[1]) for r in odd_rows()] + [(None, "A-z 09 Ünï x " * 30), (4, "Same words here " * 9), (4, "Same words here " * 9)]
    like = ["Same WORDS", None, ""]
    found = resample.resample(with_extra(docs(spark, have)), with_extra(target(spark, like)), percent=60)
    assert got(found) == brute(have, like, percent=60)


def test_empty_tables(spark):
    none, some = docs(spark, []), target(spark, ["a b"])
    assert resample.resample(none, some).count() == 0
    have = rows(3, 30)
    assert got(resample.resample(docs(spark, have), some.limit(0), percent=20)) == brute(have, [], percent=20)


def test_words_forgotten_are_counted_again(spark, monkeypatch):
    monkeypatch.setattr(resample, "CACHE", 5)
    have = rows(11, 40)
    assert got(resample.resample(docs(spark, have), target(spark, ["w3 w4"]))) == brute(have, ["w3 w4"])
