"""How many lists are probed, recall at several sizes, repeated ids, queries in turns."""

import numpy as np
import pytest

from kernelspark.llm import ann


def clustered(n, dim=16, centres=60, seed=0):
    r = np.random.default_rng(seed)
    return r.normal(size=(centres, dim))[r.integers(0, centres, n)] + 0.15 * r.normal(size=(n, dim))


def even(n, dim=32, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), v.astype(np.float32).tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").repartition(4)


def recall(spark, x, condition, step, **more):
    x = x.astype(np.float32).astype(float)
    got = ann.search(frame(spark, x), condition, **more).toPandas()
    hit = total = 0
    for q in range(0, len(x), step):
        d = ((x - x[q]) ** 2).sum(1)
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        rows = got[got["query_id"] == q].sort_values("rank")
        assert len(rows) == 10 and np.allclose(rows["score"], np.sqrt(d[rows["vec_id"]]))
        hit, total = hit + len(set(best) & set(rows["vec_id"])), total + 10
    return hit / total


@pytest.mark.parametrize("make", [clustered, even])
@pytest.mark.parametrize("n", [300, 2_000, 12_000])
def test_recall(spark, make, n):
    assert recall(spark, make(n), "vec_id % 100 = 0", 100) >= 0.93


def test_groups_need_few_lists_and_the_share_falls_with_rows():
    shares = {}
    for make in (clustered, even):
        for n in (2_000, 20_000):
            x = make(n)
            shares[make, n] = ann.share_of_lists(x, ann.fit(x[:4000], int(np.sqrt(n)), 4), 10, 0.965)
    assert shares[clustered, 20_000] < 0.12 and shares[clustered, 20_000] < 0.5 * shares[even, 20_000]
    assert shares[even, 20_000] <= shares[even, 2_000]


def test_one_id_with_two_vectors_is_its_least(spark):
    x = np.array([[0.0, 1], [1, 0], [0.9, 0], [0, 2], [3, 3]])
    for order in ([0, 1, 2, 3, 4], [4, 3, 2, 1, 0]):
        got = ann.search(frame(spark, x[order], np.array([0, 1, 1, 2, 0])[order]), "vec_id = 0").collect()
        # id 0 is (0, 1), id 1 is (0.9, 0)
        assert [(r.vec_id, round(r.score, 5)) for r in sorted(got, key=lambda r: r.rank)] == [(2, 1.0), (1, round(float(np.hypot(0.9, 1)), 5))]


def test_queries_in_turns_find_the_same(spark, monkeypatch):
    x = clustered(600)
    want = ann.search(frame(spark, x), "vec_id % 3 = 0").toPandas()
    monkeypatch.setattr(ann, "PART", 40)
    got = ann.search(frame(spark, x), "vec_id % 3 = 0").toPandas()
    key = ["query_id", "rank"]
    assert want.sort_values(key).reset_index(drop=True).equals(got.sort_values(key).reset_index(drop=True))


def test_only_the_lists_sizes_are_broadcast(spark):
    plan = ann.search(frame(spark, even(400)), "vec_id % 10 = 0")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all("rightHint=(strategy=broadcast)" in line for line in joins)


def test_copies_lie_at_distance_nought(spark):
    x = np.repeat(1e3 * even(60, dim=64), 40, axis=0)
    got = ann.search(frame(spark, x), "vec_id % 100 = 0", probe=1.0).toPandas()
    for q, rows in got.groupby("query_id"):
        first = q // 40 * 40
        assert rows.sort_values("rank")["vec_id"].tolist() == [i for i in range(first, first + 40) if i != q][:10]
