import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.llm import hardneg
from tests.llm.helpers import with_extra

SCHEMA = "vec_id long, label int, v array<long>"


def brute(rows, anchor, positives=5, k=3, low=50, high=95):
    """From the definition: rows are (id, label, vector)."""
    fine = [r for r in rows if r[0] is not None and r[1] is not None and r[2] and None not in r[2]]
    sizes = [len(r[2]) for r in fine]
    dim = max(set(sizes), key=lambda n: (sizes.count(n), -n), default=0)
    one = {}
    for r in sorted(fine, key=lambda r: (r[1], r[2])):
        if len(r[2]) == dim:
            one.setdefault(r[0], r)
    out = []
    for a in one.values():
        if not anchor(a[0]):
            continue
        scored = sorted((-sum(x * y for x, y in zip(a[2], b[2], strict=True)), b[0], b[1]) for b in one.values() if b[0] != a[0])
        for s, p, label in [r for r in scored if r[2] == a[1]][:positives]:
            found = [r for r in scored if r[2] != a[1] and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a[0], p, i, n, -s, -t) for i, (t, n, _) in enumerate(found[:k], 1)]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.collect()))


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def small(monkeypatch):
    # parts and blocks of a few rows, so that many trees and blocks meet
    for name, n in (("PART", 64), ("LEAF", 8), ("BLOCK", 7), ("SAMPLE", 100)):
        monkeypatch.setattr(hardneg, name, n)


def vectors(n, dim, labels=3, seed=1, spread=60, centres=0):
    r = np.random.default_rng(seed)
    x = r.normal(0, spread, (n, dim))
    if centres:
        x = x / 6 + r.normal(0, spread, (centres, dim))[r.integers(0, centres, n)]
    return [(i, int(r.integers(0, labels)), [int(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize("centres", [0, 5])
def test_equals_brute_force(spark, small, centres):
    rows = vectors(400, 8, centres=centres)
    found = hardneg.mine(with_extra(table(spark, rows).repartition(5)), "vec_id % 10 = 0")
    assert got(found) == brute(rows, lambda i: i % 10 == 0)


def test_ties_copies_and_negative_scores(spark, small):
    rows = [(i, i % 3, [1, -2, 3]) for i in range(200)] + [(200 + i, i % 2, [-5, i % 4, 1]) for i in range(60)]
    assert got(hardneg.mine(table(spark, rows), "vec_id % 20 = 0", high=100)) == brute(rows, lambda i: i % 20 == 0, high=100)


def test_odd_rows(spark):
    rows = [*vectors(30, 3), (None, 1, [1, 2, 3]), (40, None, [1, 2, 3]), (41, 1, None), (42, 1, []), (43, 1, [1, None, 2]), (44, 1, [1, 2]), (45, 1, [0, 0, 0]), (10, 1, [9, 9, 9]), (10, 0, [9, 9, 9]), (46, 2, [2**20, 5, -7]), (46, 2, [2**20, 5, -7])]
    assert got(hardneg.mine(table(spark, rows), "vec_id % 5 = 0")) == brute(rows, lambda i: i % 5 == 0)


def test_great_components_are_exact(spark):
    big = [(i, i % 2, [2**29 + i, 2**30 - 3 * i, i]) for i in range(12)]
    assert got(hardneg.mine(table(spark, big), "vec_id < 4", high=100)) == brute(big, lambda i: i < 4, high=100)


def test_no_rows(spark):
    assert hardneg.mine(table(spark, [])).count() == 0
    assert hardneg.mine(table(spark, vectors(20, 3)), "vec_id = 1000").count() == 0
    assert hardneg.mine(table(spark, [(0, 1, [1, 2])])).count() == 0
    assert hardneg.mine(table(spark, [(0, None, [1, 2])])).count() == 0


def test_leaves_are_passed_over():
    """Bounds hold, and let an anchor skip most leaves of clustered rows of like norms."""
    r = np.random.default_rng(1)
    x = r.normal(0, 1, (40, 16))[r.integers(0, 40, 4096)] + 0.1 * r.normal(0, 1, (4096, 16))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(int)
    ids = np.arange(4096)
    tree = hardneg.Tree.build(ids, ids % 3, x, float((x * x).sum(1).max()), 64)
    low, high = tree.bounds(x[:50])
    exact = np.sqrt(np.maximum((x[:50] ** 2).sum(1)[:, None] + tree.norm2 - 2 * x[:50] @ x.T, 0))
    kth = np.sort(exact, axis=1)[:, 10]
    assert (low <= kth[:, None]).mean() < 0.25
    for leaf in range(64):
        own = tree.ids[tree.start[leaf] : tree.start[leaf + 1]]
        assert (low[:, leaf] <= exact[:, own].min(1) + 1e-6).all() and (high[:, leaf] >= exact[:, own].max(1) - 1e-6).all()


def test_scaling(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(1, 0, [0.5, -0.001]), (2, 0, [inf, 1.0]), (3, 0, [nan, 1.0]), (4, 0, [None, 1.0]), (5, 0, None), (6, 0, [])], "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: r.v for r in hardneg.scaled(df).collect()} == {1: [128, -1], 2: None, 3: None, 4: None, 5: None, 6: []}
    assert hardneg.scaled(df.withColumn("embedding", F.lit(None).cast("array<float>"))).where("v is not null").count() == 0
