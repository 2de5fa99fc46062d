import numpy as np
import pytest
from pyspark.sql import functions as F

from kernelspark.operators import analytics as A
from kernelspark.sources import mat


def test_files_are_read_back_by_columns_and_ranges(spark, tmp_path):
    r = np.random.default_rng(0)
    x = {"lon": r.normal(size=1000), "lat": r.normal(size=1000), "grid": r.normal(size=(1000, 3))}
    (tmp_path / "a.mat").write_bytes(mat.encoded(x))
    (tmp_path / "b.mat").write_bytes(mat.encoded({k: v[:10] for k, v in x.items()}, compress=True))
    mat.register(spark)
    df = spark.read.format("mat").option("rows", 300).load(str(tmp_path))
    assert df.rdd.getNumPartitions() == 5
    got = df.where("path like '%a.mat'").orderBy("row").toPandas()
    assert np.array_equal(got["lon"], x["lon"]) and np.array_equal(np.stack(got["grid"]), x["grid"])
    b = spark.read.format("mat").option("columns", "lat").load(str(tmp_path / "b.mat"))
    assert b.columns == ["path", "row", "lat"] and np.array_equal(b.orderBy("row").toPandas()["lat"], x["lat"][:10])
    with pytest.raises(Exception, match="no such variables"):
        spark.read.format("mat").option("columns", "none").load(str(tmp_path / "b.mat")).count()


def test_row_vectors_odd_files_and_lengths(spark, tmp_path):
    mat.register(spark)
    (tmp_path / "v.mat").write_bytes(mat.encoded({"a": np.arange(5.0)[None, :], "b": np.arange(5.0), "c": np.arange(7.0)}))
    assert [v.shape for v in mat.variables(str(tmp_path / "v.mat"))] == [(1, 5), (5, 1), (7, 1)]
    assert spark.read.format("mat").option("columns", "a,b").load(str(tmp_path / "v.mat")).where("a = b").count() == 5
    with pytest.raises(Exception, match="different lengths"):
        spark.read.format("mat").load(str(tmp_path / "v.mat")).count()
    (tmp_path / "w.mat").write_bytes(b"no such file" * 20)
    with pytest.raises(Exception, match="no MAT file"):
        spark.read.format("mat").load(str(tmp_path / "w.mat")).count()


def test_sink(spark, tmp_path):
    df = spark.range(100).select(F.col("id").cast("double").alias("a"), F.when(F.col("id") > 5, F.col("id") * 2.0).alias("b")).repartition(4)
    listed = mat.write_mat(df, f"{tmp_path}/out")
    assert listed.agg(F.sum("rows")).first()[0] == 100
    mat.register(spark)
    got = spark.read.format("mat").load(f"{tmp_path}/out")
    assert got.agg(F.sum("a")).first()[0] == 4950 and got.where(F.isnan("b")).count() == 6


def quantiles(spark, rows, qs=(0.0, 0.1, 0.5, 0.9, 1.0)):
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r.k, r.q): r.v for r in A.exact_quantiles(df, ["k"], "v", list(qs)).collect()}
    groups = {}
    for k, v in rows:
        if v is not None and not np.isnan(v):
            groups.setdefault(k, []).append(v)
    assert set(got) == {(k, q) for k in groups for q in qs}
    for (k, q), v in got.items():
        assert v == pytest.approx(np.quantile(groups[k], q), rel=1e-12, abs=1e-300)


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(A, "FEW", 3)
    monkeypatch.setattr(A, "PARTS", 4)


def test_quantiles_equal_numpy(spark, small):
    r = np.random.default_rng(0)
    rows = [("a", float(v)) for v in r.normal(size=200)] + [(None, float(v)) for v in r.lognormal(0, 2, 60)] + [("one", 5.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("same", 2.0), ("same", 2.0)]
    rows += [("odd", None), ("odd", float("nan")), ("odd", 1.0), ("none", None)]
    quantiles(spark, rows)


def test_quantiles_of_far_values(spark, small):
    rows = [("a", s * 10.0**e) for e in range(-30, 31, 6) for s in (1, -1)] + [("a", 0.0)] * 9 + [("a", 1.7e308), ("a", -1.7e308)]
    quantiles(spark, rows, (0.1, 0.5, 0.77))


def test_no_rows(spark):
    assert A.exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("keys", [["k"], ["k", "m"], []])
def test_summary_equals_percentile(spark, small, monkeypatch, keys):
    """Null keys, nulls, NaN, infinities, equal values and repeated rows, as percentile() takes them, which is not called: it would shuffle every distinct value."""
    r, nan, inf = np.random.default_rng(1), float("nan"), float("inf")
    rows = [("a", i % 2, float(v)) for i, v in enumerate(r.normal(size=90))] + [(None, None, float(v)) for v in r.lognormal(0, 2, 40)] * 2
    rows += [("inf", 1, v) for v in (inf, inf, -inf, *map(float, range(12)))] + [("nan", 1, v) for v in (nan, nan, inf, -inf, 1.0, 0.1, 0.3, None)]
    rows += [("all", 1, nan)] * 3 + [("ends", 1, -inf), ("ends", 1, inf), ("same", 2, 0.1), ("same", 2, 0.1), ("same", 2, 0.1), ("none", None, None), ("one", 3, 7.5)]
    df = spark.createDataFrame(rows, "k string, m int, v double").withColumn("d", F.when(F.abs("v") < 1e6, F.col("v")).cast("decimal(12,4)")).repartition(4)
    own = [f"{e} as {v}_{name}" for v in ("v", "d") for name, e in (("median", f"percentile({v}, 0.5)"), ("mean", f"avg({v})"), ("std", f"stddev_samp({v})"), ("p10", f"percentile({v}, 0.1)"), ("p90", f"percentile({v}, 0.9)"))]
    want = df.groupBy(*keys).agg(F.count("*").alias("repeat_count"), *map(F.expr, own))
    plain = lambda t: sorted([tuple(f"{float(v):.12g}" if i >= len(keys) and v is not None else repr(v) for i, v in enumerate(x)) for x in t.collect()])
    monkeypatch.delattr(F, "percentile")
    got = A.summarise(df, keys, ["v", "d"])
    assert got.dtypes == want.dtypes and plain(got) == plain(want)
    assert plain(A.summarise(df.limit(0), keys, ["v", "d"])) == plain(df.limit(0).groupBy(*keys).agg(F.count("*"), *map(F.expr, own)))


def test_infinite_values_end(spark, small):
    """Many rows with an infinite one beside them: the range that is cut is that of the finite ones."""
    df = spark.createDataFrame([("a", float(v)) for v in range(30)] + [("a", float("inf"))] * 10 + [("a", float("-inf"))], "k string, v double")
    assert {r.q: r.v for r in A.exact_quantiles(df, ["k"], "v", [0.0, 0.5, 0.9]).collect()} == {0.0: float("-inf"), 0.5: 19.0, 0.9: float("inf")}
