from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions import statistics as st
from tessella.operators import elementwise, grid, joins, kernels, learning, search, sequence


def test_ranges_and_grids(spark):
    with pytest.raises(ValueError, match="ends before"):
        sequence.index_range(spark, 3, 2)
    assert sequence.index_range(spark, 3, 3).count() == 0
    got = [tuple(r) for r in sequence.index_grid(spark, 2, 3, 2).orderBy("idx").collect()]
    assert got == [(i, i // 6, i // 2 % 3, i % 2) for i in range(12)]
    with pytest.raises(OverflowError):
        sequence.index_grid(spark, 2**32, 2**32)


def test_dense_index(spark):
    rows = spark.range(997).withColumn("k", (F.col("id") * 389) % 997).repartition(7)
    got = sequence.dense_index(rows, "k").orderBy("idx").collect()
    assert [r["idx"] for r in got] == list(range(997)) == [r["k"] for r in got]
    assert sequence.dense_index(rows.where("id < 0"), "k").count() == 0


@pytest.mark.parametrize(("n", "k"), [(10, 4), (3, 5), (12, 12), (1, 1), (100, 7)])
def test_chunks_split_like_ntile(spark, n, k):
    got = [r["c"] for r in spark.range(n).select(sequence.chunk_of(F.col("id"), n, k).alias("c"), "id").orderBy("id").collect()]
    base, extra = divmod(n, k)
    assert got == [c for c in range(k) for _ in range(base + (c < extra))]


def test_zip_needs_equal_extents(spark):
    a = spark.range(3).withColumnRenamed("id", "idx")
    with pytest.raises(ValueError, match="extents"):
        sequence.zipped(a, a.limit(2))


def test_search_contracts(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, math.nan), (2, 5.0), (3, 5.0), (4, None)], "idx long, v double")
    assert search.count_value(rows, "v", math.nan).first()["n"] == 0
    assert search.find(rows, "v", 5.0).first()["idx"] == 2
    assert search.find(rows, "v", 9.0).first()["idx"] == 5
    none = rows.where("idx < 0")
    assert search.any_of(none, F.col("v") > 0).first()[0] is False
    assert search.all_of(none, F.col("v") > 0).first()[0] is True
    assert search.none_of(none, F.col("v") > 0).first()[0] is True
    assert search.find(none, "v", 1.0).first()["idx"] == 0
    assert search.any_of_early(rows, F.col("v") > 4)


def test_threshold_and_saturation(spark):
    row = spark.range(1).select(*[elementwise.threshold(F.lit(p), 127, 255, inverse=i).alias(f"a{p}{i}") for p in (0, 127, 128, 255) for i in (False, True)]).first()
    assert list(row) == [0, 255, 0, 255, 255, 0, 255, 0]
    with pytest.raises(ValueError, match="255"):
        elementwise.threshold(F.lit(1), 300)
    big = F.lit(str(2**64 - 1)).cast("decimal(20,0)")
    got = spark.range(1).select(elementwise.saturating_add(big, F.lit(1)), elementwise.saturating_multiply(big, big), elementwise.saturating_multiply(F.lit(3), F.lit(4))).first()
    assert [int(x) for x in got] == [2**64 - 1, 2**64 - 1, 12]


def test_axpy_arrays_need_equal_lengths(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0])], "x array<double>, y array<double>")
    assert rows.select(elementwise.axpy_arrays(0.5, "x", "y").alias("z")).first()["z"] == [3.5, 5.0]
    with pytest.raises(Exception, match="equal extents"):
        spark.createDataFrame([([1.0], [3.0, 4.0])], "x array<double>, y array<double>").select(elementwise.axpy_arrays(0.5, "x", "y")).collect()


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (5, 1), (2, 2), (3, 3), (4, 6)])
def test_stencil_on_small_grids(spark, shape):
    rows, columns = shape
    v = {(r, c): 10.0 * r + c * c for r in range(rows) for c in range(columns)}
    df = spark.createDataFrame([(r, c, x) for (r, c), x in v.items()], "r long, c long, v double")
    want = {(r, c): 0.5 * x + 0.125 * v[r - 1, c] + 0.125 * v[r + 1, c] + 0.125 * v[r, c - 1] + 0.125 * v[r, c + 1] if 0 < r < rows - 1 and 0 < c < columns - 1 else x for (r, c), x in v.items()}
    got = {(r["r"], r["c"]): r["v"] for r in grid.stencil_2d(df, rows, columns).collect()}
    assert got == want


def test_percentile_rules_differ(spark):
    rows = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0)], "x double")
    got = rows.agg(F.percentile("x", 0.5), st.upper_median(F.collect_list("x")), st.lower_rank(F.collect_list("x"), 0.5)).first()
    assert list(got) == [2.5, 3.0, 2.0]


def test_regret_fixture(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.0, 0.10, 0.50)], "r double")
    got = st.regret_summary(rows, "r").first()
    assert (got["mean"], got["median"], got["worst"], got["catastrophic_rate"]) == (pytest.approx(0.15), pytest.approx(0.05), 0.5, 0.25)


@pytest.mark.parametrize(("x", "want"), [(1.0, (2049 << 4) + 8), (0.5, (2048 << 4) + 8), (0.75, (2048 << 4) + 12), (0.0, 0), (-1.0, 0), (math.inf, 0), (math.nan, 0)])
def test_real_bucket(spark, x, want):
    assert spark.createDataFrame([(x,)], "x double").select(st.real_bucket(F.col("x"))).first()[0] == want


def test_grid_neighbors_against_all_pairs(spark):
    pts = [(i, (i * 37 % 101) / 101, (i * 53 % 103) / 103) for i in range(200)]
    df = spark.createDataFrame(pts, "id long, x double, y double")
    got = {(r["id"], r["other"]) for r in joins.grid_neighbors(df, 8, 0.1).collect()}
    assert got == {(a, b) for a, ax, ay in pts for b, bx, by in pts if a != b and (ax - bx) ** 2 + (ay - by) ** 2 <= 0.1 * 0.1}
    with pytest.raises(ValueError, match="radius"):
        joins.grid_neighbors(df, 8, 0.2)


def test_integral(spark):
    row = kernels.integrate(spark, 20_000).first()
    assert row["value"] == pytest.approx(row["exact"], abs=1e-4)


def test_ridge_recovers_a_line(spark):
    rows = spark.createDataFrame([(1.0, i / 10, 2.0 + 3.0 * i / 10) for i in range(200)], "a double, b double, y double")
    beta = learning.ridge(rows, ["a", "b"], "y", ridge_lambda=1e-9)[()]["beta"]
    assert beta == pytest.approx([2.0, 3.0], abs=1e-6)


def test_ranker_lowers_its_loss(spark):
    pairs = spark.createDataFrame([([1.0, -0.5 * k], 1.0) for k in range(1, 9)], "difference array<double>, weight double")
    _, history = learning.train_ranker(pairs, 2, 8, rate=0.5)
    assert history[-1] < history[0]
