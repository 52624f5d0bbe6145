from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import reduce as red
from tessella.operators.reduce import Policy


def sequence(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "idx long, v double")


def total(df, policy, init=0.0):
    return red.reduce_sum(df, F.col("v"), policy, init).first()["total"]


def canonical(values, init=0.0):
    """Leaves from the left, then a pairwise tree."""
    states = []
    for k in range(0, len(values), 1024):
        s = values[k]
        for v in values[k + 1 : k + 1024]:
            s += v
        states.append(s)
    while len(states) > 1:
        states = [states[i] + states[i + 1] if i + 1 < len(states) else states[i] for i in range(0, len(states), 2)]
    return init + states[0] if states else init


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_reproducible_equals_its_definition(spark, n):
    values = [1e8 if i % 3 == 0 else (i % 11) / 7 for i in range(n)]
    assert total(sequence(spark, values), Policy.REPRODUCIBLE, 0.25) == canonical(values, 0.25)


def test_positions_far_apart_lose_nothing(spark):
    """Beyond 1,024 ** 4 positions, and by group."""
    rows = [(0, 1.0, "a"), (2**41, 2.0, "a"), (3 * 2**41, 4.0, "b"), (2**62, 8.0, "b"), (5, 16.0, None)]
    df = spark.createDataFrame(rows, "idx long, v double, g string")
    for policy in Policy:
        assert total(df, policy) == 31.0
        found = red.reduce_sum(df, F.col("v"), policy, by=["g"]).collect()
        assert {r["g"]: r["total"] for r in found} == {"a": 3.0, "b": 12.0, None: 16.0} and len(found) == 3
    assert red.norm(df, F.col("v"), Policy.ACCURATE).first()["norm"] == pytest.approx(341**0.5)
    assert [red.rounds_for(n) for n in (0, 1023, 1024, 2**20 - 1, 2**20, 2**53)] == [1, 1, 2, 2, 3, 6]
    with pytest.raises(ValueError, match="start at 0"):
        total(df.withColumn("idx", F.col("idx") - 1), Policy.REPRODUCIBLE)


def test_reproducible_under_any_partitioning(spark):
    values = [random.Random(i).uniform(-1e9, 1e9) for i in range(4000)]
    random.Random(1).shuffle(values)
    base = sequence(spark, values)
    assert len({total(base.repartition(p), Policy.REPRODUCIBLE) for p in (1, 3, 7)}) == 1


def test_policies_on_adversarial_values(spark):
    values = [1e16, 1.0, -1e16] * 3000
    assert total(sequence(spark, values), Policy.ACCURATE) == 3000.0
    assert total(sequence(spark, values), Policy.REPRODUCIBLE) == canonical(values)


@pytest.mark.parametrize(
    ("values", "want"),
    [([math.nan, 1.0], math.nan), ([math.inf, 1.0], math.inf), ([-math.inf], -math.inf), ([math.inf, -math.inf], math.nan), ([-0.0], 0.0), ([5e-324] * 3, 1.5e-323), ([1e308, 1e308], math.inf)],
)
def test_special_values(spark, values, want):
    got = total(sequence(spark, values), Policy.ACCURATE)
    assert math.isnan(got) if math.isnan(want) else got == want


def test_accurate_is_correctly_rounded_here(spark):
    values = [random.Random(i).uniform(-1e12, 1e12) for i in range(3000)]
    assert total(sequence(spark, values), Policy.ACCURATE) == pytest.approx(math.fsum(values), rel=1e-15)


@pytest.mark.parametrize(("values", "want"), [([1e308, 1e308], math.sqrt(2) * 1e308), ([1e-308, 1e-308], math.sqrt(2) * 1e-308), ([], 0.0), ([0.0], 0.0), ([3.0, 4.0], 5.0)])
def test_norm_without_overflow(spark, values, want):
    got = red.norm(sequence(spark, values), F.col("v"), Policy.ACCURATE).first()["norm"]
    assert got == pytest.approx(want, rel=1e-14)


def test_order_is_kept(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("abcdef" * 400)], "idx long, v string").repartition(5)
    got = red.reduce_by(rows, F.col("v"), lambda a, b: F.concat(a, b), F.lit("prefix:"), "string").first()["total"]
    assert got == "prefix:" + "abcdef" * 400


def test_unsupported_policies_are_refused(spark):
    with pytest.raises(ValueError, match="accurate"):
        red.reduce_by(sequence(spark, [1.0]), F.col("v"), lambda a, b: a + b, F.lit(0.0), "double", Policy.ACCURATE)
    with pytest.raises(ValueError, match="custom"):
        red.require("custom", Policy.ACCURATE)


def test_dot_and_groups(spark):
    rows = spark.createDataFrame([(i, float(i + 1), float(2 * i - 3)) for i in range(2000)], "idx long, x double, y double")
    assert red.dot(rows, F.col("x"), F.col("y"), Policy.REPRODUCIBLE).first()["dot"] == sum((i + 1) * (2 * i - 3) for i in range(2000))
    keyed = rows.withColumn("k", F.col("idx") % 3)
    got = {r["k"]: r["total"] for r in red.reduce_sum(keyed, F.col("x"), Policy.ACCURATE, by=["k"]).collect()}
    assert got == {k: float(sum(i + 1 for i in range(2000) if i % 3 == k)) for k in range(3)}
