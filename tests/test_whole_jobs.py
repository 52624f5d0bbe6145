"""Queries do their whole job: as many rounds and epochs as the reference."""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import plans
from tessella.functions import statistics as st
from tessella.operators import learning

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(DATA).exists(), reason="the test tables are not here")


def test_weights_are_those_of_sparks_hash(spark):
    rounds, edges = 50, np.cumsum([0.36787944117144233 / np.prod(np.arange(1, k + 1)) for k in range(9)])
    drawn = spark.range(-20, 20).select("id", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
    drawn = drawn.select("id", "r", (F.pmod(F.xxhash64(F.lit(11), "r", "id"), F.lit(1 << 53)) / float(1 << 53)).alias("u"))
    weights = st.poisson_weights(11, rounds)
    for row in drawn.collect():
        assert weights(row["id"])[row["r"]] == np.sum(row["u"] >= edges)


@needs_tables
def test_bootstrap_draws_as_many_samples_as_the_reference(spark):
    found = plans.QUERIES["bootstrap_ci"](spark, DATA).first()
    assert found["rounds"] == 10_000
    x = np.array([r["value"] for r in spark.read.parquet(f"{DATA}/events.parquet").where("value is not null").collect()])
    error = x.std() / np.sqrt(len(x))
    # the distribution of the mean is close to normal; 10,000 rounds leave about 0.03 standard errors at either end
    assert found["low"] == pytest.approx(x.mean() - 1.96 * error, abs=0.15 * error)
    assert found["high"] == pytest.approx(x.mean() + 1.96 * error, abs=0.15 * error)


def plain_training(pairs: list[tuple[list[float], float]], size: int, epochs: int) -> np.ndarray:
    """The reference's loop, pair by pair, at the rate of ``learning``."""
    weights, rate = np.zeros(size), learning.RATE
    for _ in range(epochs):
        gradient = sum(w / (1 + np.exp(-(weights @ x))) * np.asarray(x) for x, w in pairs) / len(pairs) + learning.L2 * weights
        norm = np.sqrt(gradient @ gradient)
        weights = weights - rate * gradient * (learning.NORM / norm if norm > learning.NORM else 1.0)
        rate *= learning.COOL
    return weights


@pytest.mark.parametrize("gathered", [0, 100])
def test_gathered_differences_train_as_pairs_do(spark, monkeypatch, gathered):
    monkeypatch.setattr(learning, "GATHERED", gathered)
    pairs = [([0.0, 0.1 * (k % 3 - 1), -0.05 * (k % 7)], 0.1 + 0.01 * k) for k in range(60)]
    weights, history = learning.train_ranker(spark.createDataFrame(pairs, "difference array<double>, weight double"), 3, 12)
    assert weights == pytest.approx(plain_training(pairs, 3, 12), rel=1e-9, abs=1e-12)
    assert len(history) == 12


@needs_tables
def test_ranker_trains_as_many_epochs_as_the_reference(spark, monkeypatch):
    trained, train = [], learning.train_ranker

    def kept(*a, **b):
        trained.append((a[0].collect(), train(*a, **b)))
        return trained[-1][1]

    monkeypatch.setattr(learning, "train_ranker", kept)
    plans.QUERIES["ranker_train"](spark, DATA)
    (pairs, (weights, history)), = trained
    assert len(history) == 120
    assert weights == pytest.approx(plain_training([(r["difference"], r["weight"]) for r in pairs], 3, 120), rel=1e-9, abs=1e-12)
