"""Ridge regression and pairwise ranking, by sums over the rows.

Models of groups are solved in tasks and joined to the rows that they predict.
The only things that come to the driver are the models that are asked for there,
and the ranker's distinct differences where they are few.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.shared import materialize

#: Regularisation, decay and the limits of a pair's weight and of a gradient.
LAMBDA, DECAY = 2.0, 0.995
NEAR_TIE, MOST_WEIGHT, RATE, L2, NORM, COOL = 0.005, 3.0, 0.03, 1e-4, 5.0, 0.99
#: So many distinct differences of pairs may come to the driver.
GATHERED = 100_000


def ridge_table(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), weight: Column | None = None, ridge_lambda: float = LAMBDA) -> DataFrame:
    """(by..., beta, variance, n): coefficients and residual variance for each group, from weighted normal equations.

    Groups are summed and solved where they are; nothing comes to the driver.
    ``weight`` can hold a decay, so that the result is that of updates one by one.
    """
    n = len(features)
    rows = df.withColumn("_w", weight if weight is not None else F.lit(1.0))
    cells = [(i, j) for i in range(n) for j in range(i, n)]
    total = lambda x: F.coalesce(F.sum(F.col("_w") * x), F.lit(0.0)).cast("double")
    gram = F.array(*[total(F.col(features[i]) * F.col(features[j])) for i, j in cells]).alias("_a")
    right = F.array(*[total(F.col(f) * F.col(target)) for f in features]).alias("_b")
    sums = rows.groupBy(*by).agg(gram, right, total(F.col(target) * F.col(target)).alias("_yy"), F.coalesce(F.sum("_w"), F.lit(0.0)).cast("double").alias("n"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            betas, variances = [], []
            for cell, b, yy, count in zip(*(batch.column(c).to_pylist() for c in ("_a", "_b", "_yy", "n")), strict=True):
                a = np.zeros((n, n))
                for (i, j), v in zip(cells, cell, strict=True):
                    a[i, j] = a[j, i] = v
                beta = np.linalg.solve(a + ridge_lambda * np.eye(n), np.array(b))
                betas.append(beta.tolist())
                variances.append(max(0.0, yy - 2 * float(beta @ b) + float(beta @ a @ beta)) / max(count, 1e-12))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(betas, pa.list_(pa.float64())), pa.array(variances, pa.float64()), batch.column("n")], [*by, "beta", "variance", "n"])

    kinds = ", ".join([*(f"`{c}` {sums.schema[c].dataType.simpleString()}" for c in by), "beta array<double>, variance double, n double"])
    return sums.mapInArrow(solve, kinds)


def ridge(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = (), weight: Column | None = None, ridge_lambda: float = LAMBDA) -> dict[tuple, dict]:
    """``ridge_table`` as a dictionary, for a few groups whose models are to be saved or looked at."""
    rows = ridge_table(df, features, target, by, weight, ridge_lambda).collect()
    return {tuple(r[k] for k in by): {"beta": list(r["beta"]), "variance": r["variance"], "n": r["n"]} for r in rows}


def with_prediction(df: DataFrame, features: Sequence[str], models: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with the fitted value of its group's model, by a join; groups without a model give 0."""
    found = models.select(*[F.col(k).alias(f"_m_{k}") for k in by], F.col("beta").alias("_beta"))
    same = [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in by]
    met = df.join(found, same, "left") if by else df.join(F.broadcast(found))  # without groups there is one model
    value = sum((F.get("_beta", i) * F.col(f) for i, f in enumerate(features)), F.lit(0.0))
    return met.withColumn(name, F.coalesce(value, F.lit(0.0))).drop("_beta", *[f"_m_{k}" for k in by])


def hierarchical(df: DataFrame, features: Sequence[str], target: str, backend: str, family: str) -> DataFrame:
    """A shared fit, then a backend's on what is left, then one of family and backend; adds each part and their sum."""
    rows = df.withColumn("_left", F.col(target))
    parts = {"shared": [], "backend_part": [backend], "family_part": [family, backend]}
    for name, by in parts.items():
        models = materialize(ridge_table(rows, features, "_left", by), "ridge")
        rows = with_prediction(rows, features, models, by, name).withColumn("_left", F.col("_left") - F.col(name))
    return rows.withColumn("fitted", F.col("shared") + F.col("backend_part") + F.col("family_part")).drop("_left")


def _sums_here(rows: Sequence[tuple[list[float], float]], size: int) -> Callable[[list[float]], list[float]]:
    """Loss and gradient, summed over (difference, weight), as a function of the weights."""
    x, weight = np.array([r[0] for r in rows], float).reshape(len(rows), size), np.array([r[1] for r in rows], float)

    def sums(weights: list[float]) -> list[float]:
        z = x @ np.array(weights)
        share = weight * np.exp(-np.logaddexp(0.0, -z))
        return [float(weight @ np.logaddexp(0.0, z)), *(share @ x).tolist()]

    return sums


def _sums_by_spark(df: DataFrame, size: int) -> Callable[[list[float]], list[float]]:
    """The same for a table (difference, weight)."""

    def sums(weights: list[float]) -> list[float]:
        z = sum((F.lit(w) * F.get("difference", i) for i, w in enumerate(weights)), F.lit(0.0))
        p = 1.0 / (1.0 + F.exp(-z))
        loss = F.when(z > 30.0, z).otherwise(F.log1p(F.exp(z)))
        return list(df.agg(F.sum(F.col("weight") * loss).alias("loss"), *[F.sum(F.col("weight") * p * F.get("difference", i)).alias(f"g{i}") for i in range(size)]).first())

    return sums


def train_ranker(pairs: DataFrame, size: int, epochs: int, rate: float = RATE, l2: float = L2) -> tuple[list[float], list[float]]:
    """Full-batch descent on weighted pairwise losses.

    ``pairs`` (difference array<double> of better less worse, weight).  Pairs of
    one difference have one loss and gradient but for their weights, so the
    distinct differences are gathered once, with their summed weights.  Each
    epoch takes ``size + 1`` sums over all of them, on the driver if they are
    at most ``GATHERED`` and else in one aggregate; the gradient's norm is
    bounded.
    """
    distinct = materialize(pairs.groupBy("difference").agg(F.sum("weight").alias("weight"), F.count("*").alias("n")), "differences")
    n = distinct.agg(F.sum("n")).first()[0]
    if not n:
        raise ValueError("there is no pair that is not a near tie")
    few = sorted(distinct.select("difference", "weight").limit(GATHERED + 1).collect())
    sums = _sums_here(few, size) if len(few) <= GATHERED else _sums_by_spark(distinct, size)
    weights, history = [0.0] * size, []
    for _ in range(epochs):
        loss, *gradient = sums(weights)
        g = [x / n + l2 * w for x, w in zip(gradient, weights, strict=True)]
        norm = float(np.sqrt(np.sum(np.square(g))))
        step = rate * min(1.0, NORM / norm) if norm else 0.0
        weights = [w - step * x for w, x in zip(weights, g, strict=True)]
        history.append(loss / n)
        rate *= COOL
    return weights, history


def evaluate_ranker(df: DataFrame, group: str, item: str, cost: str, score: Column) -> DataFrame:
    """Each group's regret when its candidate of least score is taken."""
    scored = df.withColumn("_s", score)
    found = scored.groupBy(group).agg(F.min(F.struct("_s", item, cost)).alias("a"), F.min(F.struct(cost, item)).alias("b"))
    regret = F.greatest(F.lit(0.0), F.col(f"a.{cost}") / F.col(f"b.{cost}") - 1)
    return found.select(group, F.col(f"a.{item}").alias("selected"), F.col(f"b.{item}").alias("best"), regret.alias("regret"), (F.col(f"a.{item}") == F.col(f"b.{item}")).alias("exact"))


class PairTrainer:
    """One stochastic step after the other, for events (difference, ratio) in order."""

    def __init__(self, size: int):
        self.weights = [0.0] * size

    def step(self, event: dict) -> dict:
        ratio = event["ratio"]
        weight = 0.0 if ratio <= 1 + NEAR_TIE else min(MOST_WEIGHT, abs(float(np.log(ratio))))
        x = np.asarray(event["difference"], float)
        w = np.asarray(self.weights)
        z = float(w @ x)
        loss = weight * float(np.logaddexp(0.0, z))
        if weight:
            w = w - RATE * (weight / (1 + np.exp(-np.clip(z, -700, 700))) * x + L2 * w)
            self.weights = w.tolist()
        return {"loss": loss, "first": self.weights[0], "last": self.weights[-1]}
