"""The analytics' expressions against hand calculations."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessella.functions.formulas import Chain, doubles
from tessella.operators import adaptive as ad

WORK = {
    "w": 1, "iterations": 100_000, "elements": 100_000, "object_size": 64, "dims": 1, "external_bytes": 0, "hinted": False, "hint_confidence": 0.0, "contiguous_known": True, "contiguous": True, "random_known": True, "random_access": False,
    "stride_known": True, "stride_bytes": 64, "node_storage": False, "arithmetic": 0.0, "branchiness": 0.0, "randomness": 0.0, "vectorization": 0.0, "dependency_depth": 0, "dependent_accesses": 0, "mlp": 1.0, "bytes_touched": 0,
    "cv": 0.05, "tail": 1.1, "regional": 1.0, "baseline_ms": 0.01, "mean_ms": 0.01, "batches": 12, "reliable": True, "setup_ms": 0.0, "invocations": 100, "local_ms": 0.0, "distributed_ms": 0.0, "overhead_ms": 1.0,
}


def run(spark, *chains, **changes):
    row = WORK | changes
    df = spark.createDataFrame([tuple(row.values())], list(row))
    for c in chains:
        df = c.apply(df)
    return df.first()


DESCRIBED = (ad.ANALYSIS, ad.PRESSURE, ad.MEMORY, ad.FAMILY)


def test_literals_become_doubles():
    assert doubles("x1.5 + 0.25 * 3") == "x1.5 + 0.25e0 * 3"
    assert Chain(("y", "x * 0.5")).sql("t") == "(SELECT *, x * 0.5e0 AS y FROM t)"


def test_contiguous_work_streams(spark):
    r = run(spark, *DESCRIBED)
    assert (r["tier"], r["access"]) == ("L3", "Sequential")
    # 1.2 contiguous + 0.6 stride + 0.25 steady; 0.35 resident + 0.35 steady
    assert r["e_streaming"] == pytest.approx(2.05) and r["e_compute"] == pytest.approx(0.70)
    assert r["family"] == "StreamingMemory" and not r["ambiguous"]
    weights = {k: math.exp((r[f"e_{k}"] - 2.05) / 1.15) for k in ad.EVIDENCE}
    for k, x in weights.items():
        assert r[f"m_{k}"] == pytest.approx(x / sum(weights.values()) * 2.05 / 2.5)


def test_hinted_pointer_chasing_is_irregular(spark):
    r = run(spark, *DESCRIBED, hinted=True, hint_confidence=1.0, randomness=0.9, dependency_depth=4, dependent_accesses=2, contiguous=False, random_access=True)
    assert r["access"] == "PointerChasing" and r["family"] == "IrregularMemory"
    assert r["dependency_strength"] == pytest.approx(math.log(7) / math.log(9))


def test_no_evidence_is_unknown(spark):
    r = run(spark, *DESCRIBED, contiguous_known=False, random_known=False, stride_known=False, cv=1.0, tail=1.0, iterations=10, elements=10**9)
    assert r["memory_heavy"] and r["exceeds_l3"]
    unknown = run(spark, *DESCRIBED, contiguous_known=False, random_known=False, stride_known=False, cv=0.2, tail=1.0)
    assert unknown["family"] == "Unknown" and unknown["family_confidence"] == 0


def test_profile_cost_blends_a_bounded_mean(spark):
    r = run(spark, ad.PROFILE_COST, mean_ms=1.0, cv=2.0, tail=3.0)
    assert r["mean_ratio"] == 3.0 and r["mean_weight"] == pytest.approx(0.45)
    assert r["each_ms"] == pytest.approx(0.01 * (1 - 0.45) + 0.03 * 0.45)


def test_scaling_only_extrapolates(spark):
    r = run(spark, *DESCRIBED, ad.PROFILE_COST, ad.SCALING)
    conf = 0.35 + 0.40 * r["family_confidence"]
    exponent = 1 + (0.94 - 1) * conf
    assert r["growth"] == pytest.approx(max(0.72, 1000 ** (exponent - 1)))
    assert run(spark, *DESCRIBED, ad.PROFILE_COST, ad.SCALING, invocations=100_000)["growth"] == 1.0


def test_pilot_pays(spark):
    r = run(spark, ad.WORTH.__class__(("avg_ms", "mean_ms")), ad.WORTH)
    assert r["worth"] == pytest.approx(1000 / (1 + 1000 / 16 * 1.1)) and r["pays"]
    assert not run(spark, Chain(("avg_ms", "mean_ms")), ad.WORTH, mean_ms=1e-6)["pays"]


def test_similarity(spark):
    one = dict.fromkeys(ad.BUCKETS, 1) | {"cost": (2050 << 4) + 9, "variation": (2049 << 4) + 8, "cache": (2049 << 4) + 8, "iteration": 1024, "working_set": 4096, "object": 8, "stride": 64}
    far = one | {"iteration": 4096}
    rows = [(1, *one.values()), (2, *far.values()), (3, *(one | {"kind": 9}).values())]
    df = spark.createDataFrame(rows, ["w", *one])
    got = {(r["w"], r["other"]): r["similarity"] for r in ad.similar_pairs(df, df, "w").collect()}
    assert got[1, 1] == pytest.approx(1.0) and (1, 3) not in got
    assert got[1, 2] == pytest.approx(1 - 0.16 * (1 - math.exp(-2 / 2)))


def test_confidence_is_a_geometric_mean(spark):
    row = {"profile_c": 0.9, "family_c": 0.5, "residual_c": 0.5, "history_c": 0.0, "similarity_c": 0.6, "ranked": 1.1, "analytical": 1.0}
    r = ad.CONFIDENCE.apply(spark.createDataFrame([tuple(row.values())], list(row))).first()
    agree = math.exp(-0.1 / 0.5)
    want = 0.9**0.30 * 0.5**0.15 * 0.5**0.20 * 0.05**0.15 * 0.6**0.05 * agree**0.15
    assert r["confidence"] == pytest.approx(want)


def plans(spark, *rows):
    names = ["w", "plan", "predicted_ms", "confidence", "stddev_ms", "samples", "h_mean", "h_sd", "h_regret", "h_last", "h_success", "h_weight", "h_error"]
    return spark.createDataFrame([tuple(float(x) if isinstance(x, int) and i not in (0, 5) else x for i, x in enumerate(r)) for r in rows], names)


def test_measurements_overrule_a_biased_order(spark):
    same = (0.9, 0.0)
    df = plans(spark, (1, "a", 1, *same, 40, 10, 0.1, 0, 0, 1, 0, 0), (1, "b", 2, *same, 40, 5, 0.1, 0, 0, 1, 0, 0))
    got = {r["plan"]: r for r in ad.rank(df).collect()}
    assert got["a"]["overridden"] and got["a"]["chosen"] == "b"
    few = plans(spark, (1, "a", 1, *same, 2, 10, 0.1, 0, 0, 1, 0, 0), (1, "b", 2, *same, 2, 5, 0.1, 0, 0, 1, 0, 0))
    assert {r["chosen"] for r in ad.rank(few).collect()} == {"a"}


def test_guard_keeps_the_baseline_without_confidence(spark):
    df = plans(spark, (1, "a", 1.0, 0.9, 0.0, 40, 10, 0.1, 60, 60, 0, 30, 0), (1, "b", 1.05, 0.9, 0.0, 40, 5, 0.1, 0, 0, 1, 30, 0))
    sure = ad.guard(ad.RANKING.apply(df)).first()
    assert (sure["learned"], sure["baseline"]) == ("b", "a") and sure["allowed"] and sure["chosen"] == "b"
    noisy = ad.guard(ad.RANKING.apply(df.withColumn("h_sd", F.lit(5.0)))).first()
    assert noisy["learned"] == "a" or not noisy["allowed"]


def test_candidates(spark):
    df = spark.createDataFrame([(1, 10_000, 0.001, 0.5, 1.0, 1.0)], "w long, iterations long, each_ms double, cv double, tail double, regional double")
    rows = ad.candidates(df, 8).collect()
    assert {r["workers"] for r in rows} == {1, 2, 4, 8}
    two = sorted(r["chunk"] for r in rows if r["workers"] == 2 and r["engine"] == "OneTbb")
    assert two == [25, 50, 100]  # 0.05 ms a chunk, twice as much, and half for uneven work
    assert ad.worker_counts(1) == [] and ad.worker_counts(12) == [2, 4, 8, 12]
