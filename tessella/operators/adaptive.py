"""Performance analytics of workloads: description, similarity, cost, ranking.

Inputs are tables of workloads, one row each, with the columns named beside
each chain; candidates add (engine, strategy, workers, chunk).  All of it is
projection, so it runs where the rows lie.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.formulas import Chain, clamp, doubles, flag, unit, weighted_sum
from tessella.shared import materialize, partitions

#: Cache sizes taken where the hardware does not tell, and limits of the workload description.
L1, L2, L3, PAGE, LINE = 32768, 524288, 33554432, 4096, 64
SMALL, MANY, CHEAP = 1000, 1000000, 100000
LOGICAL, PHYSICAL = 16, 8

#: (iterations, elements, object_size, dims) -> shape of the work against the hardware.
ANALYSIS = Chain(
    ("represented", "CAST(elements AS DOUBLE) * object_size"),
    ("l1_ratio", f"represented / {L1}"),
    ("l2_ratio", f"represented / {L2}"),
    ("l3_ratio", f"represented / {L3}"),
    ("is_small", f"iterations < {SMALL}"),
    ("has_many", f"iterations >= {MANY}"),
    ("large_objects", f"object_size >= {2 * LINE}"),
    ("spans_lines", f"object_size > {LINE}"),
    ("memory_heavy", f"represented >= {L3}"),
    ("per_thread", f"CAST(iterations AS DOUBLE) / {LOGICAL}"),
    ("reuse", "CASE WHEN dims > 1 AND elements > 0 THEN CAST(floor(CAST(iterations AS DOUBLE) / elements) AS BIGINT) ELSE 1 END"),
)

#: (+ external_bytes, hinted) -> pressures on the memory hierarchy.
PRESSURE = Chain(
    ("working_set", "represented + CASE WHEN hinted THEN CAST(external_bytes AS DOUBLE) ELSE 0.0 END"),
    ("l1_pressure", f"greatest(l1_ratio, working_set / {L1})"),
    ("l2_pressure", f"greatest(l2_ratio, working_set / {L2})"),
    ("l3_pressure", f"greatest(l3_ratio, working_set / {L3})"),
    ("page_pressure", f"working_set / {PAGE}"),
    ("cache_pressure", "least(l3_pressure, 1.0)"),
    ("exceeds_l3", "l3_pressure >= 1.0"),
    ("memory_sensitive", "exceeds_l3 OR large_objects"),
)

#: Limits of residence and of access patterns.
RESIDENT = 0.85

#: (+ hints, contiguous/random/stride facts, storage) -> memory behaviour with a confidence.
MEMORY = Chain(
    ("hint_weight", f"CASE WHEN hinted THEN {unit('hint_confidence')} ELSE 0.0 END"),
    ("contiguous_ratio", flag("contiguous_known AND contiguous")),
    ("structural_random", flag("random_known AND random_access")),
    ("random_ratio", f"(1.0 - hint_weight) * structural_random + hint_weight * {unit('randomness')}"),
    ("intensity", f"CASE WHEN hinted THEN {unit('arithmetic')} ELSE 0.0 END"),
    ("parallel_memory", f"CASE WHEN hinted THEN {unit('mlp / 8.0')} ELSE 0.0 END"),
    ("dependency_score", f"CASE WHEN hinted THEN {unit('greatest(dependency_depth, dependent_accesses) / 8.0')} ELSE 0.0 END"),
    ("bytes_each", "CASE WHEN hinted AND bytes_touched > 0 THEN CAST(bytes_touched AS DOUBLE) ELSE represented / iterations END"),
    ("tier", f"CASE WHEN l1_pressure > 0.0 AND l1_pressure <= {RESIDENT} THEN 'L1' WHEN l2_pressure > 0.0 AND l2_pressure <= {RESIDENT} THEN 'L2' WHEN l3_pressure > 0.0 AND l3_pressure <= {RESIDENT} THEN 'L3' WHEN l3_pressure > {RESIDENT} THEN 'Memory' ELSE 'Unknown' END"),
    ("scattered", "random_ratio >= 0.55 OR node_storage"),
    ("sequential", "contiguous_ratio >= 0.70 AND random_ratio < 0.30"),
    (
        "access",
        "CASE WHEN hinted AND dependency_depth + dependent_accesses > 0 AND random_ratio >= 0.45 THEN 'PointerChasing' WHEN scattered AND sequential THEN 'Mixed' WHEN scattered THEN 'Random' "
        "WHEN stride_known AND stride_bytes > 64 THEN 'Strided' WHEN sequential THEN 'Sequential' ELSE 'Unknown' END",
    ),
    ("cache_resident", "tier IN ('L1', 'L2', 'L3')"),
    ("large_record", "large_objects OR bytes_each >= 128.0"),
    ("latency_sensitive", "access IN ('Random', 'PointerChasing') OR dependency_score >= 0.25"),
    ("bandwidth_sensitive", "access = 'Sequential' AND tier = 'Memory' AND intensity <= 0.45"),
    ("reuse_score", f"{unit('0.65 * contiguous_ratio + 0.35 * (1.0 - random_ratio)')} * CASE WHEN cache_resident THEN 1.0 ELSE {unit('1.0 / greatest(1.0, l3_pressure)')} END"),
    (
        "memory_confidence",
        unit(f"0.10 + 0.18 * {flag('contiguous_known')} + 0.18 * {flag('random_known')} + 0.18 + 0.10 * {flag('represented > 0')} + 0.08 * {flag('(stride_known AND stride_bytes > 64) OR node_storage')} + 0.18 * hint_weight"),
    ),
)

#: The weight of each signal for each family of work.
EVIDENCE = {
    "compute": {"hint_weight * arithmetic": 2.4, "hint_weight * vectorization": 0.5, flag("NOT exceeds_l3 AND l3_pressure > 0.0 AND l3_pressure <= 0.50"): 0.35, flag("has_many"): 0.20, "steady": 0.35},
    "streaming": {
        "hint_weight * vectorization * (1.0 - randomness)": 0.8,
        f"hint_weight * {flag('bytes_touched >= 64')}": 0.45,
        flag("spans_lines"): 0.25,
        "contiguous_ratio": 1.2,
        flag("stride_known AND stride_bytes > 0"): 0.6,
        flag("exceeds_l3"): 1.1,
        flag("large_objects"): 0.55,
        flag("has_many"): 0.20,
        "steady": 0.25,
        flag("NOT hinted AND NOT (random_known AND structural_random >= 0.50) AND contiguous_ratio >= 0.75 AND l3_pressure >= 1.0"): 0.60,
    },
    "irregular": {
        "hint_weight * randomness": 2.6,
        "hint_weight * dependency_strength": 1.2,
        f"hint_weight * {flag('external_bytes > 0')}": 0.35,
        flag("node_storage"): 0.9,
        "structural_random": 1.5,
        flag("exceeds_l3"): 0.35,
        "(1.0 - steady) * least(1.2, cv * 1.8)": 1.0,
        "(1.0 - steady) * least(0.8, (greatest(tail, 1.0) - 1.0) * 0.5)": 1.0,
        flag("NOT hinted AND random_known AND structural_random >= 0.50"): 0.50,
    },
    "branch": {"hint_weight * branchiness": 2.5},
    "mixed": {
        f"hint_weight * {flag('(arithmetic >= 0.35 AND randomness >= 0.35) OR (branchiness >= 0.35 AND arithmetic >= 0.35) OR (branchiness >= 0.35 AND randomness >= 0.35)')}": 1.8,
        flag("dims > 1"): 0.30,
        "(1.0 - steady) * least(0.8, (greatest(regional, 1.0) - 1.0) * 0.4)": 1.0,
    },
}
TEMPERATURE, FAMILIES = 1.15, {"compute": "ComputeHeavy", "streaming": "StreamingMemory", "irregular": "IrregularMemory", "branch": "BranchHeavy", "mixed": "Mixed"}
_SCORES = [f"e_{k}" for k in EVIDENCE]
_TOP = f"greatest({', '.join(_SCORES)})"


def _second(names: list[str]) -> str:
    """The second largest: the largest of what remains when one largest is left out."""
    pairs = [f"least({a}, {b})" for i, a in enumerate(names) for b in names[i + 1 :]]
    return f"greatest({', '.join(pairs)})"


#: (+ profile cv, tail, regional) -> family of work: evidence, soft membership, label and confidence.
FAMILY = Chain(
    ("dependency_strength", unit("ln(1.0 + dependent_accesses + dependency_depth) / ln(9.0) / greatest(1.0, sqrt(CASE WHEN mlp > 0 THEN mlp ELSE 1.0 END))")),
    ("steady", flag("cv <= 0.10 AND tail <= 1.20 AND regional <= 1.20")),
    *[(f"e_{k}", weighted_sum(v)) for k, v in EVIDENCE.items()],
    ("e_best", _TOP),
    ("e_second", _second(_SCORES)),
    ("e_total", " + ".join(_SCORES)),
    *[(f"x_{k}", f"exp((e_{k} - e_best) / {TEMPERATURE})") for k in EVIDENCE],
    ("strength", unit("e_best / 2.5")),
    ("known_family", "e_best >= 0.75 AND e_total > 0.0"),
    *[(f"m_{k}", f"CASE WHEN known_family THEN x_{k} / ({' + '.join(f'x_{j}' for j in EVIDENCE)}) * strength ELSE 0.0 END") for k in EVIDENCE],
    ("margin_ratio", "(e_best - e_second) / greatest(1e-9, e_best)"),
    ("family_confidence", f"CASE WHEN known_family THEN {unit('0.35 * e_best / greatest(1e-9, e_total) + 0.35 * margin_ratio + 0.30 * ' + unit('greatest(' + ', '.join(f'm_{k}' for k in EVIDENCE) + ') - ' + _second([f'm_{k}' for k in EVIDENCE])))} ELSE 0.0 END"),
    ("ambiguous", "NOT known_family OR margin_ratio < 0.18 OR family_confidence < 0.35"),
    ("family", "CASE WHEN NOT known_family THEN 'Unknown' WHEN ambiguous THEN 'Mixed' " + " ".join(f"WHEN e_{k} = e_best THEN '{v}'" for k, v in FAMILIES.items()) + " ELSE 'Mixed' END"),
)

#: (baseline_ms, mean_ms, iterations, batches, reliable, cv, tail, regional, setup_ms) -> calibrated work.
PROFILE_COST = Chain(
    ("mean_ratio", clamp("mean_ms / baseline_ms", "0.50", "3.00")),
    ("evidence", "(CASE WHEN reliable THEN 1.0 ELSE 0.35 END) * (CASE WHEN batches < 4 THEN 0.35 WHEN batches < 8 THEN 0.70 ELSE 1.0 END)"),
    ("variation", clamp("cv * 0.30 + greatest(0.0, tail - 1.0) * 0.12 + greatest(0.0, regional - 1.0) * 0.08", "0.0", "0.45")),
    ("mean_weight", clamp("variation * evidence", "0.0", "0.45")),
    ("each_ms", "baseline_ms * (1.0 - mean_weight) + baseline_ms * mean_ratio * mean_weight"),
    ("useful_ms", "greatest(0.0, setup_ms) + each_ms * iterations"),
)

#: Growth exponents by family.
EXPONENT = {"ComputeHeavy": 1.00, "StreamingMemory": 0.94, "IrregularMemory": 1.04, "BranchHeavy": 1.01, "Mixed": 0.99}


def by_family(values: dict[str, float], other: float) -> str:
    return "CASE family " + " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in values.items()) + f" ELSE {float(other)} END"


#: (+ invocations, local_ms, distributed_ms) -> extrapolated work.
SCALING = Chain(
    ("extrapolation", "greatest(1.0, CAST(iterations AS DOUBLE) / greatest(1.0, least(iterations, invocations)))"),
    ("spatial", "local_ms > 0.0 AND distributed_ms > 0.0"),
    ("shape_confidence", "CASE WHEN spatial THEN 0.55 ELSE 0.0 END"),
    ("observed_exponent", f"CASE WHEN spatial THEN 1.0 + 0.06 * log2({clamp('distributed_ms / local_ms', '0.50', '2.00')}) ELSE 1.0 END"),
    ("scaling_confidence", unit(f"(CASE WHEN reliable THEN 1.0 ELSE 0.45 END) * {unit('batches / 12.0')} * (0.35 + 0.40 * {unit('family_confidence')} + 0.25 * shape_confidence)")),
    ("exponent", clamp(f"1.0 + (({by_family(EXPONENT, 1.0)}) * (1.0 - shape_confidence) + observed_exponent * shape_confidence - 1.0) * scaling_confidence", "0.90", "1.08")),
    ("growth", f"CASE WHEN extrapolation <= 1.25 THEN 1.0 ELSE {clamp('pow(extrapolation, exponent - 1.0)', '0.72', '1.35')} END"),
    ("scaled_ms", "useful_ms * growth"),
)

#: Efficiency of the backends.
EFFICIENCY = "CASE engine WHEN 'OneTbb' THEN 0.82 WHEN 'ThreadPool' THEN 0.74 WHEN 'StaticThread' THEN 0.78 ELSE 0.70 END"

#: (candidate columns, overhead_ms) -> the analytical cost of a candidate.
COST = Chain(
    ("parallel", "strategy <> 'Sequential'"),
    ("efficiency", EFFICIENCY),
    ("memory_factor", clamp("(CASE WHEN l3_ratio > 1.0 THEN 1.0 / (1.0 + 0.10 * log2(l3_ratio + 1.0)) ELSE 1.0 END) * (CASE WHEN each_ms > 0.0 AND each_ms < 0.00020 AND l3_ratio >= 0.5 THEN 0.45 ELSE 1.0 END)", "0.18", "1.0")),
    ("span", "greatest(0.0, workers - 1.0)"),
    ("contention", "(1.0 - memory_factor) * 0.10 + CASE WHEN engine = 'StaticThread' THEN 0.018 ELSE 0.010 END"),
    ("speedup", "CASE WHEN parallel THEN greatest(1.0, 1.0 + span * efficiency * memory_factor / (1.0 + contention * span)) ELSE 1.0 END"),
    ("execution_ms", "scaled_ms / speedup"),
    (
        "scheduling_ms",
        "CASE WHEN NOT parallel THEN 0.0 WHEN engine = 'ThreadPool' THEN greatest(0.01, overhead_ms) * 0.35 + workers * 0.0015 WHEN engine = 'StaticThread' THEN greatest(0.01, overhead_ms) + workers * 0.0125 "
        "WHEN engine = 'OneTbb' THEN greatest(0.01, overhead_ms) * 0.45 + log2(workers + 1.0) * 0.004 ELSE greatest(0.01, overhead_ms) END",
    ),
    ("balance", "CASE WHEN strategy = 'DynamicChunks' THEN " + clamp("0.18 + 0.34 / (1.0 + iterations / greatest(1.0, CAST(chunk AS DOUBLE) * workers) / 4.0)", "0.18", "0.48") + " ELSE 1.0 END"),
    ("imbalance_ms", "CASE WHEN parallel THEN execution_ms * " + clamp("(greatest(0.0, cv) * 0.30 + greatest(0.0, tail - 1.0) * 0.10 + greatest(0.0, regional - 1.0) * 0.08) * balance", "0.0", "0.75") + " ELSE 0.0 END"),
    ("total_ms", "execution_ms + imbalance_ms + scheduling_ms"),
)

#: -> factors of family, bandwidth, access pattern and memory on a candidate's execution.
CALIBRATION = Chain(
    ("saturation", f"CASE WHEN l3_ratio <= 1.0 THEN 0.0 ELSE {unit('log2(l3_ratio + 1.0) / 6.0')} END"),
    ("worker_log", unit("log2(workers) / 5.0")),
    (
        "family_raw",
        "CASE family WHEN 'ComputeHeavy' THEN CASE WHEN parallel THEN 1.0 - 0.08 * worker_log - CASE WHEN engine = 'StaticThread' THEN 0.015 ELSE 0.0 END ELSE 1.04 END "
        "WHEN 'StreamingMemory' THEN CASE WHEN parallel THEN 1.0 + saturation * (0.05 + 0.15 * worker_log) + CASE engine WHEN 'StaticThread' THEN 0.04 WHEN 'OneTbb' THEN -0.015 ELSE 0.0 END WHEN iterations >= 50000 THEN 1.06 ELSE 1.0 END "
        "WHEN 'IrregularMemory' THEN 1.0 + CASE WHEN strategy = 'StaticChunks' THEN 0.12 WHEN parallel THEN -0.04 ELSE 0.0 END + CASE WHEN parallel THEN 0.05 * worker_log ELSE 0.0 END "
        "WHEN 'BranchHeavy' THEN CASE strategy WHEN 'DynamicChunks' THEN 0.95 WHEN 'StaticChunks' THEN 1.04 ELSE 1.0 END "
        "WHEN 'Mixed' THEN 1.0 + CASE WHEN strategy = 'StaticChunks' THEN 0.035 ELSE 0.0 END + CASE WHEN parallel THEN 0.02 * saturation * worker_log ELSE 0.0 END ELSE 1.0 END",
    ),
    ("family_factor", clamp(f"1.0 + ({clamp('family_raw', '0.82', '1.25')} - 1.0) * {unit('family_confidence')}", "0.88", "1.18")),
    ("record_strength", unit("log2(greatest(1.0, bytes_each / 64.0)) / 4.0")),
    ("stream_strength", unit(f"0.72 * {unit('log2(greatest(1.0, l3_pressure)) / 5.0')} + 0.28 * record_strength")),
    ("saturation_workers", f"least({LOGICAL}, greatest(2, CAST(ceil({PHYSICAL} * (0.78 - 0.43 * stream_strength)) AS BIGINT)))"),
    ("excess", f"CASE WHEN parallel THEN {unit(f'greatest(0.0, workers - saturation_workers) / greatest(1.0, {LOGICAL} - saturation_workers)')} ELSE 0.0 END"),
    (
        "bandwidth_raw",
        "CASE WHEN family <> 'StreamingMemory' THEN 1.0 WHEN parallel THEN 1.0 + 0.06 * stream_strength + 0.42 * excess * (0.45 + 0.55 * stream_strength) "
        f"+ CASE WHEN large_record THEN 0.08 * record_strength * {clamp(f'workers / {float(PHYSICAL)}', '0.0', '2.0')} ELSE 0.0 END + stream_strength * CASE engine WHEN 'StaticThread' THEN 0.035 WHEN 'OneTbb' THEN -0.015 ELSE 0.0 END "
        "WHEN iterations >= 100000 AND stream_strength < 0.35 THEN 1.0 + 0.035 * (0.35 - stream_strength) ELSE 1.0 END",
    ),
    ("bandwidth_factor", clamp(f"1.0 + ({clamp('bandwidth_raw', '0.96', '1.55')} - 1.0) * {unit('family_confidence')}", "0.97", "1.48")),
    ("worker_pressure", f"workers / {float(PHYSICAL)}"),
    ("regime", "CASE WHEN family NOT IN ('StreamingMemory', 'IrregularMemory') THEN 'None' WHEN random_ratio >= 0.50 OR node_storage OR (hinted AND dependency_depth + dependent_accesses > 0) THEN 'Latency' WHEN l3_pressure > 0.0 AND l3_pressure <= 0.85 AND random_ratio < 0.45 THEN 'Cache' WHEN large_record THEN 'Record' ELSE 'Bandwidth' END"),
    (
        "access_raw",
        f"CASE regime WHEN 'Cache' THEN CASE WHEN parallel AND workers <= {PHYSICAL} THEN 0.99 WHEN NOT parallel THEN 1.01 ELSE 1.0 END WHEN 'Latency' THEN 1.0 + CASE WHEN parallel AND workers > {PHYSICAL} THEN 0.04 * (least(worker_pressure, 2.0) - 1.0) ELSE 0.0 END + CASE WHEN strategy = 'StaticChunks' THEN 0.02 ELSE 0.0 END "
        "WHEN 'Record' THEN CASE WHEN parallel THEN 1.0 + 0.03 * least(worker_pressure, 2.0) ELSE 1.0 END ELSE 1.0 END",
    ),
    ("access_factor", clamp(f"1.0 + ({clamp('access_raw', '0.97', '1.05')} - 1.0) * {unit('family_confidence * memory_confidence')}", "0.97", "1.05")),
    (
        "memory_raw",
        "1.0 + CASE WHEN NOT parallel THEN 0.0 ELSE CASE WHEN bandwidth_sensitive THEN 0.055 * greatest(0.0, worker_pressure - 0.65) + CASE WHEN engine = 'StaticThread' THEN 0.015 ELSE 0.0 END ELSE 0.0 END "
        f"+ CASE WHEN latency_sensitive THEN CASE WHEN workers < {min(4, PHYSICAL)} THEN 0.025 ELSE 0.0 END + CASE strategy WHEN 'StaticChunks' THEN 0.035 WHEN 'DynamicChunks' THEN -0.015 ELSE 0.0 END + 0.045 * greatest(0.0, worker_pressure - 1.0) ELSE 0.0 END "
        "+ CASE WHEN cache_resident AND reuse_score >= 0.65 THEN CASE WHEN strategy = 'StaticChunks' THEN -0.015 ELSE 0.0 END + 0.02 * greatest(0.0, worker_pressure - 1.0) ELSE 0.0 END + CASE WHEN large_record THEN 0.02 * least(1.5, worker_pressure) ELSE 0.0 END END",
    ),
    ("memory_aware_factor", f"CASE WHEN memory_confidence < 0.20 THEN 1.0 ELSE {clamp('1.0 + (' + clamp('memory_raw', '0.96', '1.12') + ' - 1.0) * memory_confidence', '0.97', '1.10')} END"),
    ("calibrated_ms", "execution_ms * family_factor * bandwidth_factor * access_factor * memory_aware_factor"),
)

#: -> speed-up bounded by the serial fraction and by bandwidth, blended in log space.
ANALYTICAL = Chain(
    ("far", "tier = 'Memory' OR exceeds_l3"),
    ("latency", clamp("random_ratio * (0.55 + 0.45 * dependency_score) * CASE WHEN far THEN 1.0 ELSE 0.55 END", "0.0", "0.92")),
    ("bandwidth", clamp("contiguous_ratio * CASE WHEN bandwidth_sensitive THEN 1.0 ELSE 0.55 END * CASE WHEN far THEN 1.0 ELSE 0.45 END", "0.0", "0.90")),
    ("serial", clamp("0.015 + 0.72 * latency + 0.10 * dependency_score", "0.01", "0.92")),
    ("ceiling", f"greatest(1.0, least(1.0 / (serial + (1.0 - serial) / workers) * (1.0 + 0.20 * {unit('parallel_memory / 4.0')}), 1.0 + (workers - 1.0) * (0.78 - 0.58 * bandwidth)))"),
    ("authority", clamp("0.35 + 0.55 * memory_confidence + CASE WHEN far THEN 0.10 ELSE 0.0 END", "0.35", "0.95")),
    ("bounded_speedup", "CASE WHEN parallel AND workers > 1 THEN exp((1.0 - authority) * ln(speedup) + authority * ln(greatest(1.0, least(speedup, ceiling)))) ELSE speedup END"),
)

#: (profile, family, residual, history, similarity confidences and disagreement) -> geometric confidence.
CONFIDENCE_WEIGHTS = {"profile_c": 0.30, "family_c": 0.15, "residual_c": 0.20, "history_c": 0.15, "similarity_c": 0.05, "agreement_c": 0.15}
CONFIDENCE = Chain(
    ("agreement_c", unit("exp(-abs(ranked - analytical) / greatest(1e-9, analytical) / 0.50)")),
    ("confidence", clamp("exp(" + " + ".join(f"{w} * ln(greatest(0.05, {c}))" for c, w in CONFIDENCE_WEIGHTS.items()) + ")", "0.15", "1.0")),
    ("penalty", "1.0 - confidence"),
)

#: (base_ms, avg_ms, workers) -> whether a parallel run pays: work against overhead plus its share.
WORTH = Chain(
    ("work_ms", "avg_ms * iterations"),
    ("parallel_ms", f"1.0 + work_ms / {LOGICAL} * 1.10"),
    ("worth", "work_ms / parallel_ms"),
    ("pays", "worth >= 1.10"),
)

#: (is_small, memory_sensitive, worth, ...) -> scores of the engines and the rules' plan.
RULES = Chain(
    ("scheduling", f"CASE WHEN iterations < {SMALL} THEN 'Sequential' WHEN hinted AND arithmetic > 0.5 THEN 'Dynamic' ELSE 'Static' END"),
    ("locality", "scheduling = 'Static' AND l3_pressure >= 1.0"),
    ("pool_score", "0.2 + CASE scheduling WHEN 'Static' THEN 0.3 WHEN 'Dynamic' THEN 0.4 ELSE 0.0 END + CASE WHEN locality THEN 0.3 ELSE 0.0 END"),
    ("static_score", "CASE scheduling WHEN 'Static' THEN 0.8 WHEN 'Dynamic' THEN 0.3 ELSE 0.0 END + CASE WHEN locality THEN 0.5 ELSE 0.0 END"),
    ("tbb_score", "CASE scheduling WHEN 'Static' THEN 1.4 WHEN 'Dynamic' THEN 2.0 ELSE 0.0 END"),
    ("rule_engine", "CASE WHEN static_score >= tbb_score AND static_score >= pool_score THEN 'StaticThread' WHEN tbb_score >= pool_score THEN 'OneTbb' ELSE 'ThreadPool' END"),
    ("stays", f"NOT pays AND (is_small OR scheduling = 'Sequential' OR (NOT memory_sensitive AND represented <= {L3} AND NOT hinted AND iterations <= {CHEAP}))"),
    ("rule_strategy", "CASE WHEN stays THEN 'Sequential' WHEN rule_engine = 'OneTbb' OR scheduling = 'Dynamic' THEN 'DynamicChunks' ELSE 'StaticChunks' END"),
    ("rule_workers", f"CASE WHEN stays THEN 1 ELSE least({LOGICAL}, iterations) END"),
    ("rule_confidence", "0.75"),
)

#: Residual features are bounded by these scales.
RESIDUAL = [
    "1.0",
    clamp("log2(greatest(1.0, iterations)) / 24.0", "0.0", "1.5"),
    "tanh(ln(1.0 + scaled_ms) / 6.0)",
    "tanh(ln(1.0 + each_ms * 1000000.0) / 8.0)",
    unit("cv / 2.0"),
    unit("(greatest(1.0, tail) - 1.0) / 4.0"),
    unit("(greatest(1.0, regional) - 1.0) / 4.0"),
    clamp("log2(greatest(l3_pressure, 1e-9)) / 4.0", "-1.0", "1.0"),
    "tanh(ln(1.0 + bytes_each) / 6.0)",
    clamp("log2(greatest(1.0, workers)) / 6.0", "0.0", "1.5"),
    clamp(f"workers / {float(PHYSICAL)}", "0.0", "2.0") + " / 2.0",
    clamp(f"workers / {float(LOGICAL)}", "0.0", "1.5") + " / 1.5",
    clamp("log2(greatest(1.0, own_chunk)) / 16.0", "0.0", "1.5"),
    clamp("log2(greatest(1.0, iterations / greatest(1.0, own_chunk * workers))) / 12.0", "0.0", "1.5"),
    flag("strategy = 'DynamicChunks'"),
    flag("strategy = 'StaticChunks'"),
    flag("strategy = 'Sequential'"),
    flag("parallel AND engine = 'ThreadPool'"),
    flag("parallel AND engine = 'StaticThread'"),
    flag("parallel AND engine = 'OneTbb'"),
    "CASE WHEN hinted THEN " + unit("randomness") + " ELSE 0.0 END",
    "CASE WHEN hinted THEN dependency_strength ELSE 0.0 END",
    "CASE WHEN hinted THEN " + unit("arithmetic") + " ELSE 0.0 END",
    "CASE WHEN hinted THEN " + unit("branchiness") + " ELSE 0.0 END",
    "CASE WHEN hinted THEN " + unit("vectorization") + " ELSE 0.0 END",
    unit("scheduling_ms / greatest(1e-9, execution_ms + scheduling_ms)"),
]
FEATURES = Chain(("own_chunk", "CASE WHEN strategy = 'DynamicChunks' THEN greatest(1.0, CAST(chunk AS DOUBLE)) ELSE greatest(1.0, CAST(iterations AS DOUBLE) / workers) END"), *[(f"f{i}", x) for i, x in enumerate(RESIDUAL)])

#: Weights of the similarity terms, kind of bucket and distance scale.
SIMILARITY = {
    "iteration": (0.16, "size", 2.0),
    "working_set": (0.14, "size", 2.0),
    "object": (0.07, "size", 1.5),
    "cost": (0.20, "real", 1.5),
    "variation": (0.09, "real", 2.0),
    "access": (0.12, "equal", 0.15),
    "stride": (0.05, "size", 1.5),
    "cache": (0.07, "real", 1.5),
    "topology": (0.04, "equal", 0.35),
    "profile": (0.06, "equal", 0.25),
}
_LOG2 = {"size": "log2(CAST(greatest({0}, 1) AS DOUBLE))", "real": "(floor({0} / 16.0) - 2048.0 + log2((CAST({0} % 16 AS DOUBLE) + 0.5) / 16.0))"}


def similarity_chain() -> Chain:
    """(a_*, b_* buckets) -> similarity of two fingerprints of one kind.

    A term without evidence on either side drops out; evidence on one side
    counts half and says little.
    """
    steps: list[tuple[str, str]] = []
    for name, (_, kind, scale) in SIMILARITY.items():
        a, b = f"a_{name}", f"b_{name}"
        if kind == "equal":
            steps.append((f"s_{name}", f"CASE WHEN {a} = {b} THEN 1.0 ELSE {scale} END"))
            steps.append((f"v_{name}", f"CASE WHEN {a} <> 0 OR {b} <> 0 THEN 1.0 ELSE 0.0 END"))
            continue
        away = f"abs({_LOG2[kind].format(a)} - {_LOG2[kind].format(b)})"
        steps.append((f"v_{name}", f"CASE WHEN {a} > 0 AND {b} > 0 THEN 1.0 WHEN {a} > 0 OR {b} > 0 THEN 0.50 ELSE 0.0 END"))
        steps.append((f"s_{name}", f"CASE WHEN {a} > 0 AND {b} > 0 THEN exp(-{away} / {scale}) WHEN {a} > 0 OR {b} > 0 THEN 0.20 ELSE 0.0 END"))
    coverage = " + ".join(f"{w} * v_{n}" for n, (w, _, _) in SIMILARITY.items())
    weighted = " + ".join(f"{w} * s_{n} * v_{n}" for n, (w, _, _) in SIMILARITY.items())
    steps += [("coverage", unit(coverage)), ("similarity", f"CASE WHEN coverage <= 0.0 THEN 0.0 ELSE {unit(f'({weighted}) / ({coverage}) * (0.50 + 0.50 * coverage)')} END")]
    return Chain(*steps)


BUCKETS = ["kind", *SIMILARITY]


#: Rows of a cell's side, as far as the number of cells allows, and members of a list.
CELL, LIST = 512, 16


def _side(rows: DataFrame, side: str) -> DataFrame:
    """The rows' columns as ``side``_*, with what each term needs of one side: p_* is 1 with evidence, x_* its logarithm."""
    terms = []
    for name, (_, kind, _) in SIMILARITY.items():
        terms.append(F.expr(f"CASE WHEN {name} {'<>' if kind == 'equal' else '>'} 0 THEN 1e0 ELSE 0e0 END").alias(f"{side}_p_{name}"))
        if kind != "equal":
            terms.append(F.expr(doubles(_LOG2[kind].format(name))).alias(f"{side}_x_{name}"))
    return rows.select(*[F.col(c).alias(f"{side}_{c}") for c in rows.columns], *terms)


def _prepared_chain() -> Chain:
    """``similarity_chain`` on what ``_side`` prepares: the same values, bit by bit."""
    steps: list[tuple[str, str]] = []
    for name, (_, kind, scale) in SIMILARITY.items():
        if kind == "equal":
            steps.append((f"v_{name}", f"greatest(a_p_{name}, b_p_{name})"))
            steps.append((f"s_{name}", f"CASE WHEN a_{name} = b_{name} THEN 1.0 ELSE {scale} END"))
        else:
            steps.append((f"v_{name}", f"(a_p_{name} + b_p_{name}) * 0.5"))
            steps.append((f"s_{name}", f"CASE WHEN v_{name} = 1.0 THEN exp(-abs(a_x_{name} - b_x_{name}) / {scale}) ELSE 0.4 * v_{name} END"))
    return Chain(*steps, *similarity_chain().steps[-2:])


def similar_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a_*, b_*, similarity, coverage) of all pairs of rows of one kind; a row has the buckets and whatever else is wanted.

    Both sides are dealt into blocks, and each pair of blocks is a cell, so that
    a few kinds still make many tasks.  Both tables are read twice.
    """
    rows = max(left.count(), right.count())
    blocks = max(1, min(math.ceil(rows / CELL), max(16, math.isqrt(4 * partitions(left.sparkSession)))))

    def dealt(side: DataFrame, name: str, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64(*side.columns), F.lit(blocks)).cast("int")
        placed = _side(side.withColumn("own", block).where("kind is not null"), name)
        cells = placed.withColumnRenamed(f"{name}_own", f"{name}_{own}").withColumn(f"{name}_{other}", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return cells.repartition(blocks * blocks, *[f"{name}_{c}" for c in ("kind", "i", "j")])

    a, b = dealt(left, "a", "i", "j"), dealt(right, "b", "j", "i")
    met = a.join(b.hint("merge"), (F.col("a_kind") == F.col("b_kind")) & (F.col("a_i") == F.col("b_i")) & (F.col("a_j") == F.col("b_j")))
    return _prepared_chain().apply(met).select(*[f"a_{c}" for c in left.columns], *[f"b_{c}" for c in right.columns], "similarity", "coverage")


def _lists(prints: DataFrame, key: str) -> DataFrame:
    """One row for up to ``LIST`` keys of equal fingerprints."""
    place = F.row_number().over(Window.partitionBy(*BUCKETS).orderBy(key))
    keys = F.collect_list(F.struct(F.col(key).alias("k")))  # as structs, so that a null is kept
    listed = prints.where("kind is not null").withColumn("_part", F.floor((place - 1) / LIST))
    return listed.groupBy(*BUCKETS, "_part").agg(F.transform(keys, lambda x: x["k"]).alias("keys")).drop("_part")


def similar_pairs(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, other, similarity, coverage) of fingerprints of one kind.

    Equal fingerprints are compared once, by lists of their keys, and the pairs
    of two lists are written out from the one result.
    """
    a = materialize(_lists(left, key), "prints")
    b = a if right is left else materialize(_lists(right, key), "prints")
    pairs = similar_rows(a, b).select("a_keys", "b_keys", "similarity", "coverage")
    asked = pairs.select(F.explode("a_keys").alias(key), "b_keys", "similarity", "coverage")
    return asked.select(key, F.explode("b_keys").alias("other"), "similarity", "coverage")


def worker_counts(most: int, least: int = 2) -> list[int]:
    """Doubling from ``least``, and the most itself."""
    out = []
    w = max(2, least)
    while w < most:
        out.append(w)
        w *= 2
    return [*out, most] if most > 1 else []


def chunk_size(iterations: Column, workers: Column, each_ms: Column, target_ms: float = 0.05, most: int = 65536) -> Column:
    """Chunks that run about ``target_ms``, at least eight a worker."""
    wanted = F.when((each_ms > 0) & (target_ms / each_ms > 1.0), F.floor(target_ms / each_ms)).otherwise(F.lit(1))
    balanced = F.greatest(F.lit(1), F.ceil(iterations / (workers * 8)))
    return F.least(F.greatest(F.least(wanted, balanced), F.lit(1)), F.lit(most), iterations).cast("long")


def candidates(df: DataFrame, most_workers: int) -> DataFrame:
    """Every plan of each workload: sequential, dynamic chunks on two engines in up to three sizes, static chunks."""
    counts = worker_counts(most_workers)
    many = df.withColumn("workers", F.explode(F.array(F.lit(1), *[F.lit(w) for w in counts])))
    base = chunk_size(F.col("iterations"), F.col("workers"), F.col("each_ms"))
    uneven = (F.col("cv") > 0.15) | (F.col("tail") > 1.20) | (F.col("regional") > 1.20)
    sizes = many.withColumn("_base", base).withColumn(
        "_sizes",
        F.array_distinct(F.concat(F.array("_base", F.least(F.col("iterations"), F.col("_base") * 2)), F.when(uneven & (F.col("_base") > 1), F.array(F.greatest(F.lit(1), F.floor(F.col("_base") / 2)))).otherwise(F.array().cast("array<bigint>")))),
    )
    plan = lambda e, s, c: F.struct(F.lit(e).alias("engine"), F.lit(s).alias("strategy"), c.cast("long").alias("chunk"))
    dynamic = F.flatten(F.transform("_sizes", lambda c: F.array(plan("ThreadPool", "DynamicChunks", c), plan("OneTbb", "DynamicChunks", c))))
    plans = F.when(F.col("workers") == 1, F.array(plan("ThreadPool", "Sequential", F.lit(0)))).otherwise(F.concat(dynamic, F.array(plan("StaticThread", "StaticChunks", F.lit(0)))))
    return sizes.withColumn("_plan", F.explode(plans)).select(*df.columns, "workers", "_plan.engine", "_plan.strategy", "_plan.chunk")


def choose(df: DataFrame, key: str, cost: str) -> DataFrame:
    """Each workload's cheapest candidate, ties by engine, strategy, workers and chunk."""
    order = F.struct(cost, "engine", "strategy", "workers", "chunk")
    return df.groupBy(key).agg(F.min(order).alias("_b")).select(key, "_b.*")


#: Fixed values of the ranking: shares, samples, scales and margins.
RANK = {
    "history": 0.75, "full_samples": 24.0, "least_samples": 3, "stability": 1.50, "error_scale": 120.0, "regret_soft": 12.0, "disagreement": 25.0,
    "similarity": 0.20, "regret_scale": 0.35, "uncertainty_scale": 0.20, "risk": 0.75, "override_confidence": 0.60, "override_gain": 3.0,
    "negative_weight": 0.10, "success_regret": 3.0, "empirical_samples": 4, "empirical_confidence": 0.55, "empirical_gain": 5.0, "empirical_z": 1.645,
}

#: (predicted_ms, confidence, stddev_ms, and the history columns samples, h_mean, h_sd, h_regret, h_last, h_success, h_weight, h_error) -> rank scores.
RANKING = Chain(
    ("risk_ms", f"predicted_ms + {RANK['risk']} * (stddev_ms + predicted_ms * 0.05 * (1.0 - {unit('confidence')}))"),
    ("best_risk", "min(risk_ms) OVER (PARTITION BY w)"),
    ("analytical", "risk_ms / best_risk"),
    ("h_used", f"samples >= {RANK['least_samples']} AND h_mean > 0.0"),
    ("h_cv", "CASE WHEN h_mean > 0.0 THEN h_sd / h_mean ELSE 1.0 END"),
    ("exact_score", f"1.0 + greatest(0.0, h_regret) / 100.0 + 0.10 * {clamp('h_cv', '0.0', '2.0')}"),
    ("evidence_c", unit(f"1.0 - exp(-h_weight / {RANK['full_samples']} * 3.0)")),
    ("stability_c", unit(f"1.0 / (1.0 + {RANK['stability']} * h_cv)")),
    ("reliability_c", clamp(f"1.0 - h_error / {RANK['error_scale']}", "0.10", "1.0")),
    ("recent_c", f"{unit('exp(-abs(h_last - h_regret) / ' + str(RANK['disagreement']) + ')')} * {unit('exp(-greatest(0.0, h_last - ' + str(RANK['regret_soft']) + ') / ' + str(RANK['regret_soft']) + ')')}"),
    ("exact_raw", clamp(f"{RANK['history']} * evidence_c * stability_c * reliability_c * recent_c", "0.0", str(RANK["history"]))),
    ("exact_weight", f"CASE WHEN NOT h_used THEN 0.0 WHEN h_success < 0.25 AND h_regret > {RANK['success_regret']} THEN greatest(exact_raw, {RANK['negative_weight']}) ELSE exact_raw END"),
    ("ranked", "(1.0 - exact_weight) * analytical + exact_weight * exact_score"),
    ("e_half", f"{RANK['empirical_z']} * h_sd / sqrt(greatest(1.0, CAST(samples AS DOUBLE)))"),
    ("e_low", "greatest(0.0, h_mean - e_half)"),
    ("e_high", "h_mean + e_half"),
    ("e_confidence", f"(1.0 - exp(-CAST(samples AS DOUBLE) / {float(RANK['empirical_samples'])})) * {unit('1.0 / (1.0 + 2.0 * h_cv)')}"),
    ("e_usable", f"samples >= {RANK['empirical_samples']} AND h_mean > 0.0 AND e_confidence >= {RANK['empirical_confidence']}"),
)


def rank(df: DataFrame, key: str = "w", item: str = "plan") -> DataFrame:
    """Scores, and the plan chosen: lowest score, unless measurements clearly speak for another.

    The measured best replaces the ranked best when it gains 5 % or more and
    their intervals do not meet (or it gains 10 % with high confidence).
    """
    scored = RANKING.apply(df)
    per = Window.partitionBy(key)
    first = F.min(F.struct("ranked", item, "h_mean", "e_usable", "e_low")).over(per)
    measured = F.min(F.when(F.col("e_usable"), F.struct("h_mean", item, "e_high", "e_confidence"))).over(per)
    both = scored.withColumn("_first", first).withColumn("_measured", measured)
    gain = (F.col("_first.h_mean") - F.col("_measured.h_mean")) / F.col("_measured.h_mean") * 100
    apart = F.col("_measured.e_high") < F.col("_first.e_low")
    strong = (gain >= 2 * RANK["empirical_gain"]) & (F.col("_measured.e_confidence") >= RANK["empirical_confidence"] + 0.10)
    turned = F.coalesce(F.col("_first.e_usable") & (gain >= RANK["empirical_gain"]) & (apart | strong) & (F.col(f"_measured.{item}") != F.col(f"_first.{item}")), F.lit(False))
    chosen = F.when(turned, F.col(f"_measured.{item}")).otherwise(F.col(f"_first.{item}"))
    return both.withColumn("overridden", turned).withColumn("chosen", chosen).drop("_first", "_measured")


def guard(scored: DataFrame, key: str = "w", item: str = "plan") -> DataFrame:
    """(key, learned, baseline, gain, margin, allowed, chosen): may the ranked best replace the analytical best?

    Only with enough confidence, and with a gain beyond a fixed margin and the
    uncertainty of both predictions.
    """
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("evidence_c") * F.col("stability_c") * F.col("recent_c")))
    best = scored.withColumn("_c", confidence).groupBy(key).agg(
        F.min(F.struct("ranked", item, "stddev_ms", "_c")).alias("l"),
        F.min(F.struct("predicted_ms", item, "ranked", "stddev_ms")).alias("b"),
    )
    gain = F.greatest(F.lit(0.0), (F.col("b.ranked") - F.col("l.ranked")) / F.col("b.ranked") * 100)
    margin = RANK["override_gain"] + F.least(F.lit(25.0), (F.col("b.stddev_ms") + F.col("l.stddev_ms")) / F.greatest(F.lit(1e-9), F.col("b.predicted_ms")) * 100)
    named = best.select(key, F.col(f"l.{item}").alias("learned"), F.col(f"b.{item}").alias("baseline"), gain.alias("gain"), margin.alias("margin"), F.col("l._c").alias("confidence"))
    allowed = (F.col("learned") == F.col("baseline")) | ((F.col("confidence") >= RANK["override_confidence"]) & (F.col("gain") >= F.col("margin")))
    return named.withColumn("allowed", allowed).withColumn("chosen", F.when(F.col("allowed"), F.col("learned")).otherwise(F.col("baseline")))


#: What the runtime model sees of a workload, and the backends and schedules that it tells apart.
CONTEXT_FEATURES = [
    "ln(1.0 + greatest(0.0, CAST(iterations AS DOUBLE)))",
    flag("profiled"),
    "ln(1.0 + greatest(0.0, CASE WHEN profiled THEN median_ms ELSE 0.0 END) * 1000000.0)",
    "CASE WHEN profiled THEN cv ELSE 0.0 END",
    "CASE WHEN profiled THEN tail ELSE 0.0 END",
    "CASE WHEN profiled THEN worthiness ELSE 0.0 END",
    "CASE WHEN profiled THEN regional ELSE 0.0 END",
    flag("hinted"),
    "CAST(arithmetic AS DOUBLE)",
    "CAST(branchiness AS DOUBLE)",
    "CAST(randomness AS DOUBLE)",
    "CAST(vectorization AS DOUBLE)",
    "CAST(dependency_depth AS DOUBLE)",
    "ln(1.0 + greatest(0.0, CAST(bytes_touched AS DOUBLE)))",
    "ln(1.0 + CAST(external_bytes AS DOUBLE))",
    "CAST(hint_confidence AS DOUBLE)",
]
PLAN_FEATURES = ["ln(1.0 + jobs)", "ln(1.0 + chunk)", "ln(1.0 + greatest(1.0, CAST(iterations AS DOUBLE)) / jobs)", "ln(1.0 + greatest(1.0, CAST(iterations AS DOUBLE)) / chunk)"]
BACKENDS = ("Sequential", "ThreadPool", "oneTBB", "OpenMP")
SCHEDULES = ("Sequential", "DynamicChunks", "StaticChunks", "Guided")


def runtime_features() -> Chain:
    """Features r0, r1, ... of a workload and a plan (backend, schedule, jobs, chunk): 28 of their own, then each backend's flag times each of the 16 of the workload."""
    flags = [flag(f"backend = '{b}'") for b in BACKENDS]
    own = [*CONTEXT_FEATURES, *PLAN_FEATURES, *flags, *(flag(f"schedule = '{s}'") for s in SCHEDULES)]
    first = len(CONTEXT_FEATURES) + len(PLAN_FEATURES)
    crossed = [f"r{first + b} * r{k}" for b in range(len(BACKENDS)) for k in range(len(CONTEXT_FEATURES))]
    return Chain(*[(f"r{k}", x) for k, x in enumerate([*own, *crossed])])


RUNTIME_FEATURES = 28 + 64


def utility(features: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(features, weights, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)


def standardize(raw: Column, means: Column, scales: Column) -> Column:
    """1, then each feature less its mean over its scale, cut at 4 to either side."""
    scaled = F.zip_with(F.zip_with(raw, means, lambda x, m: x - m), scales, lambda x, s: F.greatest(F.lit(-4.0), F.least(F.lit(4.0), x / s)))
    return F.concat(F.array(F.lit(1.0)), scaled)


def margin_confidence(best: Column, second: Column) -> Column:
    return 1.0 - F.exp(-F.greatest(F.lit(0.0), second - best))


def prefer_history(history: Column, threshold: float = 0.8, analytical: float = 0.75) -> Column:
    """Where a decision comes from: measured history counts from the threshold on, and then against the rules' confidence."""
    return F.when(F.coalesce((history >= threshold) & (history >= analytical), F.lit(False)), "Historical").otherwise("Analytical")


def smoothstep(low: float, high: float, x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))
    return t * t * (3.0 - 2.0 * t)


def geometric_blend(a: Column, b: Column, t: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.exp((1.0 - t) * F.log(F.greatest(F.lit(1e-6), a)) + t * F.log(F.greatest(F.lit(1e-6), b)))


def curve_speedup(asked: DataFrame, curve: DataFrame, key: str) -> DataFrame:
    """Speed-up read off measured curves.

    ``asked`` (key, engine, workers, iterations, each_ms, streaming); ``curve``
    (engine, points, small, large, compute, stream).  The nearest worker count
    answers, the lower one at a tie.
    """
    near = asked.join(curve, "engine").withColumn("_d", F.struct(F.abs(F.col("points") - F.col("workers")), "points"))
    point = F.min(F.struct("_d", "small", "large", "compute", "stream")).over(Window.partitionBy(key))
    one = near.withColumn("_p", point).where(F.col("_p._d") == F.col("_d"))
    size = smoothstep(16.0, 20.0, F.log2(F.greatest(F.lit(1), F.col("iterations"))))
    cheap = geometric_blend(F.col("small"), F.col("large"), size)
    cost = smoothstep(-3.643856189774724, 1.0, F.log2(F.greatest(F.lit(1e-6), F.col("each_ms") * 1000)))
    speed = geometric_blend(geometric_blend(cheap, F.col("compute"), cost), F.col("stream"), F.col("streaming"))
    return one.select(key, "engine", "workers", F.least(F.greatest(F.lit(1.0), speed), F.greatest(F.lit(1.0), F.col("workers") * 1.25)).alias("speedup"))
