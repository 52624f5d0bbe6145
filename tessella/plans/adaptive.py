"""Queries of performance analytics.

``user_id`` names a workload.  Its timings are ``events.value``; shape and
hints are made from the number by fixed rules, so that every branch occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.formulas import Chain, doubles
from tessella.operators import adaptive as ad
from tessella.operators import joins
from tessella.plans.registry import events, query, table
from tessella.plans.statistics import micro, micro_sql

#: One row a workload; sums of whole cents keep both engines exact.
WORKLOADS = doubles("""SELECT user_id AS w, count(*) AS n, CAST(sum(c) AS BIGINT) AS s, CAST(sum(c * c) AS DOUBLE) AS s2, PCT(c, 0.5) AS p50, PCT(c, 0.95) AS p95
  FROM (SELECT user_id, CAST(floor(value * 100.0 + 0.5) AS BIGINT) AS c FROM events) AS cents GROUP BY user_id""")

DESCRIBED = Chain(
    ("iterations", "1000 * (w % 50 + 1) * (1 + w % 7) * CASE WHEN w % 9 = 0 THEN 40 WHEN w % 9 = 1 THEN 0 ELSE 1 END + 7"),
    ("elements", "iterations"),
    ("object_size", "CAST(pow(2, 3 + w % 6) AS BIGINT)"),
    ("dims", "1 + w % 2"),
    ("contiguous_known", "w % 5 <> 0"),
    ("contiguous", "w % 3 <> 0"),
    ("random_known", "w % 2 = 0"),
    ("random_access", "w % 4 = 0"),
    ("stride_known", "w % 6 = 0"),
    ("stride_bytes", "64 * (w % 5)"),
    ("node_storage", "w % 17 = 3"),
    ("hinted", "w % 3 = 1"),
    ("arithmetic", "(w % 10) / 10.0"),
    ("branchiness", "(w % 7) / 7.0"),
    ("randomness", "(w % 11) / 11.0"),
    ("vectorization", "(w % 5) / 5.0"),
    ("dependency_depth", "w % 4"),
    ("dependent_accesses", "w % 3"),
    ("mlp", "1.0 + w % 8"),
    ("hint_confidence", "0.5 + (w % 6) / 12.0"),
    ("bytes_touched", "16 * (w % 12)"),
    ("external_bytes", "CASE WHEN w % 8 = 0 THEN 1048576 * (w % 64) ELSE 0 END"),
    ("mean_ms", "s / 100000.0 / n"),
    ("baseline_ms", "p50 / 100000.0"),
    ("avg_ms", "mean_ms"),
    ("cv", "sqrt(greatest(0.0, (s2 - CAST(s AS DOUBLE) * s / n) / (n - 1))) / (CAST(s AS DOUBLE) / n) * (w % 5) / 4.0"),
    ("tail", "1.0 + (p95 / p50 - 1.0) * (w % 3) / 2.0"),
    ("regional", "1.0 + (w % 5) / 10.0"),
    ("batches", "n % 20"),
    ("reliable", "w % 4 <> 1"),
    ("setup_ms", "(w % 3) / 10.0"),
    ("invocations", "10 * n"),
    ("local_ms", "CASE WHEN w % 2 = 0 THEN baseline_ms ELSE 0.0 END"),
    ("distributed_ms", "baseline_ms * (1.0 + (w % 9) / 10.0)"),
    ("overhead_ms", "1.0"),
)

_SPARK = WORKLOADS.replace("PCT(", "percentile(")
_DUCK = f"({WORKLOADS.replace('PCT(', 'quantile_cont(')})"


def workloads(spark: SparkSession, d: str, *chains: Chain) -> DataFrame:
    found = spark.sql(_SPARK.replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))
    for c in (DESCRIBED, *chains):
        found = c.apply(found)
    return found


def workloads_sql(*chains: Chain) -> str:
    source = _DUCK
    for c in (DESCRIBED, *chains):
        source = c.sql(source)
    return source


def _rows(spark: SparkSession, d: str, chains: tuple[Chain, ...], plain: list[str], real: list[str]) -> DataFrame:
    return workloads(spark, d, *chains).select("w", *plain, *[micro(c) for c in real])


def _rows_sql(chains: tuple[Chain, ...], plain: list[str], real: list[str]) -> str:
    return f"SELECT w, {', '.join([*plain, *[micro_sql(c, c) for c in real]])} FROM {workloads_sql(*chains)}"


def _register(name: str, chains: tuple[Chain, ...], plain: list[str], real: list[str]) -> None:
    query(name, _rows_sql(chains, plain, real))(lambda spark, d: _rows(spark, d, chains, plain, real))


SHAPE = (ad.ANALYSIS, ad.PRESSURE)
DESCRIPTION = (*SHAPE, ad.MEMORY, ad.FAMILY)
WORK = (*DESCRIPTION, ad.PROFILE_COST, ad.SCALING)
_register("workload_analysis", (ad.ANALYSIS,), ["is_small", "has_many", "large_objects", "memory_heavy", "reuse"], ["l1_ratio", "l2_ratio", "l3_ratio", "per_thread"])
_register("performance_model", SHAPE, ["exceeds_l3", "memory_sensitive"], ["l1_pressure", "l2_pressure", "l3_pressure", "page_pressure", "cache_pressure"])
_register("memory_features", (*SHAPE, ad.MEMORY), ["tier", "access", "latency_sensitive", "bandwidth_sensitive", "large_record"], ["contiguous_ratio", "random_ratio", "reuse_score", "memory_confidence"])
_register("workload_family", DESCRIPTION, ["family", "ambiguous"], ["family_confidence", *[f"m_{k}" for k in ad.EVIDENCE]])
_register("profile_cost", (ad.PROFILE_COST,), [], ["mean_weight", "each_ms", "useful_ms"])
_register("runtime_scaling", WORK, [], ["extrapolation", "scaling_confidence", "exponent", "growth", "scaled_ms"])
_register("pilot_worth", (ad.WORTH,), ["pays"], ["work_ms", "parallel_ms", "worth"])
_register("decision_rules", (*SHAPE, ad.WORTH, ad.RULES), ["scheduling", "rule_engine", "rule_strategy", "rule_workers"], ["pool_score", "static_score", "tbb_score", "rule_confidence"])

_PLANS = "(VALUES ('ThreadPool', 'Sequential', 1, 0), ('ThreadPool', 'DynamicChunks', 4, 64), ('OneTbb', 'DynamicChunks', 8, 256), ('StaticThread', 'StaticChunks', 16, 0), ('OneTbb', 'DynamicChunks', 16, 16)) AS plans(engine, strategy, workers, chunk)"
PLAN_ROWS = [("ThreadPool", "Sequential", 1, 0), ("ThreadPool", "DynamicChunks", 4, 64), ("OneTbb", "DynamicChunks", 8, 256), ("StaticThread", "StaticChunks", 16, 0), ("OneTbb", "DynamicChunks", 16, 16)]


def planned(spark: SparkSession, d: str, *chains: Chain) -> DataFrame:
    """Every workload with a fixed list of five plans."""
    plans = spark.createDataFrame(PLAN_ROWS, "engine string, strategy string, workers int, chunk int")
    found = workloads(spark, d, *WORK).join(F.broadcast(plans))
    for c in (ad.COST, *chains):
        found = c.apply(found)
    return found


def planned_sql(*chains: Chain) -> str:
    source = f"(SELECT * FROM {workloads_sql(*WORK)} AS base, {_PLANS})"
    for c in (ad.COST, *chains):
        source = c.sql(source)
    return source


def _register_plans(name: str, chains: tuple[Chain, ...], plain: list[str], real: list[str]) -> None:
    keys = ["w", "engine", "strategy", "workers", "chunk"]
    text = f"SELECT {', '.join([*keys, *plain, *[micro_sql(c, c) for c in real]])} FROM {planned_sql(*chains)}"
    query(name, text)(lambda spark, d: planned(spark, d, *chains).select(*keys, *plain, *[micro(c) for c in real]))


_register_plans("candidate_cost", (), [], ["speedup", "execution_ms", "scheduling_ms", "imbalance_ms", "total_ms"])
_register_plans("calibrations", (ad.CALIBRATION,), ["regime", "saturation_workers"], ["family_factor", "bandwidth_factor", "access_factor", "memory_aware_factor", "calibrated_ms"])
_register_plans("analytical_runtime", (ad.ANALYTICAL,), [], ["serial", "ceiling", "authority", "bounded_speedup"])
_register_plans("residual_features", (ad.FEATURES,), [], [f"f{i}" for i in range(len(ad.RESIDUAL))])


@query("candidate_enumeration", f"""WITH base AS (SELECT * FROM {workloads_sql(ad.PROFILE_COST)} AS b), m AS (SELECT *, workers FROM base, (VALUES (1), (2), (4), (8), (16)) AS t(workers)),
s AS (SELECT *, least(greatest(least(CASE WHEN each_ms > 0 AND 0.05::DOUBLE / each_ms > 1 THEN CAST(floor(0.05::DOUBLE / each_ms) AS BIGINT) ELSE 1 END, greatest(1, CAST(ceil(iterations::DOUBLE / (workers * 8)) AS BIGINT))), 1), 65536, iterations) AS c FROM m),
d AS (SELECT w, workers, unnest(list_distinct([c, least(iterations, c * 2), CASE WHEN (cv > 0.15 OR tail > 1.20 OR regional > 1.20) AND c > 1 THEN greatest(1, c // 2) ELSE c END])) AS chunk FROM s WHERE workers > 1)
SELECT w, 1 AS workers, 'ThreadPool' AS engine, 'Sequential' AS strategy, 0::BIGINT AS chunk FROM base UNION ALL SELECT w, workers, e, 'DynamicChunks', chunk FROM d, (VALUES ('ThreadPool'), ('OneTbb')) AS t(e) UNION ALL SELECT w, workers, 'StaticThread', 'StaticChunks', 0 FROM m WHERE workers > 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ad.candidates(workloads(spark, d, ad.PROFILE_COST), 16).select("w", "workers", "engine", "strategy", "chunk")


_BEST = ["w", "engine", "strategy", "workers", "chunk"]


@query("plan_choice", f"SELECT * EXCLUDE (k) FROM (SELECT {', '.join(_BEST)}, {micro_sql('total_ms', 'total_ms')}, row_number() OVER (PARTITION BY w ORDER BY total_ms, engine, strategy, workers, chunk) AS k FROM {planned_sql()}) WHERE k = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ad.choose(planned(spark, d), "w", "total_ms").select(*_BEST, micro("total_ms"))


#: Buckets that stand for a workload's fingerprint.
FINGERPRINT = Chain(
    ("kind", "w % 3"),
    ("iteration", "CAST(pow(2.0, ceil(log2(CAST(iterations AS DOUBLE)))) AS BIGINT)"),
    ("working_set_b", "CAST(pow(2.0, ceil(log2(represented))) AS BIGINT)"),
    ("object", "object_size"),
    ("cost", "CASE WHEN w % 13 = 0 THEN 0 ELSE CAST((floor(log2(p50)) + 1.0 + 2048.0) * 16.0 + floor(p50 / pow(2.0, floor(log2(p50)) + 1.0) * 16.0) AS BIGINT) END"),
    ("variation_b", "(2049 + w % 3) * 16 + 8 + w % 8"),
    ("access_b", "w % 4"),
    ("stride", "CASE WHEN stride_known THEN stride_bytes ELSE 0 END"),
    ("cache", "(2049 + w % 5) * 16 + 8 + w % 7"),
    ("topology", "1 + w % 2"),
    ("profile", "w % 3"),
)
_NAMES = {"working_set": "working_set_b", "variation": "variation_b", "access": "access_b"}


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    rows = workloads(spark, d, ad.ANALYSIS, FINGERPRINT)
    return rows.select("w", *[F.col(_NAMES.get(b, b)).alias(b) for b in ad.BUCKETS])


def _prints_sql() -> str:
    return f"(SELECT w, {', '.join(f'{_NAMES.get(b, b)} AS {b}' for b in ad.BUCKETS)} FROM {workloads_sql(ad.ANALYSIS, FINGERPRINT)})"


def _pairs_sql() -> str:
    left = ", ".join(f"a.{b} AS a_{b}, o.{b} AS b_{b}" for b in ad.BUCKETS)
    pairs = f"(SELECT a.w, o.w AS other, {left} FROM {_prints_sql()} AS a JOIN {_prints_sql()} AS o ON a.kind = o.kind)"
    return ad.similarity_chain().sql(pairs)


@query("fingerprint_build", f"SELECT * FROM {_prints_sql()}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return fingerprints(spark, d)


@query("fingerprint_similarity", f"SELECT w, other, {micro_sql('similarity', 'similarity')}, {micro_sql('coverage', 'coverage')} FROM {_pairs_sql()}")
def _(spark: SparkSession, d: str) -> DataFrame:
    prints = fingerprints(spark, d)
    return ad.similar_pairs(prints, prints, "w").select("w", "other", micro("similarity"), micro("coverage"))


#: Outcomes of a workload's plan in the order of events, against the best of its round; a timing that is not positive is none.
_OUTCOMES = "SELECT user_id AS w, event_type AS plan, event_id AS idx, value AS ms, (value / min(value) OVER (PARTITION BY user_id, event_id // 1000) - 1) * 100 AS regret FROM events WHERE value > 0"


def outcomes(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    best = F.min("ms").over(Window.partitionBy("w", F.expr("idx div 1000")))
    rows = events(spark, d).where("value > 0").select(F.col("user_id").alias("w"), F.col("event_type").alias("plan"), "idx", F.col("value").alias("ms"))
    return rows.withColumn("regret", (F.col("ms") / best - 1) * 100)


_FOLD = "lambda a, x: {m: (a.m * (a.w * 0.97) + x.m) / (a.w * 0.97 + 1.0), r: (a.r * (a.w * 0.97) + x.r) / (a.w * 0.97 + 1.0), s: (a.s * (a.w * 0.97) + x.s) / (a.w * 0.97 + 1.0), w: a.w * 0.97 + 1.0}"
_HISTORY = f"""SELECT w, plan, n AS samples, mean, sd, last, f.m AS h_mean, f.r AS h_regret, f.s AS h_success, f.w AS h_weight, least(f.w / 20.0, 1.0) * least(greatest(1 - sd / mean, 0), 1) * least(greatest(0.25 + 0.75 * f.s, 0), 1) AS confidence FROM (
  SELECT w, plan, count(*) AS n, avg(ms) AS mean, stddev_pop(ms) AS sd, max_by(regret, idx) AS last, list_reduce(list({{m: ms, r: regret, s: CASE WHEN regret <= 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, w: 1.0::DOUBLE}} ORDER BY idx), {_FOLD}) AS f FROM ({_OUTCOMES}) GROUP BY w, plan)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """Experience by workload and plan: moments, decayed means and confidence."""
    rows = outcomes(spark, d).withColumn("ok", F.when(F.col("regret") <= 3, 1.0).otherwise(0.0))
    kind = "struct<m:double,r:double,s:double,w:double>"
    grouped = rows.groupBy("w", "plan").agg(
        F.count("*").alias("samples"), F.avg("ms").alias("mean"), F.stddev_pop("ms").alias("sd"), F.max_by("regret", "idx").alias("last"), F.sort_array(F.collect_list(F.struct("idx", "ms", "regret", "ok"))).alias("xs")
    )

    def step(a, x):
        old = a["w"] * 0.97
        mixed = lambda c, v: ((a[c] * old + v) / (old + 1.0)).alias(c)
        return F.struct(mixed("m", x["ms"]), mixed("r", x["regret"]), mixed("s", x["ok"]), (old + 1.0).alias("w")).cast(kind)

    first = F.get("xs", 0)
    start = F.struct(first["ms"].alias("m"), first["regret"].alias("r"), first["ok"].alias("s"), F.lit(1.0).alias("w")).cast(kind)
    folded = grouped.withColumn("f", F.aggregate(F.slice("xs", 2, F.size("xs")), start, step))
    bound = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    confidence = bound(F.col("f.w") / 20.0) * bound(1 - F.col("sd") / F.col("mean")) * bound(0.25 + 0.75 * F.col("f.s"))
    return folded.select("w", "plan", "samples", "mean", "sd", "last", F.col("f.m").alias("h_mean"), F.col("f.r").alias("h_regret"), F.col("f.s").alias("h_success"), F.col("f.w").alias("h_weight"), confidence.alias("confidence"))


@query("record_outcomes", f"SELECT w, plan, samples, {', '.join(micro_sql(c, c) for c in ('mean', 'sd', 'h_mean', 'h_regret', 'h_success', 'h_weight', 'confidence'))} FROM ({_HISTORY})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("w", "plan", "samples", *[micro(c) for c in ("mean", "sd", "h_mean", "h_regret", "h_success", "h_weight", "confidence")])


_ENTRIES = f"SELECT w AS other, h_mean AS elapsed_ms, h_regret AS regret_percent, h_success AS success_rate, confidence, h_weight AS sample_weight, samples FROM ({_HISTORY}) WHERE plan = 'click'"


@query("neighbor_weighted", f"""WITH e AS ({_ENTRIES}), p AS (SELECT w, other, similarity FROM {_pairs_sql()} WHERE similarity >= 0.55 AND w <> other), u AS (SELECT p.w, p.similarity, e.*, similarity * similarity * greatest(0.01, confidence) * greatest(1.0, sample_weight) AS k FROM p JOIN e USING (other))
SELECT w, count(*) AS entries, {', '.join(micro_sql(f'sum({c} * k) / sum(k)', c) for c in ('elapsed_ms', 'regret_percent', 'success_rate', 'confidence', 'similarity'))} FROM u GROUP BY w""")
def _(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d).where("plan = 'click'")
    entries = h.select(F.col("w").alias("other"), F.col("h_mean").alias("elapsed_ms"), F.col("h_regret").alias("regret_percent"), F.col("h_success").alias("success_rate"), "confidence", F.col("h_weight").alias("sample_weight"), "samples")
    found = joins.weighted_neighbors(fingerprints(spark, d), entries, "w")
    return found.select("w", "entries", *[micro(c) for c in ("elapsed_ms", "regret_percent", "success_rate", "confidence", "similarity")])


@query("decision_source", f"SELECT w, plan, CASE WHEN confidence * 2 >= 0.8 THEN 'Historical' ELSE 'Analytical' END AS source FROM ({_HISTORY})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return history(spark, d).select("w", "plan", ad.prefer_history(F.col("confidence") * 2).alias("source"))


_RANKED = f"(SELECT w, plan, samples, mean * (1.0 + (length(plan) % 3) / 10.0) AS predicted_ms, confidence, sd / 10 AS stddev_ms, h_mean, sd AS h_sd, h_regret, last AS h_last, h_success, h_weight, 20.0 AS h_error FROM ({_HISTORY}))"


@query("candidate_ranking", f"""WITH r AS (SELECT * FROM {ad.RANKING.sql(doubles(_RANKED))}), f AS (SELECT w, min({{a: ranked, b: plan, c: h_mean, d: e_usable, e: e_low}}) AS f, min({{a: h_mean, b: plan, c: e_high, d: e_confidence}}) FILTER (WHERE e_usable) AS m FROM r GROUP BY w),
g AS (SELECT w, f, m, (f.c - m.a) / m.a * 100 AS gain FROM f), t AS (SELECT w, coalesce(f.d AND gain >= 5 AND (m.c < f.e OR (gain >= 10 AND m.d >= 0.65)) AND m.b <> f.b, false) AS overridden, f, m FROM g)
SELECT r.w, r.plan, {', '.join(micro_sql(c, c) for c in ('analytical', 'exact_weight', 'ranked', 'e_confidence'))}, overridden, CASE WHEN overridden THEN m.b ELSE f.b END AS chosen FROM r JOIN t USING (w)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    return ad.rank(_ranked(spark, d)).select("w", "plan", *[micro(c) for c in ("analytical", "exact_weight", "ranked", "e_confidence")], "overridden", "chosen")


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    h = history(spark, d)
    return h.select("w", "plan", "samples", (F.col("mean") * (1.0 + (F.length("plan") % 3) / 10.0)).alias("predicted_ms"), "confidence", (F.col("sd") / 10).alias("stddev_ms"), "h_mean", F.col("sd").alias("h_sd"), "h_regret", F.col("last").alias("h_last"), "h_success", "h_weight", F.lit(20.0).alias("h_error"))


@query("override_guard", f"""WITH r AS (SELECT *, least(1.0, greatest(0.0, evidence_c * stability_c * recent_c)) AS c FROM {ad.RANKING.sql(doubles(_RANKED))}),
b AS (SELECT w, min({{a: ranked, b: plan, c: stddev_ms, d: c}}) AS l, min({{a: predicted_ms, b: plan, c: ranked, d: stddev_ms}}) AS s FROM r GROUP BY w),
g AS (SELECT w, l.b AS learned, s.b AS baseline, greatest(0, (s.c - l.a) / s.c * 100) AS gain, 3.0 + least(25.0, (s.d + l.c) / greatest(1e-9, s.a) * 100) AS margin, l.d AS c FROM b)
SELECT w, learned, baseline, {micro_sql('gain', 'gain')}, {micro_sql('margin', 'margin')}, learned = baseline OR (c >= 0.60 AND gain >= margin) AS allowed, CASE WHEN learned = baseline OR (c >= 0.60 AND gain >= margin) THEN learned ELSE baseline END AS chosen FROM g""")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = ad.guard(ad.RANKING.apply(_ranked(spark, d)))
    return found.select("w", "learned", "baseline", micro("gain"), micro("margin"), "allowed", "chosen")


_CONFIDENT = doubles("(SELECT user_id AS w, 0.05 + (user_id % 10) / 10.0 AS profile_c, (user_id % 7) / 7.0 AS family_c, 0.5 AS residual_c, (user_id % 5) / 5.0 AS history_c, 0.6 AS similarity_c, 1.0 + (user_id % 4) / 10.0 AS ranked, 1.0 + (user_id % 3) / 10.0 AS analytical FROM (SELECT DISTINCT user_id FROM events) AS u)")


@query("confidence_geo", f"SELECT w, {micro_sql('agreement_c', 'agreement_c')}, {micro_sql('confidence', 'confidence')}, {micro_sql('penalty', 'penalty')} FROM {ad.CONFIDENCE.sql(_CONFIDENT)}")
def _(spark: SparkSession, d: str) -> DataFrame:
    base = spark.sql("SELECT * FROM " + _CONFIDENT.replace("FROM events", "FROM {e}"), e=table(spark, d, "events"))
    return ad.CONFIDENCE.apply(base).select("w", micro("agreement_c"), micro("confidence"), micro("penalty"))


_FACTOR = "exp(ln(least(greatest(h_mean / mean, 0.70), 1.40)) * least(greatest(confidence, 0), 0.65))"


@query("residual_correction", f"SELECT w, plan, {micro_sql(_FACTOR, 'factor')}, {micro_sql(f'mean * {_FACTOR}', 'corrected_ms')} FROM ({_HISTORY})")
def _(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.least(F.greatest(F.col("h_mean") / F.col("mean"), F.lit(0.70)), F.lit(1.40))
    factor = F.exp(F.log(ratio) * F.least(F.greatest(F.col("confidence"), F.lit(0.0)), F.lit(0.65)))
    return history(spark, d).select("w", "plan", factor.alias("factor"), (F.col("mean") * factor).alias("corrected_ms")).select("w", "plan", micro("factor"), micro("corrected_ms"))


_CURVE = [("ThreadPool", 2, 1.4, 1.6, 1.9, 1.3), ("ThreadPool", 8, 3.0, 5.0, 7.5, 2.5), ("OneTbb", 2, 1.3, 1.7, 1.95, 1.4), ("OneTbb", 16, 4.0, 9.0, 14.0, 3.0)]
_CURVE_SQL = "(VALUES " + ", ".join(f"('{e}', {p}, {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {s}::DOUBLE)" for e, p, a, b, c, s in _CURVE) + ") AS curve(engine, points, small, large, compute, stream)"


def _smooth(low: str, high: str, x: str) -> str:
    t = f"least(greatest(({x} - {low}) / ({high} - {low}), 0), 1)"
    return f"({t} * {t} * (3 - 2 * {t}))"


def _blend(a: str, b: str, t: str) -> str:
    return f"exp((1 - {t}) * ln(greatest(1e-6, {a})) + {t} * ln(greatest(1e-6, {b})))"


@query("machine_curves", f"""WITH a AS (SELECT w, engine, workers, iterations, each_ms, (w % 5) / 4.0::DOUBLE AS streaming FROM {workloads_sql(ad.PROFILE_COST)} AS b, (VALUES ('ThreadPool', 4), ('OneTbb', 12)) AS t(engine, workers)),
n AS (SELECT a.*, curve.* EXCLUDE (engine), row_number() OVER (PARTITION BY w, a.engine ORDER BY abs(points - workers), points) AS k FROM a JOIN {_CURVE_SQL} ON a.engine = curve.engine)
SELECT w, engine, workers, {micro_sql('least(greatest(1.0, ' + _blend(_blend(_blend('small', 'large', _smooth('16.0', '20.0', 'log2(iterations)')), 'compute', _smooth('-3.643856189774724::DOUBLE', '1.0', 'log2(greatest(1e-6, each_ms * 1000))')), 'stream', 'streaming') + '), greatest(1.0, workers * 1.25))', 'speedup')} FROM n WHERE k = 1""")
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.createDataFrame([("ThreadPool", 4), ("OneTbb", 12)], "engine string, workers int")
    rows = workloads(spark, d, ad.PROFILE_COST).join(F.broadcast(asked)).select(F.struct("w", "engine").alias("k"), "engine", "workers", "iterations", "each_ms", ((F.col("w") % 5) / 4.0).alias("streaming"))
    curve = spark.createDataFrame(_CURVE, "engine string, points int, small double, large double, compute double, stream double")
    return ad.curve_speedup(rows, curve, "k").select(F.col("k.w").alias("w"), "engine", "workers", micro("speedup"))


#: A utility model over all features of the runtime: weights of one and of each standardized feature.
_MEANS = [(k % 5) / 2.0 for k in range(ad.RUNTIME_FEATURES)]
_SCALES = [1.0 + k % 3 for k in range(ad.RUNTIME_FEATURES)]
_WEIGHTS = [0.1, *((k * 37 % 23 - 11) / 64.0 for k in range(ad.RUNTIME_FEATURES))]

_CONTEXT = Chain(("profiled", "w % 5 <> 4"), ("median_ms", "baseline_ms / 100.0"), ("worthiness", "(w % 9) / 9.0"))
#: The analytical plan, the sequential one and the pool's and the other pool's; the last two only where there is something to share.
_PLANS = Chain(
    ("backend", "CASE WHEN k = 1 THEN 'Sequential' WHEN k = 3 THEN 'oneTBB' ELSE 'ThreadPool' END"),
    ("schedule", "CASE WHEN k = 1 THEN 'Sequential' WHEN k = 0 AND w % 2 = 0 THEN 'StaticChunks' ELSE 'DynamicChunks' END"),
    ("jobs", "CASE WHEN k = 1 THEN 1.0 WHEN k = 0 THEN 1.0 + w % 8 ELSE greatest(2.0, 1.0 + w % 8) END"),
    ("chunk", "greatest(1.0, floor(CAST(iterations AS DOUBLE) / 64.0))"),
)
_RUNTIME = _CONTEXT + _PLANS + ad.runtime_features()


def _score_sql() -> str:
    terms = [f"{_WEIGHTS[0]}::DOUBLE", *(f"({_WEIGHTS[k + 1]}::DOUBLE) * greatest(-4.0::DOUBLE, least(4.0::DOUBLE, (r{k} - {_MEANS[k]}::DOUBLE) / {_SCALES[k]}::DOUBLE))" for k in range(ad.RUNTIME_FEATURES))]
    return " + ".join(terms)


@query("runtime_features", f"SELECT w, k, {', '.join(micro_sql(f'r{i}', f'r{i}') for i in range(ad.RUNTIME_FEATURES))} FROM {_RUNTIME.sql(f'(SELECT * FROM {workloads_sql()} w, range(0, 4) t(k) WHERE k < 2 OR iterations > 1)')}")
def _(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("w", "k", *[micro(f"r{i}") for i in range(ad.RUNTIME_FEATURES)])


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    plans = workloads(spark, d).withColumn("k", F.explode(F.expr("sequence(0L, 3L)"))).where("k < 2 or iterations > 1")
    return _RUNTIME.apply(plans)


@query("utility_choose", f"""WITH u AS (SELECT w, k, {_score_sql()} AS u FROM {_RUNTIME.sql(f'(SELECT * FROM {workloads_sql()} w, range(0, 4) t(k) WHERE k < 2 OR iterations > 1)')}),
o AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY u, k) AS place FROM u) SELECT a.w, a.k AS plan, {micro_sql('a.u', 'utility')}, {micro_sql('1 - exp(-greatest(0, b.u - a.u))', 'confidence')} FROM o a JOIN o b ON a.w = b.w AND a.place = 1 AND b.place = 2""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The candidate of least utility score over all features, with the confidence that its margin gives."""
    from pyspark.sql import Window

    array = lambda xs: F.array(*[F.lit(float(x)) for x in xs])
    raw = F.array(*[F.col(f"r{i}").cast("double") for i in range(ad.RUNTIME_FEATURES)])
    scored = _candidates(spark, d).select("w", "k", ad.utility(ad.standardize(raw, array(_MEANS), array(_SCALES)), array(_WEIGHTS)).alias("u"))
    order = Window.partitionBy("w").orderBy("u", "k")
    two = scored.withColumn("next", F.lead("u").over(order)).withColumn("place", F.row_number().over(order)).where("place = 1 and next is not null")
    return two.select("w", F.col("k").alias("plan"), F.col("u").alias("utility"), ad.margin_confidence(F.col("u"), F.col("next")).alias("confidence")).select("w", "plan", micro("utility"), micro("confidence"))
