"""Queries of profiles, replay and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import learning
from tessella.operators import reduce as red
from tessella.operators.joins import better_worse_pairs
from tessella.operators.reduce import Policy
from tessella.plans.registry import events, query
from tessella.plans.statistics import micro, micro_sql
from tessella.shared import scratch
from tessella.sources import experience, profiles
from tessella.streaming import runner


def operation_profiles(spark: SparkSession, d: str) -> DataFrame:
    """A candidate profile for each workload and plan."""
    grouped = events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    confidence = F.round(F.least(F.lit(1.0), F.col("n") / 20.0), 4)
    evidence = F.struct(confidence.alias("confidence"), (F.col("user_id") % 11 != 0).alias("correct"), F.lit("2099-01-01").alias("expires"), (F.col("n") % 3 != 0).alias("holdout"), F.col("n").cast("int").alias("samples"))
    plan = F.struct(F.lit(64).alias("chunk"), F.lit("ThreadPool").alias("engine"), F.lit("DynamicChunks").alias("strategy"), (1 + F.col("user_id") % 8).cast("int").alias("workers"))
    work = F.struct(F.array("user_id", "n").alias("extents"), profiles.workload_fingerprint("user_id", "event_type").alias("fingerprint"))
    return grouped.select(F.lit("float64").alias("element_type"), evidence.alias("evidence"), F.lit("Reproducible").alias("numerical_policy"), F.concat(F.lit("sum."), "event_type").alias("operation"), plan.alias("plan"), F.lit(1).alias("schema_version"), F.lit("Candidate").alias("status"), work.alias("workload"))


_GROUPED = "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL"


@query("profile_roundtrip", f"SELECT 'sum.' || event_type AS operation, sha256(user_id || chr(31) || event_type) AS fingerprint, n::INT AS samples, true AS named FROM ({_GROUPED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "profiles")
    profiles.write_profiles(operation_profiles(spark, d), path)
    found = profiles.read_profiles(spark, path)
    return found.select("operation", F.col("workload.fingerprint").alias("fingerprint"), F.col("evidence.samples").alias("samples"), (F.length("sha256") == 64).alias("named"))


@query("profile_approve", f"SELECT sha256(user_id || chr(31) || event_type) AS fingerprint, CASE WHEN n >= 2 AND n % 3 <> 0 AND user_id % 11 <> 0 AND least(1.0, n / 20.0) >= 0.6 THEN 'Approved' ELSE 'Candidate' END AS status FROM ({_GROUPED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    return profiles.approve(operation_profiles(spark, d)).select(F.col("workload.fingerprint").alias("fingerprint"), "status")


#: The number of each issue decides in which rows of the query it occurs.
_EVERY = {name: 5 + k for k, name in enumerate(profiles.ISSUES)}


@query("compat_issues", "SELECT sha256(user_id || chr(31) || event_type) AS fingerprint, list_filter([" + ", ".join(f"CASE WHEN (user_id * 7 + n) % {m} = 0 THEN '{name}' END" for name, m in _EVERY.items()) + f"], lambda x: x IS NOT NULL) AS issues FROM ({_GROUPED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Profiles that differ from the request in one or more of all 26 ways."""
    p = operation_profiles(spark, d).withColumn("at", F.get("workload.extents", 0) * 7 + F.col("evidence.samples"))
    off = lambda name: F.col("at") % _EVERY[name] == 0
    pair = lambda c, bad: [F.when(bad, "another").otherwise("same").alias(f"p_{c}"), F.lit("same").alias(f"r_{c}")]
    columns = [x for name, fields in profiles.CHECKS.items() for k, c in enumerate(fields) for x in pair(c, off(name) if k == len(fields) - 1 else F.lit(False))]
    columns += [x for name, c in profiles.EXPECTED.items() for x in pair(c, off(name))]
    for name, (need, there) in profiles.AVAILABLE.items():
        columns += [F.lit("needed").alias(f"p_{need}"), F.when(off(name), F.array(F.lit("other"))).otherwise(F.array(F.lit("other"), F.lit("needed"))).alias(f"r_{there}")]
    columns += [F.when(off("WorkerBudgetMismatch"), 9).otherwise(3).alias("p_workers"), F.lit(4).alias("r_budget"), F.when(off("ProfileExpired"), "2001-01-01").otherwise("2099-01-01").alias("p_expires"), F.lit("2024-01-01").alias("r_now")]
    stored = F.struct(*[F.col(f.name) for f in spark.createDataFrame([], profiles.PROFILE).schema.fields])
    columns += [profiles.identity(stored).alias("p_identity"), F.when(off("IntegrityFailure"), "ab").otherwise(profiles.identity(stored)).alias("p_sha256"), F.when(off("ProfileNotApproved"), "Candidate").otherwise("Approved").alias("p_status")]
    asked = p.select(F.col("workload.fingerprint").alias("own"), *columns)
    return asked.select(F.col("own").alias("fingerprint"), profiles.issues(asked.columns, deterministic=True).alias("issues"))


@query("replay_digest", "SELECT true AS same, 64::INT AS length")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The reproducible sums of two runs over different partitions have one digest."""
    rows = events(spark, d)
    runs = [profiles.replay_digest(red.reduce_sum(x, F.col("value"), Policy.REPRODUCIBLE, by=["user_id"]), "user_id", "total") for x in (rows, rows.repartition(7, "event_type"))]
    return runs[0].join(runs[1].withColumnRenamed("digest", "other")).select((F.col("digest") == F.col("other")).alias("same"), F.length("digest").alias("length"))


@query("replay_manifests", "SELECT true AS equal, true AS known UNION ALL SELECT false, false")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of two runs that should agree, and of two whose operations differ."""
    rows = events(spark, d)
    digests = [profiles.replay_digest(x.groupBy("user_id").agg(F.count("*").alias("n"), F.min("idx").alias("first")), "user_id", "n", "first") for x in (rows, rows.repartition(5, "event_type"))]
    made = [profiles.replay_manifest(x, ops, policy="Reproducible", seed=20260714) for x, ops in ((digests[0], ["sum"]), (digests[1], ["sum"]), (digests[1], ["sum", "norm"]))]
    pairs = [profiles.compare_manifests(made[0], other) for other in made[1:]]
    return pairs[0].union(pairs[1]).select("equal", (F.col("left_sha256") == F.col("right_sha256")).alias("known"))


@query("evidence_csv", f"SELECT event_type, count(*) AS n, {micro_sql('max(value)', 'most')} FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "evidence")
    summary = events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.max("value").alias("most")).select("event_type", "n", micro("most"))
    profiles.write_evidence(summary, path)
    return profiles.read_evidence(spark, path, "event_type string, n long, most long")


@query("experience_store", f"SELECT user_id, event_type, n FROM ({_GROUPED})")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = profiles.experience_table(events(spark, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")))
    return spark.read.parquet(path)


@query("experience_text", f"""SELECT user_id AS fingerprint, length(event_type)::INT AS engine, ascii(event_type)::INT AS strategy, count(*) AS samples, min(value) AS best, {micro_sql('avg(value)', 'mean')}, 0.5::DOUBLE AS success FROM events GROUP BY user_id, event_type""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Records written as text and read again; what they do not have comes back with its default."""
    value = F.col("value")
    spread = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    records = events(spark, d).groupBy(F.col("user_id").alias("fingerprint"), F.length("event_type").alias("engine"), F.ascii("event_type").alias("strategy")).agg(
        F.lit(4).alias("job_count"), F.min(value).alias("best_elapsed_ms"), F.avg(value).alias("average_elapsed_ms"), F.max_by(value, "idx").alias("last_elapsed_ms"),
        (spread * spread).alias("variance_ms"), spread.alias("standard_deviation_ms"), F.count("*").alias("sample_count"), F.lit(0.5).alias("confidence"),
    )
    path = scratch(spark, "experience-text")
    experience.write_experience(records, path)
    found = experience.read_experience(spark, path)
    return found.select(F.col("fingerprint").cast("long").alias("fingerprint"), "engine", "strategy", F.col("sample_count").alias("samples"), F.col("best_elapsed_ms").alias("best"), F.col("average_elapsed_ms").alias("mean"), F.col("decayed_success_rate").alias("success")).withColumn("mean", micro("mean"))


def _training(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("value > 0")
    return rows.select("event_type", (F.col("user_id") % 3).alias("family"), F.lit(1.0).alias("f0"), ((F.col("user_id") % 10) / 10).alias("f1"), ((F.col("idx") % 24) / 24).alias("f2"), F.log(F.col("value") / 40).alias("y"))


@query("ridge_fit", f"""WITH t AS (SELECT event_type, (user_id % 10) / 10.0::DOUBLE AS f1, ln(value / 40) AS y FROM events WHERE value > 0),
s AS (SELECT event_type, count(*) + 2.0::DOUBLE AS a, sum(f1) AS b, sum(f1 * f1) + 2 AS c, sum(y) AS u, sum(f1 * y) AS v FROM t GROUP BY event_type) SELECT event_type, {micro_sql('(c * u - b * v) / (a * c - b * b)', 'intercept')}, {micro_sql('(a * v - b * u) / (a * c - b * b)', 'slope')} FROM s""")
def _(spark: SparkSession, d: str) -> DataFrame:
    models = learning.ridge_table(_training(spark, d), ["f0", "f1"], "y", ["event_type"])
    return models.select("event_type", F.get("beta", 0).alias("intercept"), F.get("beta", 1).alias("slope")).select("event_type", micro("intercept"), micro("slope"))


@query("hierarchical_fit")
def _(spark: SparkSession, d: str) -> DataFrame:
    fitted = learning.hierarchical(_training(spark, d), ["f0", "f1", "f2"], "y", "event_type", "family")
    return fitted.groupBy("event_type", "family").agg(F.avg("shared").alias("shared"), F.avg("backend_part").alias("backend_part"), F.avg("family_part").alias("family_part"), F.avg(F.abs(F.col("y") - F.col("fitted"))).alias("error"))


def _pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    plans = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("ms"), F.count("*").alias("n"))
    features = F.array(F.lit(1.0), F.length("event_type") / 10.0, F.col("n") / 20.0)
    rows = plans.withColumn("x", features)
    pairs = better_worse_pairs(plans.select("user_id", "event_type", "ms"), "user_id", "event_type", "ms")
    left = rows.select("user_id", F.col("event_type").alias("better"), F.col("x").alias("a"))
    right = rows.select("user_id", F.col("event_type").alias("worse"), F.col("x").alias("b"))
    joined = pairs.join(left, ["user_id", "better"]).join(right, ["user_id", "worse"])
    return rows, joined.withColumn("difference", F.zip_with("a", "b", lambda x, y: x - y))


@query("pairwise_train")
def _(spark: SparkSession, d: str) -> DataFrame:
    _, pairs = _pairs(spark, d)
    rows = pairs.select("user_id", F.concat_ws("/", "better", "worse").alias("pair"), "difference", "ratio")
    return runner.fold(rows, "user_id", "pair", lambda: learning.PairTrainer(3), lambda e: e, "loss double, first double, last double")


@query("ranker_train")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows, pairs = _pairs(spark, d)
    weights, _history = learning.train_ranker(pairs.select("difference", "weight"), 3, 120)
    score = sum((F.lit(w) * F.get("x", i) for i, w in enumerate(weights)), F.lit(0.0))
    return learning.evaluate_ranker(rows, "user_id", "event_type", "ms", score)
