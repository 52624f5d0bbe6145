"""Operation profiles: strict JSON, canonical identity, atomic writes, approval, compatibility and replay."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.shared import scratch

SCHEMA_VERSION = 1
#: A profile as it is stored; fields stand in the order of their names, which makes its JSON canonical.
PROFILE = "element_type string, evidence struct<confidence:double,correct:boolean,expires:string,holdout:boolean,samples:int>, numerical_policy string, operation string, plan struct<chunk:int,engine:string,strategy:string,workers:int>, schema_version int, status string, workload struct<extents:array<bigint>,fingerprint:string>"
MOST_BYTES = 1 << 20
#: What evidence a profile needs to be approved.
MIN_SAMPLES, MIN_CONFIDENCE = 2, 0.60
STATUSES = ("Candidate", "Approved")
#: Fixed value: how deep JSON may be nested.
MOST_DEPTH = 64


def canonical_json(profile: Column) -> Column:
    return F.to_json(profile)


def identity(profile: Column) -> Column:
    """SHA-256 of the canonical JSON."""
    return F.sha2(canonical_json(profile), 256)


def workload_fingerprint(*parts: str) -> Column:
    return F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts]), 256)


POINTER = "CURRENT"


def write_profiles(df: DataFrame, path: str) -> None:
    """One JSON line a profile with its hash, in place of what ``path`` held.

    The lines are written to a version beside the old one and read again
    strictly.  Then a small file that names the current version is replaced by
    one rename, which file systems do at once, so a reader sees the old profiles
    or the new.  The version before stays for those who still read it.
    """
    spark = df.sparkSession
    version = f"version-{uuid.uuid4().hex}"
    rows = df.select(F.struct(*sorted(df.columns)).alias("profile"))
    lines = rows.select(F.to_json(F.struct("profile", identity(F.col("profile")).alias("sha256"))).alias("value"))
    lines.write.text(f"{path}/{version}")
    _checked(spark, f"{path}/{version}").foreach(lambda row: None)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    folder = hadoop.Path(path)
    files = folder.getFileSystem(conf)
    before = _current(spark, path)
    fresh = hadoop.Path(f"{path}/.{version}")
    sink = files.create(fresh)
    sink.write(bytearray(version.encode()))
    sink.close()
    rename = getattr(hadoop, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(fresh, hadoop.Path(f"{path}/{POINTER}"), over)
    for found in files.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("version-") and name not in (version, before):
            files.delete(found.getPath(), True)


def _current(spark: SparkSession, path: str) -> str | None:
    """The name of the current version; None where there is none."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/{POINTER}")
    files = pointer.getFileSystem(conf)
    if not files.exists(pointer):
        return None
    source = files.open(pointer)
    name = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    source.close()
    return name


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Profiles of a written folder, or of a folder of such lines.

    A line must be the canonical JSON of what it says: keys that stand twice,
    unknown fields, text behind the object, other spellings of numbers and
    wrong types are errors, as are malformed and over-long lines, an unknown
    version or status, and a hash that does not fit.
    """
    version = _current(spark, path)
    return _checked(spark, f"{path}/{version}" if version else path)


def _checked(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    size = F.assert_true(F.length("value") <= MOST_BYTES, F.lit("a profile is too long"))
    parsed = F.from_json("value", f"profile struct<{_struct(PROFILE)}>, sha256 string", {"mode": "FAILFAST"})
    rows = lines.select("value", size.alias("_size"), parsed.alias("p")).where("_size is null")
    exact = F.assert_true(F.to_json("p").eqNullSafe(F.col("value")), F.lit("a line is not the canonical JSON of a profile"))
    version = F.assert_true(F.coalesce(F.col("p.profile.schema_version") == SCHEMA_VERSION, F.lit(False)), F.lit("unknown profile version"))
    status = F.assert_true(F.coalesce(F.col("p.profile.status").isin(*STATUSES), F.lit(False)), F.lit("unknown profile status"))
    fits = F.assert_true(F.coalesce(identity(F.col("p.profile")) == F.col("p.sha256"), F.lit(False)), F.lit("a profile's hash does not fit"))
    checked = rows.select("p.profile.*", "p.sha256", F.array(exact, version, status, fits).alias("_checks"))
    return checked.where("forall(_checks, x -> x is null)").drop("_checks")


def _struct(ddl: str) -> str:
    out, depth = [], 0
    for part in ddl.split(", "):
        name, kind = part.split(" ", 1)
        out.append(f"{name}:{kind}")
        depth += 1
    return ",".join(out)


def strict_json(text: str) -> dict:
    """A JSON object without duplicate keys, NaN, infinities or whole numbers beyond 64 bits, nested ``MOST_DEPTH`` deep at most."""

    def no_twice(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise ValueError("a key stands twice")
        return dict(pairs)

    def refuse(word: str) -> None:
        raise ValueError(f"{word} is not allowed")

    def whole(digits: str) -> int:
        if not -(2**63) <= (number := int(digits)) < 2**64:
            raise ValueError("a number is too large")
        return number

    def depth(x: object) -> int:
        kids = x.values() if isinstance(x, dict) else x if isinstance(x, list) else ()
        return 1 + max((depth(k) for k in kids), default=0)

    if len(text) > MOST_BYTES:
        raise ValueError("the text is too long")
    found = json.loads(text, object_pairs_hook=no_twice, parse_constant=refuse, parse_int=whole)
    if not isinstance(found, dict) or depth(found) > MOST_DEPTH:
        raise ValueError("not an object of allowed depth")
    return found


def approve(df: DataFrame) -> DataFrame:
    """Candidates with enough evidence become Approved; the others keep their status."""
    enough = (F.col("evidence.samples") >= MIN_SAMPLES) & F.col("evidence.holdout") & F.col("evidence.correct") & (F.col("evidence.confidence") >= MIN_CONFIDENCE)
    return df.withColumn("status", F.when((F.col("status") == "Candidate") & enough, "Approved").otherwise(F.col("status")))


#: The reasons for which a profile does not fit a request.  What is compared between a profile (p_) and
#: a request (r_): columns that must be equal, by issue.
CHECKS = {
    "SchemaMismatch": ("schema_version",),
    "OperationMismatch": ("operation",),
    "OperationSemanticVersionMismatch": ("operation_version",),
    "DataTypeMismatch": ("element_type",),
    "NumericalPolicyMismatch": ("numerical_policy",),
    "WorkloadFingerprintMismatch": ("fingerprint",),
    "WorkloadExtentMismatch": ("extents",),
    "StrideMismatch": ("strides",),
    "LayoutMismatch": ("layout",),
    "BoundaryModeMismatch": ("boundary_mode",),
    "ArchitectureMismatch": ("architecture", "pointer_width", "endianness"),
    "CompilerBuildMismatch": ("os_family", "compiler", "build"),
    "FloatingPointEnvironmentMismatch": ("floating_point",),
    "BuildIdentifierMismatch": ("application_build",),
    "ProviderVersionMismatch": ("provider_version",),
    "ProviderSettingMismatch": ("provider_settings",),
}
#: Compared only where the request expects something.
EXPECTED = {
    "EvaluationOrderMismatch": "evaluation_order",
    "AccumulationAlgorithmMismatch": "accumulation",
    "CanonicalPlanMismatch": "canonical_plan",
}
#: What the profile needs, and the request's list of what there is.
AVAILABLE = {
    "RequiredIsaUnavailable": ("required_isa", "isas"),
    "SchedulerUnavailable": ("scheduler", "schedulers"),
    "ProviderUnavailable": ("provider", "providers"),
}
ISSUES = (*CHECKS, *EXPECTED, *AVAILABLE, "WorkerBudgetMismatch", "ProfileExpired", "IntegrityFailure", "ProfileNotApproved")


def issues(columns: list[str], deterministic: bool = False, checked: Sequence[str] = ISSUES) -> Column:
    """Every reason among ``checked`` why a profile does not fit a request, in the order of ``ISSUES``; an empty list means that it fits.

    ``columns`` are those of the joined row.  A check whose columns are not
    there cannot be passed: it is an issue.  Whether a profile is approved only
    matters for ``deterministic`` use.
    """
    have = set(columns)
    p, r = (lambda c: F.col(f"p_{c}")), (lambda c: F.col(f"r_{c}"))
    fails: dict[str, tuple[list[str], Callable[[], Column]]] = {}
    for name, fields in CHECKS.items():
        fails[name] = ([f"{side}_{c}" for c in fields for side in "pr"], lambda fields=fields: reduce(or_, (~p(c).eqNullSafe(r(c)) for c in fields)))
    for name, c in EXPECTED.items():
        fails[name] = ([f"p_{c}", f"r_{c}"], lambda c=c: (F.coalesce(r(c), F.lit("")) != "") & ~p(c).eqNullSafe(r(c)))
    for name, (need, there) in AVAILABLE.items():
        fails[name] = ([f"p_{need}", f"r_{there}"], lambda need=need, there=there: ~F.coalesce(F.array_contains(r(there), p(need)), F.lit(False)))
    fails["WorkerBudgetMismatch"] = (["p_workers", "r_budget"], lambda: ~F.coalesce(p("workers").between(1, r("budget")), F.lit(False)))
    fails["ProfileExpired"] = (["p_expires", "r_now"], lambda: F.coalesce(p("expires") <= r("now"), F.lit(False)))
    fails["IntegrityFailure"] = (["p_sha256", "p_identity"], lambda: ~p("sha256").eqNullSafe(p("identity")))
    fails["ProfileNotApproved"] = (["p_status"], lambda: ~p("status").eqNullSafe(F.lit("Approved")) if deterministic else F.lit(False))
    found = [F.when(test() if have.issuperset(needed) else F.lit(True), F.lit(name)) for name in ISSUES if name in checked for needed, test in [fails[name]]]
    return F.array_compact(F.array(*found))


def usable(fit: Column, deterministic: bool) -> Column:
    """Deterministic use fails closed: a profile that does not fit is an error, not a fallback."""
    empty = F.size(fit) == 0
    return F.assert_true(empty, F.lit("the profile does not fit the request")).isNull() if deterministic else empty


def replay_digest(df: DataFrame, *columns: str) -> DataFrame:
    """One SHA-256 of a result, whatever the order of its rows, over sums of the row digests' eight words and the number of rows.

    The sums are exact and their order does not matter, so a task adds up its
    own rows and no list is ever gathered.
    """
    row = F.sha2(F.to_json(F.struct(*columns)), 256)
    words = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")) for k in range(8)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *[w.alias(f"w{k}") for k, w in enumerate(words)])
    return sums.select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.coalesce(F.col(f"w{k}").cast("string"), F.lit("")) for k in range(8)]), 256).alias("digest"))


def replay_manifest(digest: DataFrame, operations: Sequence[str], **stable: str | int) -> DataFrame:
    """(manifest, sha256): one JSON text of everything that a run must reproduce, its keys in order: digests, operations and settings."""
    fields = {**stable, "operations": ",".join(operations)}
    given = [F.lit(v).alias(k) for k, v in fields.items()]
    columns = sorted([*[(c, F.col(c).alias(c)) for c in digest.columns], *zip(fields, given, strict=True)], key=lambda x: x[0])
    return digest.select(F.to_json(F.struct(*[c for _, c in columns])).alias("manifest")).withColumn("sha256", F.sha2("manifest", 256))


def compare_manifests(left: DataFrame, right: DataFrame) -> DataFrame:
    """(equal, left_sha256, right_sha256) of two manifests; they are equal as texts or not at all."""
    pair = left.select(F.col("manifest").alias("a"), F.col("sha256").alias("left_sha256")).join(right.select(F.col("manifest").alias("b"), F.col("sha256").alias("right_sha256")))
    return pair.select((F.col("a") == F.col("b")).alias("equal"), "left_sha256", "right_sha256")


def experience_table(df: DataFrame, path: str | None = None) -> str:
    """Save experience records; the file format keeps types and statistics."""
    where = path or scratch(df.sparkSession, "experience")
    df.write.mode("overwrite").parquet(where)
    return where


def write_evidence(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_evidence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV evidence under a given schema; a malformed line is an error."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST")


def save_models(spark: SparkSession, models: dict[tuple, dict], path: str) -> None:
    """Fitted models, one row a group."""
    rows = [([str(k) for k in key], [float(b) for b in m["beta"]], float(m["variance"]), float(m["n"])) for key, m in sorted(models.items(), key=lambda x: str(x[0]))]
    spark.createDataFrame(rows, "key array<string>, beta array<double>, variance double, n double").write.mode("overwrite").parquet(path)


def load_models(spark: SparkSession, path: str) -> dict[tuple, dict]:
    return {tuple(r["key"]): {"beta": list(r["beta"]), "variance": r["variance"], "n": r["n"]} for r in spark.read.parquet(path).collect()}


def save_artifact(spark: SparkSession, means: list[float], scales: list[float], weights: list[float], path: str) -> None:
    """A utility model as checked JSON."""
    check_artifact(means, scales, weights)
    spark.createDataFrame([(SCHEMA_VERSION, means, scales, weights)], "schema_version int, means array<double>, scales array<double>, weights array<double>").write.mode("overwrite").json(path)


def load_artifact(spark: SparkSession, path: str) -> tuple[list[float], list[float], list[float]]:
    lines = [r[0] for r in spark.read.text(path).limit(2).collect()]
    if len(lines) != 1:
        raise ValueError("not one utility model")
    row = strict_json(lines[0])
    if set(row) != {"schema_version", "means", "scales", "weights"} or row["schema_version"] != SCHEMA_VERSION:
        raise ValueError("not a utility model of this version")
    found = tuple([float(x) for x in row[k]] for k in ("means", "scales", "weights"))
    check_artifact(*found)
    return found


def check_artifact(means: list[float], scales: list[float], weights: list[float]) -> None:
    """A utility model: as many means as scales, one weight more, positive scales, all finite."""
    if len(means) != len(scales) or len(weights) != len(means) + 1:
        raise ValueError("the model's sizes do not fit")
    if any(not abs(x) < float("inf") for x in [*means, *scales, *weights]) or any(s <= 0 for s in scales):
        raise ValueError("the model's values are not usable")
