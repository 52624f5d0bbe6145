from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessella.plans import runtime
from tessella.sources import profiles


@pytest.fixture()
def saved(spark, tmp_path):
    row = ("float64", (0.9, True, "2099-01-01", True, 12), "Reproducible", "sum", (64, "ThreadPool", "DynamicChunks", 4), 1, "Candidate", ([10], "ab"))
    df = spark.createDataFrame([row], profiles.PROFILE)
    path = f"file://{tmp_path}/profiles"
    profiles.write_profiles(df, path)
    return df, path


def test_round_trip(spark, saved):
    df, path = saved
    assert profiles.read_profiles(spark, path).drop("sha256").collect() == df.collect()
    profiles.write_profiles(df.withColumn("status", F.lit("Approved")), path)  # replaces
    assert [r["status"] for r in profiles.read_profiles(spark, path).collect()] == ["Approved"]


def only_line(spark, path):
    return spark.read.text(f"{path}/{profiles._current(spark, path)}").first()[0]


SPOILED = {
    "another operation": lambda s: s.replace('"sum"', '"dot"'),
    "cut": lambda s: s[:-5],
    "another version": lambda s: s.replace('"schema_version":1', '"schema_version":2'),
    "a key twice": lambda s: s.replace('"operation":"sum"', '"operation":"sum","operation":"sum"'),
    "an inner key twice": lambda s: s.replace('"correct":true', '"correct":true,"correct":true'),
    "an unknown field": lambda s: s.replace('"operation":"sum"', '"operation":"sum","owner":"me"'),
    "an unknown key above": lambda s: s.replace('{"profile"', '{"extra":1,"profile"'),
    "text behind": lambda s: s + " trailing",
    "a second object": lambda s: s + s,
    "a space": lambda s: s.replace('":1', '": 1', 1),
    "a status that there is not": lambda s: s.replace('"Candidate"', '"Trusted"'),
    "one byte": lambda s: s[:1],
    "not finite": lambda s: s.replace('"schema_version":1', '"schema_version":NaN'),
    "negative": lambda s: s.replace('"schema_version":1', '"schema_version":-1'),
    "too large": lambda s: s.replace('"schema_version":1', '"schema_version":184467440737095516160'),
    "nested": lambda s: "[" * 70 + "0" + "]" * 70,
    "another hash": lambda s: s[: s.index('"sha256"')] + '"sha256":"00"}',
    "an empty line": lambda s: "",
}


@pytest.mark.parametrize("name", SPOILED)
def test_spoiled_files_are_refused(spark, saved, tmp_path, name):
    _, path = saved
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "part.txt").write_text(SPOILED[name](only_line(spark, path)) + "\n")
    with pytest.raises(Exception):  # noqa: B017
        profiles.read_profiles(spark, f"file://{bad}").collect()


def test_what_is_written_is_read_from_any_folder(spark, saved, tmp_path):
    df, path = saved
    good = tmp_path / "good"
    good.mkdir()
    (good / "part.txt").write_text(only_line(spark, path) + "\n")
    assert profiles.read_profiles(spark, f"file://{good}").drop("sha256").collect() == df.collect()


def test_readers_keep_the_version_they_have(spark, saved, tmp_path):
    df, path = saved
    old = profiles.read_profiles(spark, path)
    profiles.write_profiles(df.withColumn("status", F.lit("Approved")), path)
    assert [r["status"] for r in old.collect()] == ["Candidate"]
    for _ in range(3):
        profiles.write_profiles(df, path)
    assert len([p for p in (tmp_path / "profiles").iterdir() if p.name.startswith("version-")]) == 2


MALFORMED = ['{"a":1,"a":2}', '{"a":NaN}', '{"a":1', "[1]", '{"a":Infinity}', "{" + '"a":{' * 80 + "}" * 81, "", "{", "[" * 70 + "0" + "]" * 70, '{"a":184467440737095516160}', '{"a":1} x']


@pytest.mark.parametrize("text", MALFORMED)
def test_malformed_json(text):
    with pytest.raises(ValueError):  # noqa: PT011
        profiles.strict_json(text)


def test_artifact_checks():
    profiles.check_artifact([10.0, 20.0], [2.0, 5.0], [0.0, 1.0, 2.0])
    for bad in (([1.0], [0.0], [0.0, 1.0]), ([1.0], [1.0], [0.0]), ([float("nan")], [1.0], [0.0, 1.0])):
        with pytest.raises(ValueError):  # noqa: PT011
            profiles.check_artifact(*bad)


def test_compatibility_fails_closed(spark):
    df = spark.createDataFrame([("sum", "dot", 9)], "p_operation string, r_operation string, p_workers int").withColumn("r_budget", F.lit(4))
    fit = profiles.issues(df.columns, checked=("OperationMismatch", "WorkerBudgetMismatch"))
    assert df.select(fit.alias("i")).first()["i"] == ["OperationMismatch", "WorkerBudgetMismatch"]
    assert df.select(profiles.usable(fit, False).alias("u")).first()["u"] is False
    with pytest.raises(Exception, match="does not fit"):
        df.select(profiles.usable(fit, True)).collect()
    # what is not there cannot be passed
    assert len(profiles.ISSUES) == 26 == len(set(profiles.ISSUES))
    assert df.select(profiles.issues(df.columns, deterministic=True).alias("i")).first()["i"] == list(profiles.ISSUES)


def fitting() -> dict:
    row = {f"{side}_{c}": "x" for fields in profiles.CHECKS.values() for c in fields for side in "pr"}
    row |= {f"{side}_{c}": "x" for c in profiles.EXPECTED.values() for side in "pr"}
    row |= {f"p_{need}": "x" for need, _ in profiles.AVAILABLE.values()} | {f"r_{there}": ["w", "x"] for _, there in profiles.AVAILABLE.values()}
    return row | {"p_workers": 2, "r_budget": 4, "p_expires": "2099", "r_now": "2024", "p_sha256": "ab", "p_identity": "ab", "p_status": "Approved"}


def test_every_issue_alone(spark):
    good = fitting()
    spoiled = {"WorkerBudgetMismatch": {"p_workers": 5}, "ProfileExpired": {"p_expires": "2001"}, "IntegrityFailure": {"p_sha256": "cd"}, "ProfileNotApproved": {"p_status": "Candidate"}}
    spoiled |= {name: {f"p_{fields[-1]}": "y"} for name, fields in profiles.CHECKS.items()} | {name: {f"p_{c}": "y"} for name, c in profiles.EXPECTED.items()}
    spoiled |= {name: {f"r_{there}": ["w"]} for name, (_, there) in profiles.AVAILABLE.items()}
    rows = [good, *(good | spoiled[name] for name in profiles.ISSUES), good | {"r_canonical_plan": "", "p_canonical_plan": "y"}, good | {"p_layout": None}]
    names = list(good)
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], names).coalesce(1)
    found = [r["i"] for r in df.select(profiles.issues(names, deterministic=True).alias("i")).collect()]
    assert found == [[], *([name] for name in profiles.ISSUES), [], ["LayoutMismatch"]]
    assert "ProfileNotApproved" not in df.select(F.explode(profiles.issues(names)).alias("i")).distinct().toPandas()["i"].tolist()


def test_manifests(spark):
    runs = [spark.range(50).repartition(n).withColumn("v", F.col("id") * 2) for n in (2, 5)]
    made = [profiles.replay_manifest(profiles.replay_digest(x, "id", "v"), ["sum", "norm"], policy="Reproducible", seed=7) for x in runs]
    assert profiles.compare_manifests(*made).first()["equal"]
    other = profiles.replay_manifest(profiles.replay_digest(runs[0], "id", "v"), ["sum"], policy="Reproducible", seed=7)
    row = profiles.compare_manifests(made[0], other).first()
    assert not row["equal"] and row["left_sha256"] != row["right_sha256"]


def test_digest_does_not_depend_on_order(spark):
    df = spark.range(500).withColumn("v", F.col("id") * 3)
    a = profiles.replay_digest(df, "id", "v").first()[0]
    assert a == profiles.replay_digest(df.repartition(9).orderBy(F.desc("id")), "id", "v").first()[0]
    assert a != profiles.replay_digest(df.where("id > 0"), "id", "v").first()[0]
    assert runtime.profiles is profiles
