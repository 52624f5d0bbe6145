from __future__ import annotations

import pytest

from tessella.streaming import machines, runner


def test_dispatch_settles_on_the_faster_route():
    m = machines.HotDispatch()
    routes = [m.step({"scheduled_ms": 1.0, "sequential_ms": 2.0})["route"] for _ in range(6)]
    assert routes[:3] == ["scheduled", "sequential", "scheduled"] and m.stable == "scheduled"
    slow = machines.HotDispatch()
    for _ in range(4):
        slow.step({"scheduled_ms": 1.0, "sequential_ms": 1.1})
    assert slow.stable == "sequential"  # 1.1 is below the gain that pays
    dear = machines.HotDispatch()
    assert [dear.step({"scheduled_ms": 9.0, "sequential_ms": 1.0})["route"] for _ in range(3)] == ["scheduled"] * 3


def test_dispatch_probes_again():
    m = machines.HotDispatch(search=True)
    probes = [i for i in range(120) if m.step({"scheduled_ms": 1.0, "sequential_ms": 3.0})["probe"]]
    assert probes[:2] == [0, 1] and len(probes) > 3


def test_profile_cache_starts_anew_on_contradiction():
    m = machines.ProfileCache()
    assert [m.step({"cost": 4.0, "worth": 2.0, "ms": 0})["observations"] for _ in range(3)] == [1, 2, 3]
    assert m.step({"cost": 1.0, "worth": 0.5, "ms": 1})["observations"] == 1
    assert m.step({"cost": 1.0, "worth": 0.5, "ms": 400_000})["stale"]


def test_route_selector_finds_the_fastest_and_notes_drift():
    m = machines.RouteSelector(["a", "b", "c"])
    for _ in range(60):
        m.step({"a": 5.0, "b": 2.0, "c": 4.0})
    assert m.stable == "b"
    for _ in range(60):
        m.step({"a": 5.0, "b": 9.0, "c": 4.0})
    assert m.stable == "c" and m.switches >= 1


def test_equivalent_routes_go_to_the_preferred_one():
    m = machines.RouteSelector(["a", "b"])
    for _ in range(30):
        m.step({"a": 1.00, "b": 0.99})
    assert m.stable == "a"


def test_backend_hysteresis():
    m = machines.BackendCalibration()
    m.step({"backend": "ThreadPool", "elapsed_ms": 100.0})
    assert m.step({"backend": "OneTbb", "elapsed_ms": 95.0})["winner"] == "ThreadPool"
    m.step({"backend": "freeze", "elapsed_ms": 0.0})
    assert m.step({"backend": "OneTbb", "elapsed_ms": 1.0})["winner"] == "ThreadPool"


def lease(i, n, ms=0, minimum=None, exact=True, policy="wait", deadline=0):
    return {"op": "acquire", "id": i, "ms": ms, "requested": n, "minimum": n if minimum is None else minimum, "exact": exact, "policy": policy, "deadline": deadline}


def test_governor_keeps_its_budget_and_lets_small_ones_past():
    g = machines.Governor(4)
    assert g.step(lease(1, 3))["status"] == "Granted"
    assert g.step(lease(2, 4))["status"] == "Waiting"
    assert g.step(lease(3, 1))["status"] == "Granted" and g.counts["bypasses"] == 1
    assert g.step(lease(4, 5))["status"] == "ImpossibleRequest"
    assert g.step(lease(5, 2, minimum=1))["status"] == "InvalidRequest"
    assert g.step(lease(6, 1, policy="fail"))["status"] == "WouldBlock"
    out = g.step({"op": "release", "id": 1, "ms": 1})
    assert out["active"] == 1
    assert g.step({"op": "release", "id": 3, "ms": 2})["active"] == 4 and g.peak == 4


def test_governor_reserves_for_an_aged_head():
    g = machines.Governor(4)
    g.step(lease(1, 3))
    g.step(lease(2, 4))
    assert g.step(lease(3, 1, ms=60))["status"] == "Waiting" and g.counts["reservations"] == 1


def test_governor_reports_every_outcome():
    g = machines.Governor(4)
    assert g.step(lease(1, 4))["status"] == "Granted"
    assert g.step(lease(2, 2, ms=1, policy="deadline", deadline=10))["status"] == "Waiting"
    assert g.step(lease(3, 2, ms=2, policy="deadline", deadline=2))["status"] == "DeadlineExpired"
    assert g.step(lease(9, 2, ms=2, policy="deadline"))["status"] == "InvalidRequest"
    assert g.step(lease(4, 1, ms=3))["outcomes"] == []
    out = g.step(lease(5, 1, ms=10))
    assert out["outcomes"] == [{"id": 2, "status": "DeadlineExpired"}] and out["deadlines"] == 2 and out["oldest_ms"] == 7
    assert g.step({"op": "cancel", "id": 4, "ms": 11})["outcomes"] == [{"id": 4, "status": "Cancelled"}]
    assert g.step({"op": "release", "id": 1, "ms": 12})["outcomes"] == [{"id": 5, "status": "Granted"}]
    g.step(lease(6, 4, ms=13))
    out = g.step({"op": "shutdown", "id": -1, "ms": 14})
    assert out["outcomes"] == [{"id": 6, "status": "GovernorShuttingDown"}] and out["shutting_down"] and not out["queued"]
    assert g.step(lease(7, 1, ms=15))["status"] == "GovernorShuttingDown" and g.step(lease(8, 9, ms=15))["status"] == "ImpossibleRequest"
    out = g.step({"op": "release", "id": 5, "ms": 16})
    assert out["active"] == 0 and out["available"] == 4 and out["grants"] == out["releases"] == 2


def test_outcomes_of_columns_equal_a_fresh_governor(spark):
    from itertools import product

    rows = [(r, m, x, p, d, 5, False, closed) for r, m, x, p, d, closed in product((0, 1, 3, 9), (0, 1, 3, 9), (False, True), ("wait", "fail", "deadline"), (0, 4, 6), (False, True))]
    for used in (0, 3):
        df = spark.createDataFrame(rows, "requested long, minimum long, exact boolean, policy string, deadline long, ms long, cancelled boolean, closed boolean")
        for row in df.select("*", machines.lease_outcome(4, machines.F.lit(4 - used)).alias("outcome")).collect():
            g = machines.Governor(4)
            if used:
                g.step(lease(0, used))
            if row["closed"]:
                g.step({"op": "shutdown", "id": -1, "ms": 1})
            own = g.step({"op": "acquire", "id": 1} | {k: row[k] for k in ("ms", "requested", "minimum", "exact", "policy", "deadline")})
            assert own["status"] == row["outcome"], row


class Counting:
    def __init__(self):
        self.n = self.total = 0

    def step(self, event):
        self.n += 1
        self.total += event["big"] or 0
        return {"n": self.n, "total": self.total, "missing": event["big"] is None}


def test_fold_takes_null_keys_as_one_and_keeps_whole_numbers(spark):
    big = 2**60 + 1
    rows = [(None, i, big if i % 2 else None) for i in range(6)] + [(7, i, 1) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, i long, big long").repartition(3)
    found = runner.fold(df, "k", "i", Counting, lambda e: e, "n long, total long, missing boolean").collect()
    own = sorted((r["i"], r["n"], r["total"], r["missing"]) for r in found if r["k"] is None)
    assert own == [(i, i + 1, (i + 1) // 2 * big, i % 2 == 0) for i in range(6)]
    assert sorted(r["n"] for r in found if r["k"] == 7) == [1, 2, 3]


def test_exploration_pauses_after_harm():
    m = machines.Exploration()
    rows = [m.step({"key": 7, "best": "a", "scores": {"a": 1.0, "b": 1.01}, "actual_ms": 2.0, "expected_ms": 1.0}) for _ in range(400)]
    assert any(r["explored"] for r in rows)
    first = next(i for i, r in enumerate(rows) if r["explored"])
    assert not any(r["explored"] for r in rows[first + 1 : first + 1 + machines.COOLDOWN])


def test_fold_and_stream_agree(spark, tmp_path):
    rows = [(k, i, float((i * 7 + k) % 11 + 1)) for k in range(3) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, i long, ms double")
    event = lambda e: {"scheduled_ms": e["ms"] / 10, "sequential_ms": e["ms"] / 8}
    schema = "route string, probe boolean, stable string, elapsed_ms double"
    want = sorted(tuple(r) for r in runner.fold(df, "k", "i", machines.HotDispatch, event, schema).collect())
    path = str(tmp_path / "in")
    for part in range(4):  # one file a micro-batch
        df.where(f"i div 10 = {part}").coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = runner.stream(source, "k", "i", machines.HotDispatch, event, schema).writeStream.format("memory").queryName("folded").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.table("folded").collect()) == want


def test_windowed_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{i % 60:02d}:00", "a" if i % 2 else "b", float(i)) for i in range(120)]
    df = spark.createDataFrame(rows, "ts string, kind string, value double").selectExpr("to_timestamp(ts) AS ts", "kind", "value")
    df.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = runner.windowed_counts(source, "ts", "10 minutes", "5 minutes", "kind").writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("windows").agg({"n": "sum"}).first()[0] == 120


def test_hash_unit_is_uniform_enough():
    xs = [machines.hash_unit(42, i) for i in range(4000)]
    assert 0 <= min(xs) and max(xs) < 1 and sum(xs) / len(xs) == pytest.approx(0.5, abs=0.03)
