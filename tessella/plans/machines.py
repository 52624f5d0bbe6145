"""Queries of the state machines, over ``events`` in the order of ``event_id``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.registry import events, query, table
from tessella.plans.statistics import micro, micro_sql
from tessella.streaming import machines, runner


#: One event of each user after the other: what the machines fold, as recursion.
_TURNS = "SELECT user_id, event_id AS idx, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"
_FASTER = "CASE WHEN {q} = 0 OR ({a} > 0 AND {b} / {a} >= 1.12) THEN 'scheduled' ELSE 'sequential' END"
_AGAIN = "(r.uses + 1 >= 64 AND (r.stable = 'sequential' OR r.a <= 5))"


@query("dispatch_state", f"""WITH RECURSIVE e AS ({_TURNS}),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, -1::BIGINT AS idx, '' AS route, false AS probe, '' AS stable, 0.0::DOUBLE AS elapsed_ms, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0 AS s, 0 AS q, 0 AS uses FROM events
  UNION ALL SELECT user_id, k, idx, route, probe, CASE WHEN probe AND s > 0 AND q > 0 THEN {_FASTER.format(a='a', b='b', q='q')} ELSE kept END, ms, a, b, s, q, CASE WHEN probe AND s > 0 AND q > 0 THEN 0 ELSE uses END FROM (
    SELECT user_id, k, idx, route, probe, kept, uses, ms, CASE WHEN route <> 'scheduled' THEN a0 WHEN s0 = 0 THEN ms ELSE a0 * 0.75::DOUBLE + ms * 0.25::DOUBLE END AS a, CASE WHEN route = 'scheduled' THEN b0 WHEN q0 = 0 THEN ms ELSE b0 * 0.75::DOUBLE + ms * 0.25::DOUBLE END AS b,
      s0 + CASE WHEN route = 'scheduled' THEN 1 ELSE 0 END AS s, q0 + CASE WHEN route = 'scheduled' THEN 0 ELSE 1 END AS q FROM (
      SELECT *, CASE WHEN route = 'scheduled' THEN value / 100.0::DOUBLE ELSE value / 100.0::DOUBLE * (0.7::DOUBLE + (user_id % 7) / 10.0::DOUBLE) END AS ms FROM (
        SELECT e.user_id, e.k, e.idx, e.value, r.a AS a0, r.b AS b0, r.s AS s0, r.q AS q0,
          CASE WHEN r.stable = '' THEN CASE WHEN r.s = 0 THEN 'scheduled' WHEN r.q = 0 AND r.a <= 5 THEN 'sequential' ELSE {_FASTER.format(a='r.a', b='r.b', q='r.q')} END WHEN {_AGAIN} THEN CASE WHEN r.stable = 'sequential' THEN 'scheduled' ELSE 'sequential' END ELSE r.stable END AS route,
          CASE WHEN r.stable = '' THEN r.s = 0 OR (r.q = 0 AND r.a <= 5) ELSE {_AGAIN} END AS probe,
          CASE WHEN r.stable <> '' THEN r.stable WHEN r.s = 0 OR (r.q = 0 AND r.a <= 5) THEN '' ELSE {_FASTER.format(a='r.a', b='r.b', q='r.q')} END AS kept,
          CASE WHEN r.stable = '' OR r.uses + 1 >= 64 THEN 0 ELSE r.uses + 1 END AS uses
        FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))
SELECT user_id, idx, route, probe, stable, elapsed_ms FROM r WHERE k > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "idx", "value")
    event = lambda e: {"scheduled_ms": e["value"] / 100, "sequential_ms": e["value"] / 100 * (0.7 + (e["user_id"] % 7) / 10)}
    return runner.fold(rows, "user_id", "idx", machines.HotDispatch, event, "route string, probe boolean, stable string, elapsed_ms double")


_FLIPS = "((r.worth >= 1.1) <> (e.value / 20.0::DOUBLE >= 1.1))"


@query("profile_cache_state", f"""WITH RECURSIVE e AS ({_TURNS}),
r AS (SELECT user_id, k, idx, value AS cost, value / 20.0::DOUBLE AS worth, 1::BIGINT AS observations, 1::BIGINT AS generation, false AS stale FROM e WHERE k = 1
  UNION ALL SELECT e.user_id, e.k, e.idx, CASE WHEN {_FLIPS} THEN e.value ELSE r.cost * 0.75::DOUBLE + e.value * 0.25::DOUBLE END, e.value / 20.0::DOUBLE, CASE WHEN {_FLIPS} THEN 1 ELSE r.observations + 1 END, r.generation + 1, (e.idx - r.idx) * 2000 >= 300000
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, idx, cost, observations, generation, stale, CASE WHEN observations >= 3 THEN 'High' ELSE 'Medium' END AS confidence FROM r""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "idx", "value")
    event = lambda e: {"cost": e["value"], "worth": e["value"] / 20, "ms": e["idx"] * 2000}
    return runner.fold(rows, "user_id", "idx", machines.ProfileCache, event, "cost double, observations long, generation long, stale boolean, confidence string")


@query("route_selector")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "idx", "value")
    routes = ["sequential", "pool", "tbb"]
    event = lambda e: {"sequential": e["value"], "pool": e["value"] * (0.5 + (e["user_id"] % 9) / 10), "tbb": e["value"] * (0.6 + (e["user_id"] % 5) / 10)}
    return runner.fold(rows, "user_id", "idx", lambda: machines.RouteSelector(routes), event, "phase string, route string, stable string, interval long, switches long")


@query(
    "backend_calibration",
    f"""WITH m AS (SELECT user_id, coalesce(avg(value) FILTER (WHERE event_type IN ('click', 'view')), 0) AS pool, coalesce(avg(value) FILTER (WHERE event_type NOT IN ('click', 'view')), 0) AS tbb, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS a, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS b FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN a = 0 OR b = 0 THEN '' WHEN tbb < pool * 0.92 THEN 'OneTbb' ELSE 'ThreadPool' END AS winner, {micro_sql('pool', 'pool_ms')}, {micro_sql('tbb', 'tbb_ms')} FROM m""",
)
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "idx", "value", "event_type")
    event = lambda e: {"backend": "ThreadPool" if e["event_type"] in ("click", "view") else "OneTbb", "elapsed_ms": e["value"]}
    folded = runner.fold(rows, "user_id", "idx", machines.BackendCalibration, event, "winner string, pool_ms double, tbb_ms double")
    last = folded.groupBy("user_id").agg(F.max(F.struct("idx", "winner", "pool_ms", "tbb_ms")).alias("l")).select("user_id", "l.*")
    return last.select("user_id", "winner", micro("pool_ms"), micro("tbb_ms"))


def _mixed_sql(x: str, shift: int, factor: int) -> str:
    return f"(xor({x}, {x} >> {shift})::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT"


#: The hashed number of each user's k-th turn, and the rule by which plan b is near enough.
_UNIT = f"""SELECT user_id, k, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0::DOUBLE AS unit FROM (SELECT user_id, k, {_mixed_sql('y', 27, 0x94D049BB133111EB)} AS z FROM (
  SELECT user_id, k, {_mixed_sql('x', 30, 0xBF58476D1CE4E5B9)} AS y FROM (SELECT user_id, k, xor(user_id::UBIGINT, (k::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT % 18446744073709551616::UHUGEINT)::UBIGINT) AS x FROM e)))"""
_NEARBY = "(r.pause = 0 AND 1.02::DOUBLE + (e.user_id % 5) / 50.0::DOUBLE <= 1.08::DOUBLE)"
_TRIED = f"({_NEARBY} AND h.unit < 0.05)"
_HARM = f"({_TRIED} AND (e.value / 50.0::DOUBLE - 1) * 100 > 10)"


@query("exploration", f"""WITH RECURSIVE e AS ({_TURNS}), h AS ({_UNIT}),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS k, -1::BIGINT AS idx, 'a' AS plan, false AS explored, 0::BIGINT AS pause, 0::BIGINT AS harmful, 0::BIGINT AS turns FROM events
  UNION ALL SELECT e.user_id, e.k, e.idx, CASE WHEN {_TRIED} THEN 'b' ELSE 'a' END, {_TRIED}, CASE WHEN {_HARM} THEN 32 WHEN r.pause > 0 THEN r.pause - 1 ELSE 0 END, r.harmful + CASE WHEN {_HARM} THEN 1 ELSE 0 END, r.turns + CASE WHEN {_NEARBY} THEN 1 ELSE 0 END
  FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 JOIN h ON h.user_id = r.user_id AND h.k = r.turns + 1)
SELECT user_id, idx, plan, explored, pause, harmful FROM r WHERE k > 0""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "idx", "value")

    def event(e: dict) -> dict:
        return {"key": e["user_id"], "best": "a", "scores": {"a": 1.0, "b": 1.02 + (e["user_id"] % 5) / 50, "c": 1.2}, "actual_ms": e["value"], "expected_ms": 50.0}

    return runner.fold(rows, "user_id", "idx", machines.Exploration, event, "plan string, explored boolean, pause long, harmful long")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    """Lease requests and releases of 40 tenants, made from events."""
    rows = events(spark, d).select((F.col("user_id") % 40).alias("tenant"), "idx", "event_type", "value")
    order = Window.partitionBy("tenant").orderBy("idx")
    return rows.withColumn("back", F.lag("idx", 2).over(order))


def _lease_event(e: dict) -> dict:
    """Of the tenants one shuts down at its first purchase from 9,000 ms on; the others go on."""
    ms = e["idx"]
    if e["tenant"] == 39 and ms >= 9_000 and e["event_type"] == "purchase":
        return {"op": "shutdown", "id": -1, "ms": ms}
    if e["event_type"] == "signup" and e["back"] is not None:
        return {"op": "release", "id": e["back"], "ms": ms}
    if e["event_type"] == "error" and e["back"] is not None:
        return {"op": "cancel", "id": e["back"], "ms": ms}
    n = 1 + int(e["value"]) % 10
    return {"op": "acquire", "id": ms, "ms": ms, "requested": n, "minimum": n if n % 2 else max(1, n // 2), "exact": n % 2 == 1, "policy": ("wait", "fail", "deadline")[n % 3], "deadline": ms + 400}


_COUNTERS = "grants long, releases long, waits long, cancellations long, deadlines long, bypasses long, reservations long"


@query("governor_admission")
def _(spark: SparkSession, d: str) -> DataFrame:
    schema = f"status string, granted long, active long, peak long, queued long, served long, outcomes array<struct<id:bigint,status:string>>, {_COUNTERS}"
    return runner.fold(_requests(spark, d), "tenant", "idx", lambda: machines.Governor(8), _lease_event, schema)


@query("governor_counters")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The governor's own snapshot after the last event of each tenant."""
    schema = f"active long, available long, peak long, leases long, queued long, oldest_ms long, shutting_down boolean, {_COUNTERS}"
    return runner.fold(_requests(spark, d), "tenant", "idx", lambda: machines.Governor(8), _lease_event, schema, last=True)


_LEASE = """SELECT event_id AS idx, 1 + CAST(floor(value) AS BIGINT) % 20 AS requested, CAST(floor(value * 3) AS BIGINT) % 14 AS minimum, event_id % 3 = 0 AS exact, event_id % 9 AS free,
  CASE event_id % 4 WHEN 0 THEN 'fail' WHEN 1 THEN 'deadline' ELSE 'wait' END AS policy, CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id + event_id % 7 - 3 END AS deadline, user_id % 19 = 0 AS cancelled, user_id % 23 = 0 AS closed FROM events"""


@query("lease_outcomes", f"""SELECT idx, CASE WHEN minimum < 1 OR requested < minimum OR (exact AND minimum <> requested) THEN 'InvalidRequest' WHEN minimum > 8 THEN 'ImpossibleRequest'
  WHEN policy = 'deadline' AND deadline = 0 THEN 'InvalidRequest' WHEN cancelled THEN 'Cancelled' WHEN closed THEN 'GovernorShuttingDown'
  WHEN CASE WHEN exact THEN free >= requested ELSE least(requested, free) >= minimum END THEN 'Granted' WHEN policy = 'fail' THEN 'WouldBlock' WHEN policy = 'deadline' AND idx >= deadline THEN 'DeadlineExpired' ELSE 'Waiting' END AS outcome FROM ({_LEASE})""")
def _(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("idx")
    rows = events(spark, d).select(
        "idx",
        i.alias("ms"),
        (1 + F.floor("value") % 20).alias("requested"),
        (F.floor(F.col("value") * 3) % 14).alias("minimum"),
        (i % 3 == 0).alias("exact"),
        (i % 9).alias("free"),
        F.when(i % 4 == 0, "fail").when(i % 4 == 1, "deadline").otherwise("wait").alias("policy"),
        F.when(i % 13 == 0, 0).otherwise(i + i % 7 - 3).alias("deadline"),
        (F.col("user_id") % 19 == 0).alias("cancelled"),
        (F.col("user_id") % 23 == 0).alias("closed"),
    )
    return rows.select("idx", machines.lease_outcome(8, F.col("free")).alias("outcome"))


@query("nested_budgets", "SELECT p AS parent, c AS children, i AS child, (p // c + CASE WHEN i < p % c THEN 1 ELSE 0 END)::BIGINT AS budget FROM range(1, 17) a(p), range(1, 6) b(c), range(0, 5) t(i) WHERE i < c")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(1, 17).withColumnRenamed("id", "parent").withColumn("children", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(5).cast("long")))).withColumn("child", F.explode(F.sequence(F.lit(0).cast("long"), F.col("children") - 1)))
    return rows.withColumn("budget", F.expr("parent div children") + F.when(F.col("child") < F.col("parent") % F.col("children"), 1).otherwise(0))


@query("governor_snapshot", "SELECT event_id AS idx, user_id % 10 AS tenant, CAST(sum(CASE WHEN event_type = 'signup' THEN -1 ELSE 2 END) OVER w AS BIGINT) AS active, CAST(max(event_id % 13) OVER w AS BIGINT) AS peak, count(*) OVER w AS requests FROM events WINDOW w AS (PARTITION BY user_id % 10 ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("tenant", F.col("user_id") % 10)
    w = Window.partitionBy("tenant").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    permits = F.when(F.col("event_type") == "signup", -1).otherwise(2)
    return rows.select("idx", "tenant", F.sum(permits).over(w).alias("active"), F.max(F.col("idx") % 13).over(w).alias("peak"), F.count("*").over(w).alias("requests"))


_KIND = "CASE event_id % 7 WHEN 0 THEN 'begin' WHEN 6 THEN CASE WHEN event_id % 5 = 0 THEN 'abort' ELSE 'finish' END ELSE 'update' END"


@query("trace_records", f"WITH t AS (SELECT event_id // 7 AS loop, event_id AS idx, {_KIND} AS kind, user_id AS workers FROM events) SELECT loop, min(idx) FILTER (WHERE kind = 'begin') AS begun, max(workers) FILTER (WHERE kind = 'update') AS most_workers, count(*) FILTER (WHERE kind = 'update') AS updates, coalesce(min(idx) FILTER (WHERE kind = 'finish'), min(idx) FILTER (WHERE kind = 'abort')) AS ended, coalesce(bool_or(kind = 'abort'), false) AS exceptional FROM t GROUP BY loop HAVING begun IS NOT NULL AND ended IS NOT NULL")
def _(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("idx") % 7 == 0, "begin").when(F.col("idx") % 7 == 6, F.when(F.col("idx") % 5 == 0, "abort").otherwise("finish")).otherwise("update")
    rows = events(spark, d).select(F.expr("idx div 7").alias("loop"), "idx", kind.alias("kind"), F.col("user_id").alias("workers"))
    return runner.trace_records(rows, "loop", "idx", "kind", "workers")


@query("stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(floor(sum(value) * 100 + 0.5) AS BIGINT) AS cents FROM events GROUP BY 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """An extension: the same plan runs over a stream, where the watermark bounds its state."""
    found = runner.windowed_counts(table(spark, d, "events"), "ts", "1 hour", "10 minutes", "event_type")
    return found.select(F.col("window.start").alias("start"), "event_type", "n", F.floor(F.col("total") * 100 + 0.5).cast("long").alias("cents"))
