"""Queries of joins by position, cell, box and rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import joins
from tessella.operators.sequence import zipped
from tessella.plans.registry import events, query, table
from tessella.plans.statistics import micro, micro_sql

_POINTS = "SELECT event_id AS id, (event_id * 7919 % 10007) / 10007.0::DOUBLE AS x, (event_id * 104729 % 10009) / 10009.0::DOUBLE AS y FROM events"


def points(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select(F.col("idx").alias("id"), ((F.col("idx") * 7919 % 10007) / 10007.0).alias("x"), ((F.col("idx") * 104729 % 10009) / 10009.0).alias("y"))


@query("zip_positions", "SELECT event_id AS idx, value, o_totalprice FROM events JOIN orders ON o_orderkey = event_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    left, right = events(spark, d).select("idx", "value"), table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), "o_totalprice")
    both = min(left.count(), right.count())  # equal extents: the longer one ends where the other does
    return zipped(left.where(F.col("idx") < both), right.where(F.col("idx") < both))


@query("grid_neighbors", f"WITH p AS ({_POINTS}), n AS (SELECT a.id, b.id AS other, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM p a JOIN p b ON a.id <> b.id AND abs(a.x - b.x) <= 0.01 AND abs(a.y - b.y) <= 0.01), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, other) AS k FROM n WHERE d2 <= 0.01 * 0.01) SELECT id, other, d2 FROM k WHERE k <= 12")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.grid_neighbors(points(spark, d), 100, 0.01, 12)


_BOXES = f"SELECT id, x AS min_x, x + 0.01 + (id % 7) * 0.003 AS max_x, y AS min_y, y + 0.02 AS max_y, (id % 11) / 11.0::DOUBLE AS min_z, (id % 11) / 11.0::DOUBLE + 0.1 AS max_z FROM ({_POINTS})"


def boxes(spark: SparkSession, d: str) -> DataFrame:
    z = (F.col("id") % 11) / F.lit(11.0)
    return points(spark, d).select("id", F.col("x").alias("min_x"), (F.col("x") + 0.01 + (F.col("id") % 7) * 0.003).alias("max_x"), F.col("y").alias("min_y"), (F.col("y") + 0.02).alias("max_y"), z.alias("min_z"), (z + 0.1).alias("max_z"))


@query("box_overlap", f"WITH b AS ({_BOXES}) SELECT q.id AS query, b.id FROM b JOIN (SELECT * FROM b WHERE id % 20 = 0) q ON b.min_x <= q.max_x AND q.min_x <= b.max_x AND b.min_y <= q.max_y AND q.min_y <= b.max_y AND b.min_z <= q.max_z AND q.min_z <= b.max_z")
def _(spark: SparkSession, d: str) -> DataFrame:
    every = boxes(spark, d)
    return joins.box_overlap(every, every.where("id % 20 = 0"), cell=0.03)


@query("profile_lookup", "SELECT e.event_id AS idx, n.n_name AS name FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("user_id"), F.col("n_name").alias("name"))
    return joins.lookup(events(spark, d).select("idx", "user_id"), names, "user_id").select("idx", "name")


@query("profile_best_plan", f"WITH m AS (SELECT user_id, event_type, avg(value) AS ms FROM events GROUP BY ALL) SELECT user_id, min_by(event_type, (ms, event_type)) AS event_type, {micro_sql('min(ms)', 'ms')} FROM m GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    means = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("ms"))
    return joins.best_per_key(means, "user_id", "event_type", "ms").select("user_id", "event_type", micro("ms"))


@query("pairs_better_worse", f"WITH m AS (SELECT user_id, event_type, avg(value) AS ms FROM events GROUP BY ALL), p AS (SELECT a.user_id, a.event_type AS better, b.event_type AS worse, b.ms / a.ms AS ratio FROM m a JOIN m b ON a.user_id = b.user_id AND (a.ms, a.event_type) < (b.ms, b.event_type)) SELECT user_id, better, worse, {micro_sql('ratio', 'ratio')}, {micro_sql('least(3.0, abs(ln(ratio)))', 'weight')} FROM p WHERE ratio > 1.005")
def _(spark: SparkSession, d: str) -> DataFrame:
    means = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("ms"))
    return joins.better_worse_pairs(means, "user_id", "event_type", "ms").select("user_id", "better", "worse", micro("ratio"), micro("weight"))


@query("lru_evict", "WITH t AS (SELECT user_id, event_type, max(event_id) AS epoch FROM events GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch DESC, event_type) AS k FROM t) SELECT user_id, event_type, epoch FROM k WHERE k <= 3")
def _(spark: SparkSession, d: str) -> DataFrame:
    touched = events(spark, d).groupBy("user_id", "event_type").agg(F.max("idx").alias("epoch"))
    return joins.keep_latest(touched, "epoch", "event_type", 3, "user_id")


@query("lru_evict_records", "SELECT user_id, max(event_id) AS epoch FROM events GROUP BY user_id ORDER BY epoch DESC LIMIT 40")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.keep_latest(events(spark, d).groupBy("user_id").agg(F.max("idx").alias("epoch")), "epoch", "user_id", 40)
