"""Queries of reductions under the numerical policies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import reduce as red
from tessella.operators.reduce import Policy
from tessella.operators.sequence import dense_index
from tessella.plans.registry import events, query, table

LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
CENTS = "CAST(floor(value * 100 + 0.5) AS BIGINT)"


def canonical_sql(source: str, init: str = "0.0", op: str = "a + b", rounds: int = 11) -> str:
    """Leaves of 1,024 folded from the left, then merged pairwise level by level; ``source`` gives (idx, v)."""
    levels = f"""WITH l0 AS (SELECT idx // 1024 AS node, list_reduce(list(v ORDER BY idx), lambda a, b: {op}) AS s FROM ({source}) GROUP BY 1)"""
    for k in range(1, rounds + 1):
        merged = op.replace("a ", "max(s) FILTER (WHERE node % 2 = 0) ").replace(" b", " max(s) FILTER (WHERE node % 2 = 1)")
        levels += f", l{k} AS (SELECT node // 2 AS node, CASE WHEN count(*) = 2 THEN {merged} ELSE max(s) END AS s FROM l{k - 1} GROUP BY node // 2)"
    return levels + f" SELECT coalesce({init} + (SELECT s FROM l{rounds}), {init}) AS total"


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return dense_index(table(spark, d, "lineitem").select(*LINEITEM_ORDER), *LINEITEM_ORDER)


@query("reduce_sum_int", f"SELECT (7 + coalesce(sum({CENTS}), 0))::BIGINT AS total FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg((F.lit(7) + F.coalesce(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")), F.lit(0))).alias("total"))


@query("reduce_custom_max", "SELECT greatest(-1.0, max(value)) AS total FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.reduce_by(events(spark, d), F.col("value"), lambda a, b: F.greatest(a, b), F.lit(-1.0), "double")


@query("reduce_concat_ordered", "SELECT 'prefix:' || string_agg(event_type[1], '' ORDER BY event_id) AS total FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.reduce_by(events(spark, d), F.substring("event_type", 1, 1), lambda a, b: F.concat(a, b), F.lit("prefix:"), "string")


@query("reduce_fast", "SELECT CAST(floor((0.5 + sum(value)) * 1000 + 0.5) AS BIGINT) AS milli FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.reduce_sum(events(spark, d), F.col("value"), Policy.FAST, 0.5).select(F.floor(F.col("total") * 1000 + 0.5).cast("long").alias("milli"))


@query("reduce_reproducible", canonical_sql("SELECT event_id AS idx, value AS v FROM events"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.reduce_sum(events(spark, d), F.col("value"), Policy.REPRODUCIBLE)


@query("reduce_accurate", "SELECT fsum(value) AS total FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.reduce_sum(events(spark, d), F.col("value"), Policy.ACCURATE)


@query("reduce_adversarial", "SELECT 3000.0::DOUBLE AS accurate, 0.0::DOUBLE AS reproducible")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(9000).select(F.col("id").alias("idx"), F.when(F.col("id") % 3 == 0, 1e16).when(F.col("id") % 3 == 1, 1.0).otherwise(-1e16).alias("value"))
    accurate = red.reduce_sum(rows, F.col("value"), Policy.ACCURATE, out="accurate")
    return accurate.join(red.reduce_sum(rows, F.col("value"), Policy.REPRODUCIBLE, out="reproducible"))


_REVENUE = f"SELECT row_number() OVER (ORDER BY {', '.join(LINEITEM_ORDER)}) - 1 AS idx, l_extendedprice * l_discount AS v FROM lineitem"


@query("revenue_reproducible", "SELECT 'canonical-pairwise-v1-leaf1024' AS plan, total FROM (" + canonical_sql(_REVENUE) + ")")
def revenue(spark: SparkSession, d: str) -> DataFrame:
    rows = lineitem(spark, d)
    total = red.reduce_sum(rows, F.col("l_extendedprice") * F.col("l_discount"), Policy.REPRODUCIBLE)
    return total.select(F.lit(red.report("sum", Policy.REPRODUCIBLE)["canonical_plan"]).alias("plan"), "total")


@query("policy_report", "SELECT * FROM (VALUES ('sum','Fast','Adaptive','adaptive'), ('sum','Reproducible','CanonicalDeterministic','canonical-pairwise-v1-leaf1024'), ('sum','Accurate','CanonicalDeterministic','canonical-neumaier-v1-leaf1024'), ('norm','Accurate','CanonicalDeterministic','canonical-scaled-sumsq-v1-leaf1024'), ('stencil','Reproducible','CanonicalPointwise','canonical-pointwise-v1-target4096')) t(operation, policy, evaluation_order, canonical_plan)")
def _(spark: SparkSession, d: str) -> DataFrame:
    asked = [("sum", Policy.FAST), ("sum", Policy.REPRODUCIBLE), ("sum", Policy.ACCURATE), ("norm", Policy.ACCURATE), ("stencil", Policy.REPRODUCIBLE)]
    return spark.createDataFrame([red.report(*a) for a in asked], "operation string, policy string, evaluation_order string, canonical_plan string")


@query("reduce_by_group", "SELECT user_id, CAST(floor(sum(value) * 100 + 0.5) AS BIGINT) AS cents FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = red.reduce_sum(events(spark, d), F.col("value"), Policy.ACCURATE, by=["user_id"])
    return found.select("user_id", F.floor(F.col("total") * 100 + 0.5).cast("long").alias("cents"))


@query("transform_reduce_unary", f"SELECT sum({CENTS} * {CENTS})::BIGINT AS total FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return events(spark, d).agg(F.sum(c * c).alias("total"))


@query("transform_reduce_binary", f"SELECT sum({CENTS} * user_id)::BIGINT AS total FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long") * F.col("user_id")).alias("total"))


@query("dot_embeddings", "SELECT a.vec_id, list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, 65), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)), lambda x, y: x + y) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", red.array_dot("embedding", "other").alias("dot"))


@query("dot_reproducible", canonical_sql("SELECT event_id AS idx, value * user_id AS v FROM events").replace("AS total", "AS dot"))
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.dot(events(spark, d), F.col("value"), F.col("user_id").cast("double"), Policy.REPRODUCIBLE)


@query("norm_embeddings", "SELECT vec_id, CAST(floor(sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), lambda x, y: x + y)) * 1e9 + 0.5) AS BIGINT) AS nano FROM embeddings")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.floor(F.sqrt(red.array_dot("embedding", "embedding")) * 1e9 + 0.5).cast("long").alias("nano"))


@query("norm_accurate", "SELECT CAST(floor(sqrt(fsum(value * value)) * 1e6 + 0.5) AS BIGINT) AS micro FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return red.norm(events(spark, d), F.col("value"), Policy.ACCURATE).select(F.floor(F.col("norm") * 1e6 + 0.5).cast("long").alias("micro"))
