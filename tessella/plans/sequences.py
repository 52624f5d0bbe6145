"""Queries over sequences: sources, maps, searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import elementwise as el
from tessella.operators import search, sequence
from tessella.plans.registry import events, query, table

def cents():
    return F.floor(F.col("value") * 100 + 0.5).cast("long")


@query("seq_scan", "SELECT count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.max("idx").alias("last"))


@query("seq_dense_index", "SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx, l_orderkey, l_partkey FROM lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
    return sequence.dense_index(table(spark, d, "lineitem").select(*order), *order).select("idx", "l_orderkey", "l_partkey")


@query("seq_advance", "SELECT event_id - 1000 AS idx, user_id FROM events WHERE event_id >= 1000")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.advance(events(spark, d), 1000).select("idx", "user_id")


@query("seq_index_range", "SELECT i AS idx, i * i AS square FROM range(0, 8192) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.index_range(spark, 0, 8192).withColumn("square", F.col("idx") * F.col("idx"))


@query("seq_for_nd", "SELECT i AS idx, (i // 91)::BIGINT AS i0, ((i // 7) % 13)::BIGINT AS i1, (i % 7)::BIGINT AS i2 FROM range(0, 11 * 13 * 7) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.index_grid(spark, 11, 13, 7)


@query("seq_elements", "SELECT vec_id, (i - 1)::INT AS idx, embedding[i] AS value FROM embeddings, range(1, 65) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.elements(table(spark, d, "embeddings"), "embedding", "vec_id")


@query("strided_gather", "SELECT (event_id - 3) // 7 AS idx, user_id FROM events WHERE event_id >= 3 AND (event_id - 3) % 7 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.strided(events(spark, d), 7, 3).select("idx", "user_id")


@query("image_roi", "SELECT event_id // 64 - 5 AS y, event_id % 64 - 8 AS x, (CAST(floor(value) AS INT) % 256)::INT AS px FROM events WHERE event_id // 64 BETWEEN 5 AND 24 AND event_id % 64 BETWEEN 8 AND 39")
def _(spark: SparkSession, d: str) -> DataFrame:
    image = events(spark, d).select(F.expr("idx div 64").alias("y"), (F.col("idx") % 64).alias("x"), (F.floor("value").cast("int") % 256).alias("px"))
    return sequence.region(image, 5, 8, 20, 32)


@query("dup_mapping_check", "SELECT l_orderkey, l_linenumber, count(*) AS times FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return sequence.duplicate_places(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("chunk_split", "WITH t AS (SELECT ntile(7) OVER (ORDER BY event_id) - 1 AS chunk, event_id FROM events) SELECT chunk, count(*) AS n, min(event_id) AS first FROM t GROUP BY chunk")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    total = F.lit(rows.count())
    return rows.withColumn("chunk", sequence.chunk_of(F.col("idx"), total, 7)).groupBy("chunk").agg(F.count("*").alias("n"), F.min("idx").alias("first"))


@query("leaf_partials", "SELECT event_id // 1024 AS leaf, count(*) AS n, sum(CAST(floor(value * 100 + 0.5) AS BIGINT))::BIGINT AS cents FROM events GROUP BY 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy(sequence.leaf_of(F.col("idx")).alias("leaf")).agg(F.count("*").alias("n"), F.sum(cents()).alias("cents"))


@query("seq_for_each", "SELECT event_id AS idx, value * 2.0 AS value FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return el.for_each(events(spark, d), lambda v: v * 2.0).select("idx", "value")


@query("seq_transform_unary", "SELECT event_id AS idx, value * value + 1.0 AS y FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return el.transform(events(spark, d), "y", lambda v: v * v + 1.0).select("idx", "y")


@query("seq_transform_binary", "SELECT e.event_id AS idx, e.value + o.o_totalprice AS y FROM events e JOIN orders o ON o.o_orderkey = e.event_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), "o_totalprice")
    return el.transform_pairs(events(spark, d).select("idx", "value"), orders, "y", lambda a, b: a + b, "value", "o_totalprice")


@query("seq_copy", "SELECT event_id AS idx, value FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return el.copy(events(spark, d).select("idx", "value"))


@query("seq_fill", "SELECT event_id AS idx, 42::INT AS value FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return el.fill(events(spark, d).select("idx"), 42)


@query("seq_generate", "SELECT i AS idx, i * 3 + 1 AS value FROM range(0, 10000) t(i)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return el.generate(spark, 10000, lambda i: i * 3 + 1)


@query("pair_crossjoin", "SELECT n.n_nationkey AS i, s.s_suppkey AS j, n.n_nationkey * (SELECT count(*) FROM supplier) + s.s_suppkey AS k, (n.n_nationkey * (SELECT count(*) FROM supplier) + s.s_suppkey) % 97 AS y FROM nation n, supplier s")
def _(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "nation").select(F.col("n_nationkey").alias("idx"))
    right = table(spark, d, "supplier").select(F.col("s_suppkey").alias("idx"))
    return el.for_each_pair(left, right, lambda k: k % 97, "y", right.count())


@query("axpy", "SELECT event_id AS idx, 0.375 * value + user_id AS y FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", el.axpy(0.375, F.col("value"), F.col("user_id")).alias("y"))


@query("axpy_arrays", "SELECT a.vec_id, list_transform(range(1, 65), lambda i: 0.5::DOUBLE * a.embedding[i]::DOUBLE + b.embedding[i]::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(other, "vec_id").select("vec_id", el.axpy_arrays(0.5, "embedding", "other").alias("y"))


@query("threshold_binary", "SELECT event_id AS idx, (CASE WHEN CAST(floor(value) AS INT) % 256 > 127 THEN 255 ELSE 0 END)::INT AS px FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", el.threshold(F.floor("value").cast("int") % 256).alias("px"))


@query("threshold_inverse", "SELECT event_id AS idx, (CASE WHEN CAST(floor(value) AS INT) % 256 <= 90 THEN 200 ELSE 0 END)::INT AS px FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", el.threshold(F.floor("value").cast("int") % 256, 90, 200, inverse=True).alias("px"))


@query("saturating", "SELECT event_id AS idx, least(18446744073709551615::HUGEINT, 18446744073709551000::HUGEINT + event_id)::VARCHAR AS total, least(18446744073709551615::HUGEINT, event_id::HUGEINT * 9223372036854775807)::VARCHAR AS product FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    big = F.lit("18446744073709551000").cast("decimal(20,0)")
    return events(spark, d).select("idx", el.saturating_add(big, F.col("idx")).cast("string").alias("total"), el.saturating_multiply(F.col("idx"), F.lit(2**63 - 1)).cast("string").alias("product"))


@query("seq_count_if", "SELECT count(*) FILTER (WHERE value > 50 AND event_type = 'click') AS n FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.count_if(events(spark, d), (F.col("value") > 50) & (F.col("event_type") == "click"))


@query("seq_count_value", "SELECT count(*) FILTER (WHERE user_id = 7) AS n, count(*) FILTER (WHERE value = 6.55) AS m FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return e.agg(F.count_if(search.equals(e, "user_id", 7)).alias("n"), F.count_if(search.equals(e, "value", 6.55)).alias("m"))


@query("seq_any_of", "SELECT coalesce(bool_or(value > 400), false) AS found FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.any_of(events(spark, d), F.col("value") > 400)


@query("seq_all_of", 'SELECT coalesce(bool_and(value > 0), true) AS "all" FROM events')
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.all_of(events(spark, d), F.col("value") > 0)


@query("seq_none_of", 'SELECT NOT coalesce(bool_or(value < 0), false) AS "none" FROM events')
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.none_of(events(spark, d), F.col("value") < 0)


@query("seq_empty_contracts", 'SELECT false AS found, true AS "all", true AS "none", 0::BIGINT AS n, 0::BIGINT AS idx')
def _(spark: SparkSession, d: str) -> DataFrame:
    e, test = events(spark, d).where("idx < 0"), F.col("value") > 0
    none = search.none_of(e, test)
    return search.any_of(e, test).join(search.all_of(e, test)).join(none).join(search.count_if(e, test)).join(search.find_if(e, test))


@query("seq_find_if", "SELECT coalesce(min(event_id) FILTER (WHERE value > 300), count(*)) AS idx FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.find_if(events(spark, d), F.col("value") > 300)


@query("seq_find", "SELECT coalesce(min(event_id) FILTER (WHERE user_id = 46), count(*)) AS idx FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.find(events(spark, d), "user_id", 46)


@query("seq_find_missing", "SELECT coalesce(min(event_id) FILTER (WHERE user_id = -1), count(*)) AS idx FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return search.find(events(spark, d), "user_id", -1)


@query("array_find", "SELECT conv_id, CASE WHEN list_position(turns, 2) IS NULL OR list_position(turns, 2) = 0 THEN len(turns) ELSE list_position(turns, 2) - 1 END::BIGINT AS at FROM (SELECT conv_id, list(turn ORDER BY turn) AS turns FROM conversations GROUP BY conv_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    lists = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    return lists.select("conv_id", search.array_find(F.col("turns"), F.lit(2).cast("long")).cast("long").alias("at"))
