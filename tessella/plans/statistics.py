"""Queries of timing statistics: ``events.value`` in ms, ``user_id`` the workload, ``event_type`` the plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import statistics as st
from tessella.plans.registry import events, query, table


def micro(name: str):
    """Whole millionths; 0.4 keeps clear of the halves that means of cents often are."""
    return F.floor(F.col(name) * 1e6 + 0.4).cast("long").alias(name)


def micro_sql(expression: str, name: str) -> str:
    return f"CAST(floor(({expression}) * 1e6 + 0.4) AS BIGINT) AS {name}"


@query("stats_mean_stddev", f"SELECT user_id, {micro_sql('avg(value)', 'mean')}, {micro_sql('coalesce(stddev_samp(value), 0)', 'stddev')}, {micro_sql('stddev_samp(value) / (avg(value) * sqrt(count(*)))', 'rse')} FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = events(spark, d).groupBy("user_id").agg(st.mean("value").alias("mean"), st.sample_stddev("value").alias("stddev"), st.relative_standard_error("value").alias("rse"))
    return found.select("user_id", micro("mean"), micro("stddev"), micro("rse"))


@query("stats_percentiles", f"SELECT event_type, {micro_sql('quantile_cont(value, 0.5)', 'p50')}, {micro_sql('quantile_cont(value, 0.95)', 'p95')}, {micro_sql('quantile_cont(value, 0.99)', 'p99')} FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = st.percentiles(events(spark, d), "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, "event_type")
    return found.select("event_type", micro("p50"), micro("p95"), micro("p99"))


@query("stats_trimmed_mean", f"WITH k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, {micro_sql('avg(value)', 'trimmed')} FROM k WHERE k > floor(n * 0.1) AND k <= n - floor(n * 0.1) GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return st.trimmed_mean(events(spark, d), "value", 0.1, "user_id").select("user_id", micro("trimmed"))


@query("stats_shape", f"""SELECT user_id, {micro_sql('stddev_samp(value) / avg(value)', 'cv')}, {micro_sql('quantile_cont(value, 0.95) / quantile_cont(value, 0.5)', 'tail_ratio')}, {micro_sql('max(value) / avg(value)', 'instability')},
  stddev_samp(value) / avg(value) <= 0.25 AND quantile_cont(value, 0.95) / quantile_cont(value, 0.5) <= 1.75 AND max(value) / avg(value) <= 2.5 AS stable FROM events GROUP BY user_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = events(spark, d).groupBy("user_id").agg(*st.shape("value"))
    return found.select("user_id", micro("cv"), micro("tail_ratio"), micro("instability"), "stable")


@query("stats_regional", f"""WITH r AS (SELECT user_id, value, CASE WHEN event_id::DOUBLE / ((SELECT count(*) FROM events) - 1)::DOUBLE < 1.0 / 3.0 THEN 0 WHEN event_id::DOUBLE / ((SELECT count(*) FROM events) - 1)::DOUBLE < 2.0 / 3.0 THEN 1 ELSE 2 END AS part FROM events),
m AS (SELECT user_id, quantile_cont(value, 0.5) FILTER (WHERE part = 0) AS early, quantile_cont(value, 0.5) FILTER (WHERE part = 1) AS middle, quantile_cont(value, 0.5) FILTER (WHERE part = 2) AS late FROM r GROUP BY user_id)
SELECT user_id, coalesce(early, 0) AS early, coalesce(middle, 0) AS middle, coalesce(late, 0) AS late, {micro_sql('CASE WHEN (early IS NOT NULL)::INT + (middle IS NOT NULL)::INT + (late IS NOT NULL)::INT >= 2 THEN greatest(early, middle, late) / least(early, middle, late) ELSE 1.0 END', 'regional_ratio')} FROM m""")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    return st.regional_ratio(rows, "idx", "value", F.lit(rows.count()), "user_id").withColumn("regional_ratio", micro("regional_ratio"))


_REGRET = "SELECT user_id, event_type, avg(value) AS ms FROM events GROUP BY ALL"
_BEST = f"SELECT user_id, event_type, ms, ms / min(ms) OVER (PARTITION BY user_id) - 1 AS regret FROM ({_REGRET})"


def regrets(spark: SparkSession, d: str) -> DataFrame:
    """Each plan's mean against the best of its workload."""
    from pyspark.sql import Window

    means = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("ms"))
    return means.withColumn("regret", F.col("ms") / F.min("ms").over(Window.partitionBy("user_id")) - 1)


@query("regret_summary", f"SELECT {micro_sql('avg(regret)', 'mean')}, {micro_sql('quantile_cont(regret, 0.5)', 'median')}, {micro_sql('quantile_cont(regret, 0.95)', 'p95')}, {micro_sql('quantile_cont(regret, 0.99)', 'p99')}, {micro_sql('max(regret)', 'worst')}, {micro_sql('count(*) FILTER (WHERE regret > 0.2) / count(*)', 'catastrophic_rate')} FROM ({_BEST})")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = st.regret_summary(regrets(spark, d), "regret")
    return found.select(*[micro(c) for c in found.columns])


@query("regret_percent", f"SELECT {micro_sql('quantile_cont(r, 0.5)', 'median')}, {micro_sql('quantile_cont(r, 0.9)', 'p90')}, {micro_sql('max(r)', 'worst')}, count(*) FILTER (WHERE r > 10) AS over_10, count(*) FILTER (WHERE r > 25) AS over_25 FROM (SELECT regret * 100 AS r FROM ({_BEST}))")
def _(spark: SparkSession, d: str) -> DataFrame:
    found = st.regret_percent_summary(regrets(spark, d).select((F.col("regret") * 100).alias("r")), "r")
    return found.select(micro("median"), micro("p90"), micro("worst"), "over_10", "over_25")


@query("upper_median_mad", "WITH g AS (SELECT user_id, list_sort(list(value)) AS xs FROM events GROUP BY user_id), m AS (SELECT user_id, xs, xs[len(xs) // 2 + 1] AS median FROM g) SELECT user_id, median, list_sort(list_transform(xs, lambda x: abs(x - median)))[len(xs) // 2 + 1] AS mad FROM m")
def _(spark: SparkSession, d: str) -> DataFrame:
    lists = events(spark, d).groupBy("user_id").agg(F.collect_list("value").alias("xs")).withColumn("median", st.upper_median(F.col("xs")))
    return lists.select("user_id", "median", st.upper_median(F.transform("xs", lambda x: F.abs(x - F.col("median")))).alias("mad"))


@query("lower_rank_percentile", "SELECT user_id, list_sort(list(value))[CAST(floor(0.9 * (count(*) - 1)) AS INT) + 1] AS p90 FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(st.lower_rank(F.collect_list("value"), 0.9).alias("p90"))


@query("grouped_summaries", "SELECT event_type, count(*) AS n, min(value) AS least, max(value) AS most, quantile_cont(value, 0.5) AS median, bool_and(value < 480) AS all_pass, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", 0.5).alias("median"), F.bool_and(F.col("value") < 480).alias("all_pass"), F.count_distinct("user_id").alias("users"))


_MAD = "WITH m AS (SELECT user_id, quantile_cont(value, 0.5) AS median FROM events GROUP BY user_id), g AS (SELECT e.user_id, m.median, count(*) AS n, quantile_cont(abs(value - median), 0.5) AS mad, coalesce(stddev_samp(value), 0) AS sd, avg(value) AS mean FROM events e JOIN m USING (user_id) GROUP BY e.user_id, m.median)"


@query("mad_ci", f"{_MAD} SELECT user_id, median, {micro_sql('mad', 'mad')}, {micro_sql('median - 1.96 * 1.4826 * mad / sqrt(n)', 'low')}, {micro_sql('median + 1.96 * 1.4826 * mad / sqrt(n)', 'high')} FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    return st.mad_interval(events(spark, d), "value", "user_id").select("user_id", "median", micro("mad"), micro("low"), micro("high"))


_HALF = "CASE WHEN n > 1 THEN 1.96 * 1.2533 * (CASE WHEN mad > 0 THEN 1.4826 * mad ELSE sd END) / sqrt(n) ELSE 0 END"
_MEASURED = f"""{_MAD}, k AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
t AS (SELECT user_id, avg(value) FILTER (WHERE k > CASE WHEN n >= 7 THEN n // 10 ELSE 0 END AND k <= n - CASE WHEN n >= 7 THEN n // 10 ELSE 0 END) AS trimmed, quantile_cont(value, 0.9) AS p90 FROM k GROUP BY user_id)"""


@query("measurement_summary", f"{_MEASURED} SELECT user_id, n, median, {micro_sql('mean', 'mean')}, {micro_sql('sd', 'stddev')}, {micro_sql('mad', 'mad')}, {micro_sql('p90', 'p90')}, {micro_sql('trimmed', 'trimmed')}, {micro_sql(f'greatest(0, median - {_HALF})', 'low')}, {micro_sql(f'median + {_HALF}', 'high')} FROM g JOIN t USING (user_id)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return st.measurement_summary(events(spark, d), "value", "user_id").select("user_id", "n", "median", micro("mean"), micro("stddev"), micro("mad"), micro("p90"), micro("trimmed"), micro("low"), micro("high"))


@query("ci_overlap", f"{_MAD}, i AS (SELECT user_id, greatest(0, median - {_HALF}) AS low, median + {_HALF} AS high FROM g) SELECT a.user_id, b.user_id AS other, a.low <= b.high AND b.low <= a.high AS overlap FROM i a JOIN i b ON b.user_id = a.user_id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = st.measurement_summary(events(spark, d), "value", "user_id").select("user_id", "low", "high")
    b = a.select((F.col("user_id") - 1).alias("user_id"), F.col("low").alias("l2"), F.col("high").alias("h2"))
    return a.join(b, "user_id").select("user_id", (F.col("user_id") + 1).alias("other"), st.intervals_overlap(F.col("low"), F.col("high"), F.col("l2"), F.col("h2")).alias("overlap"))


_PAIRED = "WITH l AS (SELECT e.event_type, ln(e.value / (o.o_totalprice / 1000)) AS x FROM events e JOIN orders o ON o.o_orderkey = e.event_id WHERE e.value > 0), m AS (SELECT event_type, quantile_cont(x, 0.5) AS med FROM l GROUP BY 1), g AS (SELECT l.event_type, count(*) AS n, med, quantile_cont(abs(x - med), 0.5) AS mad FROM l JOIN m USING (event_type) GROUP BY l.event_type, med)"


@query("paired_log_ratio", f"{_PAIRED} SELECT event_type, n, {micro_sql('exp(med)', 'ratio')}, {micro_sql('exp(med - 1.645 * 1.4826 * mad / sqrt(n))', 'low')}, {micro_sql('exp(med + 1.645 * 1.4826 * mad / sqrt(n))', 'high')}, CASE WHEN exp(med + 1.645 * 1.4826 * mad / sqrt(n)) <= 1.05 THEN 'PASS' WHEN exp(med - 1.645 * 1.4826 * mad / sqrt(n)) > 1.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS gate FROM g")
def _(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 1000).alias("other"))
    found = st.paired_log_ratio(events(spark, d).where("value > 0").join(orders, "idx"), "value", "other", "event_type")
    return found.select("event_type", "n", micro("ratio"), micro("low"), micro("high"), st.gate(F.col("low"), F.col("high")).alias("gate"))


@query("paired_repetitions", """WITH p AS (SELECT user_id, event_id // 100 AS rep, quantile_cont(value, 0.5) FILTER (WHERE event_type = 'click') AS a, quantile_cont(value, 0.5) FILTER (WHERE event_type = 'view') AS b FROM events GROUP BY 1, 2),
r AS (SELECT user_id, a / b AS x FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT user_id, count(*) AS pairs, """ + micro_sql("quantile_cont(x, 0.5)", "ratio") + """, CASE WHEN quantile_cont(x, 0.975) <= 1.05 THEN 'PASS' WHEN quantile_cont(x, 0.025) > 1.05 THEN 'FAIL' ELSE 'INCONCLUSIVE' END AS gate FROM r GROUP BY user_id""")
def _(spark: SparkSession, d: str) -> DataFrame:
    middle = lambda kind: F.percentile(F.when(F.col("event_type") == kind, F.col("value")), 0.5)
    pairs = events(spark, d).groupBy("user_id", F.expr("idx div 100").alias("rep")).agg(middle("click").alias("a"), middle("view").alias("b"))
    ratios = pairs.where("a is not null and b is not null").withColumn("x", st.ratio(F.col("a"), F.col("b")))
    found = ratios.groupBy("user_id").agg(F.count("*").alias("pairs"), F.percentile("x", 0.5).alias("ratio"), F.percentile("x", 0.025).alias("low"), F.percentile("x", 0.975).alias("high"))
    finite = found.withColumn("ratio", F.when(F.abs("ratio") < float("inf"), F.col("ratio")))  # others have no whole millionths
    return finite.select("user_id", "pairs", micro("ratio"), st.gate(F.col("low"), F.col("high")).alias("gate"))


@query("bootstrap_ci")
def _(spark: SparkSession, d: str) -> DataFrame:
    return st.bootstrap_interval(events(spark, d), "value", 10_000, 11)


@query("geo_mean", f"SELECT event_type, {micro_sql('exp(avg(ln(value)))', 'geo')} FROM events WHERE value > 0 GROUP BY event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("value > 0").groupBy("event_type").agg(st.geometric_mean("value").alias("geo")).select("event_type", micro("geo"))


@query("welford_moments", f"SELECT user_id, count(*) AS n, {micro_sql('avg(value)', 'mean')}, {micro_sql('var_pop(value)', 'var_pop')} FROM events GROUP BY user_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).groupBy("user_id").agg(*st.welford("value")).select("user_id", "n", micro("mean"), micro("var_pop"))


@query("running_moments", f"SELECT event_id AS idx, count(*) OVER w AS n, {micro_sql('avg(value) OVER w', 'mean')}, CAST(floor((var_pop(value) OVER w) * 100 + 0.4) AS BIGINT) AS var_pop FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return st.running_moments(events(spark, d).select("user_id", "idx", "value"), "user_id", "idx", "value").select("idx", "n", micro("mean"), F.floor(F.col("var_pop") * 100 + 0.4).cast("long").alias("var_pop"))


_LISTS = "SELECT user_id, list(value ORDER BY event_id) AS xs FROM events GROUP BY user_id"


@query("ewma_decay", f"SELECT user_id, {micro_sql('list_reduce(list_transform(xs, lambda x: {v: x, w: 1.0::DOUBLE}), lambda a, x: {v: (a.v * (a.w * 0.97) + x.v) / (a.w * 0.97 + 1.0), w: a.w * 0.97 + 1.0}).v', 'ewma')} FROM ({_LISTS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    lists = st.ordered(events(spark, d), "user_id", "idx", "value")
    return lists.select("user_id", st.decayed_mean(F.col("xs"), 0.97)["v"].alias("ewma")).select("user_id", micro("ewma"))


@query("ema_blend", f"SELECT user_id, {micro_sql('list_reduce(xs, lambda a, x: a * 0.75 + x * 0.25)', 'ema')} FROM ({_LISTS})")
def _(spark: SparkSession, d: str) -> DataFrame:
    lists = st.ordered(events(spark, d), "user_id", "idx", "value")
    return lists.select("user_id", st.blended_mean(F.col("xs"), 0.25).alias("ema")).select("user_id", micro("ema"))


@query("pow2_bucket", "SELECT event_id AS idx, CASE WHEN event_id <= 1 THEN event_id ELSE (1::BIGINT << (len(bin(event_id - 1)))::BIGINT) END AS bucket FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", st.power_bucket(F.col("idx")).alias("bucket"))


@query("real_bucket", "WITH e AS (SELECT event_id AS idx, value, floor(log2(value)) AS g FROM events WHERE value > 0), f AS (SELECT idx, value, g + (CASE WHEN value >= pow(2, g + 1) THEN 1 ELSE 0 END) - (CASE WHEN value < pow(2, g) THEN 1 ELSE 0 END) + 1 AS x FROM e) SELECT idx, CAST((x + 2048) * 16 + floor(value / pow(2, x) * 16) AS BIGINT) AS bucket FROM f UNION ALL SELECT event_id, 0 FROM events WHERE value <= 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", st.real_bucket(F.col("value")).alias("bucket"))


@query("order_free_checksum", "SELECT count(*) AS n, true AS same FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    one = e.agg(F.count("*").alias("n"), st.checksum("idx", "value").alias("a"))
    other = e.repartition(5, "user_id").agg(st.checksum("idx", "value").alias("b"))
    return one.join(other).select("n", (F.col("a") == F.col("b")).alias("same"))


@query("sha256_digest", "SELECT event_id AS idx, sha256(user_id || chr(31) || event_type) AS digest FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("idx", st.digest("user_id", "event_type").alias("digest"))


@query("scalar_math", f"SELECT event_id AS idx, {micro_sql('sin(value)', 's')}, {micro_sql('cos(value)', 'c')}, {micro_sql('exp(-value / 100)', 'e')}, {micro_sql('sqrt(value)', 'q')}, {micro_sql('ln(1 + value)', 'l')}, {micro_sql('pow(value, 0.5)', 'p')}, least(greatest(value, 10.0), 90.0) AS clamped FROM events")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    found = events(spark, d).select("idx", F.sin(v).alias("s"), F.cos(v).alias("c"), F.exp(-v / 100).alias("e"), F.sqrt(v).alias("q"), F.log1p(v).alias("l"), F.pow(v, F.lit(0.5)).alias("p"), F.least(F.greatest(v, F.lit(10.0)), F.lit(90.0)).alias("clamped"))
    return found.select("idx", *[micro(c) for c in "sceqlp"], "clamped")


@query("plan_string_split", "SELECT event_id AS idx, split_part(p, '/', 1) AS engine, split_part(p, '/', 2) AS strategy, CAST(regexp_extract(p, 'w([0-9]+)', 1) AS INT) AS workers, CAST(regexp_extract(p, '/c([0-9]+)', 1) AS INT) AS chunk FROM (SELECT event_id, 'pool/' || event_type || '/w' || (user_id % 16 + 1) || '/c' || (event_id % 512 + 1) AS p FROM events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    plan = F.concat(F.lit("pool/"), F.col("event_type"), F.lit("/w"), (F.col("user_id") % 16 + 1).cast("string"), F.lit("/c"), (F.col("idx") % 512 + 1).cast("string"))
    parts = F.split("p", "/")
    return events(spark, d).select("idx", plan.alias("p")).select("idx", F.get(parts, 0).alias("engine"), F.get(parts, 1).alias("strategy"), F.regexp_extract("p", "w([0-9]+)", 1).cast("int").alias("workers"), F.regexp_extract("p", "/c([0-9]+)", 1).cast("int").alias("chunk"))


@query("stratified_samples")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    total = rows.count()
    places = spark.range(64).select(st.stratum_start(F.col("id"), F.lit(64), F.lit(total), F.lit(8)).alias("idx"))
    return places.join(rows, "idx").select("idx", "value")


@query("prefix_samples", "SELECT event_id AS idx, value FROM events WHERE event_id % ((SELECT count(*) FROM events) // 100) = 0 AND event_id < 100 * ((SELECT count(*) FROM events) // 100)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d)
    places = spark.createDataFrame([(i,) for i in st.prefix_samples(rows.count(), 100)], "idx long")
    return rows.join(F.broadcast(places), "idx").select("idx", "value")


_TIMED = """SELECT user_id, event_type, avg(value) AS ms, avg(value) - 1.96::DOUBLE * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS low, avg(value) + 1.96::DOUBLE * coalesce(stddev_samp(value), 0) / sqrt(count(*)) AS high, length(event_type) * 8.0::DOUBLE AS predicted FROM events GROUP BY ALL"""


@query("holdout_scoring", f"""WITH m AS ({_TIMED}), b AS (SELECT user_id, unnest(min_by(m, (ms, event_type))) FROM m GROUP BY user_id), c AS (SELECT user_id, unnest(min_by(m, (predicted, event_type))) FROM m GROUP BY user_id)
SELECT b.user_id, b.event_type AS best, c.event_type AS chosen, b.event_type = c.event_type AS exact_winner, c.ms <= b.ms * 1.03 OR (c.low <= b.high AND b.low <= c.high) AS within_tolerance,
  {micro_sql('CASE WHEN b.ms > 0 THEN abs(c.predicted - b.ms) / b.ms * 100 ELSE 0 END', 'prediction_error_percent')}, {micro_sql('CASE WHEN b.ms > 0 THEN (c.ms - b.ms) / b.ms * 100 ELSE 0 END', 'regret_percent')} FROM b JOIN c USING (user_id)""")
def _(spark: SparkSession, d: str) -> DataFrame:
    """The plan with the least predicted time against the measured best one of each workload."""
    half = 1.96 * F.coalesce(F.stddev_samp("value"), F.lit(0.0)) / F.sqrt(F.count("*"))
    means = events(spark, d).groupBy("user_id", "event_type").agg(F.avg("value").alias("ms"), (F.avg("value") - half).alias("low"), (F.avg("value") + half).alias("high"))
    means = means.withColumn("predicted", F.length("event_type") * 8.0)
    found = st.holdout_scores(means, "user_id", "event_type")
    return found.select("user_id", "best", "chosen", "exact_winner", "within_tolerance", micro("prediction_error_percent"), micro("regret_percent"))
