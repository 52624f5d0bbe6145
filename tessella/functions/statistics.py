"""Statistics of timings, as aggregate expressions wherever Spark has them.

Three percentile rules exist side by side: ``percentile_linear`` interpolates,
``upper_median`` takes element n / 2 of the sorted values, and ``lower_rank``
takes element floor(f (n - 1)).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.operators.sequence import dense_index
from tessella.shared import partitions

#: Limits of a stable profile, and constants of the intervals.
STABLE_CV, STABLE_TAIL, STABLE_RATIO = 0.25, 1.75, 2.5
CATASTROPHIC = 0.20
MAD_SIGMA, MEDIAN_ERROR = 1.4826, 1.2533
Z90, Z95 = 1.645, 1.96


def mean(x: str) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def sample_stddev(x: str) -> Column:
    """With n - 1; fewer than two values give 0."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def relative_standard_error(x: str) -> Column:
    usable = (F.avg(x) > 0) & (F.count(x) >= 2)
    return F.when(usable, F.stddev_samp(x) / (F.avg(x) * F.sqrt(F.count(x)))).otherwise(F.lit(float("inf")))


def percentile_linear(x: str | Column, f: float) -> Column:
    return F.percentile(x, f)


def upper_median(values: Column) -> Column:
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def lower_rank(values: Column, f: float) -> Column:
    return F.get(F.sort_array(values), F.floor(F.lit(f) * (F.size(values) - 1)).cast("int"))


def ranked(df: DataFrame, x: str, *by: str) -> DataFrame:
    """``df`` with each value's rank ``_k`` from 0 inside its group, and the group's size ``_n``; null values are left out.

    The order comes from a range partitioning of all groups together, so a
    group of any size, or the only one, lies in as many tasks as it fills.
    """
    rows = dense_index(df.where(F.col(x).isNotNull()).select(*by, x), *by, x, name="_place")
    groups = rows.groupBy(*by).agg(F.min("_place").alias("_first"), F.count("*").alias("_n")) if by else rows.agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    if not by:
        return rows.join(F.broadcast(groups)).withColumn("_k", F.col("_place") - F.col("_first")).drop("_place", "_first")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    met = rows.alias("a").join(groups.alias("b"), same)
    return met.select(*[F.col(f"a.{c}").alias(c) for c in by], F.col(f"a.{x}").alias(x), (F.col("a._place") - F.col("b._first")).alias("_k"), F.col("b._n").alias("_n"))


def percentiles(df: DataFrame, x: str, fractions: dict[str, float], *by: str) -> DataFrame:
    """(by..., one linear percentile a name) by ranks: no task holds a group's values."""
    rows = ranked(df, x, *by)
    found = []
    for name, f in fractions.items():
        place = F.lit(f) * (F.col("_n") - 1)
        low, high = F.floor(place), F.ceil(place)
        below = F.max(F.when(F.col("_k") == low, F.col(x)))
        above = F.max(F.when(F.col("_k") == high, F.col(x)))
        weight = F.max(place - low)
        found.append(F.when(weight == 0, below).otherwise((1.0 - weight) * below + weight * above).alias(name))
    return rows.groupBy(*by).agg(*found) if by else rows.agg(*found)


def trimmed_mean(df: DataFrame, x: str, fraction: float, *by: str, out: str = "trimmed") -> DataFrame:
    """Mean without the floor(n * fraction) least and greatest values; with nothing left, of all values."""
    place = Window.partitionBy(*by).orderBy(x)
    counted = df.withColumn("_k", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    cut = F.floor(F.col("_n") * fraction)
    cut = F.when(cut * 2 >= F.col("_n"), F.lit(0)).otherwise(cut)
    kept = counted.where((F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut))
    return kept.groupBy(*by).agg(F.avg(x).alias(out))


def shape(x: str) -> list[Column]:
    """Variation, tail and stability of one group's values."""
    cv = F.when(F.avg(x) > 0, sample_stddev(x) / F.avg(x)).otherwise(F.lit(0.0))
    tail = F.when(F.percentile(x, 0.5) > 0, F.percentile(x, 0.95) / F.percentile(x, 0.5)).otherwise(F.lit(0.0))
    ratio = F.when(F.avg(x) > 0, F.max(x) / F.avg(x)).otherwise(F.lit(0.0))
    stable = (cv <= STABLE_CV) & (tail <= STABLE_TAIL) & (ratio <= STABLE_RATIO)
    return [cv.alias("cv"), tail.alias("tail_ratio"), ratio.alias("instability"), stable.alias("stable")]


def region_of(idx: Column, total: Column) -> Column:
    """Early, middle or late third of a sequence; a single element is in the middle."""
    f = idx.cast("double") / (total - 1).cast("double")
    return F.when(total <= 1, "middle").when(f < 1.0 / 3.0, "early").when(f < 2.0 / 3.0, "middle").otherwise("late")


def regional_ratio(df: DataFrame, idx: str, x: str, total: Column, *by: str) -> DataFrame:
    """Medians of the thirds and the greatest over the least positive one (1 with fewer than two)."""
    region = region_of(F.col(idx), total)
    rows = df.withColumn("_region", region)
    med = lambda r: F.coalesce(F.percentile(F.when(F.col("_region") == r, F.col(x)), 0.5), F.lit(0.0))
    found = rows.groupBy(*by).agg(med("early").alias("early"), med("middle").alias("middle"), med("late").alias("late"))
    positive = F.filter(F.array("early", "middle", "late"), lambda v: v > 0)
    return found.withColumn("regional_ratio", F.when(F.size(positive) >= 2, F.array_max(positive) / F.array_min(positive)).otherwise(F.lit(1.0)))


def regret_summary(df: DataFrame, x: str) -> DataFrame:
    """One row: mean, percentiles, worst and catastrophic rate of regrets as fractions."""
    rest = df.agg(F.avg(x).alias("mean"), F.max(x).alias("worst"), (F.count_if(F.col(x) > CATASTROPHIC) / F.count(x)).alias("catastrophic_rate"))
    return rest.join(F.broadcast(percentiles(df, x, {"median": 0.5, "p95": 0.95, "p99": 0.99})))


def regret_percent_summary(df: DataFrame, x: str) -> DataFrame:
    """One row: percentiles, worst and counts of regrets in percent."""
    rest = df.agg(F.max(x).alias("worst"), F.count_if(F.col(x) > 10.0).alias("over_10"), F.count_if(F.col(x) > 25.0).alias("over_25"))
    return rest.join(F.broadcast(percentiles(df, x, {"median": 0.5, "p90": 0.9})))


def mad(df: DataFrame, x: str, *by: str) -> DataFrame:
    """(by..., n, median, mad, stddev, mean) with linear percentiles."""
    if not by:  # one group of all values: by ranks, so that no task holds them
        middle = percentiles(df, x, {"median": 0.5})
        apart = df.join(F.broadcast(middle)).withColumn("_away", F.abs(F.col(x) - F.col("median")))
        rest = apart.groupBy("median").agg(F.count(x).alias("n"), sample_stddev(x).alias("stddev"), F.avg(x).alias("mean"))
        return rest.join(F.broadcast(percentiles(apart, "_away", {"mad": 0.5}))).select("median", "n", "mad", "stddev", "mean")
    middle = df.groupBy(*by).agg(F.percentile(x, 0.5).alias("median"))
    joined = df.join(middle, list(by))
    away = F.abs(F.col(x) - F.col("median"))
    return joined.groupBy(*by, "median").agg(F.count(x).alias("n"), F.percentile(away, 0.5).alias("mad"), sample_stddev(x).alias("stddev"), F.avg(x).alias("mean"))


def mad_interval(df: DataFrame, x: str, *by: str, z: float = Z95) -> DataFrame:
    """Median with +- z * 1.4826 * MAD / sqrt(n)."""
    half = z * MAD_SIGMA * F.col("mad") / F.sqrt("n")
    return mad(df, x, *by).withColumn("low", F.col("median") - half).withColumn("high", F.col("median") + half)


def measurement_summary(df: DataFrame, x: str, *by: str, z: float = Z95) -> DataFrame:
    """Median, mean, p90, spread, MAD and an interval of the median; the spread stands in for a MAD of 0."""
    wide = mad(df, x, *by)
    sigma = F.when(F.col("mad") > 0, MAD_SIGMA * F.col("mad")).otherwise(F.col("stddev"))
    half = F.when(F.col("n") > 1, z * MEDIAN_ERROR * sigma / F.sqrt("n")).otherwise(F.lit(0.0))
    p90 = df.groupBy(*by).agg(F.percentile(x, 0.9).alias("p90"))
    place = Window.partitionBy(*by).orderBy(x)
    counted = df.withColumn("_k", F.row_number().over(place)).withColumn("_n", F.count("*").over(Window.partitionBy(*by)))
    cut = F.when(F.col("_n") >= 7, F.floor(F.col("_n") / 10)).otherwise(F.lit(0))
    trimmed = counted.where((F.col("_k") > cut) & (F.col("_k") <= F.col("_n") - cut)).groupBy(*by).agg(F.avg(x).alias("trimmed"))
    return wide.join(p90, list(by)).join(trimmed, list(by)).withColumn("low", F.greatest(F.lit(0.0), F.col("median") - half)).withColumn("high", F.col("median") + half)


def intervals_overlap(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    return (low_a <= high_b) & (low_b <= high_a)


def paired_log_ratio(df: DataFrame, a: str, b: str, *by: str, z: float = Z90) -> DataFrame:
    """exp of the median of ln(a / b) with its interval."""
    logs = df.withColumn("_log", F.log(F.col(a) / F.col(b)))
    wide = mad(logs, "_log", *by)
    half = z * MAD_SIGMA * F.col("mad") / F.sqrt("n")
    return wide.select(*by, "n", F.exp("median").alias("ratio"), F.exp(F.col("median") - half).alias("low"), F.exp(F.col("median") + half).alias("high"))


def ratio(a: Column, b: Column) -> Column:
    """a / b of doubles as IEEE has it: by zero it is infinite or NaN, and no error."""
    infinite = F.when((a == 0) | F.isnan(a), F.lit(float("nan"))).otherwise(F.signum(a) * float("inf"))
    return F.when(b == 0, infinite).otherwise(F.try_divide(a, b))


def gate(low: Column, high: Column, limit: float = 1.05) -> Column:
    """PASS when all of the interval lies below the limit, FAIL when all of it lies above."""
    return F.when(high <= limit, "PASS").when(low > limit, "FAIL").otherwise("INCONCLUSIVE")


def geometric_mean(x: str) -> Column:
    return F.exp(F.avg(F.log(x)))


def poisson_weights(seed: int, rounds: int):
    """A function of a row's ``idx`` that gives its weights in all rounds: Poisson(1) numbers by inversion, to nine, from ``xxhash64(seed, round, idx)`` as in Spark."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda h, n: (h << np.uint64(n)) | (h >> np.uint64(64 - n))

    def last(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(33))) * p2
        h = (h ^ (h >> np.uint64(29))) * p3
        return h ^ (h >> np.uint64(32))

    def of_int(x: np.ndarray, start: np.ndarray) -> np.ndarray:
        return last(turned((start + p5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * p1), 23) * p2 + p3)

    one = of_int(np.array([seed], np.int64).view(np.uint64), np.array([42], np.uint64))
    starts = of_int(np.arange(rounds, dtype=np.uint64), one) + p5 + np.uint64(8)
    edge, term, edges = 0.0, 0.36787944117144233, []
    for k in range(9):
        edge += term
        term /= k + 1
        edges.append(np.uint64(math.ceil(edge * (1 << 53))))

    def weights(idx: int) -> np.ndarray:
        row = turned(np.array([idx], np.int64).view(np.uint64) * p2, 31) * p1
        unit = last(turned(starts ^ row, 27) * p1 + p4) & np.uint64((1 << 53) - 1)
        found = np.zeros(rounds, np.uint8)
        for e in edges:
            found += unit >= e
        return found

    return weights


def bootstrap_interval(df: DataFrame, x: str, rounds: int, seed: int, *, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile bootstrap of the mean with Poisson(1) weights.

    A round's weight for a row comes from a hash of (seed, round, row), so a
    rerun gives the same interval; rows need a unique ``idx``.  A task sums all
    rounds in two arrays, so the shuffle after it carries ``rounds`` rows a
    task.  Rounds in which no row has weight have no mean and are not counted.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = poisson_weights(seed, rounds)
        sums, counts = np.zeros(rounds), np.zeros(rounds, np.int64)
        for batch in batches:
            for idx, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                w = weights(idx)
                sums += w * value
                counts += w
        if counts.any():
            yield pa.RecordBatch.from_pydict({"_round": np.arange(rounds, dtype=np.int32), "_sum": sums, "_weight": counts})

    rows = df.where(F.col(x).isNotNull()).select(F.col("idx").cast("long").alias("idx"), F.col(x).cast("double").alias("_x"))
    parts = rows.repartition(partitions(df.sparkSession), "idx").mapInArrow(summed, "_round int, _sum double, _weight long")
    means = parts.groupBy("_round").agg(F.try_divide(F.sum("_sum"), F.sum("_weight")).alias("_mean"))
    return means.agg(F.percentile("_mean", low).alias("low"), F.percentile("_mean", high).alias("high"), F.count("_mean").alias("rounds"))


def welford(x: str) -> list[Column]:
    """Mean and population variance; Spark merges partial moments in the same manner."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_pop(x).alias("var_pop")]


def running_moments(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """``df`` with n, mean and population variance of a key's values up to each row, by Welford's recurrence; nulls are not counted.

    Spark's own ``var_pop`` multiplies other differences, and rounds otherwise
    where a variance stands at the edge of two results.
    """
    rows = df.repartition(key).sortWithinPartitions(key, order)
    kinds = T.StructType([*rows.schema.fields, T.StructField("n", T.LongType()), T.StructField("mean", T.DoubleType()), T.StructField("var_pop", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, total, mean, squares = None, 0, 0.0, 0.0, 0.0
        for batch in batches:
            counts, means, variances = [], [], []
            for own, v in zip(batch.column(key).to_pylist(), batch.column(x).to_pylist(), strict=True):
                if own != held:
                    held, n, total, mean, squares = own, 0, 0.0, 0.0, 0.0
                if v is not None:
                    v = float(v)
                    n += 1
                    total += v
                    before = mean
                    mean += (v - before) / n
                    squares += (v - before) * (v - mean)
                counts.append(n)
                means.append(total / n if n else None)
                variances.append((squares / n if n > 1 else 0.0) if n else None)
            added = {"n": pa.array(counts, pa.int64()), "mean": pa.array(means, pa.float64()), "var_pop": pa.array(variances, pa.float64())}
            yield pa.RecordBatch.from_arrays([*batch.columns, *added.values()], names=[*batch.schema.names, *added])

    return rows.mapInArrow(run, kinds)


def ordered(df: DataFrame, key: str, order: str, x: str) -> DataFrame:
    """(key, xs): a key's values in order, for folds."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, x))).alias("_o")).select(key, F.transform("_o", lambda s: s[x]).alias("xs"))


def decayed_mean(values: Column, decay: float) -> Column:
    """w' = w * decay + 1, v' = (v * w * decay + x) / w'; the first value seeds."""
    kind = "struct<w:double,v:double>"
    start = F.struct(F.lit(1.0).alias("w"), F.get(values, 0).alias("v")).cast(kind)

    def step(a: Column, x: Column) -> Column:
        old = a["w"] * decay
        return F.struct((old + 1.0).alias("w"), ((a["v"] * old + x) / (old + 1.0)).alias("v")).cast(kind)

    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), start, step)


def blended_mean(values: Column, blend: float) -> Column:
    """v' = (1 - blend) * v + blend * x; the first value seeds."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values), F.lit(1))), F.get(values, 0), lambda a, x: a * (1.0 - blend) + x * blend)


def power_bucket(n: Column) -> Column:
    """The least power of two that is n or more; 0 stays 0."""
    return F.when(n == 0, F.lit(0)).when(n == 1, F.lit(1)).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1)))).cast("long")


def real_bucket(x: Column) -> Column:
    """(exponent + 2048) * 16 + floor(16 * mantissa) with the mantissa in [1/2, 1); 0 for what is not positive and finite."""
    # the exponent comes from a logarithm and is put right where rounding moved it across a power of two
    guess = F.floor(F.log2(x)).cast("int")
    exponent = guess + F.when(x >= F.pow(F.lit(2.0), guess + 1), 1).otherwise(0) - F.when(x < F.pow(F.lit(2.0), guess), 1).otherwise(0) + 1
    mantissa = x / F.pow(F.lit(2.0), exponent)
    usable = ~F.isnan(x) & (x > 0) & (x != float("inf"))
    return F.when(usable, (exponent + 2048) * 16 + F.least(F.lit(15), F.floor(mantissa * 16))).otherwise(F.lit(0)).cast("long")


def checksum(*columns: str) -> Column:
    """Order-free xor of row hashes."""
    return F.bit_xor(F.xxhash64(*columns))


def digest(*columns: str | Column) -> Column:
    """SHA-256 of values as text, separated and with nulls marked."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("\u0000")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def stratum_start(sample: Column, samples: Column, total: Column, batch: Column) -> Column:
    """Begin of a sample's batch: a hashed place inside the sample's stratum."""
    last = total - batch
    begin = F.floor(sample * (last + 1) / samples)
    end = F.floor((sample + 1) * (last + 1) / samples) - 1
    jitter = F.pmod(F.xxhash64(sample + total), F.greatest(end - begin + 1, F.lit(1)))
    return F.when((total <= batch) | (samples == 0), F.lit(0)).otherwise(F.least(last, F.when(end <= begin, begin).otherwise(begin + jitter))).cast("long")


def prefix_samples(total: int, samples: int) -> Sequence[int]:
    """Evenly strided places that begin at 0."""
    if total <= 0 or samples <= 0:
        return []
    stride = max(1, total // samples)
    return [k * stride for k in range(min(samples, -(-total // stride)))]


#: Fixed value: a choice this close to the best counts as right.
NEAR_OPTIMAL = 0.03


def holdout_scores(plans: DataFrame, case: str, plan: str) -> DataFrame:
    """One row a case of ``plans(case, plan, ms, low, high, predicted)``: the plan of least predicted time against that of least measured time.

    The choice is within tolerance if it takes at most ``NEAR_OPTIMAL`` longer
    or if the intervals of both overlap.  Errors and regrets are in percent of
    the best time, 0 where that is 0.
    """
    fields = F.struct("ms", plan, "low", "high", "predicted")
    cases = plans.groupBy(case).agg(F.min(fields).alias("b"), F.min(F.struct("predicted", plan, "ms", "low", "high")).alias("c"))
    best, chosen = (lambda n: F.col(f"b.{n}")), (lambda n: F.col(f"c.{n}"))
    percent = lambda x: F.when(best("ms") > 0, x / best("ms") * 100).otherwise(F.lit(0.0))
    return cases.select(
        case,
        best(plan).alias("best"),
        chosen(plan).alias("chosen"),
        (best(plan) == chosen(plan)).alias("exact_winner"),
        ((chosen("ms") <= best("ms") * (1.0 + NEAR_OPTIMAL)) | intervals_overlap(chosen("low"), chosen("high"), best("low"), best("high"))).alias("within_tolerance"),
        percent(F.abs(chosen("predicted") - best("ms"))).alias("prediction_error_percent"),
        percent(chosen("ms") - best("ms")).alias("regret_percent"),
    )
