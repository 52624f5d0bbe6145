"""Experience records as text: one line of numbers a workload and plan, under a header that ends in its version.

Four layouts are read, the last one is written.  What an older layout does not
have gets its default.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fields of a line in their order, with the first version that has them and their default.
FIELDS = (
    ("fingerprint", "decimal(20,0)", 1, None),
    ("engine", "int", 1, None),
    ("strategy", "int", 1, None),
    ("job_count", "bigint", 1, None),
    ("chunk_size", "bigint", 3, 0),
    ("best_elapsed_ms", "double", 1, None),
    ("average_elapsed_ms", "double", 1, None),
    ("last_elapsed_ms", "double", 1, None),
    ("variance_ms", "double", 1, None),
    ("standard_deviation_ms", "double", 1, None),
    ("sample_count", "bigint", 1, None),
    ("confidence", "double", 1, None),
    ("last_predicted_ms", "double", 2, 0.0),
    ("last_prediction_error_percent", "double", 2, 0.0),
    ("average_absolute_prediction_error_percent", "double", 2, 0.0),
    ("average_runtime_correction", "double", 2, 1.0),
    ("prediction_sample_count", "bigint", 2, 0),
    ("kind_bucket", "bigint", 4, 0),
    ("iteration_bucket", "bigint", 4, 0),
    ("working_set_bucket", "bigint", 4, 0),
    ("object_size_bucket", "bigint", 4, 0),
    ("function_cost_bucket", "bigint", 4, 0),
    ("variation_bucket", "bigint", 4, 0),
    ("effective_sample_weight", "double", 4, 0.0),
    ("decayed_elapsed_ms", "double", 4, 0.0),
    ("decayed_regret_percent", "double", 4, 0.0),
    ("decayed_success_rate", "double", 4, 0.5),
    ("last_regret_percent", "double", 4, 0.0),
    ("outcome_sample_count", "bigint", 4, 0),
)
KEY = ("fingerprint", "engine", "strategy", "job_count", "chunk_size")
HEADER = "^[A-Z][A-Z_]*_V([0-9]+)$"
VERSION = 4


def write_experience(df: DataFrame, path: str) -> None:
    """All fields of ``df``, defaults for those that it does not have; the header is a line of its own."""
    missing = [name for name, _, first, _ in FIELDS if first == 1 and name not in df.columns]
    if missing:
        raise ValueError(f"without {', '.join(missing)} there is no record")
    values = [F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind)).cast("string") if name in df.columns else F.lit(str(default)) for name, kind, _, default in FIELDS]
    # a null would shift the fields after it
    whole = F.assert_true(F.forall(F.array(*values), lambda v: v.isNotNull()), F.lit("a record has no null"))
    lines = df.select(F.concat_ws(" ", *values).alias("value"), whole.alias("_whole")).where("_whole is null").select("value")
    header = df.sparkSession.createDataFrame([(f"EXPERIENCE_V{VERSION}",)], "value string")
    header.union(lines).write.mode("overwrite").text(path)


def read_experience(spark: SparkSession, path: str) -> DataFrame:
    """The records of a file or folder in any of the layouts; without a header it is the first.

    Lines with too few numbers, or with something else in their places, are
    left out; of two lines of one workload and plan the later one counts.
    """
    lines = spark.read.text(path)
    found = sorted({int(r[0]) for r in lines.where(F.col("value").rlike(HEADER)).select(F.regexp_extract("value", HEADER, 1)).distinct().collect()})
    if len(found) > 1 or (found and not 2 <= found[0] <= VERSION):
        raise ValueError(f"not one known version: {found}")
    version = found[0] if found else 1
    parts = F.split(F.trim("value"), "\\s+")
    have = [f for f in FIELDS if f[2] <= version]

    def value(name: str, kind: str, default: float | int | None) -> Column:
        names = [f[0] for f in have]
        return F.get(F.col("_parts"), names.index(name)).try_cast(kind) if name in names else F.lit(default).cast(kind)

    rows = lines.where(~F.col("value").rlike(HEADER)).select(parts.alias("_parts"), F.monotonically_increasing_id().alias("_line"))
    rows = rows.select("_line", *[value(name, kind, default).alias(name) for name, kind, _, default in FIELDS])
    rows = rows.where(F.forall(F.array(*[F.col(f[0]).isNotNull() for f in FIELDS]), lambda x: x))
    rest = [f[0] for f in FIELDS if f[0] not in KEY]
    last = rows.groupBy(*KEY).agg(F.max_by(F.struct(*rest), "_line").alias("_r"))
    return last.select(*[F.col(f[0]) if f[0] in KEY else F.col(f"_r.{f[0]}").alias(f[0]) for f in FIELDS])
