"""Maps over sequences.  All are narrow: no shuffle unless two sequences are zipped."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators.sequence import index_range, zipped

U64 = 2**64 - 1
POINTWISE_PLANS = ("canonical-pointwise-v1-target4096", "canonical-pointwise-2d-v1-target4096")


def transform(df: DataFrame, out: str, op: Callable[[Column], Column], value: str = "value") -> DataFrame:
    return df.withColumn(out, op(F.col(value)))


def for_each(df: DataFrame, op: Callable[[Column], Column], value: str = "value") -> DataFrame:
    """In-place map."""
    return df.withColumn(value, op(F.col(value)))


def transform_pairs(left: DataFrame, right: DataFrame, out: str, op: Callable[[Column, Column], Column], a: str, b: str) -> DataFrame:
    return zipped(left, right, checked=False).select("idx", op(F.col(a), F.col(b)).alias(out))


def copy(df: DataFrame) -> DataFrame:
    return df.select(*df.columns)


def fill(df: DataFrame, value: object, out: str = "value") -> DataFrame:
    return df.withColumn(out, F.lit(value))


def generate(spark: SparkSession, count: int, op: Callable[[Column], Column], out: str = "value") -> DataFrame:
    """The generator gets the index."""
    return index_range(spark, 0, count).withColumn(out, op(F.col("idx")))


def for_each_pair(left: DataFrame, right: DataFrame, op: Callable[[Column], Column], out: str, right_extent: int) -> DataFrame:
    """Every pair (i, j) in row-major order, k = i * extent(right) + j; a Cartesian product by definition."""
    a = left.withColumnRenamed("idx", "i")
    b = right.withColumnRenamed("idx", "j")
    pairs = a.crossJoin(b).withColumn("k", F.col("i") * right_extent + F.col("j"))
    return pairs.withColumn(out, op(F.col("k")))


def axpy(alpha: float, x: Column, y: Column) -> Column:
    """alpha * x + y, for columns of one row."""
    return F.lit(float(alpha)) * x + y


def axpy_arrays(alpha: float, x: str, y: str) -> Column:
    """alpha * x + y for array columns; unequal lengths are an error."""
    same = F.assert_true(F.size(x) == F.size(y), F.lit("axpy needs equal extents"))
    summed = F.zip_with(x, y, lambda a, b: F.lit(float(alpha)) * a.cast("double") + b.cast("double"))
    return F.when(same.isNull(), summed)


def threshold(pixel: Column, limit: int = 127, most: int = 255, inverse: bool = False) -> Column:
    """Binary: above the limit ``most``, else 0; inverse: at or below the limit ``most``, else 0.  Eight-bit values."""
    if not (0 <= limit <= 255 and 0 <= most <= 255):
        raise ValueError("limit and most must be in 0..255")
    hit = pixel <= limit if inverse else pixel > limit
    return F.when(hit, F.lit(most)).otherwise(F.lit(0))


def threshold_batches(df: DataFrame, column: str, out: str, limit: int = 127, most: int = 255) -> DataFrame:
    """The provider route: whole Arrow batches in numpy, for a library that Spark does not have.  The plain route is faster."""

    @F.pandas_udf("int")
    def batch(px: pd.Series) -> pd.Series:
        return ((px > limit) * most).astype("int32")

    return df.withColumn(out, batch(F.col(column)))


def _saturated(value: Column) -> Column:
    return F.least(value, F.lit(str(U64)).cast("decimal(38,0)")).cast("decimal(20,0)")


def saturating_add(a: Column, b: Column) -> Column:
    """Sum of unsigned 64-bit numbers, cut at the largest."""
    return _saturated(a.cast("decimal(20,0)") + b.cast("decimal(20,0)"))


def saturating_multiply(a: Column, b: Column) -> Column:
    """Product of unsigned 64-bit numbers, cut at the largest; what even 38 digits cannot hold is cut too."""
    product = F.try_multiply(a.cast("decimal(20,0)").cast("decimal(38,0)"), b.cast("decimal(20,0)").cast("decimal(38,0)")).cast("decimal(38,0)")
    return F.coalesce(_saturated(product), F.when(a.isNotNull() & b.isNotNull(), F.lit(str(U64)).cast("decimal(20,0)")))
