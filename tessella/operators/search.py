"""Counts, predicates and searches, as partial aggregates.

Empty sequences: counts are 0, any is false, all and none are true, and a
search ends at the sequence's end.  A NaN equals nothing, itself included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def equals(df: DataFrame, column: str, value: object) -> Column:
    same = F.col(column) == F.lit(value)
    if isinstance(df.schema[column].dataType, T.DoubleType | T.FloatType):
        same = same & ~F.isnan(column)
    return F.coalesce(same, F.lit(False))


def count_if(df: DataFrame, test: Column, out: str = "n") -> DataFrame:
    return df.agg(F.count_if(test).alias(out))


def count_value(df: DataFrame, column: str, value: object, out: str = "n") -> DataFrame:
    return count_if(df, equals(df, column, value), out)


def any_of(df: DataFrame, test: Column, out: str = "found") -> DataFrame:
    return df.agg(F.coalesce(F.bool_or(test), F.lit(False)).alias(out))


def any_of_early(df: DataFrame, test: Column) -> bool:
    """Stops at the first hit: Spark reads more partitions only while there is none."""
    return not df.where(test).limit(1).isEmpty()


def all_of(df: DataFrame, test: Column, out: str = "all") -> DataFrame:
    return df.agg(F.coalesce(F.bool_and(test), F.lit(True)).alias(out))


def none_of(df: DataFrame, test: Column, out: str = "none") -> DataFrame:
    return df.agg((~F.coalesce(F.bool_or(test), F.lit(False))).alias(out))


def find_if(df: DataFrame, test: Column, out: str = "idx", end: Column | None = None) -> DataFrame:
    """The earliest position that passes, else the end (the number of elements)."""
    return df.agg(F.coalesce(F.min(F.when(test, F.col("idx"))), end if end is not None else F.count("*")).alias(out))


def find(df: DataFrame, column: str, value: object, out: str = "idx") -> DataFrame:
    return find_if(df, equals(df, column, value), out)


def array_find(array: Column, value: object) -> Column:
    """Position of the first equal element of an array column, or its length."""
    at = F.array_position(array, value)
    return F.when(at == 0, F.size(array)).otherwise(at - 1)
