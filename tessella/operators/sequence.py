"""Sequences: DataFrames whose rows have a dense position ``idx`` from 0.

A null value is outside a sequence: filter it before numbering.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.shared import materialize, partitions

LEAF = 1024


def dense_index(df: DataFrame, *order: str | Column, name: str = "idx") -> DataFrame:
    """Number rows 0, 1, ... in a total order without a single-task sort.

    Rows are range-partitioned and sorted, numbered inside each partition, and
    moved up by the partitions' running counts, a table of one row a partition.
    The sorted rows are written once, so that both passes see the same split.
    """
    ranged = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    ahead = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_ahead"))
    return placed.withColumn("_part", part).join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + inside).drop("_part", "_at", "_ahead")


def index_range(spark: SparkSession, begin: int, end: int) -> DataFrame:
    """Positions begin..end-1; an end before the beginning is an error, an empty range is not."""
    if end < begin:
        raise ValueError("the range ends before it begins")
    return spark.range(begin, end).withColumnRenamed("id", "idx")


def index_grid(spark: SparkSession, *extents: int) -> DataFrame:
    """All index tuples of an n-dimensional range, flattened in row-major order: idx, i0, i1, ..."""
    if not extents or any(e < 0 for e in extents):
        raise ValueError("extents must be given and not negative")
    if prod(extents) >= 1 << 63:
        raise OverflowError("the extents' product does not fit")
    grid = index_range(spark, 0, prod(extents))
    below = 1
    digits: list[Column] = []
    for e in reversed(extents):
        digits.insert(0, (F.floor(F.col("idx") / F.lit(below).cast("decimal(20,0)")).cast("long") if below > 1 else F.col("idx")) % max(e, 1))
        below *= max(e, 1)
    return grid.select("idx", *[d.alias(f"i{k}") for k, d in enumerate(digits)])


def advance(df: DataFrame, k: int) -> DataFrame:
    """The sequence from position k on, numbered from 0 again."""
    return df.where(F.col("idx") >= k).withColumn("idx", F.col("idx") - k)


def strided(df: DataFrame, stride: int, offset: int = 0) -> DataFrame:
    """Every ``stride``-th element from ``offset`` on."""
    if stride <= 0 or offset < 0:
        raise ValueError("the stride must be positive and the offset not negative")
    return df.where((F.col("idx") >= offset) & ((F.col("idx") - offset) % stride == 0)).withColumn("idx", F.expr(f"(idx - {offset}L) div {stride}L"))


def elements(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """A contiguous view of an array column: keys, idx, value."""
    return df.select(*keys, F.posexplode(column).alias("idx", "value"))


def chunk_of(idx: Column, total: Column | int, chunks: int) -> Column:
    """The chunk of a position when ``total`` positions are split into ``chunks`` runs whose first ones are longer by one."""
    total = F.lit(total) if isinstance(total, int) else total
    base, extra = F.floor(total / chunks), total % chunks
    split = extra * (base + 1)
    return F.when(idx < split, F.floor(idx / (base + 1))).otherwise(extra + F.floor((idx - split) / F.greatest(base, F.lit(1)))).cast("long")


def leaf_of(idx: Column, size: int = LEAF) -> Column:
    return F.floor(idx / size).cast("long")


def extent(df: DataFrame) -> int:
    return df.count()


def zipped(left: DataFrame, right: DataFrame, *, checked: bool = True) -> DataFrame:
    """Both sequences side by side by position; different extents are an error."""
    if checked and left.count() != right.count():
        raise ValueError("the sequences have different extents")
    return left.join(right, "idx")


def duplicate_places(df: DataFrame, *place: str) -> DataFrame:
    """Places that more than one element of a mapping has: an output view must have none."""
    return df.groupBy(*place).agg(F.count("*").alias("times")).where("times > 1")


def region(df: DataFrame, top: int, left: int, height: int, width: int) -> DataFrame:
    """The part of an image (y, x, ...) inside a rectangle, with its own coordinates; pushed to the scan as a filter."""
    inside = F.col("y").between(top, top + height - 1) & F.col("x").between(left, left + width - 1)
    return df.where(inside).withColumn("y", F.col("y") - top).withColumn("x", F.col("x") - left)
