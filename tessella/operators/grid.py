"""Operators on grids in long form (r, c, v): stencils, diffusion, convolution, gradients."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.shared import materialize

#: Weights of the diffusion step, centre then north, south, west, east.
HEAT = (0.5, 0.125, 0.125, 0.125, 0.125)
CHECKPOINT_EVERY = 4


def _around(rows_key: str, along: str, column: str, step: int) -> Column:
    w = Window.partitionBy(rows_key).orderBy(along)
    return F.lag(column, step).over(w) if step > 0 else F.lead(column, -step).over(w)


def stencil_2d(df: DataFrame, rows: int, columns: int, weights: Sequence[float] = HEAT, value: str = "v") -> DataFrame:
    """Five-point stencil; border cells, and whole rows of fewer than three columns, are copied.

    The sum runs centre, north, south, west, east, so results do not depend on
    partitions.  The grid is shuffled twice, by column and by row.
    """
    center, north, south, west, east = (F.lit(float(w)) for w in weights)
    near = (
        df.withColumn("_n", _around("c", "r", value, 1))
        .withColumn("_s", _around("c", "r", value, -1))
        .withColumn("_w", _around("r", "c", value, 1))
        .withColumn("_e", _around("r", "c", value, -1))
    )
    border = (F.col("r") == 0) | (F.col("r") == rows - 1) | (F.col("c") == 0) | (F.col("c") == columns - 1)
    inner = center * F.col(value) + north * F.col("_n") + south * F.col("_s") + west * F.col("_w") + east * F.col("_e")
    return near.withColumn(value, F.when(border, F.col(value)).otherwise(inner)).drop("_n", "_s", "_w", "_e")


def heat(df: DataFrame, rows: int, columns: int, steps: int, value: str = "v") -> DataFrame:
    """Repeated diffusion; lineage is cut by a written table every few steps."""
    now = df
    for k in range(1, steps + 1):
        now = stencil_2d(now, rows, columns, HEAT, value)
        if k % CHECKPOINT_EVERY == 0 and k < steps:
            now = materialize(now, "heat")
    return now


def convolve(df: DataFrame, kernel: Sequence[Sequence[float]], scale: float = 1.0, value: str = "v") -> DataFrame:
    """(r, c, v): correlation with a small odd kernel; cells outside the grid count as 0, and there is one value a cell.

    Like the stencil: neighbours along the columns and then along the rows come
    by windows, two shuffles, and no cell is copied.  Terms are summed in
    row-major order of the kernel.  Cells that are missing inside the grid count
    as 0 and have no row.
    """
    high, wide = len(kernel), len(kernel[0])
    if high % 2 == 0 or wide % 2 == 0:
        raise ValueError("the kernel must have odd sides")
    up, left = high // 2, wide // 2
    by_column, by_row = Window.partitionBy("c").orderBy("r"), Window.partitionBy("r").orderBy("c")

    def near(window: Window, name: str, step: int) -> Column:
        """``name`` of the cell ``step`` places further, null where there is none."""
        return F.col(name) if step == 0 else F.first(name).over(window.rangeBetween(step, step))

    column = F.array(*[near(by_column, value, i - up) for i in range(high)])
    tall = df.select("r", "c", F.col(value).alias(value)).withColumn("_column", column)
    rows = [near(by_row, "_column", j - left) for j in range(wide)]
    around = tall.select("r", "c", *[x.alias(f"_k{j}") for j, x in enumerate(rows)])
    total = F.lit(0.0)
    for i in range(high):
        for j in range(wide):
            total = total + F.lit(float(kernel[i][j])) * F.coalesce(F.get(F.col(f"_k{j}"), i).cast("double"), F.lit(0.0))
    return around.select("r", "c", (total * F.lit(float(scale))).alias(value))


def sobel(df: DataFrame, rows: int, columns: int, value: str = "v") -> DataFrame:
    """Gradient magnitude from the two 3 x 3 operators; border cells are 0."""
    by_row = Window.partitionBy("r").orderBy("c")
    by_column = Window.partitionBy("c").orderBy("r")
    wide = df.withColumn("_w", F.lag(value).over(by_row)).withColumn("_e", F.lead(value).over(by_row))
    tall = wide
    for name in (value, "_w", "_e"):
        tall = tall.withColumn(f"_up{name}", F.lag(name).over(by_column)).withColumn(f"_dn{name}", F.lead(name).over(by_column))
    col = F.col
    gx = (col("_up_e") + 2 * col("_e") + col("_dn_e")) - (col("_up_w") + 2 * col("_w") + col("_dn_w"))
    gy = (col("_dn_w") + 2 * col(f"_dn{value}") + col("_dn_e")) - (col("_up_w") + 2 * col(f"_up{value}") + col("_up_e"))
    border = (col("r") == 0) | (col("r") == rows - 1) | (col("c") == 0) | (col("c") == columns - 1)
    return tall.select("r", "c", F.when(border, F.lit(0.0)).otherwise(F.sqrt(gx.cast("double") * gx + gy.cast("double") * gy)).alias("magnitude"))


def sliding_history(df: DataFrame, key: str, order: str, value: str, window: int) -> DataFrame:
    """Median (the upper one) and median absolute deviation of each row's last ``window`` values."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(window - 1), 0)
    upper = lambda xs: F.get(F.sort_array(xs), F.floor(F.size(xs) / 2).cast("int"))
    ring = df.withColumn("_ring", F.collect_list(value).over(w)).withColumn("median", upper(F.col("_ring")))
    return ring.withColumn("mad", upper(F.transform("_ring", lambda x: F.abs(x - F.col("median"))))).drop("_ring")
