"""Joins by grid cell, box and rank within a group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.adaptive import BUCKETS, similar_rows
from tessella.shared import materialize


#: Neighbours that a point of average surroundings has within the reach of the finest cells, for each one that is kept.
CROWD = 2.0


def grid_neighbors(df: DataFrame, cells: int, radius: float, cap: int | None = None, key: str = "id") -> DataFrame:
    """(id, other, d2): pairs of points in the unit square within ``radius``, found in the 3 x 3 cells around each.

    An equi-join on the cell; with a ``cap`` the nearest ones are kept, ties by
    key.  ``radius`` must not exceed a cell's side.  Of many points with a cap,
    finer cells are asked first: who has ``cap`` neighbours within their reach
    has all of its nearest there, and only the others ask coarser cells.
    """
    if radius > 1.0 / cells:
        raise ValueError("the radius reaches beyond the neighbouring cells")
    points = df.select(F.col(key).alias("id"), "x", "y")
    asking, out = points, None
    fine = math.isqrt(int(points.count() * math.pi / (CROWD * cap))) if cap else 0
    while fine >= 2 * cells:
        tried = materialize(_nearest_in_lists(asking, points, fine, min(radius, 0.999 / fine), cap), "near")
        enough = F.size("best") >= cap
        own = tried.where(enough).select("id", F.explode("best").alias("b")).select("id", F.col("b.other").alias("other"), F.col("b.d2").alias("d2"))
        out = own if out is None else out.unionByName(own)
        asking, fine = tried.where(~enough).select("id", "x", "y"), fine // 2
    rest = _all_within(asking, points, cells, radius)
    if cap is not None:
        rest = rest.withColumn("_k", F.row_number().over(Window.partitionBy("id").orderBy("d2", "other"))).where(F.col("_k") <= cap)
    rest = rest.select("id", "other", "d2")
    return rest if out is None else out.unionByName(rest)


def _placed(points: DataFrame, cells: int) -> DataFrame:
    side = lambda x: F.least(F.floor(F.col(x) * cells), F.lit(cells - 1))
    return points.withColumn("cx", side("x")).withColumn("cy", side("y"))


_AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]


def _around(cells: DataFrame, *columns: str) -> DataFrame:
    """Each row once for each of the 3 x 3 cells around its own."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in _AROUND])
    return cells.withColumn("step", F.explode(steps)).select(*columns, (F.col("cx") + F.col("step.i")).alias("cx"), (F.col("cy") + F.col("step.j")).alias("cy"))


def _all_within(asking: DataFrame, points: DataFrame, cells: int, radius: float) -> DataFrame:
    """(id, other, d2): every pair within the radius."""
    other = _placed(points, cells).select(F.col("id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"), "cx", "cy")
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return _around(_placed(asking, cells), "id", "x", "y").join(other, ["cx", "cy"]).where("id != other").withColumn("d2", d2).where(F.col("d2") <= radius * radius)


def _nearest_in_lists(asking: DataFrame, points: DataFrame, cells: int, radius: float, cap: int) -> DataFrame:
    """(id, x, y, best): up to ``cap`` (d2, other) within the radius, nearest first; a point meets one list, and no pair is shuffled."""
    own = _placed(points, cells).groupBy("cx", "cy").agg(F.collect_list(F.struct("id", "x", "y")).alias("near"))
    lists = _around(own, "near").groupBy("cx", "cy").agg(F.flatten(F.collect_list("near")).alias("near"))
    listed = _placed(asking, cells).join(lists, ["cx", "cy"])
    d2 = lambda o: (F.col("x") - o["x"]) * (F.col("x") - o["x"]) + (F.col("y") - o["y"]) * (F.col("y") - o["y"])
    close = F.filter("near", lambda o: (d2(o) <= radius * radius) & (o["id"] != F.col("id")))
    best = F.sort_array(F.transform(close, lambda o: F.struct(d2(o).alias("d2"), o["id"].alias("other"))))
    return listed.select("id", "x", "y", F.slice(best, 1, cap).alias("best"))


def box_overlap(boxes: DataFrame, queries: DataFrame, axes: tuple[str, ...] = ("x", "y", "z"), cell: float = 0.125) -> DataFrame:
    """(query, id) of boxes that meet; min_/max_ columns by axis.

    Boxes go to the cells of the first axis that they reach, so the join is an
    equi-join on the cell; a pair is kept in the first cell that both reach.
    """
    first = axes[0]
    low, high = (lambda p: F.floor(F.col(f"{p}min_{first}") / cell)), (lambda p: F.floor(F.col(f"{p}max_{first}") / cell))
    a = boxes.withColumn("cell", F.explode(F.sequence(low(""), high(""))))
    b = queries.select(*[F.col(c).alias(f"q_{c}") for c in queries.columns]).withColumn("cell", F.explode(F.sequence(low("q_"), high("q_"))))
    meet = a.join(b, "cell").where(F.col("cell") == F.greatest(low(""), low("q_")))
    for x in axes:
        meet = meet.where((F.col(f"min_{x}") <= F.col(f"q_max_{x}")) & (F.col(f"q_min_{x}") <= F.col(f"max_{x}")))
    return meet.select(F.col("q_id").alias("query"), "id")


def best_per_key(df: DataFrame, key: str, choice: str, cost: str) -> DataFrame:
    """The choice of least cost for each key; ties go to the choice that sorts first."""
    return df.groupBy(key).agg(F.min(F.struct(cost, choice)).alias("_b")).select(key, F.col(f"_b.{choice}").alias(choice), F.col(f"_b.{cost}").alias(cost))


def lookup(wanted: DataFrame, table: DataFrame, *key: str) -> DataFrame:
    """Exact lookup; what is not there comes back with nulls."""
    return wanted.join(table, list(key), "left")


def better_worse_pairs(df: DataFrame, group: str, item: str, cost: str, near_tie: float = 0.005, most: float = 3.0) -> DataFrame:
    """(group, better, worse, ratio, weight) of the candidates of each group, near ties left out.

    Every pair of a group is asked for, by definition; groups are the plans of
    one workload.
    """
    a, b = df.alias("a"), df.alias("b")
    col = F.col
    order = (col(f"a.{cost}") < col(f"b.{cost}")) | ((col(f"a.{cost}") == col(f"b.{cost}")) & (col(f"a.{item}") < col(f"b.{item}")))
    pairs = a.join(b, (col(f"a.{group}") == col(f"b.{group}")) & order)
    ratio = col(f"b.{cost}") / F.greatest(col(f"a.{cost}"), F.lit(1e-12))
    named = pairs.select(col(f"a.{group}").alias(group), col(f"a.{item}").alias("better"), col(f"b.{item}").alias("worse"), ratio.alias("ratio"))
    return named.where(col("ratio") > 1.0 + near_tie).withColumn("weight", F.least(F.lit(most), F.abs(F.log("ratio"))))


def keep_latest(df: DataFrame, epoch: str, tie: str, limit: int, *by: str) -> DataFrame:
    """The ``limit`` rows touched last, by group if one is given; the rest is evicted."""
    if by:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(epoch).desc(), F.col(tie)))
        return df.withColumn("_k", place).where(F.col("_k") <= limit).drop("_k")
    return df.orderBy(F.col(epoch).desc(), F.col(tie)).limit(limit)


_MEANS = ("elapsed_ms", "regret_percent", "success_rate", "confidence")


def weighted_neighbors(prints: DataFrame, entries: DataFrame, key: str, least: float = 0.55) -> DataFrame:
    """Similarity-weighted means over the other workloads' entries.

    ``prints`` (key, buckets), one row a workload; ``entries`` (other,
    elapsed_ms, regret_percent, success_rate, confidence, sample_weight,
    samples).  Workloads of equal fingerprints are equally similar to any other,
    so fingerprints are compared once and weigh their entries' sums.  A
    workload's own entry is left out by adding what stands before and behind
    it; nothing is subtracted.
    """
    weight = F.greatest(F.lit(0.01), F.col("confidence")) * F.greatest(F.lit(1.0), F.col("sample_weight"))
    sums = ("n", "weight", *_MEANS)
    weighed = entries.where("samples > 0").select(F.col("other").alias(key), F.lit(1).alias("n"), weight.alias("weight"), *[(F.col(c) * weight).alias(c) for c in _MEANS])
    known = weighed.groupBy(key).agg(*[F.sum(c).alias(c) for c in sums])
    rows = prints.where(F.col("kind").isNotNull() & F.col(key).isNotNull()).join(known, key, "left")

    alike = Window.partitionBy(*BUCKETS)
    before, behind = (alike.orderBy(order).rowsBetween(Window.unboundedPreceding, -1) for order in (F.asc(key), F.desc(key)))
    either = lambda x, y: F.coalesce(x + y, x, y)
    others = [either(F.sum(c).over(before), F.sum(c).over(behind)).alias(f"o_{c}") for c in sums]
    rows = materialize(rows.select(key, *BUCKETS, *sums, F.min(key).over(alike).alias("print"), *others), "workloads")
    prints = materialize(rows.groupBy("print", *BUCKETS).agg(*[F.sum(c).alias(c) for c in sums]), "prints")

    # no filter by similarity: it would be pushed into the join and the formula worked out twice
    near = similar_rows(prints.select("print", *BUCKETS), prints.where("n > 0")).withColumn("s", F.when(F.col("similarity") >= least, F.col("similarity")))
    same = F.col("a_print") == F.col("b_print")
    near = near.withColumn("k", F.when(~same, F.col("s") * F.col("s")))
    total = near.groupBy(F.col("a_print").alias("print")).agg(
        F.max(F.when(same, F.col("s"))).alias("own"),
        F.sum(F.when(F.col("k").isNotNull(), F.col("b_n"))).alias("t_n"),
        *[F.sum(F.col("k") * F.col(f"b_{c}")).alias(f"t_{c}") for c in sums[1:]],
        F.sum(F.col("k") * F.col("b_weight") * F.col("s")).alias("t_similarity"),
    )
    own = F.col("own")
    found = rows.select(key, "print", *[f"o_{c}" for c in sums]).join(total, "print").select(
        key,
        either(F.col("t_n"), F.when(own.isNotNull(), F.col("o_n"))).alias("entries"),
        *[either(F.col(f"t_{c}"), own * own * F.col(f"o_{c}")).alias(c) for c in sums[1:]],
        either(F.col("t_similarity"), own * own * F.col("o_weight") * own).alias("similarity"),
    )
    return found.where("entries > 0").select(key, *[(F.col(c) / F.col("weight")).alias(c) for c in (*_MEANS, "similarity")], F.col("weight").alias("effective_weight"), "entries")
