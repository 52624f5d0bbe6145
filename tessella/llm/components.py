"""Connected components by alternating large and small stars.

Edges stay distributed; each round is two aggregations with map-side combine
and two joins.  The centre of a large star, a node with far more edges than a
task's mean, takes no part in a join.  The number of rounds grows with the
logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import common

#: A node is a hub with this many edges and more than a task's mean.
HUB = 1000


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    """Each edge's greater end with the least neighbour of its smaller one (or that itself).

    Nodes with more than ``hub`` edges, of which there are about two for each
    task, hand theirs out by broadcast: their edges are not gathered.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"), "n")
    hubs = F.broadcast(least.where(F.col("n") > hub).select("b", F.col("m").alias("hub_m")))
    marked = edges.select("a", "b").join(hubs, "b", "left")
    rest = marked.where("hub_m is null").select("a", "b").join(least.where(F.col("n") <= hub).select("b", "m"), "b").select("a", "m")
    return marked.where("hub_m is not null").select("a", F.col("hub_m").alias("m")).union(rest).select("a", F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """All smaller neighbours of a node, and the node, with the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return row[0], row[1]


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)`` other than the roots; the root is the least node of its component.

    Nodes may be of any type that can be ordered.  Loops and repeated edges do no harm.
    """
    greatest: Column = F.greatest("a", "b")
    n = common.shuffle_partitions(edges.sparkSession)
    now = common.materialize(edges.select(greatest.alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = _state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        hub = max(HUB, before[0] // n)
        last, now = now, common.materialize(_small_star(_large_star(now, hub)), "edges")
        after = _state(now)
        common.discard(now.sparkSession, last.scratch_path)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    found = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found.scratch_path = now.scratch_path
    return found
