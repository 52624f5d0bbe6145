"""Reductions under three numerical policies.

* FAST: Spark's own aggregates; the order of additions is not fixed.
* REPRODUCIBLE: leaves of 1,024 positions are folded from the left, leaf states
  merge pairwise in a left-aligned tree, and the initial value joins last.  The
  result depends on values and positions alone, not on partitions or cores.
* ACCURATE: the same leaves and tree over compensated states.

The tree is evaluated in rounds: a group of 1,024 neighbouring states is a
whole aligned subtree, so its ten levels are computed inside one row, and a
round shrinks the table by that factor.  There are as many rounds as the
greatest position needs, so one state is left whatever the positions are.  They
need not be dense: a leaf or subtree without positions is left out, and its
neighbours move together inside their group of 1,024.
"""

from __future__ import annotations

import enum
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.sequence import LEAF, leaf_of

#: Identifiers of the evaluation plans.
PAIRWISE_PLAN = "canonical-pairwise-v1-leaf1024"
COMPENSATED_PLAN = "canonical-neumaier-v1-leaf1024"
SCALED_PLAN = "canonical-scaled-sumsq-v1-leaf1024"


class Policy(enum.Enum):
    FAST = "Fast"
    REPRODUCIBLE = "Reproducible"
    ACCURATE = "Accurate"


@dataclass(frozen=True)
class Fold:
    """A state, how a value enters it and how two states merge."""

    kind: str
    first: Callable[[Column], Column]
    add: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]
    plan: str


def plain(op: Callable[[Column, Column], Column], kind: str = "double") -> Fold:
    """Left fold and merge by one operator; the first element seeds a leaf."""
    return Fold(kind, lambda x: x, op, op, PAIRWISE_PLAN)


_INF = float("inf")
COMPENSATED = "struct<s:double,c:double,nan:boolean,pos:boolean,neg:boolean>"


def _state(s: Column, c: Column, nan: Column, pos: Column, neg: Column) -> Column:
    return F.struct(s.alias("s"), c.alias("c"), nan.alias("nan"), pos.alias("pos"), neg.alias("neg"))


def compensated_add(a: Column, x: Column) -> Column:
    """Neumaier's sum with NaN and infinities kept apart from the running value."""
    total = a["s"] + x
    special = F.isnan(x) | (F.abs(x) == _INF)
    stuck = a["nan"] | a["pos"] | a["neg"]
    overflow = ~special & ~stuck & (F.abs(total) == _INF)
    moves = ~special & ~stuck & ~overflow
    slip = F.when(F.abs(a["s"]) >= F.abs(x), (a["s"] - total) + x).otherwise((x - total) + a["s"])
    return _state(
        F.when(moves, total).otherwise(a["s"]),
        F.when(moves, a["c"] + slip).otherwise(a["c"]),
        a["nan"] | F.isnan(x),
        a["pos"] | (~F.isnan(x) & (x == _INF)) | (overflow & (total > 0)),
        a["neg"] | (x == -_INF) | (overflow & (total < 0)),
    )


def compensated_merge(a: Column, b: Column) -> Column:
    flags = _state(a["s"], a["c"], a["nan"] | b["nan"], a["pos"] | b["pos"], a["neg"] | b["neg"])
    # a struct cannot be named inside an expression; one-element arrays bind it for the next step
    step = lambda state, x: F.aggregate(F.array(x), state.cast(COMPENSATED), lambda acc, v: compensated_add(acc, v).cast(COMPENSATED))
    return step(step(flags, b["s"]), b["c"])


def compensated_value(a: Column) -> Column:
    return (
        F.when(a["nan"] | (a["pos"] & a["neg"]), F.lit(float("nan")))
        .when(a["pos"], F.lit(_INF))
        .when(a["neg"], F.lit(-_INF))
        .otherwise(a["s"] + a["c"])
    )


def _zero() -> Column:
    no = F.lit(False)
    return _state(F.lit(0.0), F.lit(0.0), no, no, no).cast(COMPENSATED)


COMPENSATED_SUM = Fold(COMPENSATED, lambda x: compensated_add(_zero(), x), compensated_add, compensated_merge, COMPENSATED_PLAN)

SCALED = "struct<scale:double,ssq:double,some:boolean,nan:boolean,inf:boolean>"


def _scaled(scale: Column, ssq: Column, some: Column, nan: Column, inf: Column) -> Column:
    return F.struct(scale.alias("scale"), ssq.alias("ssq"), some.alias("some"), nan.alias("nan"), inf.alias("inf"))


def scaled_merge(a: Column, b: Column) -> Column:
    """Sums of squares relative to the larger scale."""
    down, up = a["scale"] / b["scale"], b["scale"] / a["scale"]
    both = a["some"] & b["some"]
    smaller = a["scale"] < b["scale"]
    return _scaled(
        F.when(~b["some"], a["scale"]).when(~a["some"], b["scale"]).otherwise(F.greatest(a["scale"], b["scale"])),
        F.when(~b["some"], a["ssq"]).when(~a["some"], b["ssq"]).when(both & smaller, b["ssq"] + a["ssq"] * down * down).otherwise(a["ssq"] + b["ssq"] * up * up),
        a["some"] | b["some"],
        a["nan"] | b["nan"],
        a["inf"] | b["inf"],
    )


def scaled_value(x: Column) -> Column:
    size = F.abs(x)
    odd = F.isnan(x) | (size == _INF)
    some = ~odd & (size > 0)
    return _scaled(F.when(some, size).otherwise(F.lit(0.0)), F.lit(1.0), some, F.isnan(x), ~F.isnan(x) & (size == _INF)).cast(SCALED)


SCALED_SQUARES = Fold(SCALED, scaled_value, lambda a, x: scaled_merge(a, scaled_value(x)), scaled_merge, SCALED_PLAN)


def scaled_norm(a: Column) -> Column:
    return F.when(a["nan"], F.lit(float("nan"))).when(a["inf"], F.lit(_INF)).when(~a["some"], F.lit(0.0)).otherwise(a["scale"] * F.sqrt(a["ssq"]))


def _pairs(states: Column, fold: Fold) -> Column:
    """One level of the tree: neighbours merge, a last one without neighbour moves up."""
    n = F.size(states)
    level = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int")),
        lambda i: F.when(2 * i + 1 < n, fold.merge(F.get(states, 2 * i), F.get(states, 2 * i + 1)).cast(fold.kind)).otherwise(F.get(states, 2 * i)),
    )
    return level.cast(f"array<{fold.kind}>")


def rounds_for(greatest: int) -> int:
    """Rounds of ``tree`` that bring nodes 0..greatest down to one, one round at least."""
    rounds = 1
    while greatest >= LEAF**rounds:
        rounds += 1
    return rounds


def tree(df: DataFrame, fold: Fold, by: Sequence[str] = (), rounds: int = 1) -> DataFrame:
    """(by..., state) from (by..., node, state) with nodes from 0 to ``LEAF ** rounds - 1``; a node beyond is an error."""
    now = df
    for _ in range(rounds):
        grouped = now.groupBy(*by, leaf_of(F.col("node")).alias("node")).agg(F.sort_array(F.collect_list(F.struct("node", "state"))).alias("own"))
        states = F.transform("own", lambda x: x["state"]).cast(f"array<{fold.kind}>")
        top = F.aggregate(F.sequence(F.lit(1), F.lit(10)), states, lambda acc, _: _pairs(acc, fold))
        now = grouped.select(*by, "node", F.get(top, 0).alias("state"))
    one = F.assert_true(F.col("node") == 0, F.lit("a reduction has more than one state left"))
    return now.where(one.isNull()).drop("node")


def leaf_states(df: DataFrame, value: Column, fold: Fold, by: Sequence[str] = ()) -> DataFrame:
    """(by..., node, state) of each leaf of 1,024 positions."""
    rows = df.select(*by, "idx", value.alias("v"))
    grouped = rows.groupBy(*by, leaf_of(F.col("idx")).alias("node")).agg(F.sort_array(F.collect_list(F.struct("idx", "v"))).alias("own"))
    values = F.transform("own", lambda x: x["v"])
    state = F.aggregate(F.slice(values, 2, LEAF), fold.first(F.get(values, 0)).cast(fold.kind), lambda acc, x: fold.add(acc, x).cast(fold.kind))
    return grouped.select(*by, "node", state.alias("state"))


def canonical(df: DataFrame, value: Column, fold: Fold, by: Sequence[str] = ()) -> DataFrame:
    """(by..., state); without ``by`` one row, whose state is null for an empty sequence."""
    least, greatest = df.agg(F.min("idx"), F.max("idx")).first()
    if least is not None and least < 0:
        raise ValueError("positions start at 0")
    found = tree(leaf_states(df, value, fold, by), fold, by, rounds_for((greatest or 0) // LEAF))
    return found if by else found.agg(F.first("state").alias("state"))


def reduce_sum(df: DataFrame, value: Column, policy: Policy = Policy.FAST, init: float = 0.0, by: Sequence[str] = (), out: str = "total") -> DataFrame:
    """init plus the sum of ``value`` over the positions ``idx``."""
    start = F.lit(float(init))
    if policy is Policy.FAST:
        total = (start + F.coalesce(F.sum(value), F.lit(0.0))).alias(out)
        return df.groupBy(*by).agg(total) if by else df.agg(total)
    if policy is Policy.REPRODUCIBLE:
        found = canonical(df, value, plain(lambda a, b: a + b), by)
        return found.select(*by, F.when(F.col("state").isNull(), start).otherwise(start + F.col("state")).alias(out))
    found = canonical(df, value, COMPENSATED_SUM, by)
    first = compensated_add(_zero(), start).cast(COMPENSATED)
    merged = F.when(F.col("state").isNull(), first).otherwise(compensated_merge(first, F.col("state")))
    return found.select(*by, merged.cast(COMPENSATED).alias("state")).select(*by, compensated_value(F.col("state")).alias(out))


def reduce_by(df: DataFrame, value: Column, op: Callable[[Column, Column], Column], init: Column, kind: str, policy: Policy = Policy.REPRODUCIBLE, out: str = "total") -> DataFrame:
    """A reduction by any operator; order is kept, and ACCURATE is refused."""
    if policy is Policy.ACCURATE:
        raise ValueError("the accurate policy has no compensated form for this operator")
    found = canonical(df, value, plain(op, kind))
    return found.select(F.when(F.col("state").isNull(), init.cast(kind)).otherwise(op(init.cast(kind), F.col("state"))).alias(out))


def dot(df: DataFrame, x: Column, y: Column, policy: Policy = Policy.FAST, out: str = "dot") -> DataFrame:
    """Products are rounded before they are summed, under every policy."""
    return reduce_sum(df, x * y, policy, out=out)


def norm(df: DataFrame, x: Column, policy: Policy = Policy.FAST, out: str = "norm") -> DataFrame:
    if policy is Policy.ACCURATE:
        found = canonical(df, x, SCALED_SQUARES)
        return found.select(F.coalesce(scaled_norm(F.col("state")), F.lit(0.0)).alias(out))
    return dot(df, x, x, policy, "_sq").select(F.sqrt("_sq").alias(out))


def array_dot(x: str, y: str) -> Column:
    """Dot product of array columns, from the left."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, v: acc + v)


CAPABILITY = {
    "sum": {p for p in Policy},
    "custom": {Policy.FAST, Policy.REPRODUCIBLE},
    "dot": {p for p in Policy},
    "norm": {p for p in Policy},
    "axpy": {p for p in Policy},
    "stencil": {p for p in Policy},
}


def require(operation: str, policy: Policy) -> None:
    """An unsupported policy is refused; it never falls back."""
    if policy not in CAPABILITY.get(operation, set()):
        raise ValueError(f"{operation} does not support {policy.value}")


def report(operation: str, policy: Policy) -> dict[str, str]:
    """What a run under a policy promises, to stand beside its result."""
    require(operation, policy)
    pointwise = operation in ("axpy", "stencil")
    accurate = SCALED_PLAN if operation == "norm" else COMPENSATED_PLAN
    plan = "adaptive" if policy is Policy.FAST else "canonical-pointwise-v1-target4096" if pointwise else PAIRWISE_PLAN if policy is Policy.REPRODUCIBLE else accurate
    order = "Adaptive" if policy is Policy.FAST else "CanonicalPointwise" if pointwise else "CanonicalDeterministic"
    return {"operation": operation, "policy": policy.value, "evaluation_order": order, "canonical_plan": plan}
