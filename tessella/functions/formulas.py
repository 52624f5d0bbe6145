"""Chains of named scalar expressions.

A chain is a list of (name, expression) in the SQL that Spark and the check
engine share; each may use the columns before it.  ``apply`` adds them to a
DataFrame, where Catalyst folds them into as few projections as it likes, and
``sql`` nests them around a source.  Numbers are doubles throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NUMBER = re.compile(r"(?<![\w.])(\d+\.\d+)(?![\w.])")


def doubles(expression: str) -> str:
    """Decimal literals as doubles."""
    return _NUMBER.sub(r"\1e0", expression)


class Chain:
    def __init__(self, *steps: tuple[str, str]):
        self.steps = [(name, doubles(" ".join(text.split()))) for name, text in steps]

    def __add__(self, other: Chain) -> Chain:
        out = Chain()
        out.steps = self.steps + other.steps
        return out

    def apply(self, df: DataFrame) -> DataFrame:
        for name, text in self.steps:
            df = df.withColumn(name, F.expr(text))
        return df

    def sql(self, source: str) -> str:
        for name, text in self.steps:
            source = f"(SELECT *, {text} AS {name} FROM {source})"
        return source


def clamp(x: str, low: str, high: str) -> str:
    return f"least(greatest({x}, {low}), {high})"


def unit(x: str) -> str:
    return clamp(x, "0.0", "1.0")


def weighted_sum(terms: dict[str, float]) -> str:
    """Evidence: signals times their weights."""
    return " + ".join(f"{float(w)} * ({signal})" for signal, w in terms.items())


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0 ELSE 0.0 END"
