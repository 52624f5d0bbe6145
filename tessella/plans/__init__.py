"""Registered queries of the library's operators."""

from tessella.plans import adaptive, grids, joins, kernels, machines, reductions, runtime, sequences, statistics
from tessella.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "adaptive", "grids", "joins", "kernels", "machines", "reductions", "runtime", "sequences", "statistics"]
