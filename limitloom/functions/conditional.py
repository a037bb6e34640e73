"""Conditional aggregates and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 where the condition is true, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def cond_sum(condition: Column, x=1, empty=0) -> Column:
    """Sum of ``x`` over matching rows.

    ``empty=0`` adds 0 for the other rows, so a group without a match sums to 0;
    ``empty=None`` skips them, so such a group is NULL. Some rules read that NULL.
    """
    x = x if isinstance(x, Column) else (F.col(x) if isinstance(x, str) else F.lit(x))
    branch = F.when(condition, x)
    return F.sum(branch if empty is None else branch.otherwise(F.lit(empty)))


def cond_count(condition: Column, counted="*") -> Column:
    """Number of matching rows whose ``counted`` column is not NULL (all rows for ``*``)."""
    if isinstance(counted, str):
        counted = F.lit(1) if counted == "*" else F.col(counted)
    return F.count(F.when(condition, counted))
