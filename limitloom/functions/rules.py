"""First-match rule chains: bands, waterfalls and ladders held as data.

All of them compile to one CASE expression, so a ruleset stays inside whole-stage
codegen and three-valued logic is the engine's own: a predicate that is NULL is not
taken and the next rule is tried.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def _value(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates)


def any_of(predicates: Iterable[Column]) -> Column:
    return reduce(or_, predicates)


def first_match(rules: Sequence[tuple[Column, object]], default=None) -> Column:
    """Value of the first rule whose predicate is true, else ``default``."""
    if not rules:
        raise ValueError("a rule chain needs at least one rule")
    (predicate, value), *rest = rules
    chain = F.when(predicate, _value(value))
    for predicate, value in rest:
        chain = chain.when(predicate, _value(value))
    return chain if default is None else chain.otherwise(_value(default))


def band(x, edges: Sequence, labels: Sequence, missing=None, closed: str = "right") -> Column:
    """Label of the interval that holds ``x``.

    ``edges`` ascend; there is one label more than edges. ``closed="right"`` puts an
    edge value in the lower band (``x <= edge``), ``"left"`` in the upper (``x < edge``).
    A missing ``x`` gets ``missing``.
    """
    if len(labels) != len(edges) + 1:
        raise ValueError("bands need one label more than edges")
    if closed not in ("left", "right"):
        raise ValueError("closed is 'left' or 'right'")
    x = F.col(x) if isinstance(x, str) else x
    below = [(x <= e) if closed == "right" else (x < e) for e in edges]
    rules = [(x.isNull(), missing)] if missing is not None else []
    rules += list(zip(below, labels))
    rules.append((x.isNotNull(), labels[-1]))
    return first_match(rules)


@dataclass(frozen=True)
class Rung:
    """One step of a ladder: applies for ``above < x <= up_to`` and its guard range."""

    op: str  # "add" or "times"
    amount: float
    above: float | None = None
    up_to: float | None = None
    guard_from: float | None = None  # guard >= guard_from
    guard_below: float | None = None  # guard < guard_below


def ladder(x, guard, rungs: Sequence[Rung], when: Column | None = None) -> list[tuple[Column, Column]]:
    """Rules of one ladder over ``x``, to be chained by :func:`first_match`."""
    x = F.col(x) if isinstance(x, str) else x
    guard = F.col(guard) if isinstance(guard, str) else guard
    rules = []
    for rung in rungs:
        tests = [] if when is None else [when]
        if rung.above is not None:
            tests.append(x > rung.above)
        if rung.up_to is not None:
            tests.append(x <= rung.up_to)
        if rung.guard_below is not None:
            tests.append(guard < rung.guard_below)
        if rung.guard_from is not None:
            tests.append(guard >= rung.guard_from)
        if rung.op not in ("add", "times"):
            raise ValueError(f"unknown ladder step {rung.op!r}")
        moved = x + rung.amount if rung.op == "add" else x * rung.amount
        rules.append((all_of(tests), moved.cast("double")))
    return rules
