"""Month keys, month differences and look-back windows on an explicit ``as_of``."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

DateLike = Column | str | dt.date


def as_date(value: DateLike) -> Column:
    """A date column from a column, a column name or a Python date."""
    if isinstance(value, dt.date):
        return F.lit(value).cast("date")
    if isinstance(value, str):
        value = F.col(value)
    return F.to_date(value)


def month_key(d: DateLike) -> Column:
    """``yyyy-MM`` of a date or timestamp."""
    return F.date_format(as_date(d), "yyyy-MM")


def month_floor(d: DateLike) -> Column:
    """First day of the month; an integer-backed key, cheaper to group on than the label."""
    return F.trunc(as_date(d), "month")


def month_start(m: Column | str) -> Column:
    """First day of the month named by a ``yyyy-MM`` label."""
    m = F.col(m) if isinstance(m, str) else m
    return F.to_date(F.concat(m, F.lit("-01")), "yyyy-MM-dd")


def month_diff(a: DateLike, b: DateLike) -> Column:
    """Calendar months from ``a`` to ``b``, counting month boundaries crossed.

    Spark's own ``datediff(month, ..)`` counts completed months, so 31 January to
    1 February is 0 there and 1 here.
    """
    a, b = as_date(a), as_date(b)
    return (F.year(b) - F.year(a)) * 12 + (F.month(b) - F.month(a))


def completed_months(a: DateLike, b: DateLike) -> Column:
    """Whole months elapsed from ``a`` to ``b``, truncated toward zero."""
    return F.months_between(as_date(b), as_date(a)).cast("int")


def mob(opened: DateLike, as_of: DateLike) -> Column:
    """Months on book, fractional (31-day month fractions)."""
    return F.months_between(as_date(as_of), as_date(opened))


def mob_rounded(opened: DateLike, as_of: DateLike) -> Column:
    return F.round(mob(opened, as_of), 0)


def within_days(d: DateLike, as_of: DateLike, n: int, inclusive: bool = False) -> Column:
    """True when ``d`` lies in the ``n`` days up to ``as_of``.

    ``inclusive`` keeps a date exactly ``n`` days back (``age <= n``); the default drops
    it (``d > as_of - n``). Dates after ``as_of`` are outside.
    """
    d, as_of = as_date(d), as_date(as_of)
    start = F.date_sub(as_of, n)
    return ((d >= start) if inclusive else (d > start)) & (d <= as_of)


def within_months(d: DateLike, as_of: DateLike, n: int, inclusive: bool = True) -> Column:
    """True when at most (or, exclusive, less than) ``n`` fractional months have passed."""
    age = mob(d, as_of)
    return (age <= n) if inclusive else (age < n)
