"""Cents, ratios and rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dollars(cents) -> Column:
    """Integer cents to exact dollars."""
    return (_col(cents).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(18,2)")


def zero_if_null(x) -> Column:
    return F.coalesce(_col(x), F.lit(0))


def safe_ratio(n, d, default=None) -> Column:
    """``n / d`` with NULL, or ``default``, for a zero or missing denominator."""
    ratio = F.try_divide(_col(n).cast("double"), _col(d).cast("double"))
    return ratio if default is None else F.coalesce(ratio, F.lit(float(default)))


def ceil_to(x, step: int) -> Column:
    """Next multiple of ``step`` at or above ``x``."""
    return F.ceil(_col(x) / step) * step


def round_to(x, step: int) -> Column:
    """Nearest multiple of ``step``, halves away from zero."""
    return F.round(_col(x) / step, 0) * step


def clamp(x, lo=None, hi=None) -> Column:
    """Limit ``x`` to ``[lo, hi]``; NULL stays NULL."""
    x = _col(x)
    out = x
    if hi is not None:
        out = F.least(out, F.lit(hi))
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    return F.when(x.isNotNull(), out)
