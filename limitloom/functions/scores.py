"""Score clean-up and buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_score(x) -> Column:
    """NaN to NULL: Spark orders NaN above every number, the analyses treat it as missing."""
    x = _col(x).cast("double")
    return F.when(~F.isnan(x), x)


def floor_at_zero(x) -> Column:
    """Missing or negative scores become 0."""
    return F.greatest(F.coalesce(_col(x), F.lit(0)), F.lit(0))


def score_bucket(score, per_unit: int = 10, prefix: str = "Bucket") -> Column:
    """``Bucket7`` for a score in [0.7, 0.8); NULL for a missing score."""
    return F.concat(F.lit(prefix), F.floor(_col(score) * per_unit).cast("string"))
