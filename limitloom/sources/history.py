"""A backfilled history continued by a live feed."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stitch_history(backfill: DataFrame, live: DataFrame, date_col: str, cutoff: dt.date | dt.datetime) -> DataFrame:
    """Backfill up to and including ``cutoff``, the live feed after it.

    The two filters are disjoint, so no duplicate can arise and none is searched for; both
    reach their scans.
    """
    limit = F.lit(cutoff)
    return backfill.filter(F.col(date_col) <= limit).unionByName(live.filter(F.col(date_col) > limit))
