"""Last step of every registered query: plain comparable columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Sums of floating-point means differ in the last digit with the order of summation, and
# means of a few exact amounts often end in the very digit that plain rounding turns on.
# Steady values are cut at an offset such amounts do not hit.
_OFFSET = 0.3717171


def steady(x: Column, places: int) -> Column:
    return F.floor(x * 10**places + _OFFSET).cast("double") / 10**places


def steady_sql(x: str, places: int) -> str:
    return f"(floor(({x}) * {10**places} + {_OFFSET}) / {10**places})"


def plain(df: DataFrame, places: int | None = None) -> DataFrame:
    """Decimals as doubles, dates and timestamps as text, flags as integers.

    ``places`` makes floating-point columns steady to that many digits.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        if places is not None and isinstance(f.dataType, (T.DoubleType, T.DecimalType)):
            c = steady(c, places)
        cols.append(c.alias(f.name))
    return df.select(*cols)
