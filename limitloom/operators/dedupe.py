"""One row per key: latest, first, worst, any.

All of them rank inside the key and filter directly on the rank, so Spark plans a
``WindowGroupLimit`` before the shuffle: a map task sends at most ``n`` rows per key,
and a key holding a large share of the table does not end up whole in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RANK = "__rank"


def _as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, T.MapType) or t.typeName() == "variant":
        return False
    if isinstance(t, T.ArrayType):
        return _sortable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_sortable(f.dataType) for f in t.fields)
    return True


def sortable_columns(df: DataFrame, used: Sequence[str] = ()) -> list[str]:
    used = {u.lower() for u in used}
    return [f.name for f in df.schema.fields if f.name.lower() not in used and _sortable(f.dataType)]


def total_order(df: DataFrame, used: Sequence[str]) -> list[Column]:
    """Every sortable column not in ``used``, ascending: equal rows are then identical rows."""
    return [F.col(name).asc_nulls_last() for name in sortable_columns(df, used)]


def top_per_key(df: DataFrame, keys, order: Sequence[Column], n: int = 1, tiebreak: Sequence[Column] | None = None) -> DataFrame:
    """The first ``n`` rows of each key. Ties fall to ``tiebreak``, by default all other columns."""
    keys = _as_list(keys)
    if tiebreak is None:
        tiebreak = total_order(df, [k for k in keys if isinstance(k, str)])
    w = Window.partitionBy(*keys).orderBy(*order, *tiebreak)
    return df.withColumn(_RANK, F.row_number().over(w)).filter(F.col(_RANK) <= n).drop(_RANK)


def narrowed(df: DataFrame, keys, by: str, descending: bool = True) -> DataFrame:
    """The rows of each key that share its greatest (or smallest) ``by``; all rows of a key that has none.

    Only keys and ``by`` are read, by a hash aggregate, before a semi join reads whole rows: for tables whose rows are wide or
    whose keys repeat a lot. ``by`` is a number, date or timestamp, for which Spark aggregates in place.
    """
    keys = _as_list(keys)
    best = (F.max if descending else F.min)(by).alias("__best")
    best = df.groupBy(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)]).agg(best)
    same = F.col(by).eqNullSafe(F.col("__best"))
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{i}"))
    return df.join(best, same, "left_semi")


def _ordered(cols, descending: bool) -> list[Column]:
    cols = [F.col(c) if isinstance(c, str) else c for c in _as_list(cols)]
    return [c.desc_nulls_last() if descending else c.asc_nulls_last() for c in cols]


def latest_per_key(df: DataFrame, keys, by, tiebreak=None, narrow: bool = False) -> DataFrame:
    """The row with the greatest ``by``. ``narrow`` finds the greatest first (see :func:`narrowed`) and ranks what shares it."""
    if narrow:
        df = narrowed(df, keys, _as_list(by)[0])
    return top_per_key(df, keys, _ordered(by, True), tiebreak=tiebreak)


def first_per_key(df: DataFrame, keys, by, tiebreak=None) -> DataFrame:
    return top_per_key(df, keys, _ordered(by, False), tiebreak=tiebreak)


def worst_per_key(df: DataFrame, keys, metric, tiebreak=None) -> DataFrame:
    """The row with the highest ``metric``."""
    return top_per_key(df, keys, _ordered(metric, True), tiebreak=tiebreak)


def dedupe(df: DataFrame, keys, tiebreak=None, hashed: bool = False) -> DataFrame:
    """One row per key, made repeatable: the smallest by ``tiebreak`` or by all other columns.

    ``hashed`` takes the row whose values have the smallest hash instead: one long is compared, and
    found by a hash aggregate, where a rank by all columns would sort whole rows.
    """
    if not hashed:
        return top_per_key(df, keys, [], tiebreak=tiebreak)
    told = df.withColumn("__hash", F.xxhash64(*sortable_columns(df)))
    return top_per_key(narrowed(told, keys, "__hash", descending=False), keys, [F.col("__hash")], tiebreak=[]).drop("__hash")
