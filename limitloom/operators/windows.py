"""Running and lagged values along a key's time line.

A plain window puts a whole key into one task. Frames that hold one row per (key, month)
or (key, day) are bounded by the calendar and take a plain window. On raw frames long keys
are cut into pieces (`scan`): the window runs inside a piece, and a frame with one row per
piece carries the running value from piece to piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitloom.functions import month_diff, month_start
from limitloom.operators import scan
from limitloom.operators.dedupe import sortable_columns


def _as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def _null_safe(pairs) -> Column:
    condition = None
    for l, r in pairs:
        test = F.col(l).eqNullSafe(F.col(r))
        condition = test if condition is None else condition & test
    return condition


def running_ordinal(df: DataFrame, keys, order: str, name: str, piece_rows: int | None = None, tiebreak: Sequence[str] | None = None) -> DataFrame:
    """Position of each row among its key's rows, from 1; missing times come last.

    Without ``piece_rows`` this is a plain window, for frames with one row per key and month or
    day. On raw frames give the rows a task should hold: longer keys are cut along ``order`` and
    ``tiebreak`` (`scan.cut`), ranked piece by piece and shifted by the rows in the key's earlier pieces.
    """
    keys = _as_list(keys)
    tiebreak = sortable_columns(df, [*keys, order]) if tiebreak is None else list(tiebreak)
    ascending = [F.col(x).asc_nulls_last() for x in (order, *tiebreak)]
    cut = None if piece_rows is None else scan.cut(df, keys, [order, *tiebreak], piece_rows)
    if cut is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ascending)))
    ranked = cut.withColumn("__inside", F.row_number().over(Window.partitionBy("__piece").orderBy(*ascending)))
    # one row per piece of the keys that were cut
    held = cut.filter("__split").groupBy(F.col("__piece").alias("__at")).agg(F.count(F.lit(1)).alias("__rows"))
    earlier = scan.along("__at", keys).rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("__at", F.sum("__rows").over(earlier).alias("__before"))
    out = ranked.join(shift, F.col("__piece") == F.col("__at"), "left")
    ordinal = F.col("__inside") + F.coalesce("__before", F.lit(0))
    return out.withColumn(name, ordinal.cast("int")).select(*df.columns, name)


def cumulative(df: DataFrame, keys, order: str, x: str, name: str) -> DataFrame:
    """Running sum along ``order`` for frames with one row per (key, order).

    Missing values are skipped and stay missing at their own row.
    """
    w = Window.partitionBy(*_as_list(keys)).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.when(F.col(x).isNotNull(), F.sum(x).over(w)))


def group_value(df: DataFrame, keys, aggregate: Column, name: str) -> DataFrame:
    """An aggregate of the key on each of its rows.

    Partial aggregates first, then a join back, so that a key holding much of the frame is
    never gathered in one task as a window over it would.
    """
    keys = _as_list(keys)
    totals = df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(aggregate.alias(name))
    out = df.join(totals, _null_safe([(k, f"__k{i}") for i, k in enumerate(keys)]), "left")
    return out.select(*df.columns, name)


def group_total(df: DataFrame, keys, x: str, name: str) -> DataFrame:
    """The key's sum of ``x`` on every row."""
    return group_value(df, keys, F.sum(x), name)


def first_event_month(df: DataFrame, keys, event: Column, month: str, name: str, one_per_month: bool = False) -> DataFrame:
    """The first ``month`` in which ``event`` holds, on every row of the key.

    ``one_per_month`` says that a key has at most a few rows per month: the calendar then
    bounds the key and one window does it. Other frames go through :func:`group_value`.
    """
    first = F.min(F.when(event, F.col(month)))
    if one_per_month:
        return df.withColumn(name, first.over(Window.partitionBy(*_as_list(keys))))
    return group_value(df, keys, first, name)


def month_number(d) -> Column:
    """Months since year 0."""
    return F.year(d) * 12 + F.month(d) - 1


def month_index(rows: DataFrame, key: str, event: Column, month: str, years: tuple[int, int]) -> DataFrame:
    """Where each key's next ``event`` month lies, as an index to look up by key and year.

    A row per key that has such a month and per year: ``first`` the earliest one, ``following`` for each of the year's
    twelve months the first one after it, ``last`` the key's last month with a row. Months are numbers (`month_number`).
    """
    at = month_number(month)
    hits = F.array_sort(F.collect_set(F.when(event, at)))
    known = rows.groupBy(key).agg(hits.alias("__hits"), F.max(at).alias("last")).filter(F.size("__hits") > 0)
    paged = known.withColumns({"first": F.element_at("__hits", 1), "year": F.explode(F.sequence(F.lit(years[0]), F.lit(years[1])))})
    after = lambda m: F.try_element_at(F.filter("__hits", lambda h: h > m), F.lit(1))
    following = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: after(F.col("year") * 12 + i))
    return paged.select(key, "year", "first", following.alias("following"), "last")


def since_event(df: DataFrame, month: str, event_month: str, name: str, after: int = 0) -> DataFrame:
    """Months since the event month, rows later than ``after`` months only."""
    age = month_diff(month_start(event_month), month_start(month))
    return df.withColumn(name, age).filter(F.col(name) > after)


def lags(df: DataFrame, keys, ordinal: str, cols: Sequence[str], n: int = 3, name=lambda c, k: f"{c}_{k}m_prior") -> DataFrame:
    """Values 1..n positions back in the key's sequence, one window instead of n joins.

    ``ordinal`` numbers the rows; where a number is absent the lag is NULL, exactly as an
    equality join on ``ordinal - k`` would leave it. Meant for frames of one row per key
    and month.
    """
    keys = _as_list(keys)
    w = Window.partitionBy(*keys).orderBy(ordinal)
    row = F.struct(F.col(ordinal).alias("__o"), *cols)
    staged = df.withColumns({f"__lag{k}": F.lag(row, k).over(w) for k in range(1, n + 1)})
    out = {}
    for k in range(1, n + 1):
        # A gap brings the wanted ordinal nearer, so it may sit on any of the k rows before.
        hits = [F.when(F.col(f"__lag{j}.__o") == F.col(ordinal) - k, F.col(f"__lag{j}")) for j in range(1, k + 1)]
        out[k] = F.coalesce(*hits) if len(hits) > 1 else hits[0]
    staged = staged.withColumns({f"__hit{k}": out[k] for k in out})
    values = [F.col(f"__hit{k}")[c].alias(name(c, k)) for k in out for c in cols]
    return staged.select(*df.columns, *values)
