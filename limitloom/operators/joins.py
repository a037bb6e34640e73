"""Attaching one table to another: by key, by day, by month, by next event.

Every equi join is left to Catalyst: it becomes a broadcast when the measured side is
small, otherwise a sort-merge join whose hot partitions adaptive execution splits on the
preserved (left) side. Operators whose reference form multiplies rows inside a key
(next event, "no later event") are rewritten so that no key expands to pairs.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitloom.functions import all_of, as_date, month_floor
from limitloom.operators import scan
from limitloom.operators.dedupe import worst_per_key

Keys = str | Sequence[str | tuple[str, str]]


def _pairs(on: Keys) -> list[tuple[str, str]]:
    on = [on] if isinstance(on, str) else list(on)
    return [(k, k) if isinstance(k, str) else tuple(k) for k in on]


def attach(left: DataFrame, right: DataFrame, on: Keys, how: str = "left", extra: Column | None = None, flag: str | None = None, keyless_apart: bool = False) -> DataFrame:
    """Join ``right`` to ``left``; the right key columns are dropped.

    ``on`` holds names shared by both sides or ``(left, right)`` pairs. ``extra`` is a
    residual condition inside ON, so on a left join it can exclude a match but never a
    row. ``flag`` adds 1 for a matched row, 0 otherwise.

    ``keyless_apart`` is for left joins with many rows that lack a key: a missing key matches nothing,
    but would travel to the one partition of missing keys. Such rows pass by the join and are added back.
    """
    if keyless_apart:
        if how != "left":
            raise ValueError("only a left join keeps rows without a key")
        known = all_of([F.col(l).isNotNull() for l, _ in _pairs(on)])
        joined = attach(left.filter(known), right, on, how, extra, flag)
        keyless = left.filter(~known)
        keyless = keyless.withColumn(flag, F.lit(0)) if flag else keyless
        return joined.unionByName(keyless, allowMissingColumns=True)
    pairs = _pairs(on)
    renamed = {r: f"__key{i}" for i, (_, r) in enumerate(pairs)}
    side = right.withColumnsRenamed(renamed)
    if flag:
        side = side.withColumn(flag, F.lit(1))
    clash = {c.lower() for c in left.columns} & {c.lower() for c in side.columns}
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    condition = all_of([F.col(l) == F.col(renamed[r]) for l, r in pairs])
    if extra is not None:
        condition = condition & extra
    out = left.join(side, condition, how).drop(*renamed.values())
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(0))) if flag else out


def _attach_on(left, right, on, lkey: Column, rkey: Column, how, flag) -> DataFrame:
    left = left.withColumn("__when", lkey)
    right = right.withColumn("__when", rkey)
    return attach(left, right, [*_pairs(on), "__when"], how, flag=flag).drop("__when")


def attach_on_day(left, right, on: Keys, ldate, rdate, how="left", flag=None) -> DataFrame:
    """Match on key and calendar day."""
    return _attach_on(left, right, on, as_date(ldate), as_date(rdate), how, flag)


def attach_on_month(left, right, on: Keys, ldate, rdate, how="left", flag=None) -> DataFrame:
    """Match on key and calendar month."""
    return _attach_on(left, right, on, month_floor(ldate), month_floor(rdate), how, flag)


def attach_prev_month(left, right, on: Keys, ldate, rdate, how="left", flag=None) -> DataFrame:
    """Match the right rows of the month before the left date."""
    previous = F.trunc(F.add_months(as_date(ldate), -1), "month")
    return _attach_on(left, right, on, previous, month_floor(rdate), how, flag)


def attach_history(left: DataFrame, right: DataFrame, on: Keys) -> DataFrame:
    """Left join of a keyed table to a long history, all matches kept.

    Adaptive execution can split a hot key only on the preserved side of an outer join.
    Here the history is the long side, so matches are found with an inner join, where
    both sides may be split, and the rows without a match are added by an anti join.
    """
    pairs = _pairs(on)
    known = right.select(*[F.col(r) for _, r in pairs]).distinct()
    matched = attach(left, right, on, "inner")
    renamed = known.select(*[F.col(r).alias(f"__key{i}") for i, (_, r) in enumerate(pairs)])
    condition = all_of([F.col(l) == F.col(f"__key{i}") for i, (l, _) in enumerate(pairs)])
    unmatched = left.join(renamed, condition, "left_anti")
    return matched.unionByName(unmatched, allowMissingColumns=True)


def member_flag(df: DataFrame, members: DataFrame, on: Keys, name: str) -> DataFrame:
    """1 when the key occurs among ``members`` (made distinct first), else 0. Adds no rows."""
    keys = [r for _, r in _pairs(on)]
    return attach(df, members.select(*keys).distinct(), on, flag=name)


def exclude(df: DataFrame, other: DataFrame, on: Keys, later_than: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``df`` without a partner in ``other``.

    ``later_than=(other_ts, df_ts)`` counts only partners after the row's own time. Some
    partner is later exactly when the latest is, so ``other`` is reduced to one row per
    key first and the residual compares a single pair.
    """
    pairs = _pairs(on)
    keys = [F.col(r).alias(f"__key{i}") for i, (_, r) in enumerate(pairs)]
    condition = all_of([F.col(l) == F.col(f"__key{i}") for i, (l, _) in enumerate(pairs)])
    if later_than is None:
        return df.join(other.select(*keys).distinct(), condition, "left_anti")
    other_ts, df_ts = later_than
    latest = other.groupBy(*keys).agg(F.max(other_ts).alias("__latest"))
    return df.join(latest, condition & (F.col("__latest") > F.col(df_ts)), "left_anti")


def asof_forward(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    lts: str,
    rts: str,
    strict: bool = True,
    tiebreak: Sequence[str] = (),
    own: Sequence[str] = (),
    piece_rows: int = scan.PIECE_ROWS,
) -> DataFrame:
    """Each left row with the first right row of its key after it; unmatched rows stay.

    ``strict`` wants a later time, otherwise the same instant matches too. Right rows with
    one time are ordered by ``tiebreak``. ``own`` names left columns that tell left rows of one instant apart.

    No pair is ever formed. Both sides are merged into one time line and a running last value, read
    backwards, finds the match. Keys of more than ``piece_rows`` rows are cut into pieces (`scan.cut`), by time
    and within an instant too: a row with no match in its piece takes the first right row of the
    nearest later piece, found on a frame of one row per piece.
    """
    keys = [on] if isinstance(on, str) else list(on)
    carried = [c for c in right.columns if c not in keys]
    clash = set(left.columns) & set(carried)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    # Reading backwards, a right row at the same instant must come after the left row
    # to be invisible to it (strict), or before it to be seen.
    lside, rside = (1, 0) if strict else (0, 1)
    ties = [f"__tie{i}" for i in range(len(tiebreak))]
    order = ["__t", "__side", *ties, *[f"__own{i}" for i in range(len(own))]]
    events = right.filter(all_of([F.col(rts).isNotNull(), *[F.col(k).isNotNull() for k in keys]]))
    events = events.select(*keys, F.col(rts).alias("__t"), F.lit(rside).alias("__side"), *[F.col(t).alias(n) for t, n in zip(tiebreak, ties, strict=True)], F.struct(*carried).alias("__event"))
    rows = left.select(*keys, F.col(lts).alias("__t"), F.lit(lside).alias("__side"), *[F.col(x).alias(f"__own{i}") for i, x in enumerate(own)], F.struct(*left.columns).alias("__row"))
    line = rows.unionByName(events, allowMissingColumns=True)
    cut = scan.cut(line, keys, order, piece_rows)

    backwards = [F.col(x).desc_nulls_first() for x in order]
    whole = keys if cut is None else ["__piece"]
    inside = Window.partitionBy(*whole).orderBy(*backwards).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (line if cut is None else cut).withColumn("__inside", F.last("__event", ignorenulls=True).over(inside)).filter(F.col("__row").isNotNull())
    if cut is None:
        return found.select("__row.*", *[F.col("__inside")[c].alias(c) for c in carried])
    at = F.when(F.col("__event").isNotNull(), scan.place(order))
    first = cut.filter("__split").groupBy(F.col("__piece").alias("__at")).agg(F.min_by("__event", at).alias("__first"))
    later = scan.along("__at", keys, backwards=True).rowsBetween(Window.unboundedPreceding, -1)
    carry = first.select("__at", F.last("__first", ignorenulls=True).over(later).alias("__later")).filter(F.col("__later").isNotNull())
    hit = F.coalesce(F.col("__inside"), F.col("__later"))
    return found.join(carry, F.col("__piece") == F.col("__at"), "left").select("__row.*", *[hit[c].alias(c) for c in carried])


def lookback_max(anchors: DataFrame, events: DataFrame, on: str, metric: str, started: str, anchor_date: str, months: int, name: str) -> DataFrame:
    """The key's worst record, attached to anchors when it began within ``months`` before them.

    Only the single worst record of a key is considered, as in the eligibility rules: a
    smaller, more recent one does not stand in for it. Ties go to the latest start.
    """
    worst = worst_per_key(
        events.select(on, F.col(metric).alias(name), F.col(started).alias(f"{name}_from")),
        on,
        [name, f"{name}_from"],
        tiebreak=[],
    )
    recent = F.col(f"{name}_from") >= F.add_months(F.col(anchor_date), -months)
    return attach(anchors, worst, on, extra=recent)


def fallback_fill(df: DataFrame, snapshot: DataFrame, on: Keys, cols: Mapping[str, str] | Sequence[str], follows: Mapping[str, str] | None = None) -> DataFrame:
    """Fill missing ``cols`` from a one-row-per-key snapshot.

    ``cols`` maps a column to its snapshot column (or lists shared names). A column in
    ``follows`` is taken from the snapshot when the column it follows is missing, whatever
    its own value: a pull date travels with the score it dates.
    """
    follows = dict(follows or {})
    cols = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    sources = {**cols, **{c: cols.get(c, c) for c in follows}}
    keys = [r for _, r in _pairs(on)]
    side = snapshot.select(*keys, *[F.col(s).alias(f"__fill_{c}") for c, s in sources.items()])
    out = attach(df, side, on)
    filled = {}
    for c in sources:
        lead = follows.get(c, c)
        filled[c] = F.when(F.col(lead).isNull(), F.col(f"__fill_{c}")).otherwise(F.col(c))
    return out.withColumns(filled).drop(*[f"__fill_{c}" for c in sources])


def compare_groups(df: DataFrame, keys, group: str, metrics: Sequence[str], suffixes: Mapping, how: str = "inner") -> DataFrame:
    """One row per key with each group's metrics side by side.

    The reference form joins the frame to itself once per group; one aggregation reads it
    once. Expects one row per (key, group). ``how="inner"`` keeps keys present in every
    group, ``"left"`` those present in the first.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    groups = list(suffixes)
    aggs = [F.max(F.when(F.col(group) == F.lit(g), F.col(m))).alias(m + suffixes[g]) for m in metrics for g in groups]
    needed = groups if how == "inner" else groups[:1]
    present = [F.max((F.col(group) == F.lit(g)).cast("int")).alias(f"__in{i}") for i, g in enumerate(needed)]
    out = df.dropna(subset=[*keys, group]).groupBy(*keys).agg(*aggs, *present)
    return out.filter(all_of([F.col(f"__in{i}") == 1 for i in range(len(needed))])).drop(*[f"__in{i}" for i in range(len(needed))])

