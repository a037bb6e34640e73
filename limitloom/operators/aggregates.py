"""Grouped tables: pivots, thresholds, two-stage means, cut points, flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.functions import cond_count, cond_sum


def _as_list(x) -> list:
    return list(x) if isinstance(x, (list, tuple)) else [x]


def pivot_months(df: DataFrame, keys, month: str, x: str, months: Sequence[str], prefix: str) -> DataFrame:
    """One column per listed month: the sum of ``x`` in it, 0 without rows."""
    aggs = [cond_sum(F.col(month) == m, x).alias(f"{prefix}_{m.replace('-', '')}") for m in months]
    return df.groupBy(*_as_list(keys)).agg(*aggs)


def ever_flags(df: DataFrame, keys, metric: str, tests: Mapping[str, tuple[str, float]]) -> DataFrame:
    """The key's maximum of ``metric`` against thresholds: ``{"ever_late": (">", 0)}``."""
    peak = df.groupBy(*_as_list(keys)).agg(F.max(metric).alias(f"max_{metric}"))
    m = F.col(f"max_{metric}")
    compare = {">": m.__gt__, ">=": m.__ge__, "<": m.__lt__, "<=": m.__le__}
    return peak.withColumns({n: F.when(compare[op](t), 1).otherwise(0) for n, (op, t) in tests.items()})


def any_and_any(df: DataFrame, keys, first: Column, second: Column, name: str) -> DataFrame:
    """1 when the key has a row meeting ``first`` and a row, maybe another, meeting ``second``."""
    met = lambda c: F.max(F.when(c, 1).otherwise(0)) > 0
    return df.groupBy(*_as_list(keys)).agg(F.when(met(first) & met(second), 1).otherwise(0).alias(name))


def mean_then_sum(
    df: DataFrame, keys, step: str, x: str, name: str, counted: str | None = None, largest: str | None = None
) -> DataFrame:
    """Mean of ``x`` per (key, step), summed over the steps. Not the mean of all rows.

    With ``counted``, also the largest per-step count of its non-missing values; with
    ``largest``, the highest per-step sum of a count column the frame already holds.
    """
    keys = _as_list(keys)
    inner, outer = [F.avg(x).alias("__mean")], [F.coalesce(F.sum("__mean"), F.lit(0.0)).alias(name)]
    if counted:
        inner.append(F.count(counted).alias("__n"))
        outer.append(F.max("__n").alias(f"{counted}_count"))
    if largest:
        inner.append(F.sum(largest).alias("__l"))
        outer.append(F.max("__l").alias(f"{largest}_largest"))
    steps = df.dropna(subset=[*keys, step]).groupBy(*keys, step).agg(*inner)
    return steps.groupBy(*keys).agg(*outer)


def count_of_counts(df: DataFrame, keys, per: str, of: str) -> DataFrame:
    """How many keys have 1, 2, 3 .. rows."""
    return df.groupBy(*_as_list(keys)).count().groupBy(F.col("count").alias(per)).agg(F.count(F.lit(1)).alias(of))


# The cut levels of the score study (fixed values).
CUT_LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def cut_points(df: DataFrame, score: str, positive: Column, counted: str, cuts: Sequence[float] = CUT_LEVELS, labels=("hram", "non_hram")) -> DataFrame:
    """For each cut: how many of each class score at or above it, and what share of the class.

    All counts are taken in one pass over the frame; the single result row is then unfolded
    to one row per cut. A class without rows has a missing share.
    """
    hit, miss = labels
    positive, s = F.coalesce(positive, F.lit(False)), F.col(score)
    aggs = [cond_count(positive, counted).alias("__p"), cond_count(~positive, counted).alias("__n")]
    for i, c in enumerate(cuts):
        aggs += [cond_count(positive & (s >= c), counted).alias(f"__p{i}"), cond_count(~positive & (s >= c), counted).alias(f"__n{i}")]
    rows = F.array(*[F.struct(F.lit(float(c)).alias("cut_level"), F.col(f"__n{i}").alias("n"), F.col(f"__p{i}").alias("p")) for i, c in enumerate(cuts)])
    share = lambda part, whole: F.try_divide(part.cast("double"), whole.cast("double"))
    return (
        df.agg(*aggs)
        .select("__p", "__n", F.explode(rows).alias("r"))
        .select(
            F.col("r.cut_level"),
            share(F.col("r.n"), F.col("__n")).alias(f"{miss}_cut_percentage"),
            F.col("r.n").alias(f"{miss}_cut_volume"),
            share(F.col("r.p"), F.col("__p")).alias(f"{hit}_cut_percentage"),
            F.col("r.p").alias(f"{hit}_cut_volume"),
        )
    )


def bucket_histogram(df: DataFrame, bucket, group) -> DataFrame:
    return df.groupBy(*_as_list(group), *_as_list(bucket)).agg(F.count(F.lit(1)).alias("n"))


def flow_edges(df: DataFrame, stages: Sequence[str], value: str | None = None) -> DataFrame:
    """Links ``(step, source, target, value)`` between consecutive stage columns.

    Rows are first counted per combination of stage labels, so only the combinations are
    unfolded into links.
    """
    if len(stages) < 2:
        raise ValueError("a flow needs two stages or more")
    weight = F.count(F.lit(1)) if value is None else F.sum(value)
    combos = df.groupBy(*stages).agg(weight.alias("__w"))
    links = F.array(
        *[
            F.struct(F.lit(i + 1).alias("step"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"))
            for i, (a, b) in enumerate(zip(stages, stages[1:]))
        ]
    )
    return (
        combos.select(F.explode(links).alias("l"), "__w")
        .groupBy("l.step", "l.source", "l.target")
        .agg(F.sum("__w").alias("value"))
        .filter(F.col("source").isNotNull() & F.col("target").isNotNull())
    )


def distinct_values(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols).distinct()


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both frames by column name, exact duplicates removed."""
    return a.unionByName(b).distinct()
