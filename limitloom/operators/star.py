"""Enrichment from many side tables at once.

Side tables of one key are laid out below each other as one tall frame, a few columns per side, and
aggregated by the key once: one exchange and one join, however many sides there are.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A side: its frame and, by name, what each row contributes and how contributions are combined.
Side = tuple[DataFrame, Mapping[str, tuple[Column, Callable[[str], Column]]]]


def gather(keys: str | Sequence[str], sides: Sequence[Side]) -> DataFrame:
    """One row per key of any side with all sides' aggregates; missing where a side lacks the key.

    Aggregates skip missing values, so a side's columns do not see the rows of the others. Partial results are
    merged before the exchange; rows without a first key are left out, as a join would.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    tall, combine = None, {}
    for frame, values in sides:
        part = frame.select(*[k for k in keys if k in frame.columns], *[value.alias(name) for name, (value, _) in values.items()])
        tall = part if tall is None else tall.unionByName(part, allowMissingColumns=True)
        combine |= {name: how for name, (_, how) in values.items()}
    return tall.filter(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(*[how(name).alias(name) for name, how in combine.items()])


def _number(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType.typeName()
    return F.unix_micros(name) if kind.startswith("timestamp") else F.unix_date(name) if kind == "date" else F.col(name)


def newest(df: DataFrame, by: Sequence[str], ties: Sequence[str | Column], kept: Sequence[str] = (), **keep: Column) -> Column:
    """A struct whose minimum is the row latest in ``by`` (missing last), then first in ``ties`` (ascending, missing last), with what to keep of it.

    Ties named in ``kept`` are kept under their names, without a second copy.
    """
    fields = []
    for i, name in enumerate(by):
        fields += [F.col(name).isNull().alias(f"__none{i}"), (-_number(df, name)).alias(f"__by{i}")]
    for i, tie in enumerate(ties):
        name = tie if isinstance(tie, str) and tie in kept else f"__tie{i}"
        tie = F.col(tie) if isinstance(tie, str) else tie
        fields += [tie.isNull().alias(f"__void{i}"), tie.alias(name)]
    return F.struct(*fields, *[value.alias(name) for name, value in keep.items()])
