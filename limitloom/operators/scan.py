"""Cutting long keys into pieces along their order, for scans that carry a value from piece to piece.

A window over a key puts the whole key into one task. Here a sample of (key, place) pairs shows which keys are long and where to
cut them: a key's pieces hold about the same number of rows however its rows crowd in time, since places are compared down to the
last tie-break. Rows then meet by piece, and a frame with one row per piece of the long keys carries what the scan needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitloom.session import durable

# A piece holds about this many rows; about SAMPLES of them are drawn. A key has MOST pieces at most, larger ones if need be.
PIECE_ROWS, SAMPLES, MOST = 1 << 20, 64, 1024
# Cuts are looked up in two steps, a shelf of SHELF cuts first.
SHELF = 32


def place(order: Sequence[str]) -> Column:
    """Position along ``order`` (ascending, nulls last) as one value that compares."""
    return F.struct(*[x for i, name in enumerate(order) for x in (F.col(name).isNull().alias(f"null{i}"), F.col(name).alias(f"value{i}"))])


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])


def cuts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame:
    """(__of, shelves): for each key of more than one piece the places where its later pieces start, stored."""
    step = min(SAMPLES, piece_rows)
    drawn = rows.select(_key(keys).alias("__of"), place(order).alias("__place")).sample(step / piece_rows, seed=11)
    by_key = Window.partitionBy("__of")
    drawn = drawn.withColumns({"__nth": F.row_number().over(by_key.orderBy("__place")) - 1, "__drawn": F.count(F.lit(1)).over(by_key)})
    apart = F.greatest(F.lit(step), F.ceil(F.col("__drawn") / MOST))
    starts = drawn.filter((F.col("__nth") > 0) & (F.col("__nth") % apart == 0))
    starts = starts.groupBy("__of").agg(F.array_sort(F.collect_set("__place")).alias("starts"))
    shelves = F.transform(F.sequence(F.lit(0), F.floor((F.size("starts") - 1) / SHELF).cast("int")), lambda i: F.slice("starts", i * SHELF + 1, SHELF))
    return durable(starts.select("__of", shelves.alias("shelves")), "cuts")


def long_keys(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS) -> bool:
    """Whether any key has more rows than a piece."""
    return bool(cuts(rows, keys, order, piece_rows).limit(1).count())


def _nth_piece(order: Sequence[str]) -> Column:
    """Number of cuts at or before a row; a struct keeps the row's place from being built twice per lambda."""
    here = F.col("__place")
    shelf = F.size(F.filter("shelves", lambda s: s[0] <= here))
    inside = F.size(F.filter(F.element_at("shelves", shelf), lambda s: s <= here))
    return F.when(F.col("shelves").isNull() | (shelf == 0), 0).otherwise((shelf - 1) * SHELF + inside)


def cut(rows: DataFrame, keys: Sequence[str], order: Sequence[str], piece_rows: int = PIECE_ROWS) -> DataFrame | None:
    """``rows`` with __piece (struct: the key's columns and the number ``at`` of the piece) and __split (its key has several).

    None if every key is one piece. The piece is a struct and never missing itself, so missing keys meet missing keys.
    """
    found = cuts(rows, keys, order, piece_rows)
    if not found.limit(1).count():
        return None
    placed = rows.withColumns({"__key": _key(keys), "__place": place(order)})
    met = placed.join(found, F.col("__key") == F.col("__of"), "left")
    met = met.withColumns({"__nth": _nth_piece(order), "__split": F.col("shelves").isNotNull()})
    piece = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col("__nth").alias("at"))
    return met.withColumn("__piece", piece).drop("__key", "__place", "__of", "shelves", "__nth")


def along(piece: str, keys: Sequence[str], backwards: bool = False) -> Window:
    """Window over the pieces of a key, in order."""
    at = F.col(f"{piece}.at")
    return Window.partitionBy(*[F.col(f"{piece}.k{i}") for i in range(len(keys))]).orderBy(at.desc() if backwards else at.asc())
