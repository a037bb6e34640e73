"""Even split of a whole population, without a single-partition sort."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.session import durable

# Values of a cell that are few enough to be read and sorted.
FEW = 1024


class _Digits:
    """Ids as numbers or bytes read from the most significant digit: cells of one level are ranges in order."""

    def __init__(self, ids: DataFrame):
        kind = ids.schema["id"].dataType.typeName()
        self.text = kind == "string"
        if kind in ("byte", "short", "integer", "long"):
            self.value = F.col("id").cast("long")
        elif kind == "date":
            self.value = F.unix_date("id").cast("long")
        elif kind == "timestamp":
            self.value = F.unix_micros("id")
        elif self.text:
            self.value = F.col("id").cast("binary")
        else:
            raise ValueError(f"cannot split by an id of type {kind}")

    def first(self, low, high) -> int:
        """The level before the first at which the least and the greatest value differ."""
        if not self.text:
            return max(8, (low ^ high).bit_length()) if (low < 0) == (high < 0) else 64
        return next((i for i, (a, b) in enumerate(zip(low, high, strict=False)) if a != b), min(len(low), len(high)))

    def finer(self, level: int) -> int:
        return level + 1 if self.text else max(0, level - 8)

    def cell(self, level: int) -> Column:
        """A digit more per level: eight bits of a number, a byte of a text."""
        if self.text:
            return F.substring(self.value, 1, level)
        return self.value if level == 0 else F.shiftright(self.value, min(level, 63))


def _counts(ids: DataFrame, cell: Column, within: Column, known: list) -> dict:
    """Rows per cell inside the known coarser cells: at most 257 per known cell."""
    rows = ids.filter(within.isin(known)).groupBy(cell.alias("cell")).count().collect()
    return {bytes(r["cell"]) if isinstance(r["cell"], (bytes, bytearray)) else r["cell"]: r["count"] for r in rows}


def order_statistics(ids: DataFrame, ranks: list[int]) -> list:
    """The values of the unique column ``id`` with the given numbers of smaller values.

    Histograms are refined around the wanted ranks, one digit a round, until the cell of a rank holds few values, which are read.
    What reaches the driver depends on the number of ranks, not on rows or partitions.
    """
    digits = _Digits(ids)
    low, high = ids.agg(F.min(digits.value), F.max(digits.value)).first()
    low, high = (bytes(low), bytes(high)) if digits.text else (low, high)
    level = digits.first(low, high)
    start = low[:level] if digits.text else low >> min(level, 63)
    cells = {start} if digits.text or level < 64 else {-1, 0}
    # of each rank: the cell it lies in, the values before the cell
    if len(cells) > 1:
        level, counts = 63, _counts(ids, digits.cell(63), F.lit(0), [0])
        placed = _place(counts, {r: (None, 0) for r in ranks}, lambda _: sorted(counts))
    else:
        counts, placed = {start: None}, {r: (start, 0) for r in ranks}
    while any(counts[cell] is None or counts[cell] > FEW for cell, _ in placed.values()):
        finer = digits.finer(level)
        if finer == level:
            break
        found = _counts(ids, digits.cell(finer), digits.cell(level), sorted({cell for cell, _ in placed.values()}))
        parent = (lambda cell, n=level: cell[:n]) if digits.text else (lambda cell, n=level - finer: cell >> n)
        inside = defaultdict(list)
        for cell in sorted(found):
            inside[parent(cell)].append(cell)
        placed, counts, level = _place(found, placed, inside.__getitem__), found, finer
    wanted = sorted({cell for cell, _ in placed.values()})
    rows = ids.filter(digits.cell(level).isin(wanted)).select("id", digits.cell(level).alias("cell")).collect()
    held = defaultdict(list)
    for r in rows:
        held[bytes(r["cell"]) if digits.text else r["cell"]].append(r["id"])
    return [sorted(held[cell])[r - before] for r, (cell, before) in ((r, placed[r]) for r in ranks)]


def _place(counts: dict, placed: dict, inside) -> dict:
    """Each rank's cell on the next level."""
    out = {}
    for rank, (cell, before) in placed.items():
        for finer in inside(cell):
            if rank < before + counts[finer]:
                out[rank] = (finer, before)
                break
            before += counts[finer]
    return out


def tile_starts(df: DataFrame, unique: str, n: int) -> list:
    """The smallest ``unique`` value of tiles 2..n of an exact NTILE. A missing id comes first."""
    ids = durable(df.select(F.col(unique).alias("id")), "tile-ids")
    total, present = ids.agg(F.count(F.lit(1)), F.count("id")).first()
    base, extra = divmod(total, n)
    ranks = [i * base + min(i, extra) - (total - present) for i in range(1, n)]  # ids ahead of tile i + 1
    ranks = sorted({r for r in ranks if 0 <= r < present})
    return order_statistics(ids.filter("id is not null"), ranks) if ranks else []


def ntile_global(df: DataFrame, unique: str, n: int, name: str = "tile") -> DataFrame:
    """NTILE(n) over the whole frame ordered by a unique column (whole number, date, timestamp or text).

    Needs no shuffle of the frame itself: once the tile boundaries are known the tile is a
    comparison per row. The first ``rows mod n`` tiles get the extra row, as NTILE does.
    """
    tile: Column = F.lit(1)
    for start in tile_starts(df, unique, n):
        tile = tile + F.when(F.col(unique) >= F.lit(start), 1).otherwise(0)
    return df.withColumn(name, tile)
