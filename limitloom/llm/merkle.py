"""Merkle manifest of a table as a persistent, path-copying tree.

Each group's rows, in key order, are the leaves of a tree whose nodes hash runs of eight; the groups' roots, in group
order, are the leaves of one more such tree. Aligned blocks of 512 leaves are grown in one task each; their tops are the leaves
of the next, 512 times smaller table of blocks, until one block per group is left. Going down again, each block gets the path
from its top to the root once. A changed leaf is a version of the tree: it copies its ancestors inside the block, then
those on the block's path, and shares every other node with the first version.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitloom.llm.frames import durable

RUN, LEVELS = 8, 3
BLOCK = RUN**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_BLOCKS = "grp string, block long, n long, keys array<string>, changed array<binary>, levels array<binary>"
_PATHS = "grp string, idx long, key string, path array<struct<at:int,run:binary>>, digest binary, subroot binary, root binary"
_VERSIONS = "key string, grp string, idx long, leaf string, subroot string, root string, proof string, folded_root string, copies array<string>"


def entry(value: Column) -> Column:
    """`-` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(entry(c) for c in columns)), 256)


def leaves(docs: DataFrame, changes: dict[str, Column], where: Column, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """grp, key, leaf and, of rows that meet ``where``, the changed leaf that ``changes`` (column: new value) makes."""
    before = leaf_hash([F.col(c) for c in columns])
    after = leaf_hash([changes.get(c, F.col(c)) for c in columns])
    return docs.select(
        F.col(group).cast("string").alias("grp"), F.col(key).alias("key"), F.unhex(before).alias("digest"), F.when(where, F.unhex(after)).alias("changed")
    )


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with grp) and idx, the place within the group from 0, and n, the group's size.

    Rows are range-partitioned and stored; only counts per range and group are summed up in order. The place in
    the input is the last tie-break, so rows that are alike spread over ranges too.
    """
    spread = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = ["grp", *order, "tie"]
    placed = durable(spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie").withColumn("place", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("place", 33)
    runs = placed.groupBy("grp", part.alias("part")).agg(F.min("place").alias("first"), F.count("*").alias("held"))
    group = Window.partitionBy("grp")
    runs = runs.select(
        F.col("grp").alias("run_grp"), F.col("part").alias("run_part"), F.sum("held").over(group).alias("n"),
        (F.sum("held").over(group.orderBy("part")) - F.col("held") - F.col("first")).alias("shift"),
    )
    met = placed.join(runs, F.col("grp").eqNullSafe(F.col("run_grp")) & (part == F.col("run_part")))
    return met.withColumn("idx", F.col("place") + F.col("shift")).drop("run_grp", "run_part", "shift", "place")


def digest(run: list[bytes]) -> bytes:
    """Hash of a run of nodes, joined as hex text."""
    return sha256(b"".join(run).hex().encode()).digest()


def split(nodes: bytes) -> list[bytes]:
    return [nodes[i : i + 32] for i in range(0, len(nodes), 32)]


def grow(nodes: list[bytes], n: int) -> list[list[bytes]]:
    """The levels of a block's tree, ``nodes`` first: three, or up to the single node in a group of ``n`` nodes that is one block."""
    levels, left = [nodes], n if n <= BLOCK else BLOCK
    while left > 1:
        below = levels[-1]
        levels.append([digest(below[i : i + RUN]) for i in range(0, len(below), RUN)])
        left = -(-left // RUN)
    return levels


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block at a time, from rows in order; a block starts at every multiple of its size."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        starts = np.flatnonzero(table.column("idx").to_numpy() % BLOCK == 0)
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            yield table.slice(a, b - a)
        held = table.slice(int(starts[-1]))
    if held is not None:
        yield held


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _whole_blocks(batches):
        n = block.column("n")[0].as_py()
        levels = grow(block.column("digest").to_pylist(), n)
        row = {
            "grp": block.column("grp")[0].as_py(), "block": block.column("idx")[0].as_py() // BLOCK, "n": n,
            "keys": block.column("key").to_pylist(), "changed": block.column("changed").to_pylist(), "levels": [b"".join(x) for x in levels],
        }
        kinds = pa.schema([("grp", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.string())), ("changed", pa.list_(pa.binary())), ("levels", pa.list_(pa.binary()))])
        yield pa.RecordBatch.from_pylist([row], kinds)


def blocks(nodes: DataFrame) -> DataFrame:
    """Stored rows of blocks from nodes (grp, idx, n, digest, key, changed)."""
    ordered = nodes.withColumn("block", F.floor(F.col("idx") / BLOCK)).repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")
    columns = ["grp", "idx", "n", "digest", F.col("key").cast("string").alias("key"), "changed"]
    return durable(ordered.select(*columns).mapInArrow(_build, _BLOCKS), "blocks")


def _top() -> Column:
    return F.element_at("levels", -1)


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, each over the tops of the one before, until every group has a single node."""
    out = [blocks(nodes)]
    while out[-1].filter(F.col("n") > BLOCK).limit(1).count():
        above = out[-1].filter(F.col("n") > BLOCK)
        out.append(blocks(above.select("grp", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), _top().alias("digest"), F.lit(None).cast("string").alias("key"), F.lit(None).cast("binary").alias("changed"))))
    return out


@dataclass
class Tree:
    """Stored tables of blocks, bottom first: ``groups`` over the leaves of each group, ``top`` over the groups' roots."""

    groups: list[DataFrame]
    top: list[DataFrame]


def build(rows: DataFrame) -> Tree:
    """The tree of ``leaves``: ascending key (null first) in each group, groups ascending bytewise (null first)."""
    # hashes are stored before they are sorted, as the sort draws a sample of its input first
    groups = _rounds(ranked(durable(rows, "leaves"), ["key", "digest"]))
    roots = None
    for table in groups:
        ended = table.filter(F.col("n") <= BLOCK).select(F.lit("").alias("grp"), F.col("grp").alias("key"), _top().alias("digest"))
        roots = ended if roots is None else roots.unionByName(ended)
    return Tree(groups, _rounds(ranked(roots, ["key"]).withColumn("changed", F.lit(None).cast("binary"))))


def _run_of(levels: list[list[bytes]], at: int) -> Iterator[tuple[int, list[bytes]]]:
    """On each level but the last, the place in its run of the node above leaf ``at``, and that run."""
    for level in levels[:-1]:
        start = at - at % RUN
        yield at - start, level[start : start + RUN]
        at //= RUN


def _levels(column: pa.Array, row: int) -> list[list[bytes]]:
    return [split(x) for x in column[row].as_py()]


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of each leaf of a block: its runs in the block, then the block's own path."""
    for batch in batches:
        for r in range(batch.num_rows):
            grp, block, n, keys, above, subroot, root = (batch.column(c)[r].as_py() for c in ("grp", "block", "n", "keys", "path", "subroot", "root"))
            levels = _levels(batch.column("levels"), r)
            rows = [
                {"grp": grp, "idx": block * BLOCK + i, "key": keys[i], "path": [{"at": at, "run": b"".join(run)} for at, run in _run_of(levels, i)] + above, "digest": levels[0][i], "subroot": subroot, "root": root}
                for i in range(len(levels[0]))
            ]
            kinds = pa.schema([("grp", pa.string()), ("idx", pa.int64()), ("key", pa.string()), ("path", pa.list_(pa.struct([("at", pa.int32()), ("run", pa.binary())]))), ("digest", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
            yield pa.RecordBatch.from_pylist(rows, kinds)


def _down(rounds: list[DataFrame], ended: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The lowest blocks with the path from their top to the root; ``ended`` gives it to blocks that are a group's only one."""
    below = None
    for table in reversed(rounds):
        whole = ended(table.filter(F.col("n") <= BLOCK))
        if below is not None:
            paths = below.mapInArrow(_children, _PATHS)
            paths = paths.select(F.col("grp").alias("up_grp"), "idx", "path", "subroot", "root")
            part = table.filter(F.col("n") > BLOCK).join(paths, F.col("grp").eqNullSafe(F.col("up_grp")) & (F.col("block") == F.col("idx")))
            whole = whole.unionByName(part.drop("up_grp", "idx"))
        below = whole
    return below


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            grp, block, keys, changed, above, subroot, root = (batch.column(c)[r].as_py() for c in ("grp", "block", "keys", "changed", "path", "subroot", "root"))
            levels = _levels(batch.column("levels"), r)
            above = [(p["at"], split(p["run"])) for p in above]
            rest = "".join(x.hex() for at, run in above for x in run[:at] + run[at + 1 :])
            out = {name: [] for name in ("key", "grp", "idx", "leaf", "subroot", "root", "proof", "folded_root", "copies")}
            for i, leaf in enumerate(levels[0]):
                inside = list(_run_of(levels, i))
                copies = [leaf if changed[i] is None else changed[i]]
                for at, run in inside + above:
                    copies.append(digest([*run[:at], copies[-1], *run[at + 1 :]]))
                siblings = b"".join(x for at, run in inside for x in run[:at] + run[at + 1 :])
                values = (keys[i], grp, block * BLOCK + i, leaf.hex(), subroot.hex(), root.hex(), siblings.hex() + rest, copies[-1].hex(), None if changed[i] is None else [c.hex() for c in copies])
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            kinds = pa.schema([(name, pa.int64() if name == "idx" else pa.list_(pa.string()) if name == "copies" else pa.string()) for name in out])
            yield pa.RecordBatch.from_pydict(out, kinds)


def versions(tree: Tree) -> DataFrame:
    """A row per leaf: key (as text), grp, idx, leaf, subroot, root, proof, folded_root, copies.

    ``proof`` is the hex text of all siblings, level by level from the leaf to the root, left to right. ``folded_root`` is the root
    that the changed leaf, or else the leaf itself, gives with those siblings. Of changed leaves, ``copies`` holds the version's own nodes, the new leaf first
    and its root last: on level l it replaces node ``idx // 8**l``; every other node is the first version's.
    """
    top_path = F.array().cast("array<struct<at:int,run:binary>>")
    top = _down(tree.top, lambda t: t.select("*", top_path.alias("path"), F.lit(None).cast("binary").alias("subroot"), _top().alias("root")))
    paths = top.mapInArrow(_children, _PATHS).select(F.col("key").alias("label"), "path", F.col("digest").alias("subroot"), "root")
    paths = durable(paths, "group-paths")
    lowest = _down(tree.groups, lambda t: t.join(paths, F.col("grp").eqNullSafe(F.col("label"))).drop("label"))
    return lowest.mapInArrow(_fold, _VERSIONS)


def base_nodes(tree: Tree) -> DataFrame:
    """grp, level, idx, digest: every node of the first version's group trees, leaves at level 0."""
    out = None
    for i, table in enumerate(tree.groups):
        level = F.posexplode("levels").alias("level", "nodes")
        nodes = table.select("grp", "block", level).filter(F.col("level") > 0 if i else F.lit(True))
        each = F.posexplode(F.expr("transform(sequence(0, cast(length(nodes) / 32 as int) - 1), i -> hex(substring(nodes, i * 32 + 1, 32)))")).alias("place", "digest")
        first = F.col("block") * F.pow(F.lit(RUN), F.lit(LEVELS) - F.col("level")).cast("long")
        nodes = nodes.select("grp", "block", "level", each).select("grp", (F.col("level") + i * LEVELS).alias("level"), (first + F.col("place")).alias("idx"), F.lower("digest").alias("digest"))
        out = nodes if out is None else out.unionByName(nodes)
    return out


def manifest(docs: DataFrame, changes: dict[str, Column], where: Column, group: str = "lang", key: str = "doc_id", columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """``versions`` of the tree over ``docs`` with its key in the type it has there.

    Null values hash as `-`; rows with a null group are a group of their own, first; null keys come first. Rows repeated with the
    same key are leaves each, in the order of their hashes, and equal rows may swap places without any change. Further columns are not read. An empty table gives no rows.
    """
    out = versions(build(leaves(docs, changes, where, group, key, columns)))
    return out.withColumn("key", F.col("key").cast(docs.schema[key].dataType))
