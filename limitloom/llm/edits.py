"""Token counts of edited documents from segment trees.

A text is cut into leaves at spaces between two non-space characters, where the vocabulary's
pre-tokens always end. A tree over the leaves sums their characters and tokens. An edit re-encodes the
leaves it touches, widened until both borders lie beyond its reach, and updates the sums above.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import durable
from limitloom.llm.packing import encoder

LEAF = 256
_CUT = re.compile(r"(?<=\S) (?=\S)")


class SegmentTree:
    """Sums of leaf characters and tokens; node 1 is the root, leaves start at half the length."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.chars, self.tokens = chars, tokens

    @classmethod
    def of_leaves(cls, chars: list[int], tokens: list[int]) -> SegmentTree:
        size = 1
        while size < len(chars):
            size *= 2
        pad = [0] * (size - len(chars))
        tree = cls([0] * size + chars + pad, [0] * size + tokens + pad)
        for i in range(size - 1, 0, -1):
            tree._sum(i)
        return tree

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def size(self) -> int:
        return len(self.chars) // 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one beyond the end) and where it starts."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def replace(self, first: int, last: int, chars: int, tokens: int) -> None:
        """Leaf ``first`` takes the place of leaves ``first`` to ``last``."""
        for i in range(first, last + 1):
            self.chars[self.size + i], self.tokens[self.size + i] = (chars, tokens) if i == first else (0, 0)
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


def leaves(text: str) -> list[str]:
    out, start = [], 0
    while start < len(text):
        cut = _CUT.search(text, start + LEAF)
        stop = cut.start() if cut else len(text)
        out.append(text[start:stop])
        start = stop
    return out


def grow(text: str, count) -> SegmentTree:
    parts = leaves(text)
    return SegmentTree.of_leaves([len(p) for p in parts] or [0], [count(p) for p in parts] or [0])


def clipped(edits: list[tuple], length: int) -> list[tuple[int, int, str]]:
    """Edits in order, within the text, each from the end of the one before at least; nulls are 0, 0 and empty."""
    out, last = [], 0
    for start, stop, put in sorted((a or 0, b or 0, c or "") for a, b, c in edits):
        start = min(max(start, last, 0), length)
        stop = min(max(stop, start), length)
        if stop > start or put:
            out.append((start, stop, put))
            last = stop
    return out


def recount(text: str, tree: SegmentTree, edits: list[tuple], count) -> int:
    """Applies ``edits`` (start, stop, replacement; positions in ``text``) to the tree; returns the characters encoded again."""
    touched: list[list] = []  # first leaf, last leaf, start, stop, edits
    for start, stop, put in clipped(edits, len(text)):
        # a border stays one if the characters beside it stay: its space, the one before and the one after
        first, a = tree.find(max(0, start - 2))
        last, b = tree.find(stop + 1)
        b += tree.chars[tree.size + last]
        if touched and touched[-1][1] >= first:
            touched[-1][1], touched[-1][3] = max(touched[-1][1], last), max(touched[-1][3], b)
            touched[-1][4].append((start, stop, put))
        else:
            touched.append([first, last, a, b, [(start, stop, put)]])
    encoded = 0
    for first, last, a, b, own in touched:
        parts, at = [], a
        for start, stop, put in own:
            parts += [text[at:start], put]
            at = stop
        new = "".join([*parts, text[at:b]])
        encoded += len(new)
        tree.replace(first, last, len(new), count(new))
    return encoded


def stored_trees(docs: DataFrame, edits: Column, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """A stored table of texts with their segment trees and pending ``edits`` (array of start, stop, put)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            trees = [grow(t.as_py() or "", lambda s: len(encode(s)) // 4) for t in batch.column(1)]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t.chars for t in trees], kind), pa.array([t.tokens for t in trees], kind)], ["doc_id", "text", "edits", "chars", "tokens"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), edits.alias("edits"))
    kinds = "doc_id long, text string, edits array<struct<start: int, stop: int, put: string>>, chars array<int>, tokens array<int>"
    return durable(rows.mapInArrow(run, kinds), "segment-trees")


def apply_edits(trees: DataFrame, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """doc_id, chars_before, tokens_before, chars_after, tokens_after, chars_encoded of every row of stored trees.

    A null text is empty, null edits are none; edits beyond the text are moved to its end, and an edit that overlaps the
    one before it starts at that one's end. Every row is a document of its own, whatever its id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        names = ("chars_before", "tokens_before", "chars_after", "tokens_after", "chars_encoded")
        for batch in batches:
            out = []
            for text, edits, chars, tokens in zip(*(batch.column(i) for i in range(1, 5)), strict=True):
                tree = SegmentTree(chars.as_py(), tokens.as_py())
                before = tree.chars[1], tree.tokens[1]
                own = [(e["start"], e["stop"], e["put"]) for e in edits.as_py() or () if e]
                encoded = recount(text.as_py() or "", tree, own, lambda s: len(encode(s)) // 4)
                out.append((*before, tree.chars[1], tree.tokens[1], encoded))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)], ["doc_id", *names])

    kinds = "doc_id long, chars_before long, tokens_before long, chars_after long, tokens_after long, chars_encoded long"
    return trees.select("doc_id", "text", "edits", "chars", "tokens").mapInArrow(run, kinds)


def sample_edits(text: str = "text", key: str = "doc_id") -> Column:
    """Three edits per text from a hash of its id: a passage repeated elsewhere, a cut, a replaced stretch with white space."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)
    draw = lambda i: F.pmod(F.xxhash64(F.col(key), F.lit(i)), F.lit(1 << 30)).cast("int")
    place = lambda i: F.when(n > 0, draw(i) % F.greatest(n, F.lit(1))).otherwise(0)
    edit = lambda start, stop, put: F.struct(start.cast("int").alias("start"), stop.cast("int").alias("stop"), put.alias("put"))
    return F.array(
        edit(place(1), place(1), F.substring(t, place(2) + 1, F.lit(40))),
        edit(place(3), place(3) + draw(4) % 60, F.lit("")),
        edit(place(5), place(5) + draw(6) % 20, F.concat(F.lit("  "), F.substring(t, place(7) + 1, draw(8) % 30), F.lit("\n"))),
    )
