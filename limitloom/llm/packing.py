"""Packing of tokenised documents into sequences by fitted length patterns.

Lengths are counted per whole corpus; the histogram has at most ``capacity`` bins. On it, patterns of
few documents that fill a sequence exactly are enumerated, their repeat counts fitted by
non-negative least squares, rounded, and what stays over is packed best-fit on the histogram.
The plan's size depends on ``capacity`` alone; documents find their place from their rank among equal lengths.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limitloom.llm.frames import durable, small_batches, texts

CAPACITY = 2048
# Text pieces an encoder remembers. It outlives its task in a worker that later stages use too; far fewer cost half as much time again.
_CACHE_ENTRIES = 250_000
_encoders: dict[str, PieceEncoder] = {}


class PieceEncoder:
    """Token ids as little-endian 32-bit bytes, remembered by text piece.

    The vocabulary splits text so that a space belongs to the word behind it. As long as no
    space is followed by further white space, the pieces between spaces are therefore
    encoded independently of each other. Other texts are encoded whole.
    """

    def __init__(self, ranks_path: str, special: dict[str, int]):
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._known: dict[str, bytes | None] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self._encoding.encode(text, allowed_special="all"), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        known = self._known
        try:
            return self.ids(head) + b"".join([known[w] for w in rest])
        except (KeyError, TypeError):
            pass
        parts = [self.ids(head)]
        for w in rest:
            part = known.get(w, b"?")
            if part == b"?":
                part = self.ids(" " + w) if w and not w[0].isspace() else None
                if len(w) <= 64:
                    if len(known) >= _CACHE_ENTRIES:
                        # frequent pieces were met early, so the older half stays
                        for old in list(known)[_CACHE_ENTRIES // 2 :]:
                            del known[old]
                    known[w] = part
            if part is None:
                return self.ids(text)
            parts.append(part)
        return b"".join(parts)


def encoder(name: str = "byte_bpe_50k") -> PieceEncoder:
    """The encoder of a public vocabulary; its ids are those of the tokenizers file of the same name."""
    import public_tokenizers

    if name not in _encoders:
        _encoders[name] = PieceEncoder(public_tokenizers.path(f"{name}.tiktoken"), {"<|endoftext|>": 50256})
    return _encoders[name]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, nth long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece of each document's ids followed by id 0.

    A null text counts as empty and gives the closing id alone. Documents of more than ``capacity`` ids
    are cut so that the first piece is the shorter one. ``task`` and ``nth`` number the pieces of
    one length within a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n, view, start = len(ids) // 4, memoryview(ids), 0
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                for piece, stop in enumerate(stops):
                    length = stop - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(view[4 * start : 4 * stop]), task, int(seen[length])))
                    seen[length] += 1
                    start = stop
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "task", "nth")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return texts(docs).mapInArrow(cut, PIECES)


def patterns(histogram: np.ndarray, per_length: int = 8) -> list[tuple[int, ...]]:
    """Patterns of one to four lengths in use, longest first, that fill a sequence exactly.

    All of one and two lengths; of three and four an even choice of ``per_length`` for each longest length.
    """
    capacity = len(histogram) - 1
    used = np.flatnonzero(histogram)
    has = histogram > 0
    out: list[tuple[int, ...]] = [(capacity,)] if has[capacity] else []
    for a in used[::-1].tolist():
        rest = capacity - a
        if not 0 < rest:
            continue
        if rest <= a and has[rest]:
            out.append((a, rest))
        b = used[(used <= min(a, rest - 1)) & (2 * used >= rest)]
        b = b[has[rest - b]]
        for x in b[np.unique(np.linspace(0, len(b) - 1, per_length).astype(int))].tolist() if len(b) else ():
            out.append((a, x, rest - x))
        if 4 * a >= capacity:
            b = used[(used <= min(a, rest - 2)) & (3 * used >= rest)]
            for x in b[np.unique(np.linspace(0, len(b) - 1, per_length).astype(int))].tolist() if len(b) else ():
                c = used[(used <= min(x, rest - x - 1)) & (2 * used >= rest - x)]
                c = c[has[rest - x - c]]
                if len(c):
                    y = int(c[len(c) // 2])
                    out.append((a, x, y, rest - x - y))
    return out


def fit(histogram: np.ndarray, found: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the weighted squares of histogram - A x.

    Accelerated projected gradient; weights are the lengths, as long pieces are hard to place.
    """
    if not found:
        return np.zeros(0)
    at = np.concatenate([np.array(p) for p in found])
    of = np.repeat(np.arange(len(found)), [len(p) for p in found])
    weight = (np.arange(len(histogram)) / (len(histogram) - 1)) ** 2
    forward = lambda x: np.bincount(at, x[of], len(histogram))
    backward = lambda r: np.bincount(of, (weight * r)[at], len(found))
    x = np.ones(len(found))
    for _ in range(30):
        x = backward(forward(x))
        x /= np.linalg.norm(x)
    step = 1 / max(1e-12, 1.02 * np.linalg.norm(backward(forward(x))))
    x = y = np.zeros(len(found))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y + step * backward(histogram - forward(y)))
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = new + (t - 1) / s * (new - x), new, s
    return x


def best_fit(left: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths) of sequences that take all pieces of a histogram, longest first into the fullest place."""
    capacity = len(left) - 1
    spaces: list[int] = []
    open_: dict[int, list[tuple[int, tuple[int, ...]]]] = {}

    def put(space: int, count: int, content: tuple[int, ...]) -> None:
        if space not in open_:
            open_[space] = []
            bisect.insort(spaces, space)
        open_[space].append((count, content))

    for length in range(capacity, 0, -1):
        todo = int(left[length])
        while todo:
            i = bisect.bisect_left(spaces, length)
            if i < len(spaces):
                space = spaces[i]
                count, content = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[i]
            else:
                space, count, content = capacity, todo, ()
            each = space // length
            full = min(count, todo // each)
            if full:
                put(space - each * length, full, content + (length,) * each)
                todo -= full * each
                count -= full
            if count and 0 < todo < each:
                put(space - todo * length, 1, content + (length,) * todo)
                todo, count = 0, count - 1
            if count and content:
                put(space, count, content)
    return [(count, content) for groups in open_.values() for count, content in groups]


def plan(histogram: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """(repeat count, lengths) of all sequences."""
    left = histogram.astype(np.int64).copy()
    found = patterns(left)
    x = fit(left.astype(float), found)
    out = []
    for j in np.argsort(-x, kind="stable").tolist():
        content = found[j]
        most = min(int(left[v]) // content.count(v) for v in set(content))
        count = min(int(round(x[j])), most)
        if count:
            out.append((count, content))
            for v in content:
                left[v] -= count
    return out + best_fit(left)


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """All pieces of ``docs`` with the sequence and the offset they are packed at.

    Rows repeated or with a null id are packed like others; an empty table gives no rows. The pieces are stored
    once; the histogram (``capacity`` rows at most) is all that reaches the driver, and the broadcast plan
    has a few slots per length.
    """
    with small_batches(docs.sparkSession):
        stored = durable(pieces(docs, capacity, vocabulary), "pieces")
    counts = stored.groupBy("task", "length").agg((F.max("nth") + 1).alias("n"))
    # one row per task and length, so a length's window holds as many rows as there are tasks
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("base"))
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():
        histogram[length] = n
    slots, sequence = [], 0
    taken = np.zeros(capacity + 1, np.int64)
    for count, content in plan(histogram):
        offset = 0
        for length in content:
            slots.append((length, taken[length], sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    table = np.array(sorted(slots), np.int64).reshape(-1, 4)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of, first, base, offset = shared.value.T
        key = (length_of << np.int64(48)) + first
        for batch in batches:
            length = batch.column(3).to_numpy().astype(np.int64)
            rank = batch.column(5).to_numpy()
            at = np.searchsorted(key, (length << np.int64(48)) + rank, "right") - 1
            placed = [pa.array(base[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:3] + [pa.array(length), batch.column(4), *placed], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            )

    ranked = stored.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("rank")
    )
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
