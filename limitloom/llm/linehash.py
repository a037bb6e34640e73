"""Line deduplication by a sharded minimal perfect hash.

Keys of lines are 128-bit hashes. Those found in enough documents are dealt into shards, and each shard gets a minimal perfect
hash: a cascade of bit rows in which a key's bit is the first it has alone, so that the rank of the bit is the key's slot. Slots hold a
fingerprint, the number of documents and the largest one. Documents look their lines up in these arrays: in a broadcast
copy while its size, known beforehand, allows, else shard by shard, each shard's arrays met by the lookups dealt to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from limitloom.llm.frames import chunks, durable
from limitloom.llm.words import mix

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 17
# Arrays up to this size are broadcast; a key takes some 21 bytes.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 21
# Lookups that one task answers for one copy of a shard.
TASK_LOOKUPS = 1 << 22

_BLANK = b" \t\n\x0b\x0c\r"
_INDEX = "shard long, sizes array<long>, bits binary, prints binary, counts binary, lasts binary"


def line_keys(text: bytes, min_chars: int) -> list[bytes | None]:
    """128-bit hash of each line's key, null for keys of fewer than ``min_chars`` code points."""
    out = []
    for line in text.lower().split(b"\n"):
        key = line.strip(_BLANK)
        # no code point takes more than four bytes
        long = len(key) >= min_chars and (len(key) >= 4 * min_chars or key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)
        out.append(xxh3_128_digest(key) if long else None)
    return out


def _pairs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _sources(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))


def _copies() -> Column:
    """Tells texts apart where ids do not."""
    return F.xxhash64("text")


def _held(docs: DataFrame, min_chars: int) -> DataFrame:
    """(hi, lo, doc_id, copy): the distinct long keys of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found, sizes = [], []
                for text in part.column(1).to_pylist():
                    keys = {k for k in line_keys(text, min_chars) if k} if text else ()
                    found.extend(keys)
                    sizes.append(len(keys))
                hi, lo = _pairs(found)
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), part.column(0).take(rows), part.column(2).take(rows)], ["hi", "lo", "doc_id", "copy"])

    return docs.withColumn("copy", _copies()).mapInArrow(run, "hi long, lo long, doc_id long, copy long")


def frequent_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(hi, lo, n_docs, last) of keys held by ``min_docs`` ids or more; last is the largest. Null ids do not count."""
    once = _held(docs, min_chars).filter("doc_id is not null").select("hi", "lo", "doc_id").distinct()
    return once.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last")).filter(F.col("n_docs") >= min_docs)


# The minimal perfect hash of a shard


def _place(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """Both halves are mixed anew on every level, so keys that meet on one part on the next."""
    with np.errstate(over="ignore"):
        step = np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)
        return ((mix(hi + step) ^ mix(lo + ~step)) % np.uint64(size)).astype(np.int64)


def perfect_levels(hi: np.ndarray, lo: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the cascade's bit rows, and the rows in 64-bit words, for distinct keys."""
    sizes, words, left = [], [], np.arange(len(hi))
    while len(left):
        size = -(-2 * len(left) // 64) * 64
        at = _place(hi[left], lo[left], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        left = left[~alone[at]]
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64)


@dataclass
class Shard:
    sizes: list[int]
    bits: np.ndarray
    before: np.ndarray
    prints: np.ndarray
    counts: np.ndarray
    lasts: np.ndarray

    @classmethod
    def of(cls, sizes: list[int], bits: bytes, prints: bytes, counts: bytes, lasts: bytes) -> Shard:
        words = np.frombuffer(bits, np.uint64)
        before = np.cumsum(np.r_[0, np.bitwise_count(words)])[:-1]
        return cls(sizes, words, before, np.frombuffer(prints, np.uint64), np.frombuffer(counts, np.uint32), np.frombuffer(lasts, np.int64))

    def slots(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where no bit stands for it; a key that was never indexed may get any slot."""
        out, left, start = np.full(len(hi), -1), np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes):
            at = _place(hi[left], lo[left], level, size) + start
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) != 0
            below = np.bitwise_count(word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1)))
            out[left[hit]] = self.before[at[hit] >> 6] + below
            left, start = left[~hit], start + size
        return out

    def probe(self, hi: np.ndarray, lo: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are held by ``min_docs`` documents or more, and the largest holder of those."""
        slots = self.slots(hi, lo)
        ok = slots >= 0
        if len(self.prints):
            ok &= (self.prints[slots] == lo) & (self.counts[slots] >= min_docs)
        return ok, self.lasts[slots[ok]]


def _by_change(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Runs of rows of one value, from rows in order."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        values = table.column(column).to_numpy()
        cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1, len(values)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[0].column(column)[0].as_py() != values[a]:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
    if held:
        yield pa.concat_tables(held)


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys in _by_change(batches, "shard"):
        hi, lo = (keys.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        sizes, bits = perfect_levels(hi, lo)
        order = np.argsort(Shard.of(sizes, bits.tobytes(), b"", b"", b"").slots(hi, lo))
        counts = np.minimum(keys.column("n_docs").to_numpy()[order], 2**32 - 1).astype(np.uint32)
        row = {
            "shard": [keys.column("shard")[0].as_py()], "sizes": [sizes], "bits": [bits.tobytes()], "prints": [lo[order].tobytes()],
            "counts": [counts.tobytes()], "lasts": [keys.column("last").to_numpy()[order].tobytes()],
        }
        kinds = pa.schema([("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), *((c, pa.binary()) for c in ("bits", "prints", "counts", "lasts"))])
        yield pa.RecordBatch.from_pydict(row, kinds)


@dataclass
class Index:
    """Stored rows of shards; ``keys`` and ``shards`` count them."""

    table: DataFrame
    keys: int
    shards: int


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id", shard_keys: int = SHARD_KEYS) -> Index:
    """Index of the keys found in ``min_docs`` documents or more. Rarer keys need no slot: their fingerprints match none."""
    keys = durable(frequent_keys(_sources(docs, text, key), min_chars, min_docs), "line-keys")
    n = keys.count()
    shards = max(1, -(-n // shard_keys))
    dealt = keys.withColumn("shard", F.pmod("hi", F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    return Index(durable(dealt.mapInArrow(_build, _INDEX), "line-index"), n, shards)


def _without(text: bytes | None, keys: list[bytes | None], gone: set[bytes]) -> tuple[bytes | None, int, int]:
    """Text without the lines of some keys, its number of lines and how many went."""
    if text is None:
        return None, 1, 0
    drop = [k in gone for k in keys] if gone else []
    if not any(drop):
        return text, len(keys), 0
    return b"\n".join(line for line, d in zip(text.split(b"\n"), drop, strict=True) if not d), len(keys), sum(drop)


def _result(part: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
    texts, lines, dropped = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"]
    )


_RESULT = "doc_id long, text string, n_lines long, n_dropped long"


def _by_broadcast(docs: DataFrame, index: Index, min_chars: int, min_docs: int) -> DataFrame:
    shards = {r["shard"]: Shard.of(*(r[c] for c in ("sizes", "bits", "prints", "counts", "lasts"))) for r in index.table.toArrow().to_pylist()}
    shared, n = docs.sparkSession.sparkContext.broadcast(shards), np.uint64(index.shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                texts, ids = part.column(1).to_pylist(), part.column(0).to_pylist()
                keys = [line_keys(t or b"", min_chars) for t in texts]
                flat = [k for row in keys for k in row if k]
                owner = np.repeat(np.arange(len(keys)), [sum(k is not None for k in row) for row in keys])
                hi, lo = _pairs(flat)
                gone: list[set[bytes]] = [set() for _ in keys]
                dealt = (hi.view(np.int64) % np.int64(n)) if len(hi) else np.zeros(0, np.int64)
                for shard in np.unique(dealt).tolist():
                    if shard in shared.value:
                        at = np.flatnonzero(dealt == shard)
                        ok, last = shared.value[shard].probe(hi[at], lo[at], min_docs)
                        for i, top in zip(at[ok].tolist(), last.tolist(), strict=True):
                            if ids[owner[i]] is None or ids[owner[i]] < top:
                                gone[owner[i]].add(flat[i])
                yield _result(part, [_without(*x) for x in zip(texts, keys, gone, strict=True)])

    return docs.mapInArrow(run, _RESULT)


def _by_shard(docs: DataFrame, index: Index, min_chars: int, min_docs: int) -> DataFrame:
    """The same without a broadcast: lookups travel to their shard, and what it answers to the documents concerned.

    A shard with many lookups is copied to as many tasks as they need, so that a line that every document holds is no hot spot.
    """
    asked = durable(_held(docs, min_chars).withColumn("shard", F.pmod("hi", F.lit(index.shards))), "lookups")
    load = asked.groupBy("shard").agg(F.ceil(F.count("*") / TASK_LOOKUPS).cast("long").alias("tasks")).join(index.table.select("shard"), "shard")
    arrays = index.table.join(load, "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task")).drop("tasks")
    dealt = asked.join(load, "shard").withColumn("task", F.pmod(F.xxhash64("doc_id", "copy", "lo"), "tasks")).drop("tasks")
    rows = arrays.unionByName(dealt, allowMissingColumns=True)
    ordered = rows.repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("hi").isNotNull())

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            heads = np.flatnonzero(batch.column("hi").is_null().to_numpy(zero_copy_only=False)).tolist()
            for a, b in zip([0, *(h + 1 for h in heads)], [*heads, batch.num_rows], strict=True):
                if a and a - 1 in heads:
                    shard = Shard.of(*(batch.column(c)[a - 1].as_py() for c in ("sizes", "bits", "prints", "counts", "lasts")))
                part = batch.slice(a, b - a)
                if part.num_rows and shard:
                    hi, lo = (part.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
                    ok, last = shard.probe(hi, lo, min_docs)
                    met = part.filter(pa.array(ok))
                    older = [i is None or i < top for i, top in zip(met.column("doc_id").to_pylist(), last.tolist(), strict=True)]
                    yield met.filter(pa.array(older, pa.bool_())).select(["hi", "lo", "doc_id", "copy"])

    gone = ordered.mapInArrow(answer, "hi long, lo long, doc_id long, copy long").distinct()
    gone = gone.groupBy(F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy")).agg(F.collect_list(F.struct("hi", "lo")).alias("gone"))
    told = docs.withColumn("copy", _copies())
    told = told.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("copy") == F.col("gone_copy")), "left").select("doc_id", "text", "gone")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                rows = []
                for text, gone in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    keys = {np.array([x["hi"], x["lo"]], np.int64).tobytes() for x in gone or ()}
                    rows.append(_without(text, line_keys(text or b"", min_chars), keys))
                yield _result(part, rows)

    return told.mapInArrow(drop, _RESULT)


def drop_lines(docs: DataFrame, index: Index, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, text: str = "text", key: str = "doc_id", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every row's text without the lines whose key the index holds, unless it is the largest id that holds them.

    Lines end at `\\n`; their key is the line without blanks at both ends, A-Z lower-cased. A null text is one empty line and stays null; an empty text is one empty
    line; a text that loses all lines is empty. Rows repeated with the same id are one document. Rows without id count as no document, and lose every
    line that other documents of smaller id would. Further columns are not read. An empty table gives no rows.
    """
    probe = _by_broadcast if index.keys * KEY_BYTES <= broadcast_bytes else _by_shard
    return probe(_sources(docs, text, key), index, min_chars, min_docs)
