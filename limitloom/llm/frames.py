"""Helpers the operators share: stored tables, bounded Bloom filters, Arrow batches cut by bytes."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from limitloom.session import durable

CHUNK_BYTES = 4 << 20

__all__ = ["CHUNK_BYTES", "bloom_filter", "buffer_of", "chunks", "durable", "in_bloom", "merged_counts", "read_table", "small_batches", "texts", "without"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Key and text alone, so that further columns of any name do no harm."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes; a longer text is a slice of its own."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    ends = _offsets(values)
    start = 0
    while start < len(values):
        stop = int(np.searchsorted(ends, ends[start] + limit, "right")) - 1
        stop = min(max(stop, start + 1), len(values))
        yield batch.slice(start, stop - start)
        start = stop


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, limit: int = CHUNK_BYTES) -> Iterator[None]:
    """Queries that start inside hand Python tasks Arrow batches of about ``limit`` bytes (a longer row is one of its own).

    A batch is held whole in the JVM's direct memory, where its buffers grow by doubling, and in the worker; Spark's 64 MB a
    batch and core cost hundreds of MB an executor. How many rows a batch has decides no result.
    """
    before = spark.conf.get(BATCH_BYTES)
    spark.conf.set(BATCH_BYTES, str(limit))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES, before)


def _offsets(values: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type) else np.int32
    raw = np.frombuffer(values.buffers()[1], kind)
    return raw[values.offset : values.offset + len(values) + 1].astype(np.int64)


def buffer_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and where each value starts and ends; nulls are empty."""
    ends = _offsets(values)
    data = values.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of several (values, counts) pairs with their summed counts."""
    values = np.concatenate([p[0] for p in parts])
    counts = np.concatenate([p[1] for p in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


# A filter never exceeds this many 64-bit words (8 MB), whatever it stands for. Beyond some
# 60 million keys it merely lets more through; an exact join always follows.
BLOOM_WORDS = 1 << 20


def bloom_filter(keys: DataFrame, hashed: Column, count: int) -> np.ndarray:
    """A one-hash filter of hashes (long), built by a grouped OR; only its bounded words reach the driver."""
    words = min(1 << max(6, (max(1, count) // 4).bit_length()), BLOOM_WORDS)
    rows = (
        keys.select(F.pmod(hashed, F.lit(words * 64)).alias("bit"))
        .groupBy(F.floor(F.col("bit") / 64).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
        .toArrow()
    )
    out = np.zeros(words, np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def in_bloom(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold."""
    at = np.mod(hashed.astype(np.int64), len(bits) * 64)
    return (bits[at >> 6].view(np.uint64) >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


# Ids that are broadcast at most (some 100 MB); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not among ``ids``; null ids stay. The ids are stored, so that they are counted and used alike."""
    gone = durable(ids.select(F.col(key).cast("long").alias(key)).filter(F.col(key).isNotNull()).distinct(), "removed")
    n = gone.count()
    return docs.join(F.broadcast(gone) if n <= BROADCAST_IDS else gone, key, "left_anti").select(*docs.columns) if n else docs
