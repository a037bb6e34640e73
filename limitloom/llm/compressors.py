"""Text quality from two zstandard dictionaries, one of good and one of bad labelled text.

A text is cut into blocks; each is compressed with either dictionary. The normalised difference of the
summed sizes, and the sizes against the text's own, go into a logistic curve fitted on labelled
texts that the dictionaries have not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import durable, texts

BLOCK, LEVEL, DICTIONARY = 2048, 3, 48 << 10
# The labelled sample: rows of each class, blocks of a text that go into a dictionary.
PER_CLASS, PER_TEXT = 2000, 6


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray
    base: float


def _blocks(data: bytes) -> list[bytes]:
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def _dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=LEVEL)
    return dictionary


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; from too few samples, their plain content."""
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY:]


class Measure:
    """Features of a text: 1, normalised size difference, log sizes against the length."""

    def __init__(self, good: bytes, bad: bytes):
        self._good, self._bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d) if d else None, write_checksum=False, write_content_size=False, write_dict_id=False) for d in (good, bad))

    def __call__(self, data: bytes) -> tuple[float, ...]:
        if not data:
            return (1.0, 0.0, 0.0, 0.0)
        blocks = _blocks(data)
        good = sum(len(self._good.compress(b)) for b in blocks)
        bad = sum(len(self._bad.compress(b)) for b in blocks)
        return (1.0, 10 * (bad - good) / (bad + good), float(np.log(good / len(data))), float(np.log(bad / len(data))))


def fit_logistic(x: np.ndarray, y: np.ndarray, base: float, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic curve on a class-balanced sample, moved to the classes' true share ``base``."""
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - penalty @ w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + penalty
        w = w + np.linalg.solve(curve, slope)
    w[0] += np.log(base / (1 - base))
    return w


def train(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = PER_CLASS) -> Model:
    """Dictionaries and curve from at most ``per_class`` labelled rows of each class.

    ``usable`` (over labels.doc_id) says which labelled rows may be learned from. Labels that are null
    or contradict each other are not used; of an id with several texts the one with the smallest hash is. Texts of any
    length take part: some blocks of each in half the sample make the dictionaries, and the curve is fitted on sizes of
    the whole texts of the other half, measured in tasks, so the driver holds a bounded number of blocks and features.
    Without both classes the model scores all texts with the share of good rows (0.5 without any).
    """
    agreed = (
        labels.filter(usable & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").alias("y"), F.max("quality").alias("most"))
        .filter("y = most")
    )
    counts = {y: n for y, n in agreed.groupBy("y").count().collect()}
    if len(counts) < 2:
        total = sum(counts.values())
        return Model(b"", b"", np.zeros(0), counts.get(1, 0) / total if total else 0.5)
    # a bounded sample: the ids are collected, and one text of each is found by them in one scan
    ids = [(r.doc_id, y) for y in (0, 1) for r in agreed.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    wanted = docs.sparkSession.createDataFrame([(i, y, hash_of(i) % 2 == 1) for i, y in ids], "doc_id long, y int, fits boolean")
    found = texts(docs).filter(F.length("text") > 0).join(F.broadcast(wanted), "doc_id")
    chosen = durable(found.groupBy("doc_id", "y", "fits").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "labelled")

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [_spread(_blocks(t.as_py().encode()), PER_TEXT) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "blocks": pa.array(blocks, pa.list_(pa.binary()))})

    halves = chosen.filter("not fits").select("doc_id", "y", "text").mapInArrow(samples, "doc_id long, y int, blocks array<binary>").collect()
    halves.sort(key=lambda r: (hash_of(r.doc_id), r.doc_id))
    good, bad = (train_dictionary([bytes(b) for r in halves if r.y == y for b in r.blocks]) for y in (1, 0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(good, bad)
        for batch in batches:
            features = [list(measure(t.as_py().encode())) for t in batch.column(2)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "y": batch.column(1), "x": pa.array(features, pa.list_(pa.float64()))})

    rest = chosen.filter("fits").select("doc_id", "y", "text").mapInArrow(measured, "doc_id long, y int, x array<double>").collect()
    rest.sort(key=lambda r: (hash_of(r.doc_id), r.doc_id))
    base = counts[1] / (counts[0] + counts[1])
    if len({r.y for r in rest}) < 2:
        return Model(b"", b"", np.zeros(0), base)
    return Model(good, bad, fit_logistic(np.array([r.x for r in rest]), np.array([r.y for r in rest]), base), base)


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 % 2**64) >> 40


def _spread(blocks: list[bytes], most: int) -> list[bytes]:
    return [blocks[i] for i in sorted({round(j * (len(blocks) - 1) / max(1, most - 1)) for j in range(most)})]


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score and predicted for every row, whole texts; a null or empty text scores the share of good rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        measure = Measure(m.good, m.bad) if len(m.weights) else None
        for batch in batches:
            out = np.full(batch.num_rows, m.base)
            for i, text in enumerate(batch.column(1)):
                data = (text.as_py() or "").encode() if measure else b""
                if data:
                    out[i] = 1 / (1 + np.exp(-np.clip(np.dot(measure(data), m.weights), -30, 30)))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(out), "predicted": pa.array((out >= threshold).astype(np.int32))})

    return texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text leaves no remainder by 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, learned from labels that are not held out."""
    model = train(docs, labels, ~held_out())
    scored = score(docs, model, threshold)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")
