"""Repeated passages by a sparse suffix array.

Suffixes are kept at minimisers of word runs only: positions that depend on nothing but the words around
them, so that copies of a passage keep the same ones. They are sorted by the fingerprint of their first words and
compared with their neighbours. All windows around suffixes that have an equal neighbour are sorted and
compared in the same way, at every word; repeated windows that touch are one passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import bloom_filter, buffer_of, chunks, durable, in_bloom, texts
from limitloom.llm.words import run_hashes, words_by_row

GRAM = 8


def minimisers(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions that are the first smallest of some ``width`` neighbouring values."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, at, reach = grams, np.arange(len(grams)), 1
    while reach < width:  # smallest of windows that double, the last step overlapping
        hop = min(reach, width - reach)
        left, right = least[:-hop], least[hop:]
        first = left <= right
        at = np.where(first, at[:-hop], at[hop:])
        least = np.where(first, left, right)
        reach += hop
    return np.unique(at[:n])


def _shape(words: int) -> tuple[int, int]:
    """Minimiser width and suffix length that leave no passage of ``words`` words out.

    A window of that length has a minimiser among its first ``width`` runs, whose suffix ends inside the window. So a
    repeated window starts at most ``width`` - 1 words before a repeated suffix, in each of its copies.
    """
    width = words // 2
    return width, words - width + 1


def _reached(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of the ``n`` first places lie at or at most ``width`` - 1 before one of the places ``at`` (ascending)."""
    after = np.searchsorted(at, np.arange(n))
    return np.r_[at, n + width][after] - np.arange(n) < width


def _suffixes(docs: DataFrame, words: int, wanted: np.ndarray | None) -> DataFrame:
    """(h, doc_id, at) of all kept suffixes, or of every window around those whose fingerprint ``wanted`` may hold."""
    width, length = _shape(words)
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                with np.errstate(over="ignore"):
                    h, _, _, first = words_by_row(*buffer_of(part.column(1)))
                    grams, prints = run_hashes(h, GRAM), run_hashes(h, length).view(np.int64)
                    wide = run_hashes(h, words).view(np.int64) if shared.value is not None else None
                found, ids, places = [], [], []
                doc_ids = part.column(0).to_numpy(zero_copy_only=False)
                for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if b - a < words:
                        continue
                    at = a + minimisers(grams[a : b - GRAM + 1], width)
                    at = at[at + length <= b]
                    values = prints[at]
                    if wide is not None:
                        at = at[in_bloom(shared.value, values)]
                        # starts at and up to width - 1 words before a known suffix
                        at = a + np.flatnonzero(_reached(at - a, width, b - a - words + 1))
                        values = wide[at]
                    found.append(values)
                    places.append(at - a)
                    ids.append(np.full(len(at), doc_ids[i]))
                if found:
                    yield pa.RecordBatch.from_pydict({"h": pa.array(np.concatenate(found)), "doc_id": pa.array(np.concatenate(ids).astype(np.int64)), "at": pa.array(np.concatenate(places), pa.int32())})

    return texts(docs).filter("doc_id is not null and text is not null").mapInArrow(run, "h long, doc_id long, at int")


def with_equal_neighbour(rows: DataFrame) -> DataFrame:
    """Rows (h, doc_id, at) whose neighbour in sorted order has the same ``h``.

    Sorting deals ranges of the whole row, so rows of one ``h`` spread over as many tasks as they need. First and last
    rows of a range, two per task, are compared among themselves.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = rows.repartitionByRange(n, "h", "doc_id", "at").sortWithinPartitions("h", "doc_id", "at")

    def flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # state 1: has an equal neighbour; 2: first or last of its range, without one there; 3: both
        held, before, opening = None, None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if held is None else pa.concat_batches([held, batch])
            h = table.column(0).to_numpy()
            same = np.r_[before is not None and before == h[0], h[1:] == h[:-1], False]
            state = (same[:-1] | same[1:]).astype(np.int32)
            if opening:
                state[0] = 3 if state[0] else 2
            # the last row waits for its next neighbour
            keep = np.flatnonzero(state[:-1])
            if len(keep):
                out = table.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(state[:-1][keep])], ["h", "doc_id", "at", "state"])
            if len(h) > 1:
                before, opening = h[-2], False
            held = table.slice(len(h) - 1, 1)
        if held is not None:
            last = 3 if before is not None and before == held.column(0)[0].as_py() else 2
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([last], pa.int32())], ["h", "doc_id", "at", "state"])

    marked = durable(order.mapInArrow(flag, "h long, doc_id long, at int, state int"), "suffix-array")
    met = marked.filter("state > 1").groupBy("h").count().filter("count > 1").select("h")
    alone = marked.filter("state = 2").join(met, "h", "left_semi").select(*marked.columns)
    return marked.filter("state <> 2").unionByName(alone).select("h", "doc_id", "at")


def repeated_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """doc_id, first_word, n_words, passage: the stretches of each document that occur elsewhere.

    Finds every passage of ``words`` words or more that occurs twice in the corpus, in one document or several; passages
    that touch are one stretch. Words are compared without A-Z case. ``passage`` is the fingerprint of its first window, equal for copies that start alike. Null ids, null, empty and shorter
    texts give no rows. Rows repeated with the same id are copies of each other.
    """
    again = with_equal_neighbour(_suffixes(docs, words, None)).select("h").distinct()
    again = durable(again, "repeated-suffixes")
    bits = bloom_filter(again, F.col("h"), again.count())
    found = with_equal_neighbour(_suffixes(docs, words, bits))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            hits = batch.column(1)
            flat, sizes = hits.flatten(), np.diff(hits.offsets.to_numpy())
            row, at, h = np.repeat(np.arange(len(sizes)), sizes), flat.field("at").to_numpy(), flat.field("h").to_numpy()
            order = np.lexsort((h, at, row))
            row, at, h = row[order], at[order], h[order]
            start = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (at[1:] > at[:-1] + words)])
            last = np.r_[start[1:], len(at)] - 1
            columns = (batch.column(0).take(pa.array(row[start])), at[start], at[last] + words - at[start], h[start])
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if isinstance(c, np.ndarray) else c for c, k in zip(columns, kinds, strict=True)], ["doc_id", "first_word", "n_words", "passage"])

    # a document's windows are bounded by its own length
    by_doc = found.groupBy("doc_id").agg(F.collect_list(F.struct("at", "h")).alias("hits"))
    return by_doc.mapInArrow(merge, "doc_id long, first_word int, n_words int, passage long")
