"""Exact top-k search by inner product with a table of pivot distances.

For integer vectors 2 q.x = |q|^2 + |x|^2 - d(q, x)^2. The largest difference of a query's and a
candidate's distances to the same pivot is a lower bound of d, so it bounds the score from above.
Candidates are evaluated in bound order until no bound reaches the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from limitloom.llm.frames import durable

PIVOTS, SAMPLE, BLOCK, QUERIES = 32, 512, 4096, 1024
# Components of this size and beyond end in an error: they would not fit a long.
LARGEST = float(1 << 62)
_STEP = 128


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Integer vectors floor(1024 x); null ids or vectors, empty ones and those with null or non-finite components go."""
    x = F.col(embedding).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    whole = lambda v: F.when(F.abs(v * 1024.0) < LARGEST, F.floor(v * 1024.0)).otherwise(F.raise_error(F.lit("a component times 1024 exceeds 2**62")).cast("long"))
    return (
        vectors.filter(F.col(vec_id).isNotNull() & (F.size(x) > 0) & good)
        .select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))
        .withColumn("dim", F.size("v"))
    )


def choose_pivots(ints: DataFrame, pivots: int = PIVOTS, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By dimension: pivots picked far from each other, and the whole sample with its ids; ``sample`` rows at most."""
    rows = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    out = {}
    for dim in {r.dim for r in rows}:
        ids = np.array([r.vec_id for r in rows if r.dim == dim], np.int64)
        m = np.array([r.v for r in rows if r.dim == dim], np.float64)
        chosen, least = [0], ((m - m[0]) ** 2).sum(1)
        while len(chosen) < min(pivots, len(m)):
            chosen.append(int(least.argmax()))
            least = np.minimum(least, ((m - m[chosen[-1]]) ** 2).sum(1))
        out[dim] = (m[chosen], m, ids)
    return out


def _distances(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (m * m).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * m @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _blocks(ints: DataFrame, chosen: dict, rows: int) -> DataFrame:
    """Blocks of vectors of one dimension with their pivot distances, neighbours of a pivot side by side."""
    shared = ints.sparkSession.sparkContext.broadcast({d: p[0] for d, p in chosen.items()})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim: int) -> Iterator[pa.RecordBatch]:
            nonlocal made
            ids = np.concatenate([h[0] for h in held[dim]])
            m = np.concatenate([h[1] for h in held.pop(dim)])
            table = _distances(m.astype(np.float64), shared.value.get(dim, np.zeros((1, dim))))
            order = np.lexsort((table.min(1), table.argmin(1)))
            for i in range(0, len(order), rows):
                at = order[i : i + rows]
                own = m[at]
                own = own.astype(np.int32) if np.abs(own).max() < 2**31 else own  # wide components take eight bytes
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([(task << 32) + made], pa.int64()), "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids[at].tobytes()], pa.binary()),
                    "vectors": pa.array([own.tobytes()], pa.binary()), "distances": pa.array([table[at].tobytes()], pa.binary()),
                })
                made += 1

        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                values = part.column(1).flatten().to_numpy().reshape(-1, dim)
                held.setdefault(dim, []).append((part.column(0).to_numpy(), values))
                if sum(len(h[0]) for h in held[dim]) >= 4 * rows:
                    yield from emit(dim)
        for dim in list(held):
            yield from emit(dim)

    return ints.mapInArrow(build, "block long, dim int, ids binary, vectors binary, distances binary")


def best_of_block(q_ids: np.ndarray, q: np.ndarray, q_far: np.ndarray, floor: np.ndarray, ids: np.ndarray, m: np.ndarray, far: np.ndarray, k: int) -> Iterator[tuple]:
    """(query, candidate ids, scores) of the best ``k`` of a block for each query, none below its floor; ties to the smaller id."""
    largest = int(np.abs(q).max(initial=0)) * int(np.abs(m).max(initial=0)) * q.shape[1]
    kind = np.float64 if largest < 2**52 else np.int64 if largest < 2**63 else object  # exact in any case
    qx, mx = q.astype(kind), m.astype(kind)
    q2, m2 = (q.astype(np.float64) ** 2).sum(1), (m.astype(np.float64) ** 2).sum(1)
    for i in range(len(q)):
        near = np.abs(far - q_far[i]).max(1)
        total = q2[i] + m2
        bound = (total - near * near) / 2 + 1e-6 * (1 + total)  # the margin covers rounding
        order = np.argsort(-bound, kind="stable")
        order = order[: np.searchsorted(-bound[order], -floor[i], "right")]
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for j in range(0, len(order), _STEP):
            if len(best) >= k and bound[order[j]] < best[k - 1]:
                break
            at = order[j : j + _STEP]
            at = at[ids[at] != q_ids[i]]
            best_id = np.r_[best_id, ids[at]]
            best = np.r_[best, (mx[at] @ qx[i]).astype(np.int64)]
            top = np.lexsort((best_id, -best))[:k]
            best_id, best = best_id[top], best[top]
        keep = best >= floor[i]
        yield i, best_id[keep], best[keep]


def search(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """For each query row its ``k`` highest integer inner products among all rows of other ids.

    Columns query_id, rank, vec_id, score; ties go to the smaller vec_id. Only vectors of the same length are compared. Repeated
    rows are candidates each; a repeated query row gives its own list. Query blocks meet candidate blocks through a join
    on the candidate block, so neither set passes through the driver or one task.
    """
    ints = usable(vectors)
    chosen = choose_pivots(ints)
    blocks = durable(_blocks(ints, chosen, BLOCK), "pivot-table")
    asked = durable(_blocks(ints.filter(is_query), chosen, QUERIES), "queries")
    heads = blocks.select("block", "dim")
    # every block of queries with every block of candidates: a stated query set, in blocks
    pairs = (
        asked.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("distances").alias("q_distances"))
        .join(heads, "dim")
        .join(blocks.drop("dim"), "block")
        .select("q_block", "dim", "q_ids", "q_vectors", "q_distances", "ids", "vectors", "distances")
    )
    shared = vectors.sparkSession.sparkContext.broadcast({d: p[1:] for d, p in chosen.items()})

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_block, dim, q_ids, q, q_far, ids, m, far = (batch.column(c)[row].as_py() for c in range(8))
                q_ids, ids = np.frombuffer(q_ids, np.int64), np.frombuffer(ids, np.int64)
                q, m = (np.frombuffer(v, np.int32 if len(v) == 4 * dim * len(i) else np.int64).reshape(-1, dim) for v, i in ((q, q_ids), (m, ids)))
                q_far, far = np.frombuffer(q_far).reshape(len(q), -1), np.frombuffer(far).reshape(len(m), -1)
                # the k-th best score in the sample is a floor that every result reaches
                seen, seen_ids = shared.value.get(dim, (np.zeros((0, dim)), np.zeros(0, np.int64)))
                scores = np.where(seen_ids[None] == q_ids[:, None], -np.inf, q.astype(np.float64) @ seen.T)
                floor = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(q), -np.inf)
                # what rounding may have added, also where large products cancel
                widest = float(np.sqrt((seen * seen).sum(1).max(initial=0))) if len(seen) else 0.0
                floor = floor - 1e-9 * np.abs(np.where(np.isfinite(floor), floor, 0)) - 1e-12 * widest * np.sqrt((q.astype(np.float64) ** 2).sum(1))
                for i, found, best in best_of_block(q_ids, q, q_far, floor, ids, m, far, k):
                    if len(found):
                        yield pa.RecordBatch.from_pydict({
                            "asked": pa.array(np.full(len(found), (q_block << 11) + i)), "query_id": pa.array(np.full(len(found), q_ids[i])),
                            "vec_id": pa.array(found), "score": pa.array(best),
                        })

    found = pairs.mapInArrow(evaluate, "asked long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
