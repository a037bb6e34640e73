"""Whitening of embeddings with principal components found by contour integration.

Moments of the distinct integer vectors are summed up by Spark. Intervals that hold the largest eigenvalues of the covariance are
chosen by inertia counts and solved in a task each: quadrature of complex shifted solves along a circle through the interval's
ends filters a block of vectors down to the interval's eigenvectors, a Rayleigh-Ritz step extracts them, and the inertia count tells
whether any is missing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitloom.llm.frames import durable

SCALE, COMPONENTS = 256, 4
# Quadrature nodes on the upper half circle, eigenvalues of an interval at most (unless they cluster), and rounds of filtering.
NODES, MOST, ROUNDS = 8, 8, 30
_LARGEST = float(1 << 53)


def integers(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x, dim) with x = floor(256 c); null and empty vectors and those with null or non-finite entries go."""
    c = F.col(embedding).cast("array<double>")
    good = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.when(F.abs(v * SCALE) < _LARGEST, F.floor(v * SCALE)).otherwise(F.raise_error(F.lit("an entry times 256 exceeds 2**53")).cast("long")))
    return vectors.filter((F.size(c) > 0) & good).select(F.col(vec_id).alias("vec_id"), x.alias("x"), F.size(c).alias("dim"))


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows of the batch, their vectors) for each dimension of a batch with columns x and dim."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, batch.column("x").take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    """Column sums as Python integers, halves apart so that none overflows."""
    return (x >> 26).sum(0).astype(object) * (1 << 26) + (x & ((1 << 26) - 1)).sum(0).astype(object)


def _totals(fit: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """By dimension the number of vectors and their exact sums; a row per dimension and entry reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, at, x in _matrices(batch):
                seen = held.setdefault(dim, [0, np.zeros(dim, object)])
                seen[0] += len(at)
                seen[1] += _exact_sums(x)
        for dim, (n, sums) in held.items():
            total = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), total], ["dim", "i", "n", "total"])

    parts = fit.mapInArrow(run, "dim int, i int, n long, total decimal(38,0)")
    rows = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total")).collect()
    out = {r.dim: (r.n, np.zeros(r.dim, object)) for r in rows}
    for r in rows:
        out[r.dim][1][r.i] = int(r.total)
    return out


def _means(totals: dict[int, tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    return {dim: np.array([int(s) / n for s in sums]) for dim, (n, sums) in totals.items()}


def _products(fit: DataFrame, centre: dict[int, np.ndarray], turn: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """By dimension the sums of y y' over centred vectors y, turned by ``turn`` if given, with y and 1 as one longer vector.

    A task sums up whole batches, so its rows (a matrix) do not grow with the data; they are added up by a grouped sum.
    """
    shared = fit.sparkSession.sparkContext.broadcast((centre, turn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        means, turns = shared.value
        for batch in batches:
            for dim, at, x in _matrices(batch):
                y = x - means[dim]
                y = np.c_[y if turns is None else y @ turns[dim], np.ones(len(at))]
                held[dim] = held.get(dim, 0) + y.T @ y
        for dim, m in held.items():
            i, j = np.triu_indices(len(m))
            kinds = (pa.array(np.full(len(i), dim), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j]))
            yield pa.RecordBatch.from_arrays(list(kinds), ["dim", "i", "j", "v"])

    tasks = 4 * fit.sparkSession.sparkContext.defaultParallelism
    rows = fit.coalesce(tasks).mapInArrow(run, "dim int, i int, j int, v double").groupBy("dim", "i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = {}
    dims, i, j, v = (rows.column(c).to_numpy() for c in ("dim", "i", "j", "v"))
    for dim in np.unique(dims).tolist():
        at = dims == dim
        m = np.zeros((int(j[at].max()) + 1,) * 2)
        m[i[at], j[at]] = m[j[at], i[at]] = v[at]
        out[dim] = m
    return out


def _covariance(m: np.ndarray) -> np.ndarray:
    """Covariance from sums of products with a last column of ones."""
    n = m[-1, -1]
    return m[:-1, :-1] / n - np.outer(m[-1, :-1], m[-1, :-1]) / n**2


# Inertia


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and side diagonal of a similar tridiagonal matrix, by reflections."""
    a = a.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        length = np.linalg.norm(x)
        if length == 0:
            continue
        x[0] += np.copysign(length, x[0])
        x /= np.linalg.norm(x)
        p = a[k + 1 :, k + 1 :] @ x
        w = 2 * (p - (x @ p) * x)
        a[k + 1 :, k + 1 :] -= np.outer(x, w) + np.outer(w, x)
        a[k + 1 :, k] -= 2 * x * (x @ a[k + 1 :, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(diagonal: np.ndarray, side: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed ``shift``: the positive pivots of the shifted matrix (Sylvester)."""
    tiny = np.finfo(float).tiny
    count, pivot = 0, 1.0
    for d, e in zip(diagonal.tolist(), [0.0, *side.tolist()], strict=True):
        pivot = d - shift - e * e / pivot
        pivot = pivot if abs(pivot) > tiny else -tiny
        count += pivot > 0
    return count


def top_intervals(a: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """(low, high, count) of neighbouring intervals from the top that hold ``wanted`` eigenvalues or more.

    An interval is halved while it holds more than a few; ends keep away from eigenvalues where they can.
    """
    diagonal, side = tridiagonal(a)
    reach = np.abs(np.r_[side, 0]) + np.abs(np.r_[0, side])
    scale = float(np.abs(diagonal).max() + reach.max()) or 1.0
    out, held = [], 0
    ends = float((diagonal - reach).min()) - 1e-3 * scale, float((diagonal + reach).max()) + 1e-3 * scale
    stack = [(*ends, len(a), 0)]  # the counts above the two ends
    while stack and held < min(wanted, len(a)):
        low, high, below_low, below_high = stack.pop()
        count = below_low - below_high
        if not count:
            continue
        if count <= MOST or high - low < 1e-9 * scale:
            out.append((low, high, count))
            held += count
            continue
        for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65):
            middle, gap = low + part * (high - low), 1e-3 * (high - low)
            if above(diagonal, side, middle - gap) == above(diagonal, side, middle + gap):
                break
        at = above(diagonal, side, middle)
        stack += [(low, middle, below_low, at), (middle, high, at, below_high)]
    return out


def feast(a: np.ndarray, low: float, high: float, count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenvalues of symmetric ``a`` between ``low`` and ``high``, falling, and their unit vectors as columns."""
    d = len(a)
    centre, radius = (low + high) / 2, (high - low) / 2
    x, w = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(0.5j * np.pi * (1 + x))
    size = min(d, max(2 * count, count + 4))
    norm = float(np.abs(a).sum(1).max())
    while True:
        block = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, size)))[0]
        for _ in range(ROUNDS):
            filtered = np.zeros((d, size))
            for e, weight in zip(turn, w, strict=True):
                shifted = (centre + radius * e) * np.eye(d) - a
                filtered += 0.5 * weight * (radius * e * np.linalg.solve(shifted, block.astype(complex))).real
            basis = np.linalg.qr(filtered)[0]
            values, small = np.linalg.eigh(basis.T @ a @ basis)
            block = basis @ small
            inside = (values > low) & (values < high)
            rest = np.linalg.norm(a @ block - block * values, axis=0)[inside]
            if inside.sum() == count and rest.max(initial=0) <= 16 * d * np.finfo(float).eps * norm:
                order = np.flatnonzero(inside)[::-1]
                return values[order], block[:, order]
        if size == d:
            raise ArithmeticError(f"{int(inside.sum())} of {count} eigenvalues between {low} and {high} were found")
        size = min(d, 2 * size)


def _solve(fit: DataFrame, matrices: dict[int, np.ndarray], wanted: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension the largest eigenvalues, falling, and their vectors; a task per interval."""
    spark = fit.sparkSession
    todo = [(dim, *interval) for dim, a in matrices.items() for interval in top_intervals(a, wanted)]
    shared = spark.sparkContext.broadcast(matrices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, low, high, count in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                values, vectors = feast(shared.value[dim], low, high, count)
                yield pa.RecordBatch.from_pydict({"dim": pa.array([dim] * count, pa.int32()), "value": pa.array(values), "vector": pa.array(vectors.T.tolist(), pa.list_(pa.float64()))})

    intervals = spark.createDataFrame(todo, "dim int, low double, high double, count int").repartition(len(todo))
    rows = intervals.mapInArrow(run, "dim int, value double, vector array<double>").collect()
    out = {}
    for dim in matrices:
        found = sorted((r for r in rows if r.dim == dim), key=lambda r: -r.value)[: min(wanted, dim)]
        out[dim] = np.array([r.value for r in found]), np.array([r.vector for r in found]).T
    return out


@dataclass
class Model:
    """Of one dimension: size and sums of the fit list, components as columns, their eigenvalues and shares, and the whitening's error."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def turn(self) -> np.ndarray:
        """Projection on the components to unit variance; a component without variance stays unscaled."""
        return self.vectors / np.sqrt(np.where(self.varies, self.values, 1))

    @property
    def varies(self) -> np.ndarray:
        return self.values > len(self.mean) * np.finfo(float).eps * max(self.values.max(initial=0), np.finfo(float).tiny)


def fit_components(ints: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per dimension, fitted to each distinct vector once."""
    fit = durable(ints.select("x", "dim").distinct(), "fit-list")
    totals = _totals(fit)
    if not totals:
        return {}
    means = _means(totals)
    matrices = {dim: _covariance(m) for dim, m in _products(fit, means).items()}
    models = {}
    for dim, (values, vectors) in _solve(fit, matrices, components).items():
        trace = float(np.trace(matrices[dim]))
        models[dim] = Model(*totals[dim], means[dim], vectors, values, np.maximum(values, 0) / trace if trace > 0 else np.zeros(len(values)))
    for dim, m in _products(fit, means, {dim: model.turn for dim, model in models.items()}).items():
        kept = models[dim].varies
        error = np.abs(_covariance(m) - np.eye(len(m) - 1))[np.ix_(kept, kept)]
        models[dim].identity_error = float(error.max()) if error.size else None
    return models


def _deviations(x: np.ndarray, model: Model) -> pa.Array:
    """Exact sums of (n x - S)**2."""
    most = model.n * int(np.abs(x).max(initial=0)) + max(abs(int(s)) for s in model.sums)
    if most**2 * x.shape[1] < 2**63:
        return pa.array(((model.n * x - model.sums.astype(np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(int(s)) for s in ((model.n * x.astype(object) - model.sums) ** 2).sum(1)], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for every usable row and component.

    Rows repeated with the same id, or with a null id, each give their rows; equal vectors count once in the fit. Vectors of different lengths are
    fitted apart. Where a component has no variance, ``whitened`` is null; identity_error is taken over the others and null if there is none. Entries that
    times 256 exceed 2**53 end in an error. Further columns are not read. An empty table gives no rows.
    """
    ints = integers(vectors, vec_id, embedding)
    shared = vectors.sparkSession.sparkContext.broadcast(fit_components(ints, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, at, x in _matrices(batch):
                model = shared.value[dim]
                k = len(model.values)
                rows = pa.array(np.repeat(np.arange(len(at)), k))
                white = ((x - model.mean) @ model.turn).ravel()
                blank = np.tile(~model.varies, len(at))
                each = (
                    batch.column("vec_id").take(pa.array(at)).take(rows), pa.array(np.tile(np.arange(1, k + 1), len(at)), pa.int32()), pa.array(np.full(len(at) * k, model.n)),
                    _deviations(x, model).take(rows), pa.array(white, mask=blank), pa.array(np.tile(model.explained, len(at))), pa.array([model.identity_error] * (len(at) * k), pa.float64()),
                )
                yield pa.RecordBatch.from_arrays(list(each), ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    kind = dict(vectors.dtypes)[vec_id]
    return ints.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
