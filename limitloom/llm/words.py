"""Hashes of words and word runs over whole Arrow columns, in numpy.

A word is a run of bytes other than 0x20 and 0x09-0x0D; letters A-Z count as a-z. Its hash is
a polynomial over random byte values modulo 2**64, finished by a mixing step; a run's hash
mixes a weighted sum of its words' hashes.
"""

from __future__ import annotations

import numpy as np

_PIECE = 1 << 18
_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_BASE = int(_rng.integers(1, 2**62, dtype=np.uint64)) * 4 + 3
_WEIGHT = _rng.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(_PIECE.bit_length(), (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        pair = []
        for base in (_BASE % 2**64, pow(_BASE, -1, 2**64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            pair.append(np.cumprod(a, dtype=np.uint64))
        _powers[size] = (pair[0], pair[1])
    return _powers[size]


def _words_of_piece(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~_SPACE[data]
    edge = np.diff(np.r_[False, word, False].view(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _pow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    return mix(h + (end - start).astype(np.uint64)), start, end


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word; works through the bytes a quarter megabyte at a time."""
    found, at = [], 0
    while at < len(data):
        stop = at + _PIECE
        if stop < len(data):
            tail = np.flatnonzero(_SPACE[data[stop : stop + _PIECE]])
            while not len(tail) and stop < len(data):
                stop += _PIECE
                tail = np.flatnonzero(_SPACE[data[stop : stop + _PIECE]])
            stop = stop + int(tail[0]) if len(tail) else len(data)
        h, start, end = _words_of_piece(data[at:stop])
        found.append((h, start + at, end + at))
        at = max(stop, at + 1)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words_by_row(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows that share a buffer, and each row's first word index (one more at the end).

    Rows lie side by side without a gap, so a separator is put between them; byte positions
    are those of the buffer with separators, row ``i`` shifted by ``i``.
    """
    rows = len(ends) - 1
    joined = np.full(len(data) + rows, 0x20, np.uint8)
    keep = np.ones(len(joined), bool)
    keep[ends[1:] + np.arange(rows)] = False
    joined[keep] = data
    h, start, end = word_hashes(joined)
    return h, start, end, np.searchsorted(start, np.r_[ends[:-1] + np.arange(rows), len(joined)])


def run_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total += h[i : i + n] * _WEIGHT[i % 64]
    return mix(total)


def whole_hash(h: np.ndarray) -> np.uint64:
    """Hash of a whole word sequence; unlike that of any run of another length."""
    total = np.uint64(0x9E3779B97F4A7C15) * np.uint64(len(h) + 1)
    for x, w in zip(h, np.resize(_WEIGHT, len(h)), strict=True):
        total = mix(np.array([total + x * w], np.uint64))[0]
    return total


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its ``k``-word runs.

    With fewer words, the whole sequence as one; without words, none.
    """
    with np.errstate(over="ignore"):
        h, _, _, first = words_by_row(data, ends)
        runs = run_hashes(h, k)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(runs[a : b - k + 1]))
            else:
                out.append(np.array([whole_hash(h[a:b])], np.uint64) if b > a else np.zeros(0, np.uint64))
        return out
