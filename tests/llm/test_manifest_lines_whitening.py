"""Merkle manifest, line hash and whitening against brute force, and their edge cases."""

import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from limitloom.llm import linehash, merkle, whitening

DOCS = "doc_id long, text string, lang string, source string, n_chars long, idx int, grp string, digest string, n_lines int, copy long"
EXTRA = (1, "g", "d", 2, 3)


def lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# manifest


def node(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row[0], row[3], row[2], row[4], text)
    return node(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def proofs_of(leaves):
    """Root and, for each leaf, its (place, run) pairs, by plain recursion over levels."""
    level, paths, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for i, a in enumerate(at):
            start = a - a % 8
            paths[i].append((a - start, level[start : start + 8]))
        level = [node(*level[i : i + 8]) for i in range(0, len(level), 8)]
        at = [a // 8 for a in at]
    return level[0], paths


def brute_manifest(rows):
    null_first = lambda v: (v is not None, v if v is not None else 0)
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((null_first(row[0]), leaf_of(row, row[1]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
        subs[g] = proofs_of([x[1] for x in groups[g]])
    root, upper = proofs_of([subs[g][0] for g in order])
    out = []
    for g, up in zip(order, upper, strict=True):
        for (_, leaf, row), path in zip(groups[g], subs[g][1], strict=True):
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            folded = leaf_of(row, lower(row[1])) if changed else leaf
            siblings = ""
            for at, run in path + up:
                siblings += "".join(run[:at] + run[at + 1 :])
                folded = node(*run[:at], folded, *run[at + 1 :])
            out.append((row[0], leaf, subs[g][0], root, node(siblings), folded, folded == root))
    return out


def manifest_of(docs):
    where = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(docs, {"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")}, where)


def manifest_rows(docs):
    out = manifest_of(docs).withColumn("p", F.sha2("proof", 256)).withColumn("v", F.col("folded_root") == F.col("root"))
    return [tuple(r) for r in out.select("key", "leaf", "subroot", "root", "p", "folded_root", "v").collect()]


def test_manifest_equals_plain_recursion(frame):
    rows = [(i, f"Text {i} É\n", "en", f"src{i % 3}", i, *EXTRA) for i in range(600)]
    rows += [(i, "abc" if i % 2 else None, None, None, None, *EXTRA) for i in range(0, 20)]
    rows += [(7, "Same", "de", "s", 4, *EXTRA)] * 9 + [(7, "Other", "de", "s", 5, *EXTRA), (None, "No Id", "de", "s", 5, *EXTRA), (-3, "", "de", "s", 0, *EXTRA)]
    rows += [(5, "Lone", "Ω", "s", 4, *EXTRA), (10**12, "X" * 300_000, "é", None, 300_000, *EXTRA)]
    key = lambda r: tuple(map(str, r))
    assert sorted(manifest_rows(frame(DOCS, *rows)), key=key) == sorted(brute_manifest(rows), key=key)


def test_manifest_with_more_groups_than_a_block(frame):
    rows = [(i, f"T{i}", f"lang{i % 530}", "s", 2, *EXTRA) for i in range(1100)]
    assert sorted(manifest_rows(frame(DOCS, *rows)), key=repr) == sorted(brute_manifest(rows), key=repr)


def test_manifest_of_little(frame):
    assert manifest_rows(frame(DOCS)) == []
    row = (1, "A", "en", "s", 1, *EXTRA)
    ((_, leaf, subroot, root, proof, folded, _),) = manifest_rows(frame(DOCS, row))
    assert leaf == subroot == root == leaf_of(row, "A") and proof == node("")
    assert folded == (leaf_of(row, "a") if zlib.crc32(b"1") % 3 == 0 else leaf)


def test_versions_share_untouched_nodes(frame):
    rows = [(i, f"Text {i}", "en", "s", 5, *EXTRA) for i in range(700)]
    docs = frame(DOCS, *rows)
    change = {"text": F.lower("text")}
    tree = merkle.build(merkle.leaves(docs, change, F.col("doc_id").isin(3, 699)))
    base = {(r.level, r.idx): r.digest for r in merkle.base_nodes(tree).collect()}
    assert len(base) == 700 + 88 + 11 + 2 + 1
    for r in merkle.versions(tree).filter("copies is not null").collect():
        own = {(level, r.idx // 8**level): d for level, d in enumerate(r.copies)}
        assert len(own) == 5 and r.copies[-1] == r.folded_root
        fresh = merkle.build(merkle.leaves(docs.withColumn("text", F.when(F.col("doc_id") == int(r.key), F.lower("text")).otherwise(F.col("text"))), {}, F.lit(False)))
        assert {(x.level, x.idx): x.digest for x in merkle.base_nodes(fresh).collect()} == base | own


# lines


def brute_lines(rows):
    split = [(r[0], (r[1] or "").split("\n")) for r in rows]
    keys = [[lower(line.strip(" \t\n\x0b\x0c\r")) for line in lines] for _, lines in split]
    held = {}
    for (i, _), ks in zip(split, keys, strict=True):
        for k in ks:
            if len(k) >= 20 and i is not None:
                held.setdefault(k, set()).add(i)
    gone = {k: max(ids) for k, ids in held.items() if len(ids) >= 3}
    out = []
    for (i, lines), ks in zip(split, keys, strict=True):
        keep = [line for line, k in zip(lines, ks, strict=True) if not (k in gone and (i is None or i < gone[k]))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out, key=repr)


def lines_of(out):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in out.collect()), key=repr)


def some_lines():
    rng = np.random.default_rng(5)
    common = [f"a line that many documents hold {i}" for i in range(40)] + ["exactly twenty chars", "nineteen characters", "éééééééééééééééééééé", "ééééééééééééééééééé"]
    rows = []
    for i in range(300):
        lines = []
        for _ in range(int(rng.integers(0, 9))):
            line = common[int(rng.integers(len(common)))] if rng.random() < 0.6 else f"own line of document {i} {rng.integers(5)}"
            line = line.upper() if rng.random() < 0.2 else line
            lines.append(["", " \t", "\r", "\x0b\x0c"][int(rng.integers(4))] + line + ["", "\r", " "][int(rng.integers(3))])
        rows.append((i, "\n".join(lines), "en", "s", 0, *EXTRA))
    line = "held by two rows of one id and one more"
    rows += [(1000, line, "en", "s", 0, *EXTRA)] * 2 + [(1001, line, "en", "s", 0, *EXTRA)]
    rows += [(None, common[0] + "\nkept", "en", "s", 0, *EXTRA), (None, None, None, None, None, *EXTRA), (7, None, "en", "s", 0, *EXTRA), (8, "", "en", "s", 0, *EXTRA), (9, "\n\n", "en", "s", 0, *EXTRA)]
    rows += [(2000, "\n".join(f"a very long text, line {i} of it" for i in range(20_000)), "en", "s", 0, *EXTRA)]
    return rows


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
@pytest.mark.parametrize("shard_keys", [1 << 17, 7])
def test_line_dedup_equals_brute_force(frame, broadcast_bytes, shard_keys):
    rows = some_lines()
    docs = frame(DOCS, *rows)
    index = linehash.build_index(docs, shard_keys=shard_keys)
    assert index.keys > 30 and index.shards == -(-index.keys // shard_keys)
    assert lines_of(linehash.drop_lines(docs, index, broadcast_bytes=broadcast_bytes)) == brute_lines(rows)


def test_a_hot_shard_is_copied(frame, monkeypatch):
    monkeypatch.setattr(linehash, "TASK_LOOKUPS", 50)
    rows = [(i, f"the one line that everybody holds\nline {i}", "en", "s", 0, *EXTRA) for i in range(400)]
    docs = frame(DOCS, *rows)
    assert lines_of(linehash.drop_lines(docs, linehash.build_index(docs), broadcast_bytes=0)) == brute_lines(rows)


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_line_dedup_of_nothing(frame, broadcast_bytes):
    empty = frame(DOCS)
    assert linehash.drop_lines(empty, linehash.build_index(empty), broadcast_bytes=broadcast_bytes).count() == 0
    unlike = frame(DOCS, (1, "no line occurs here more than once", "en", "s", 0, *EXTRA), (2, None, "en", "s", 0, *EXTRA))
    assert lines_of(linehash.drop_lines(unlike, linehash.build_index(unlike), broadcast_bytes=broadcast_bytes)) == [(1, 1, 0, "no line occurs here more than once"), (2, 1, 0, "")]


def test_perfect_hash_is_minimal_and_knows_strangers():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(0, 2**64, (2, 5000), dtype=np.uint64)
    hi[:100] = hi[0]  # halves that agree are told apart by the other half
    sizes, bits = linehash.perfect_levels(hi, lo)
    slots = linehash.Shard.of(sizes, bits.tobytes(), b"", b"", b"").slots(hi, lo)
    assert sorted(slots.tolist()) == list(range(5000))
    order = np.argsort(slots)
    shard = linehash.Shard.of(sizes, bits.tobytes(), lo[order].tobytes(), np.full(5000, 3, np.uint32).tobytes(), np.arange(5000)[order].tobytes())
    ok, last = shard.probe(hi, lo, 3)
    assert ok.all() and last.tolist() == list(range(5000))
    assert not shard.probe(hi, lo, 4)[0].any()
    assert not shard.probe(*rng.integers(0, 2**64, (2, 5000), dtype=np.uint64), 3)[0].any()
    assert sum(sizes) < 5 * 5000 and linehash.perfect_levels(hi[:0], lo[:0])[0] == []


# whitening

VECTORS = "vec_id long, embedding array<float>, label int, dim int, x int, n int"


def vectors_of(frame, rows):
    return frame(VECTORS, *[(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, 2, 3) for i, v in rows])


def check_whitening(rows, out, k=4):
    x = {}
    for i, v in rows:
        x.setdefault(i, []).append(np.floor(256 * np.array(v, np.float32).astype(float)).astype(np.int64))
    fit = np.unique(np.concatenate(list(x.values())), axis=0)
    n, total = len(fit), fit.sum(0)
    y = fit - total / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    got = {}
    for r in out:
        assert r.n == n and r.identity_error <= 1e-10 and abs(r.explained - values[r.component - 1] / np.trace(y.T @ y / n)) < 1e-12
        got.setdefault(r.vec_id, []).append((r.component, int(r.deviation), r.whitened))
    signs = np.zeros(k)
    for i, vs in x.items():
        assert len(got[i]) == k * len(vs)
        assert {d for _, d, _ in got[i]} == {int(((n * v - total) ** 2).sum()) for v in vs}
        if len(vs) == 1:
            want = (vs[0] - total / n) @ vectors / np.sqrt(values)
            have = np.array([w for _, _, w in sorted(got[i])])
            signs = np.where(signs == 0, np.sign(have * want), signs)
            assert np.allclose(have, signs * want, atol=1e-9)


def test_whitening_equals_a_dense_solver(frame):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(16) * np.linspace(1, 3, 16)) for i in range(400)]
    hot = rng.standard_normal(16)
    rows += [(500 + i, hot) for i in range(300)] + [(900, rows[0][1]), (900, rows[1][1]), (None, rows[2][1])]
    odd = [(1, None), (2, []), (3, [None] + [1.0] * 15), (4, [float("nan")] * 16), (5, [float("inf")] * 16)]
    out = whitening.whiten(vectors_of(frame, rows + odd)).collect()
    check_whitening(rows, out)


def test_whitening_by_dimension(frame):
    rng = np.random.default_rng(4)
    wide, narrow = [(i, rng.standard_normal(6)) for i in range(50)], [(100 + i, rng.standard_normal(2) * (1, 2)) for i in range(50)]
    out = whitening.whiten(vectors_of(frame, wide + narrow)).collect()
    check_whitening(wide, [r for r in out if r.vec_id < 100])
    check_whitening(narrow, [r for r in out if r.vec_id >= 100], k=2)


def test_whitening_without_variance(frame):
    out = whitening.whiten(vectors_of(frame, [(i, [1.0, 2.0, 3.0]) for i in range(5)])).collect()
    assert len(out) == 15 and {(r.n, int(r.deviation), r.whitened, r.explained, r.identity_error) for r in out} == {(1, 0, None, 0.0, None)}
    out = whitening.whiten(vectors_of(frame, [(i, [float(i), 2.0, 3.0]) for i in range(5)])).collect()
    assert [r.whitened is None for r in sorted(out, key=lambda r: (r.vec_id, r.component))] == [False, True, True] * 5
    assert whitening.whiten(vectors_of(frame, [])).count() == 0 and whitening.whiten(vectors_of(frame, [(1, None)])).count() == 0


def test_deviations_beyond_64_bits(frame):
    rows = [(i, [float(2**30 * (i + 1)), 1.0]) for i in range(40)]
    out = whitening.whiten(frame("vec_id long, embedding array<double>", *rows)).collect()
    x = [(256 * 2**30 * (i + 1)) for i in range(40)]
    assert {(r.vec_id, int(r.deviation)) for r in out} == {(i, (40 * x[i] - sum(x)) ** 2) for i in range(40)}


@pytest.mark.parametrize("spectrum", ["cluster", "spread", "equal", "negative"])
def test_feast_finds_what_inertia_counts(spectrum):
    rng = np.random.default_rng(9)
    d = 40
    values = {"cluster": np.r_[np.full(12, 5.0) + 1e-12 * np.arange(12), np.linspace(0, 1, 28)], "spread": np.geomspace(1e-8, 1e3, d), "equal": np.full(d, 2.0), "negative": np.linspace(-3, 3, d)}[spectrum]
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    a = (q * values) @ q.T
    a = (a + a.T) / 2
    diagonal, side = whitening.tridiagonal(a)
    for shift in (-1.03, 0.5, 1.7, 4.0):
        assert whitening.above(diagonal, side, shift) == (values > shift).sum()
    found = []
    for low, high, count in whitening.top_intervals(a, 4):
        e, v = whitening.feast(a, low, high, count)
        assert len(e) == count and np.abs(v.T @ v - np.eye(count)).max() < 1e-10
        assert np.abs(a @ v - v * e).max() < 1e-11 * np.abs(values).max()
        found.extend(e)
    assert np.allclose(sorted(found, reverse=True)[:4], np.sort(values)[::-1][:4], atol=1e-10 * np.abs(values).max())
