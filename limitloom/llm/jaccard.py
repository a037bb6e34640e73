"""Exact similarity join of documents by word shingles, with a token-group matrix.

Documents with equal shingle sets are one class. Sets similar enough share a token of their prefixes, in an order that
puts tokens common in the corpus last; classes without such a token are done. The others are put into groups of similar
documents, each with the classes that have the same most shared prefix token, cut into parts of a few dozen classes. The
matrix stores the union of each part's tokens, and every class as places in that union. Two parts meet if they share a
prefix token: a bit row of each union first bounds how much any member can have in common with the other part, then the
unions themselves do, and only members that may still be similar are opened and counted exactly. Parts are held against
themselves and their neighbour first, which joins groups of copies; parts that are wholly one component by then need not meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitloom.llm.components import components
from limitloom.llm.frames import bloom_filter, buffer_of, chunks, durable, in_bloom, merged_counts, small_batches, texts
from limitloom.llm.words import shingle_sets

# Tokens of one flush of a counting task; tokens per reducer; classes and tokens of a part (a longer set is a part of
# its own or nearly); documents that make a token common; common tokens that are broadcast at most, as they are and as bits.
FLUSH, PER_BUCKET, MEMBERS, PART_TOKENS, COMMON, MOST_COMMON, MOST_BITS = 1_000_000, 2_500_000, 64, 1 << 16, 2, 1_000_000, 16_000_000
# Ratio of the ends of a band of set sizes; columns of a union that are multiplied at once; bytes of text whose sets, and counted
# tokens whose counts, a task makes at once.
BAND, COLUMNS, TEXT_BYTES, MERGED = 1.04, 1 << 14, 1 << 20, 1 << 18


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for part in chunks(batch, limit=TEXT_BYTES):
        yield part, shingle_sets(*buffer_of(part.column(1)), k)


def _key(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=12).digest()


def _pack(values: np.ndarray) -> bytes:
    """Sorted integers as zstandard-compressed byte planes of their differences."""
    planes = np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _width(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def _bits(tokens: np.ndarray) -> bytes:
    """A bit row of two to four bits a token (64 at least); a token's place is a residue, so rows fold to smaller widths."""
    width = _width(len(tokens))
    row = np.zeros(width, np.uint8)
    row[((tokens >> np.uint64(24)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(row).tobytes()


def _folded(row: np.ndarray, size: int) -> np.ndarray:
    """The row at ``size`` bytes: folded by OR, or repeated if it was narrower (a superset then)."""
    return np.bitwise_or.reduce(row.reshape(-1, size)) if len(row) >= size else np.tile(row, size // len(row))


def _lacking(q: np.ndarray, u: np.ndarray) -> int:
    """How many tokens of ``q`` are surely not in ``u``: its bits that ``u`` lacks."""
    size = min(len(q), len(u))
    return int(np.bitwise_count(_folded(q, size) & ~_folded(u, size)).sum())


def signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size) and key of the set (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, sets in _sets(batch, k):
                keys = [_key(t) if len(t) else None for t in sets]
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "n": pa.array([len(t) for t in sets], pa.int32()), "key": pa.array(keys, pa.binary())})

    return texts(docs).mapInArrow(run, "doc_id long, n int, key binary")


def without_copies(docs: DataFrame, classes: DataFrame) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    """What leaves the rows of a batch (doc_id, text) that may be a class's smallest doc_id; ``classes`` is stored.

    Rows without an id stay. The bounded filter may let further copies through, never a class's only row.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(classes.filter("least is not null"), F.col("least"), classes.count()))

    def few(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0)
        return batch.filter(pa.array(in_bloom(bits.value, ids.fill_null(0).to_numpy()) | ids.is_null().to_numpy(zero_copy_only=False)))

    return few


def _bucket_starts(buckets: int, bits: int) -> np.ndarray:
    return (np.arange(1, buckets, dtype=object) * (1 << bits) // buckets).astype(np.uint64)


def _merged_common(tokens: list[bytes], counts: list[bytes], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens counted ``least`` times in all, of packed sorted tokens and their counts, some ``MERGED`` at a time.

    Tokens are hashes, so ranges of equal width hold about equally many.
    """
    unpack = zstandard.ZstdDecompressor()
    parts = [(_unpack(t), np.frombuffer(unpack.decompress(c), np.uint32)) for t, c in zip(tokens, counts, strict=True)]
    low, high = min(int(t[0]) for t, _ in parts), max(int(t[-1]) for t, _ in parts) + 1
    ranges = -(-sum(len(t) for t, _ in parts) // MERGED)
    edges = [low + (high - low) * i // ranges for i in range(1, ranges)]
    cuts = [np.r_[0, np.searchsorted(t, np.array(edges, np.uint64)), len(t)].tolist() for t, _ in parts]
    kept = []
    for i in range(ranges):
        values, sums = merged_counts([(t[c[i] : c[i + 1]], n[c[i] : c[i + 1]].astype(np.int64)) for (t, n), c in zip(parts, cuts, strict=True)])
        kept.append((values[sums >= least], sums[sums >= least]))
    return np.concatenate([v for v, _ in kept]), np.concatenate([n for _, n in kept])


def common_tokens(docs: DataFrame, k: int, bits: int, buckets: int, few: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """(token, df) of tokens, by their leading ``bits``, in at least ``COMMON`` documents; counted over all that ``few`` leaves."""
    shift = np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, held, size = _bucket_starts(buckets, bits), [], 0

        def flush() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            held.clear()
            tokens >>= shift
            tokens.sort()
            first = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
            tokens, counts = tokens[first], np.diff(first, append=len(tokens))
            cut = np.r_[0, np.searchsorted(tokens, starts), len(tokens)]
            spans = [(i, a, b) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            squeeze = zstandard.ZstdCompressor(level=1)
            return pa.RecordBatch.from_pydict({
                "bucket": pa.array([i for i, _, _ in spans], pa.int32()), "tokens": pa.array([_pack(tokens[a:b]) for _, a, b in spans], pa.binary()),
                "counts": pa.array([squeeze.compress(counts[a:b].astype(np.uint32).tobytes()) for _, a, b in spans], pa.binary()),
            })

        for batch in batches:
            for _, sets in _sets(few(batch), k):
                held += sets
                size += sum(map(len, sets))
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        tokens, counts = _merged_common(rows.tokens, rows.counts, COMMON)
        return pd.DataFrame({"token": tokens.view(np.int64), "df": counts})

    blobs = texts(docs).mapInArrow(count, "bucket int, tokens binary, counts binary")
    return blobs.groupBy("bucket").applyInPandas(merge, "token long, df long")


def _log_count() -> Column:
    return F.floor(F.log2("df")).cast("int")


def _least_count(sizes: dict[int, int], most: int) -> int:
    """The lowest class of counts (by log2) from which on all classes together hold ``most`` tokens at most."""
    least, total = 64, 0
    for c in sorted(sizes, reverse=True):
        total += sizes[c]
        if total > most:
            break
        least = c
    return least


def common_order(common: DataFrame, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their counts: the classes of counts from the highest on that hold a million tokens at most."""
    rows = common.filter(_log_count() >= _least_count(sizes, MOST_COMMON)).select("token", "df").toArrow()
    tokens = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column("df").to_numpy()[order]


def prefix_entries(docs: DataFrame, k: int, percent: int, common: DataFrame, bits: int, few: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """(token, key, n) of the prefix tokens that sets of at least two classes have; ``common`` is stored.

    A bounded Bloom filter of the tokens in several documents spares the others the shuffle; the count behind it is exact.
    It also orders: tokens of one document come first, then those of several, then the common ones by their counts. So a set
    with enough tokens of its own has none to send, however many of the rest are shared. Where the tokens in several documents
    are too many for the filter to tell, another one of those in the most documents orders.
    """
    sc = docs.sparkSession.sparkContext
    sizes = {c: n for c, n in common.groupBy(_log_count().alias("c")).count().collect()}
    rarest, total = min(sizes, default=64), sum(sizes.values())
    several, least = bloom_filter(common, F.col("token"), 4 * total), _least_count(sizes, MOST_BITS)
    later = None if least <= rarest else bloom_filter(common.filter(_log_count() >= least), F.col("token"), 4 * sum(n for c, n in sizes.items() if c >= least))
    shared = sc.broadcast((*common_order(common, sizes), several, later))
    shift = np.uint64(64 - bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank, several, later = shared.value
        seen = set()
        for batch in batches:
            for _, sets in _sets(few(batch), k):
                held, keys, sizes = [], [], []
                for tokens in sets:
                    if not len(tokens) or (key := _key(tokens)) in seen:
                        continue
                    seen.add(key)
                    take, n = len(tokens) + (-percent * len(tokens)) // 100 + 1, len(tokens)
                    cut = tokens >> shift
                    sent = in_bloom(several, cut)
                    place = (sent if later is None else in_bloom(later, cut)).astype(np.int64)
                    if len(common):
                        at = np.minimum(np.searchsorted(common, cut), len(common) - 1)
                        place = np.where(common[at] == cut, rank[at], place)
                    first = np.argsort(place, kind="stable")[:take]
                    tokens = tokens[first[sent[first]]]
                    held.append(tokens)
                    keys += [key] * len(tokens)
                    sizes += [n] * len(tokens)
                tokens = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_pydict({"token": pa.array(tokens), "key": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int32())})

    entries = durable(texts(docs).mapInArrow(emit, "token long, key binary, n int").distinct(), "prefixes")
    return durable(_promising(entries, percent), "entries")


def _promising(entries: DataFrame, percent: int) -> DataFrame:
    """The entries whose token and class may be part of a link, with c, the classes that have the token; ``entries`` is stored.

    Of two similar sets the one whose prefix ends first in the order has all but ``percent`` of its size of the shared
    tokens in both prefixes. So a class must share more prefix tokens than the bound below with classes of one band of
    sizes; the bound is least at the ends of the sizes met there. A class meets a band once a token, never its classes.
    """
    banded = entries.withColumn("band", F.floor(F.log("n") / math.log(BAND)).cast("int"))
    sides = banded.groupBy("token", F.col("band").alias("other")).agg(F.count("*").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    fit = (F.col("low") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("high") * 100) & ((F.col("other") != F.col("band")) | (F.col("c") > 1))
    met = banded.join(sides, "token").filter(fit).groupBy("key", "n", "other").agg(F.count("*").alias("met"), F.min("low").alias("low"), F.max("high").alias("high"))
    beyond = lambda m: percent * (F.col("n") + m) / (100 + percent) - percent * F.greatest("n", m) / 100
    fewest, most = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / 100)), F.least(F.col("high"), F.floor(F.col("n") * 100 / percent))
    enough = met.filter(F.col("met") > F.least(beyond(fewest), beyond(most)) - 1e-6).select("key").distinct()
    left = durable(entries.join(durable(enough, "promising"), "key", "left_semi"), "promising-entries")
    return left.join(left.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"), "token")


def placed_in_parts(entries: DataFrame) -> DataFrame:
    """(key, n, g, p, parts): each class beside those with the same most shared prefix token, and its part of that group."""
    homes = entries.groupBy("key").agg(F.max("n").alias("n"), F.max(F.struct("c", "token")).alias("most")).select("key", "n", F.col("most.token").alias("g"))
    homes = durable(homes, "homes")
    parts = F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum("n") / PART_TOKENS))
    sizes = homes.groupBy("g").agg(parts.alias("parts"))
    return homes.join(sizes, "g").select("key", "n", "g", F.pmod(F.xxhash64("key"), "parts").alias("p"), "parts")


def token_sets(docs: DataFrame, k: int, members: DataFrame) -> DataFrame:
    """(key, g, p, parts, tokens) of the classes ``members`` (stored, with the class's smallest doc_id), eight bytes a token.

    A bounded Bloom filter of key and doc_id keeps the scan from emitting sets that nobody needs, and those of further copies;
    the join behind it is exact. Most classes are no members, so the filter has some 256 bits a member as long as they fit.
    """
    hashed = F.conv(F.hex(F.substring("key", 1, 7)), 16, 10).cast("long").bitwiseXOR(F.coalesce("least", F.lit(-1)))
    bits = docs.sparkSession.sparkContext.broadcast(bloom_filter(members, hashed, 16 * members.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for part, sets in _sets(batch, k):
                keys, out = [], []
                for i, t in zip(part.column(0).to_pylist(), sets, strict=True):
                    if not len(t) or (key := _key(t)) in seen:
                        continue
                    if in_bloom(bits.value, np.array([int.from_bytes(key[:7], "big") ^ (-1 if i is None else i)], np.int64))[0]:
                        seen.add(key)
                        keys.append(key)
                        out.append(t.tobytes())
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "tokens": pa.array(out, pa.binary())})

    found = texts(docs).mapInArrow(run, "key binary, tokens binary")
    return found.join(members.select("key", "g", "p", "parts"), "key").groupBy("key", "g", "p", "parts").agg(F.first("tokens").alias("tokens"))


MATRIX = "g long, p long, parts long, keys binary, sizes binary, union binary, places binary, u binary, rows binary"


def token_group_matrix(sets: DataFrame) -> DataFrame:
    """A row per part: its keys and set sizes, the union of its tokens, every set as places in it, and the bit rows of union and sets.

    A part has ``MEMBERS`` classes and ``PART_TOKENS`` tokens or little more, so a row is bounded but for a single very long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = sorted(batch.column(3)[i].as_py(), key=lambda r: r["key"])
                sets = [np.frombuffer(r["tokens"], np.uint64) for r in rows]
                union, places = np.unique(np.concatenate(sets), return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    **{name: batch.column(j).slice(i, 1) for j, name in enumerate(("g", "p", "parts"))},
                    "keys": pa.array([b"".join(r["key"] for r in rows)], pa.binary()), "sizes": pa.array([np.array([len(t) for t in sets], np.uint32).tobytes()], pa.binary()),
                    "union": pa.array([union.tobytes()], pa.binary()), "places": pa.array([places.astype(np.uint32).tobytes()], pa.binary()),
                    "u": pa.array([_bits(union)], pa.binary()), "rows": pa.array([b"".join(map(_bits, sets))], pa.binary()),
                })

    return sets.groupBy("g", "p", "parts").agg(F.collect_list(F.struct("key", "tokens")).alias("sets")).mapInArrow(run, MATRIX)


def _may_meet(left: dict, right: dict, percent: int) -> bool:
    """Whether, by bit rows, a set of each part may have enough tokens in the other part's union."""
    for own, other in ((left, right), (right, left)):
        u, at, any_ = np.frombuffer(other["u"], np.uint8), 0, False
        for n in np.frombuffer(own["sizes"], np.uint32).tolist():
            width = _width(n) // 8
            if not any_:
                any_ = 100 * (n - _lacking(np.frombuffer(own["rows"], np.uint8, width, at), u)) >= percent * n
            at += width
        if not any_:
            return False
    return True


def _overlaps(own: dict, columns: np.ndarray, total: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Members that have enough tokens among the shared columns of the union, their sizes, and where their places lie."""
    n = np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
    to = np.full(len(own["union"]) // 8, -1, np.int64)
    to[columns] = np.arange(total)
    at = to[np.frombuffer(own["places"], np.uint32)]
    member = np.repeat(np.arange(len(n)), n)[at >= 0]
    at = at[at >= 0]
    open_ = np.flatnonzero(100 * np.bincount(member, minlength=len(n)) >= percent * n)
    row = np.full(len(n), -1, np.int64)
    row[open_] = np.arange(len(open_))
    keep = row[member] >= 0
    return open_, n[open_], row[member][keep], at[keep]


def _part_links(left: dict, right: dict, percent: int) -> list[tuple[bytes, bytes]]:
    """Links between the sets of two parts (or of one part, given twice), as many as connect what their links connect."""
    a, b = np.frombuffer(left["union"], np.uint64), np.frombuffer(right["union"], np.uint64)
    _, in_a, in_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    x, y = _overlaps(left, in_a, len(in_a), percent), _overlaps(right, in_b, len(in_a), percent)
    if not len(x[0]) or not len(y[0]):
        return []
    both = np.zeros((len(x[0]), len(y[0])), np.int64)
    for start in range(0, len(in_a), COLUMNS):
        sides = []
        for open_, _, member, at in (x, y):
            here = (at >= start) & (at < start + COLUMNS)
            side = np.zeros((len(open_), min(COLUMNS, len(in_a) - start)), np.float32)
            side[member[here], at[here] - start] = 1
            sides.append(side)
        both += (sides[0] @ sides[1].T).astype(np.int64)
    near = 100 * both >= percent * (x[1][:, None] + y[1][None, :] - both)
    keys = [[side["keys"][12 * i : 12 * i + 12] for i in open_.tolist()] for side, open_ in ((left, x[0]), (right, y[0]))]
    top = {key: key for side in keys for key in side}

    def root(key: bytes) -> bytes:
        while top[key] != key:
            top[key] = key = top[top[key]]
        return key

    out = []
    for i, j in np.argwhere(near).tolist():
        p, q = root(keys[0][i]), root(keys[1][j])
        if p != q:
            top[p] = q
            out.append((keys[0][i], keys[1][j]))
    return out


def links_within(matrix: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [link for row in _dicts(batch) if len(row["keys"]) > 12 for link in _part_links(row, row, percent)]
            yield _link_batch(links)

    return matrix.select("keys", "sizes", "union", "places").mapInArrow(run, "a binary, b binary")


def links_between(pairs: DataFrame, matrix: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the parts (g, p) and (h, q) of ``pairs``; sets travel only for parts whose bit rows let them."""

    def side(names: list[str], right: bool) -> DataFrame:
        keys = {"g": "h", "p": "q"} if right else {"g": "g", "p": "p"}
        return matrix.select(*[F.col(x).alias(y) for x, y in keys.items()], F.struct(*names).alias("right" if right else "left"))

    def both(pairs: DataFrame, names: list[str]) -> DataFrame:
        return pairs.join(side(names, False), ["g", "p"]).join(side(names, True), ["h", "q"]).select("g", "p", "h", "q", "left", "right")

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_may_meet(row["left"], row["right"], percent) for row in _dicts(batch)]
            yield batch.select(["g", "p", "h", "q"]).filter(pa.array(keep, pa.bool_()))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _link_batch([link for row in _dicts(batch) for link in _part_links(row["left"], row["right"], percent)])

    enough = durable(both(pairs, ["sizes", "u", "rows"]).mapInArrow(bounded, "g long, p long, h long, q long"), "qualifying")
    return both(enough, ["keys", "sizes", "union", "places"]).mapInArrow(opened, "a binary, b binary")


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows one by one, so that one pair of parts at a time is held as Python objects."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _link_batch(links: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.binary()), "b": pa.array([b for _, b in links], pa.binary())})


def apart(entries: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of parts that share a prefix token, hold sets of fitting sizes and are not of one component, each once.

    A part is compared with itself and its neighbour before, so those pairs are left out.
    """
    home = members.join(labels.select(F.col("node").alias("key"), "label"), "key", "left").select("key", "g", "p", F.coalesce("label", "key").alias("comp"))
    rows = entries.select("token", "key", "n").join(durable(home, "components"), "key")
    rows = rows.groupBy("token", "g", "p").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    rows = durable(rows, "part-tokens")
    several = rows.groupBy("token").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("c")).filter("c > 1 and first <> last")
    rows = rows.join(several.select("token"), "token", "left_semi")
    other = rows.select("token", *[F.col(x).alias(y) for x, y in (("g", "h"), ("p", "q"), ("low", "low2"), ("high", "high2"), ("first", "first2"), ("last", "last2"))])
    after = (F.col("g") < F.col("h")) | ((F.col("g") == F.col("h")) & (F.col("q") > F.col("p") + 1))
    sizes = (F.col("low") * percent <= F.col("high2") * 100) & (F.col("low2") * percent <= F.col("high") * 100)
    one = (F.col("first") == F.col("last")) & (F.col("first2") == F.col("last2")) & (F.col("first") == F.col("first2"))
    return rows.join(other, (rows.token == other.token) & after & sizes & ~one).select("g", "p", "h", "q").distinct()


def similarity_classes(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row: links join sets of ``percent`` Jaccard similarity or more.

    ``component_id`` is the smallest doc_id reachable. Null, empty and word-less texts have no shingles and link with
    nothing (component_id is their own id); so do rows with a null id, whose set still links others.
    Repeated rows have the same set and therefore the same class.
    """
    with small_batches(docs.sparkSession):
        return _classes(docs, k, percent)


def _classes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``similarity_classes``; all its Python tasks have run when it returns."""
    rows = durable(signed(docs, k), "sets")
    classes = durable(rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")), "classes")
    words = max(1, rows.agg(F.sum("n")).first()[0] or 1)
    bits, buckets = max(32, 9 + math.ceil(math.log2(words))), max(16, -(-words // PER_BUCKET))

    few = without_copies(docs, classes)
    common = durable(common_tokens(docs, k, bits, buckets, few), "common")
    entries = prefix_entries(docs, k, percent, common, bits, few)
    members = durable(placed_in_parts(entries).join(classes, "key"), "members")
    matrix = durable(token_group_matrix(token_sets(docs, k, members)), "token-group-matrix")

    beside = matrix.filter("p + 1 < parts").select("g", "p", F.col("g").alias("h"), (F.col("p") + 1).alias("q"))
    near = durable(links_within(matrix, percent).union(links_between(beside, matrix, percent)), "near")
    pairs = durable(apart(entries, members, components(near), percent), "pairs")
    labels = components(near.union(durable(links_between(pairs, matrix, percent), "links")))

    placed = classes.join(labels, classes.key == labels.node, "left").select("key", "least", F.coalesce("label", "key").alias("comp"))
    smallest = placed.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = durable(placed.join(smallest, "comp").select("key", "component_id"), "named")
    own = rows.filter("key is null").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.filter("key is not null").join(named, "key").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(own)
