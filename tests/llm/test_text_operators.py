"""Operators on training text against brute force, round trips and edge cases."""

import hashlib
import re
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from limitloom.llm import archives, compressors, edits, jaccard, languages, packing, pivots, suffixes, surrogates, templates
from limitloom.llm.components import components
from limitloom.llm.frames import BATCH_BYTES, CHUNK_BYTES
from limitloom.llm.words import _powers, run_hashes, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars int"
BASE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def docs_of(frame, *texts):
    return frame(DOCS, *[(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)])


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefghij"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


# words


def test_word_hashes_follow_the_definition():
    data = "One  two\tone\nTWO été \x0bone".encode()
    h, start, end = word_hashes(np.frombuffer(data, np.uint8))
    assert [data[a:b].decode() for a, b in zip(start, end, strict=True)] == ["One", "two", "one", "TWO", "été", "one"]
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3


def test_run_hashes_tell_runs_apart():
    h = word_hashes(np.frombuffer(b"a b a b b a", np.uint8))[0]
    runs = run_hashes(h, 2)
    assert runs[0] == runs[2] and len(set(runs.tolist())) == 3


# archives


def test_round_trip_gives_one_row_per_page(frame):
    big = "x" * 1500 + "é\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", big), (2, "http://b c/ü", big), (3, None, big), (4, "http://d/", "small"), (5, "http://e/", "small"), (6, "http://f/", None), (None, "x", "")]
    out = archives.round_trip(frame("page_id long, url string, html string, extra string", *[(*r, "e") for r in rows])).collect()
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out}
    assert len(out) == len(rows) and all(r.error is None for r in out)
    for page_id, _, html in rows:
        payload = (html or "").encode()
        kind = "revisit" if page_id in (1, 2) else "response"
        assert got[page_id] == (len(payload), hashlib.sha1(payload).hexdigest(), kind, 3 if kind == "revisit" else None)


def test_empty_pages(frame):
    assert archives.round_trip(frame("page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    about = f"{version} 0 me\n{archives.ARC_FIELDS[version]}\n".encode()
    middle = b"200 - - 0 f.arc " if version == 2 else b""
    head = b"filedesc://f.arc 0.0.0.0 19970923 text/plain " + middle + b"%d\n" % len(about)
    body = b"HTTP/1.0 200 OK\n\nhello\n\n"
    record = b"http://x/a b 1.2.3.4 19970923231500 text/html " + middle + b"%d\n" % len(body) + body + b"\n"
    found = list(archives.arc_records(head + about + b"\n" + record + record))
    assert [f["error"] for f in found] == [None] * 3 and found[1]["url"] == "http://x/a b" and found[1]["block"] == body
    same = archives.equivalent(found[1])
    assert same["kind"] == "response" and same["date"] == "1997-09-23T23:15:00Z" and same["payload_bytes"] == 7
    assert same["record_id"] != archives.equivalent(found[2])["record_id"]
    cut = list(archives.arc_records((head + about + b"\n" + record)[:-10]))
    assert cut[-1]["error"] == "length"


# quality


def test_compression_score_learns_junk(frame):
    good = [prose(i, 60) for i in range(60)]
    bad = [" ".join(w + "%%%" for w in prose(100 + i, 60).split()) for i in range(60)]
    docs = docs_of(frame, *good, *bad, "", None)
    labels = frame("doc_id long, quality int, toxic int", *[(i, int(i < 60), 0) for i in range(120)], (0, 1, 0), (5, 0, 0), (None, 1, 0), (7, None, 0))
    rows = compressors.classify(docs, labels).collect()
    assert len(rows) == 122 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == int(r.doc_id < 60) for r in rows if r.doc_id < 120) >= 114


def test_long_and_repeated_labelled_texts_are_learned_from(frame):
    good = [prose(i, 14_000 if i < 30 else 200) for i in range(60)]
    bad = [" ".join(w + "%%%" for w in prose(100 + i, 200).split()) for i in range(60)]
    rows = [(i, t, "en", "s", 0, 1) for i, t in enumerate(good + bad)]
    docs = frame(DOCS + ", y int", *rows, *rows[:3], (4, "another text of id 4", "en", "s", 0, 1))
    labels = frame("doc_id long, quality int, toxic int", *[(i, int(i < 60), 0) for i in range(120)], *[(7, 1, 0)] * 50)
    model = compressors.train(docs, labels, F.lit(True))
    # the long texts, of 70,000 characters, are half of the good ones
    again = compressors.train(docs.repartition(5), labels, F.lit(True))
    assert (model.good, model.bad, model.weights.tolist()) == (again.good, again.bad, again.weights.tolist())
    got = compressors.score(docs, model).collect()
    assert len(got) == 124 and sum(r.predicted == int(r.doc_id < 60) for r in got) >= 118
    assert compressors.classify(docs.limit(0), labels).count() == 0


def test_scores_without_labels(frame):
    rows = compressors.classify(docs_of(frame, "some text", None), frame("doc_id long, quality int, toxic int")).collect()
    assert [r.score for r in rows] == [0.5, 0.5]


# similarity join


def brute_classes(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and both * 100 >= percent * len(sets[a] | sets[b]) and label[a] < label[b]:
                    label[b], changed = label[a], True
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_similarity_classes_equal_brute_force(frame):
    rng = np.random.default_rng(3)
    texts = ["", None, " \n", "one", "One", "two words", "two  WORDS", "a b c d", "a b c d e"]
    for seed in range(6):
        words = prose(seed, int(rng.integers(20, 120))).split()
        texts.append(" ".join(words))
        for _ in range(8):
            other = list(words)
            for at in rng.integers(0, len(words), int(rng.integers(0, 5))):
                other[at] = "zz" + str(rng.integers(0, 99))
            texts.append(" ".join(other))
    passage = prose(77, 50)
    texts += [f"{prose(200 + i, 12)} {passage}" for i in range(12)] + [passage, passage.upper()]
    for k, percent in ((4, 85), (5, 80)):
        out = jaccard.similarity_classes(docs_of(frame, *texts), k, percent).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_classes(texts, k, percent)


def test_large_groups_of_near_copies_equal_brute_force(frame):
    """Copies that mostly link through their base only, and copies without one that mostly do not link at all."""
    rng = np.random.default_rng(8)
    texts = []
    for seed, base in ((11, True), (12, False)):
        words = prose(seed, 100).split()
        texts += [" ".join(words)] if base else []
        for i in range(150):
            other = list(words)
            for at in rng.integers(0, 100, 1 if base else 2):
                other[at] = f"edit{i}x{at}"
            texts.append(" ".join(other))
    out = jaccard.similarity_classes(docs_of(frame, *texts), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_classes(texts, 4, 85)


def test_sets_with_tokens_of_their_own_and_copies_send_no_prefix(frame, monkeypatch):
    sent, promising = [], jaccard._promising
    monkeypatch.setattr(jaccard, "MOST_COMMON", 0)
    monkeypatch.setattr(jaccard, "_promising", lambda entries, percent: (sent.append(entries.count()), promising(entries, percent))[1])
    texts = [f"{prose(i // 2, 60)} {prose(100 + i, 40)}" for i in range(20)] + [prose(200, 50)] * 3
    out = jaccard.similarity_classes(docs_of(frame, *texts), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_classes(texts, 4, 85)
    assert sent == [0]


@pytest.mark.parametrize("most", [0, 400])
def test_similarity_with_more_tokens_than_a_filter_tells(frame, monkeypatch, most):
    monkeypatch.setattr(jaccard, "MOST_COMMON", most // 4)
    monkeypatch.setattr(jaccard, "MOST_BITS", most, raising=False)
    rng, texts = np.random.default_rng(5), []
    for seed in range(8):
        words = prose(seed, 60).split() + prose(50 + seed // 4, 30).split()
        for i in range(2 + seed):
            other = list(words)
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                other[at] = f"edit{seed}x{i}x{at}"
            texts.append(" ".join(other))
    texts += [texts[5]] * 3
    out = jaccard.similarity_classes(docs_of(frame, *texts), 4, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_classes(texts, 4, 85)


def test_bit_rows_never_undercount_an_overlap():
    rng = np.random.default_rng(3)
    for n, m, shared in ((1, 1, 0), (1, 1, 1), (40, 45, 40), (200, 170, 120), (3000, 90, 90), (5000, 5200, 1000)):
        tokens = np.unique(rng.integers(0, 2**63, n + m, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(tokens)
        a, b = tokens[:n], tokens[n - shared : n - shared + m]
        rows = [np.frombuffer(jaccard._bits(x), np.uint8) for x in (a, b)]
        size = max(map(len, rows))
        union = np.bitwise_or.reduce([jaccard._folded(r, size) for r in rows])
        assert jaccard._lacking(rows[0], rows[0]) == jaccard._lacking(rows[0], union) == jaccard._lacking(rows[1], union) == 0
        common = len(np.intersect1d(a, b))
        assert n - jaccard._lacking(rows[0], rows[1]) >= common <= m - jaccard._lacking(rows[1], rows[0])
    assert n - jaccard._lacking(rows[0], rows[1]) < 0.7 * n


def peak_of(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_words_of_much_text_take_little_memory():
    data = np.frombuffer(" ".join("w" * 60 + str(i % 1000) for i in range(64_000)).encode(), np.uint8)
    _powers.clear()
    (h, start, end), peak = peak_of(lambda: word_hashes(data))
    assert len(h) == 64_000 and len(np.unique(h)) == 1000 and (end - start).min() == 61
    assert peak < 32 << 20


def test_counts_of_common_tokens_are_merged_in_little_memory():
    rng = np.random.default_rng(9)
    parts = [np.unique(rng.integers(0, 1 << 22, 200_000, dtype=np.uint64)) for _ in range(12)] + [np.array([5], np.uint64)]
    counts = [rng.integers(1, 3, len(p)).astype(np.uint32) for p in parts]
    packed = [jaccard._pack(p) for p in parts], [zstandard.compress(n.tobytes()) for n in counts]
    (tokens, sums), peak = peak_of(lambda: jaccard._merged_common(*packed, 2))
    every = np.bincount(np.concatenate(parts).astype(np.int64), np.concatenate(counts))
    assert tokens.tolist() == np.flatnonzero(every >= 2).tolist() and sums.tolist() == every[every >= 2].tolist()
    assert peak < 80 << 20


def test_python_tasks_of_the_similarity_join_get_small_batches(spark, frame, monkeypatch):
    sizes, durable, before = [], jaccard.durable, spark.conf.get(BATCH_BYTES)
    monkeypatch.setattr(jaccard, "durable", lambda df, *label: (sizes.append(spark.conf.get(BATCH_BYTES)), durable(df, *label))[1])
    out = jaccard.similarity_classes(docs_of(frame, prose(1, 30), prose(1, 30), prose(2, 30)), 4, 85)
    assert set(sizes) == {str(CHUNK_BYTES)} and spark.conf.get(BATCH_BYTES) == before
    assert {r.doc_id: r.component_id for r in out.collect()} == {0: 0, 1: 0, 2: 2}


def test_python_tasks_of_the_language_stage_get_small_batches(spark, frame, monkeypatch):
    sizes, durable, before = {}, languages.durable, spark.conf.get(BATCH_BYTES)
    monkeypatch.setattr(languages, "durable", lambda df, label: (sizes.update({label: spark.conf.get(BATCH_BYTES)}), durable(df, label))[1])
    docs = docs_of(frame, prose(1, 30), prose(2, 30))
    assert languages.identify(docs, languages.train(docs)).count() == 2
    assert sizes["languages"] == str(CHUNK_BYTES) and spark.conf.get(BATCH_BYTES) == before


def test_similarity_of_nothing_and_repeated_rows(frame):
    assert jaccard.similarity_classes(docs_of(frame)).count() == 0
    text = prose(1, 30)
    rows = jaccard.similarity_classes(frame(DOCS, (3, text, None, None, 1), (3, text, None, None, 1), (None, text, None, None, 1), (9, text, None, None, 1))).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in rows) == [(-1, 3), (3, 3), (3, 3), (9, 3)]


def test_components_of_a_chain(frame):
    edges = frame("a long, b long", *[(i, i + 1) for i in range(40)], (100, 101), (5, 5))
    got = {r.node: r.label for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


# packing


def test_encoder_equals_the_tokenizer(tokenizer):
    rng = np.random.default_rng(0)
    bits = ["a", " ", "  ", "\n", "'s", "'", " the", "<|endoftext|>", "é", "12", "!!", "\t", "　", " word", "$%"]
    encode = packing.encoder()
    for _ in range(400):
        text = "".join(rng.choice(bits, int(rng.integers(0, 30))))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_remembers_few_pieces_of_any_text(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_ENTRIES", 500)
    encode = packing.encoder()
    encode._known.clear()
    # one text with more pieces than are remembered, then others
    for text in [" ".join(f"the w{i}" for i in range(at, at + n)) for at, n in ((0, 3000), (2900, 400), (0, 50))]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert "the" in encode._known and len(encode._known) <= 500


def test_python_tasks_of_packing_get_small_batches(spark, frame, monkeypatch):
    sizes, durable, before = {}, packing.durable, spark.conf.get(BATCH_BYTES)
    monkeypatch.setattr(packing, "durable", lambda df, label: (sizes.update({label: spark.conf.get(BATCH_BYTES)}), durable(df, label))[1])
    assert packing.pack(docs_of(frame, prose(1, 30), None)).count() == 2
    assert sizes["pieces"] == str(CHUNK_BYTES) and spark.conf.get(BATCH_BYTES) == before


def test_packing_keeps_every_id(frame, tokenizer):
    texts = [prose(i, 40 * i) for i in range(1, 25)] + ["", None, prose(99, 4000)]
    rows = packing.pack(docs_of(frame, *texts)).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert len(own) == 1 or all(r.length == 2048 for r in own[1:])
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert packing.pack(docs_of(frame)).count() == 0


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(5)
    for top in (64, 2048):
        histogram = np.zeros(top + 1, np.int64)
        histogram[1:] = rng.integers(0, 9, top) * (rng.random(top) < 0.3)
        used = np.zeros(top + 1, np.int64)
        for count, content in packing.plan(histogram):
            assert count > 0 and sum(content) <= top
            np.add.at(used, np.array(content), count)
        assert (used == histogram).all()


# passages


def test_repeated_passages_are_found_whole(frame):
    passage = prose(1, 60)
    texts = [f"{prose(2, 33)} {passage} {prose(3, 70)}", f"{prose(4, 90)} {passage.upper()}", prose(5, 200), prose(6, 49), prose(6, 49), "", None]
    rows = suffixes.repeated_passages(docs_of(frame, *texts)).collect()
    assert sorted((r.doc_id, r.first_word, r.n_words) for r in rows) == [(0, 33, 60), (1, 90, 60)]
    assert len({r.passage for r in rows}) == 1
    assert suffixes.repeated_passages(docs_of(frame)).count() == 0


def test_passages_quoted_from_exact_copies_are_found_whole(frame):
    copied = [prose(10 + i, 300) for i in range(4)]
    quotes = [(i, 20 + 31 * j, n) for i in range(4) for j, n in enumerate((50, 50, 51, 52, 53, 54, 71))]
    texts = copied + copied + [f"{prose(100 + k, 20)} {' '.join(copied[i].split()[at : at + n])} {prose(200 + k, 30)}" for k, (i, at, n) in enumerate(quotes)]
    rows = suffixes.repeated_passages(docs_of(frame, *texts)).collect()
    got = sorted((r.doc_id, r.first_word, r.n_words) for r in rows)
    assert got == [(i, 0, 300) for i in range(8)] + [(8 + k, 20, n) for k, (_, _, n) in enumerate(quotes)]


def test_equal_neighbours_across_ranges(frame):
    rows = frame("h long, doc_id long, at int", *[(i // 3, i, 0) for i in range(300)], *[(1000 + i, i, 0) for i in range(50)])
    assert suffixes.with_equal_neighbour(rows).count() == 300


# top k


def test_top_k_equals_brute_force(frame):
    rng = np.random.default_rng(2)
    vectors = [[float(x) for x in rng.normal(size=8).round(2)] for _ in range(300)] + [[0.5] * 8] * 5
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, None), (1000, [1.0, None] + [0.0] * 6), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1200, [1.0, 2.0])]
    out = pivots.search(frame("vec_id long, embedding array<float>", *rows), pivots_query(), 10).collect()
    m = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    for q in (0, 100, 200, 300):
        scores = m @ m[q]
        order = sorted((i for i in range(len(m)) if i != q), key=lambda i: (-scores[i], i))[:10]
        assert [(r.vec_id, r.score) for r in sorted(out, key=lambda r: r.rank) if r.query_id == q] == [(i, int(scores[i])) for i in order]
    assert {r.query_id for r in out} == {0, 100, 200, 300}


def pivots_query():
    from pyspark.sql import functions as F

    return F.col("vec_id") % 100 == 0


# decontamination


def test_templates_catch_other_numbers_and_names(frame):
    items = frame(
        "item_id long, text string, extra int",
        (1, "In the town of Northfield a farmer sells 12 apples and 5 kg of flour to Anna, then Anna gives 12 apples back", 0),
        (2, "tiny item", 0), (3, None, 0), (4, "one two three four five", 0),
    )
    same = "In the town of Northfield a farmer sells 12 apples and 5 kg of flour to Anna, then Anna gives 12 apples back"
    other = "Yes. In the town of Southport a farmer sells 31 apples and 8 pounds of flour to Maria, then Maria gives 31 apples back. End."
    broken = "In the town of Southport a farmer sells 31 apples and 8 pounds of flour to Maria, then Peter gives 77 apples back"
    docs = docs_of(frame, "x " + same, other, broken, prose(1, 300), "", None, "well ONE two, three four five six", "tiny item")
    got = {(r.doc_id, r.item_id): r.verbatim for r in templates.matches(docs, items).collect()}
    assert got == {(0, 1): True, (1, 1): False, (6, 4): True}
    assert templates.matches(docs_of(frame), items).count() == 0 and templates.matches(docs, items.limit(0)).count() == 0


def test_verbatim_copies_are_found_whatever_their_case_and_line_breaks(frame):
    item = "In the town of Northfield a farmer sells 12 apples and 5 kg of flour to Anna, then Anna gives 12 apples back"
    items = frame("item_id long, text string", (1, item), (2, "Which river crosses Vienna"), (3, "the big Town of Northfield has 5 km"))
    copies = [item.lower(), item.upper(), item.replace(" ", "\n"), item.replace("of N", "of\n N").replace("5 kg", "5\t\tkg"), f"so, {item}"]
    short = ["they ask which River crosses vienna today", "a, Which river  crosses\nVienna", "The Big town\nof NORTHFIELD has 5\nkm left"]
    other = "A note. In the town\nof Southport a farmer sells 31 apples and 8\n\npounds of flour to\nMaria, then Maria gives 31 apples back"
    docs = docs_of(frame, *copies, *short, other, prose(1, 100))
    got = {(r.doc_id, r.item_id): (r.found, r.windows, r.verbatim) for r in templates.matches(docs, items).collect()}
    assert got == {**{(i, 1): (16, 16, True) for i in range(5)}, (5, 2): (1, 1, True), (6, 2): (1, 1, True), (7, 3): (1, 1, True), (8, 1): (16, 16, False)}


# personal data


def test_surrogates_keep_type_format_and_identity(frame):
    texts = [
        "Write to Ann.Lee@mail.example.com or ann.lee@mail.example.com now",
        "Call +1 (017) 555-7713, 4111 1111 1111 1111 and 4111111111111111 from 97.51.17.173!",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" NOISE 24BE64439E3E49CF46B2D7C90F3602A3D0B907FF!!',
        "Mrs. Clara Weber met Mr Otto Weber and Госпожа left", "nothing here, 1 2 3, version 4.0.", "", None,
        "ann.lee@mail.example.com again",
    ]
    out = {r.doc_id: r for r in surrogates.replace(docs_of(frame, *texts), "k", count="n").collect()}
    assert [out[i].n for i in range(8)] == [2, 4, 2, 2, 0, 0, 0, 1] and all(out[i].text == texts[i] for i in (4, 5, 6))
    first, second = re.findall(r"\S+@\S+", out[0].text)
    assert first.lower() == second and first != second and first[0].isupper() and second in out[7].text and "ann" not in second
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[1].text)
    assert cards[0].replace(" ", "") == cards[1] != "4111111111111111"
    digits = [int(c) for c in reversed(cards[1])]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    assert re.search(r"Call \+1 \(\d{3}\) \d{3}-\d{4}, ", out[1].text) and "555-7713" not in out[1].text and "97.51.17.173" not in out[1].text
    low, high = re.findall(r"[0-9a-fA-F]{40}", out[2].text)
    assert low.upper() == high and low != high and not low.startswith("24be64")
    names = re.match(r"Mrs\. (\w+) (\w+) met Mr (\w+) (\w+) and", out[3].text).groups()
    assert names[1] == names[3] != "Weber" and names[0].endswith("na") and names[2].endswith("n")


def test_each_pattern_is_found_alone(frame):
    alone = ["8.8.8.8", "1.1.1.1", "a1" * 20, "1a" * 100, "f0" * 300, "555-123-4567", "555.123.4567", "1-555-123-4567", "555 123 4567", "(555) 123-4567", "+49 30 1234567",
             "4111 1111 1111 1111", "123-45-6789", "DE89 3704 0044 0532 0130 00", "a@b.de", "x" * 60 + "@" + ("y" * 60 + ".") * 5 + "com", "Mr Weber"]
    none = ["1.2.3", "555-12-34567", "12-555-123-4567", "555-123.4567", "555-123-4567-8", "a" * 40, "1a" * 15, "version 4.0"]
    texts = [f"see {x} there" for x in alone + none]
    out = {r.doc_id: r for r in surrogates.replace(docs_of(frame, *texts), "k", count="n").collect()}
    assert [out[i].n for i in range(len(texts))] == [1] * len(alone) + [0] * len(none)
    for i, x in enumerate(alone):
        assert x not in out[i].text and out[i].text.startswith("see ") and out[i].text.endswith(" there")
        if x[0] != "M" and x.count(".") != 3:
            assert re.sub(r"[^\W_]", "x", out[i].text) == re.sub(r"[^\W_]", "x", texts[i])
    assert all(out[len(alone) + i].text == texts[len(alone) + i] for i in range(len(none)))


def test_surrogates_stay_distinct(frame):
    rows = docs_of(frame, *[f"({100 + i}) 555-{1000 + i} and 10.0.{i}.1" for i in range(120)])
    out = [r.text for r in surrogates.replace(rows, "k").collect()]
    assert len({t.split(" and ")[0] for t in out}) == len({t.split(" and ")[1] for t in out}) == 120


# language


def test_language_fuses_evidence(frame):
    words = {"en": "the and of with this that from which have been", "de": "der die und das nicht mit sich auf ein über", "fr": "le la les des que dans pour avec une été"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[v].split(), 40)), v, "s" + v, 1) for i, v in enumerate(list(words) * 12)]
    odd = [(50, "123 456 !!", "en", "sen", 1), (51, "", None, None, 0), (52, None, "de", "sde", 0), (53, "und das", "de", "sde", 1), (54, "x", "fr", "sfr", 1)]
    docs = frame(DOCS, *rows, *odd)
    pages = frame("page_id long, url string, html string", (1, "http://h.example.fr/fr/54", '<html lang="fr">x'), (2, "http://h.example.com/x", "<html>"), (3, None, None))
    out = {r.doc_id: r for r in languages.identify(docs, languages.train(docs), languages.page_evidence(pages)).collect()}
    assert len(out) == 41 and all(out[r[0]].lang == r[2] and out[r[0]].keep for r in rows)
    assert all(not out[i].keep and out[i].lang is None for i in (50, 51, 52))
    assert out[53].lang == "de" and out[54].lang == "fr"
    assert languages.identify(docs, languages.train(docs.limit(0))).filter("keep").count() == 0


def test_a_filter_on_told_languages_is_one_condition(frame):
    docs = frame(DOCS, *[(i, f"{v} " * 30, v, "s", 1) for i, v in enumerate(["en", "de", "fr", "es", "it"] * 3)])
    pages = frame("page_id long, url string, html string", (1, "http://h.example.fr/fr/4", '<html lang="fr">x'))
    out = languages.identify(docs, languages.train(docs), languages.page_evidence(pages)).filter("not keep").select("doc_id").distinct()
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 5_000


# edits


def test_trees_follow_edits(frame, tokenizer, monkeypatch):
    monkeypatch.setattr(edits, "LEAF", 8)
    rng = np.random.default_rng(4)
    bits = ["a", " ", "  ", "\n", "'s", " the", "é", "12", "!!", "\t", " word"] + [" some"] * 6
    encode = packing.encoder()
    for _ in range(300):
        text = "".join(rng.choice(bits, int(rng.integers(0, 60))))
        n = len(text)
        own = [(int(rng.integers(-1, n + 3)), int(rng.integers(0, n + 3)), "".join(rng.choice(bits, int(rng.integers(0, 4))))) for _ in range(int(rng.integers(0, 4)))]
        tree = edits.grow(text, lambda s: len(encode(s)) // 4)
        edits.recount(text, tree, own, lambda s: len(encode(s)) // 4)
        new, at = "", 0
        for start, stop, put in edits.clipped(own, n):
            new, at = new + text[at:start] + put, stop
        new += text[at:]
        assert (tree.chars[1], tree.tokens[1]) == (len(new), len(tokenizer.encode(new, add_special_tokens=False).ids))


def test_edited_counts_of_a_table(frame, tokenizer):
    texts = [prose(1, 500), "", None, "short"]
    rows = edits.apply_edits(edits.stored_trees(docs_of(frame, *texts), edits.sample_edits())).collect()
    for r in rows:
        assert r.tokens_before == len(tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
    assert rows[0].chars_encoded < rows[0].chars_after
